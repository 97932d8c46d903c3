"""Vector codes: product quantisation whose codebooks are fitted by ball k-means.

A vector becomes whole numbers and is cut into parts; each part position has a
codebook, and a part is coded as its nearest entry.  All comparisons are made in
whole numbers, so results do not depend on how the rows are partitioned.

Ball k-means.  A part lies in the ball of its entry.  With ``own`` the distance of
a part to the centre of its ball, an entry farther than ``2 * own`` from that centre
cannot be nearer to the part (triangle inequality).  Hence

* the ball's radius (its farthest member) defines its neighbour entries;
* members nearer to the centre than half the way to the closest other entry form
  the stable core and need no distance at all;
* the others are taken in annular rings of growing ``own``; a ring is compared with
  the neighbours that its outermost member can reach, and no others.

This holds for any ball, so the ball that a part had when the table of parts was
written serves all later rounds: the vectors are written once, as whole numbers,
and each round is one pass that sends at most parts x entries rows per task.  The
codebooks (parts x entries x width / parts numbers) are the only broadcast.

Defined results: rows whose vector is null, or holds a null or non-finite component,
are dropped.  Null ids are coded, but start no entry.  The width is that of the
smallest id's vector and is filled up with zeros to a multiple of ``parts``.  Vectors
of another width, or with a component beyond 2^24 / ``scale``, stay with null code
and error.  Rows with equal ids are all coded; of those the smaller vector starts an
entry first.  With fewer vectors than entries the codebook is shorter.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from measurelens.llm.texts import name_of, share
from measurelens.operators.common import settle

SCALE = 1024
LIMIT = 1 << 24  # whole numbers beyond this have no code: squared distances stay below 2^63
CHUNK = 16_384  # rows whose balls are formed together
RING = 128  # members of an annular ring, unless fewer are left
LABELS = 100_000  # most labels whose sums are broadcast (8 bytes and a label each); more go by a salted join
SALTS = 64


@dataclass
class Fit:
    width: int
    codebooks: list[np.ndarray]  # per part position: entries x width of a part


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to all rows of ``b``, exact; floats are used only where they are exact."""
    top = int(max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)))
    kind = np.float64 if 4 * top * top * max(1, a.shape[1]) < 1 << 52 else np.int64
    x, y = a.astype(kind), b.astype(kind)
    out = (x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)[None, :]
    return out.astype(np.int64)


class Balls:
    """The entries of one part position, each with the others in order of distance."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        gaps = squared(entries, entries)
        self.order = np.argsort(gaps, axis=1, kind="stable")
        self.gaps = np.take_along_axis(gaps, self.order, axis=1)

    def assign(self, parts: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(nearest entry, squared distance) of parts that lie in the balls ``home``; ties go to the lower entry."""
        off = parts - self.entries[home]
        own = (off * off).sum(1)
        code, best = home.copy(), own.copy()
        by_ball = np.lexsort((own, home))
        starts = np.concatenate(([0], np.flatnonzero(np.diff(home[by_ball])) + 1, [len(by_ball)]))
        for a, b in zip(starts[:-1], starts[1:]):
            if a == b:
                continue
            members = by_ball[a:b]
            ball = home[members[0]]
            # entries within twice the distance of each member; the last one is the ball's radius
            reach = np.searchsorted(self.gaps[ball], 4 * own[members], "right")
            core = int(np.searchsorted(reach, 1, "right"))
            for first in range(core, len(members), RING):
                ring = members[first : first + RING]
                rivals = np.sort(self.order[ball, : reach[min(first + RING, len(members)) - 1]])
                away = squared(parts[ring], self.entries[rivals])
                at = away.argmin(1)
                code[ring] = rivals[at]
                best[ring] = away[np.arange(len(ring)), at]
        return code, best


def floors(col: pa.Array, width: int, parts: int, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whole numbers of the coded rows, rows that are kept, which of them are coded) of a list column."""
    length = pc.list_value_length(col).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = col.flatten()
    values = pc.cast(flat, pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(length)), np.maximum(length, 0))
    bad = np.bincount(row[~np.isfinite(values)], minlength=len(length)) > 0
    kept = (length >= 0) & ~bad
    whole = np.floor(np.where(np.isfinite(values), values, 0.0) * scale)
    large = np.bincount(row[np.abs(whole) > LIMIT], minlength=len(length)) > 0
    coded = kept & ~large & (length == width)
    out = np.zeros((int(coded.sum()), -(-width // parts) * parts), np.int64)
    out[:, :width] = whole[coded[row]].reshape(-1, width)
    return out, np.flatnonzero(kept), coded[kept]


def usable(vector):
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & fine


def _first_entries(rows: DataFrame, parts: int, entries: int, scale: int) -> Fit | None:
    """The vectors of the smallest ids; the sort keeps ``entries`` rows per task."""
    rows = rows.where(F.col("_id").isNotNull() & usable(F.col("_v")))
    pick = lambda d: [r[0] for r in d.orderBy("_id", "_v").select("_v").limit(entries).collect()]
    found = pick(rows)
    if not found:
        return None
    width = len(found[0])
    inside = F.forall("_v", lambda x: F.abs(F.floor(x * scale)) <= LIMIT)
    if any(len(v) != width or any(abs(x) * scale > LIMIT - 1 for x in v) for v in found):
        found = pick(rows.where((F.size("_v") == width) & inside))
    whole, _, coded = floors(pa.array(found, pa.list_(pa.float64())), width, parts, scale)
    return Fit(width, np.split(whole, parts, axis=1)) if len(coded) and coded.all() else None


def _list(x: np.ndarray) -> pa.Array:
    """A list<int> array of the rows of a matrix."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.reshape(-1).astype(np.int32)))


def _matrix(col: pa.Array) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(col), -1) if len(col) else flat.reshape(0, 0)


class Coder:
    """Assigns matrices of whole numbers part by part."""

    def __init__(self, fit: Fit):
        self.balls = [Balls(c) for c in fit.codebooks]

    def __call__(self, whole: np.ndarray, home: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(codes, errors); without balls, every part starts in the ball of entry 0."""
        codes = np.zeros((len(whole), len(self.balls)), np.int64)
        error = np.zeros(len(whole), np.int64)
        for first in range(0, len(whole), CHUNK):
            rows = slice(first, first + CHUNK)
            for k, (ball, part) in enumerate(zip(self.balls, np.split(whole[rows], len(self.balls), axis=1))):
                start = np.zeros(len(part), np.int64) if home is None else home[rows, k]
                codes[rows, k], best = ball.assign(part, start)
                error[rows] += best
        return codes, error


def _parts_table(rows: DataFrame, fit: Fit, parts: int, scale: int) -> DataFrame:
    """(_id, _label, whole, home): the coded rows as whole numbers with their first balls, the others with nulls."""
    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType([rows.schema["_id"], rows.schema["_label"], T.StructField("whole", ints), T.StructField("home", ints)])
    names, shared = schema.fieldNames(), share(rows.sparkSession, fit)

    def run(batches):
        fit = shared()
        coder = Coder(fit)
        for batch in batches:
            whole, kept, coded = floors(batch.column(2), fit.width, parts, scale)
            home, _ = coder(whole, None)
            # rows that are kept without a code take nulls
            at = pa.array(np.where(coded, np.cumsum(coded) - 1, 0), pa.int64(), mask=~coded)
            ids = batch.select([0, 1]).take(pa.array(kept))
            yield pa.RecordBatch.from_arrays([*ids.columns, _list(whole).take(at), _list(home).take(at)], names)

    return settle(rows.mapInArrow(run, schema))


def _moved(table: DataFrame, fit: Fit, assign: bool) -> Fit:
    """The codebooks after one round: every used entry becomes the floor of the mean of its parts."""
    spark, parts = table.sparkSession, len(fit.codebooks)
    shared, wide = share(spark, fit), fit.codebooks[0].shape[1]

    def run(batches):
        fit = shared()
        coder = Coder(fit) if assign else None
        k = len(fit.codebooks[0])
        sums, n = np.zeros((parts, k, wide), np.int64), np.zeros((parts, k), np.int64)
        for batch in batches:
            whole, codes = _matrix(batch.column(0)), _matrix(batch.column(1))
            if not len(whole):
                continue
            if coder:
                codes, _ = coder(whole, codes)
            for p, part in enumerate(np.split(whole, parts, axis=1)):
                n[p] += np.bincount(codes[:, p], minlength=k)
                order = np.argsort(codes[:, p], kind="stable")
                entry, first = np.unique(codes[order, p], return_index=True)
                if wide:
                    sums[p, entry] += np.add.reduceat(part[order], first, axis=0)
        part, entry = np.nonzero(n)
        if len(part):
            flat = sums[part, entry]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * wide, pa.int32()), pa.array(flat.reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry]), lists], ["part", "entry", "n", "sums"])

    some = table.where("whole is not null").select("whole", "home").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    total = some.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(wide)]).alias("sums"))
    new = [c.copy() for c in fit.codebooks]
    for r in total.collect():  # at most parts x entries rows
        new[r.part][r.entry] = [s // r.n for s in r.sums]
    return Fit(fit.width, new)


def digest(fit: Fit | None) -> str:
    """SHA-256 over all components, by part, entry and position."""
    flat = [] if fit is None else [str(x) for c in fit.codebooks for x in c.reshape(-1).tolist()]
    return hashlib.sha256(",".join(flat).encode()).hexdigest()


def compress(df: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = SCALE) -> tuple[DataFrame, Fit | None]:
    """(rows of key, label, ``code`` and ``error``, the fitted codebooks).

    The code has two hex digits per part.  Columns are named ``_id`` and ``_label``.
    """
    if not 1 <= entries <= 256 or parts < 1 or rounds < 1:
        raise ValueError("need 1 to 256 entries, at least one part and one round")
    rows = df.select(name_of(key).alias("_id"), name_of(label).alias("_label"), name_of(vector).cast("array<double>").alias("_v"))
    fit = _first_entries(rows, parts, entries, scale)
    if fit is None:
        return rows.where(usable(F.col("_v"))).select("_id", "_label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")), None
    table = _parts_table(rows, fit, parts, scale)
    for turn in range(rounds):
        fit = _moved(table, fit, turn > 0)
    shared = share(df.sparkSession, fit)
    schema = T.StructType([table.schema["_id"], table.schema["_label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    names = schema.fieldNames()

    def run(batches):
        coder = Coder(shared())
        for batch in batches:
            coded = np.asarray(batch.column(2).is_valid())
            some = batch.filter(pa.array(coded))
            codes, error = coder(_matrix(some.column(2)), _matrix(some.column(3))) if len(some) else (np.zeros((0, parts), np.int64), np.zeros(0, np.int64))
            text, w = codes.astype(np.uint8).tobytes().hex(), 2 * parts
            at = pa.array(np.where(coded, np.cumsum(coded) - 1, 0), pa.int64(), mask=~coded)
            code = pa.array([text[i * w : (i + 1) * w] for i in range(len(some))], pa.string()).take(at)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), code, pa.array(error).take(at)], names)

    return table.mapInArrow(run, schema), fit


def label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``, the errors summed over equal labels, nulls together.

    Sums are made before anything moves.  The list of labels is broadcast up to a
    checked number; beyond it the join is salted, so that no label lands in one task.
    """
    sums = settle(coded.groupBy(F.col("_label").alias("_l")).agg(F.sum("error").alias("label_error")))
    same = F.col("_label").eqNullSafe(F.col("_l"))
    if sums.count() <= LABELS:
        return coded.join(F.broadcast(sums), same, "left").drop("_l")
    salted = sums.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = coded.withColumn("_salt", F.pmod(F.xxhash64("_id", "code"), F.lit(SALTS)).cast("int"))
    return rows.join(salted, same & (F.col("_salt") == F.col("_s")), "left").drop("_l", "_s", "_salt")


def op11(spark, sf_dir: str) -> DataFrame:
    coded, fit = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    out = label_errors(settle(coded))
    return out.select(F.col("_id").alias("vec_id"), "code", "error", "label_error", F.lit(digest(fit)).alias("codebooks_sha256"))


def _sql(rounds: int = 4) -> str:
    d = "array_inner_product(v, v) - 2 * array_inner_product(v, c) + array_inner_product(c, c)"
    mean = ", ".join(f"floor(sum(v[{i}]) / count(*))" for i in range(1, 17))
    nearest = "a{0} AS MATERIALIZED (SELECT vec_id, part, any_value(v) AS v, arg_min(e, d * 256 + e) AS e, min(d) AS d FROM (SELECT vec_id, part, v, e, {d} AS d FROM p JOIN e{0} USING (part)) GROUP BY 1, 2)"
    steps = [
        "kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "p AS MATERIALIZED (SELECT vec_id, part, q[part * 16 + 1 : part * 16 + 16]::DOUBLE[16] AS v FROM kept, range(4) r(part))",
        "e0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, v AS c FROM p QUALIFY e < 256)",
    ]
    for i in range(rounds):
        steps.append(nearest.format(i, d=d))
        steps.append(f"e{i + 1} AS MATERIALIZED (SELECT part, e, coalesce(m.c, e{i}.c) AS c FROM e{i} LEFT JOIN (SELECT part, e, [{mean}]::DOUBLE[16] AS c FROM a{i} GROUP BY 1, 2) m USING (part, e))")
    steps.append(nearest.format(rounds, d=d))
    steps.append("o AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a4 GROUP BY 1)")
    steps.append("h AS (SELECT sha256(string_agg(CAST(CAST(c[i] AS BIGINT) AS VARCHAR), ',' ORDER BY part, e, i)) AS codebooks_sha256 FROM e4, range(1, 17) t(i))")
    return f"WITH {', '.join(steps)} SELECT o.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM o JOIN kept ON o.vec_id = kept.vec_id, h"


SQL = _sql()

"""Label permutations, without numbering every row in every repeat."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from measurelens.operators.common import settle

# Leading bits of a draw that are counted, rows that draw in one step, and ranks that one task pairs.
_BITS, _ROWS, _RANKS = 12, 50_000, 50_000
_SIDES = ("row", "value")
_BLOCK = 14  # bits of the rows that get their values back together


def _draws(ids: list[str], seed: int, side: str, rep: int) -> np.ndarray:
    """The first 52 bits of the md5 of ``seed:side:rep:id``, as ``hash_long`` gives them."""
    first = f"{seed}:{side}:{rep}:"
    codes = b"".join([hashlib.md5((first + i).encode()).digest()[:8] for i in ids])
    return (np.frombuffer(codes, ">u8") >> np.uint64(12)).astype(np.int64)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of a task, some tens of thousands at a time."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= _ROWS:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _paired(rows: DataFrame, repeats: int, seed: int, finish: Callable, schema: str) -> DataFrame:
    """``finish(rep, x, y)`` of every stretch of ranks of every repeat (from 1), for rows (id, x, y).

    The k-th row in one hash order gets the k-th value in a second one.  Draws are
    first counted by their leading bits, a table of fixed size; so it is known
    which stretches of ranks a draw may fall into, and it moves there once, beside
    its number.  A task pairs one stretch of ranks of one repeat.
    """
    spark, buckets, shift, ranks = rows.sparkSession, 1 << _BITS, 52 - _BITS, _RANKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(_SIDES), repeats, buckets), np.int64)
        for part in _gathered(batches):
            ids = part.column("id").to_pylist()
            for s, side in enumerate(_SIDES):
                for r in range(repeats):
                    total[s, r] += np.bincount(_draws(ids, seed, side, r + 1) >> shift, minlength=buckets)
        if total.any():
            keys = [pa.array(k, pa.int32()) for k in (np.repeat(np.arange(len(_SIDES)), repeats), np.tile(np.arange(repeats), len(_SIDES)))]
            yield pa.RecordBatch.from_arrays([*keys, pa.array([c.tobytes() for c in total.reshape(-1, buckets)], pa.binary())], ["side", "rep", "n"])

    def add(key: tuple, parts: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(p.as_buffer(), np.int64) for p in parts.column("n"))
        return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["side", "rep", "n"])

    counted = rows.mapInArrow(count, "side int, rep int, n binary").groupBy("side", "rep").applyInArrow(add, "side int, rep int, n binary").collect()
    ends = np.zeros((len(_SIDES), repeats, buckets + 1), np.int64)
    for c in counted:
        ends[c.side, c.rep, 1:] = np.cumsum(np.frombuffer(c.n, np.int64))
    placed = spark.sparkContext.broadcast(ends)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _gathered(batches):
            ids = part.column("id").to_pylist()
            for s, side in enumerate(_SIDES):
                number = part.column("xy"[s]).to_numpy()
                for r in range(repeats):
                    draw, end = _draws(ids, seed, side, r + 1), placed.value[s, r]
                    low, high = end[draw >> shift] // ranks, (end[(draw >> shift) + 1] - 1) // ranks
                    owner = np.repeat(np.arange(len(draw)), high - low + 1)
                    cell = low[owner] + np.arange(len(owner)) - (np.cumsum(high - low + 1) - (high - low + 1))[owner]
                    order = np.argsort(cell, kind="stable")
                    cell, owner = cell[order], owner[order]
                    cuts = np.flatnonzero(np.diff(cell, prepend=-1))
                    both = np.empty(len(owner), [("draw", np.int64), ("number", np.float64)])
                    both["draw"], both["number"] = draw[owner], number[owner]
                    packed = [both[a:z].tobytes() for a, z in zip(cuts, [*cuts[1:], len(cell)])]
                    keys = [pa.array(np.full(len(cuts), k), pa.int32()) for k in (s, r)]
                    yield pa.RecordBatch.from_arrays([*keys, pa.array(cell[cuts], pa.int64()), pa.array(packed, pa.binary())], ["side", "rep", "cell", "part"])

    def pair(key: tuple, parts: pa.Table) -> pa.Table:
        rep, cell = key[0].as_py(), key[1].as_py()
        dealt, which = [], parts.column("side").to_numpy()
        for s in range(len(_SIDES)):
            own = [np.frombuffer(p.as_buffer(), [("draw", np.int64), ("number", np.float64)]) for p in parts.column("part").filter(pa.array(which == s))]
            both = np.concatenate(own)
            both = both[np.lexsort((both["number"], both["draw"]))]
            # the stretch begins inside the first bucket that is here
            skip = cell * ranks - placed.value[s, rep, both["draw"][0] >> shift]
            dealt.append(both["number"][max(skip, 0) :][:ranks])
        return finish(rep + 1, *dealt)

    dealt = rows.mapInArrow(deal, "side int, rep int, cell long, part binary").groupBy("rep", "cell")
    return dealt.applyInArrow(pair, schema)


def permuted_correlations(df: DataFrame, *, row: str, value: str, other: str, repeats: int, seed: int = 42) -> DataFrame:
    """(rep, q): correlation of ``other`` with ``value`` dealt to rows in a new hash order per repeat."""
    rows = settle(df.select(F.col(row).cast("string").alias("id"), F.col(other).cast("double").alias("x"), F.col(value).cast("double").alias("y")))

    def summed(rep: int, x: np.ndarray, y: np.ndarray) -> pa.Table:
        seen = ~(np.isnan(x) | np.isnan(y))
        x, y = x[seen], y[seen]
        sums = [float(len(x)), x.sum(), y.sum(), (x * x).sum(), (y * y).sum(), (x * y).sum()]
        return pa.Table.from_arrays([pa.array([rep], pa.int32()), *[pa.array([float(v)]) for v in sums]], ["rep", *names])

    names = ["n", "sx", "sy", "sxx", "syy", "sxy"]
    partial = _paired(rows, repeats, seed, summed, "rep int, " + ", ".join(f"{n} double" for n in names))
    one = partial.groupBy("rep").agg(*[F.sum(n).alias(n) for n in names])
    c = F.col
    return one.select("rep", ((c("sxy") - c("sx") * c("sy") / c("n")) / F.sqrt((c("sxx") - c("sx") * c("sx") / c("n")) * (c("syy") - c("sy") * c("sy") / c("n")))).alias("q"))


def permuted_values(df: DataFrame, *, row: str, value: str, repeats: int, seed: int = 42) -> DataFrame:
    """``df`` with ``permuted``: the values that a row is dealt in repeats 1, 2, ..., each in a new hash order.

    Values return to their rows in blocks, so a row's values move as one piece.
    """
    rows = settle(df.withColumn("_code", F.monotonically_increasing_id()))
    low = (1 << _BLOCK) - 1

    def back(rep: int, x: np.ndarray, y: np.ndarray) -> pa.Table:
        code = x.astype(np.int64)
        order = np.argsort(code, kind="stable")
        block = code[order] >> _BLOCK
        cuts = np.flatnonzero(np.diff(block, prepend=-1))
        both = np.empty(len(code), [("place", np.uint16), ("number", np.float64)])
        both["place"], both["number"] = code[order] & low, y[order]
        packed = [both[a:z].tobytes() for a, z in zip(cuts, [*cuts[1:], len(code)])]
        return pa.Table.from_arrays([pa.array(block[cuts]), pa.array(np.full(len(cuts), rep), pa.int32()), pa.array(packed, pa.binary())], ["block", "rep", "part"])

    def gather(key: tuple, parts: pa.Table) -> pa.Table:
        found = np.full((1 << _BLOCK, repeats), np.nan)
        here = np.zeros(1 << _BLOCK, np.bool_)
        for rep, part in zip(parts.column("rep").to_pylist(), parts.column("part")):
            both = np.frombuffer(part.as_buffer(), [("place", np.uint16), ("number", np.float64)])
            found[both["place"], rep - 1] = both["number"]
            here[both["place"]] = True
        at = np.flatnonzero(here)
        values = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * repeats, pa.int32()), pa.array(found[at].ravel()))
        return pa.Table.from_arrays([pa.array((key[0].as_py() << _BLOCK) + at), values], ["_code", "permuted"])

    # numbers of rows are whole and below 2^53
    slim = rows.select(F.col(row).cast("string").alias("id"), F.col("_code").cast("double").alias("x"), F.col(value).cast("double").alias("y"))
    found = _paired(slim, repeats, seed, back, "block long, rep int, part binary").groupBy("block").applyInArrow(gather, "_code long, permuted array<double>")
    return rows.join(found, "_code").drop("_code")

"""Exact k nearest neighbours in Euclidean space, and the models that vote or average over them.

The reference rows are dealt to cells, each around its nearest pivot (a bounded number
of rows drawn by hash).  A query first visits the nearest cells that hold k rows, which
bounds the distance of its k-th neighbour.  The bound then rules out whole cells: those
whose nearest possible member, by the triangle inequality (distance to the pivot against
the cell's inner and outer radius) or by the plane between two pivots, lies beyond it.
What is left is visited in two steps, the few closest cells before all others, so the
bound has tightened before the farther ones are asked.  Every bound is safe: nothing
nearer is missed, and results do not depend on the pivots.

Neighbouring cells are packed into bins of about one block of rows, and a query goes
to a bin once, with the list of the cells it visits there.  A bin of any size is divided
into blocks and the queries that visit it into chunks; block meets chunk, so neither
copies of one vector nor a crowd of queries make a hot task.  Distances of a block are found as matrix products and then confirmed one by one,
so equal vectors have equal distances.  Ties go to the smaller id.

Values must be finite and of one width; anything else is an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from measurelens.operators.common import carried, settle
from measurelens.operators.normal import matrix

# Most pivots; with their radii they are the only broadcast (8 bytes x width each).
PIVOTS = 1024
# Reference rows of a block, and queries of a chunk: their distances are one matrix.
BLOCK = 8192
# Cells that are visited before the bound is tightened for the last time.
CLOSE = 4
# Queries that are looked at together, and (query, row) or (query, cell) pairs whose vectors lie in memory at once.
SLICE = 256
PAIRS = 16_384


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :], 0.0)


class Cells:
    """Pivots with the number and the least and greatest distance of their members."""

    def __init__(self, pivots: np.ndarray):
        self.pivots = pivots
        self.gaps = np.sqrt(squares(pivots, pivots))
        n = len(pivots)
        self.count, self.low, self.high = np.zeros(n, np.int64), np.full(n, np.inf), np.zeros(n)

    def home(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        away = np.sqrt(squares(x, self.pivots))
        cell = away.argmin(1)
        return cell, away[np.arange(len(x)), cell]

    def visits(self, x: np.ndarray, bound: np.ndarray, k: int, step: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, cell) of one step: 0 the nearest cells with k rows, 1 the next few, 2 the rest; empty and ruled out cells are left out."""
        away = np.sqrt(squares(x, self.pivots))
        order = np.argsort(away, axis=1, kind="stable")
        before = np.cumsum(self.count[order], axis=1) - self.count[order]
        first = (before < k).sum(1)[:, None]
        place = np.arange(len(self.pivots))[None, :]
        turn = (place < first, (place >= first) & (place < first + CLOSE), place >= first + CLOSE)[step]
        turn = turn & (self.count[order] > 0)
        if step:
            near = np.take_along_axis(away, order, axis=1)
            gap = self.gaps[order, order[:, :1]]
            with np.errstate(divide="ignore", invalid="ignore"):
                plane = np.where(gap > 0, (near**2 - near[:, :1] ** 2) / (2 * gap), 0.0)
            least = np.maximum(np.maximum(near - self.high[order], self.low[order] - near), plane)
            # rounding must not rule out a cell
            turn = turn & (least <= bound[:, None] * (1 + 1e-9) + 1e-6 * (1 + near))
        query, at = np.nonzero(turn)
        return query, order[query, at]

    def bins(self) -> np.ndarray:
        """Bin of every cell: cells that follow each other along the pivots' widest direction share one, up to about ``BLOCK`` rows."""
        if len(self.pivots) < 2:
            return np.zeros(len(self.pivots), np.int64)
        middle = self.pivots - self.pivots.mean(axis=0)
        order = np.argsort(middle @ np.linalg.eigh(middle.T @ middle)[1][:, -1], kind="stable")
        out = np.empty(len(order), np.int64)
        out[order] = np.unique((np.cumsum(self.count[order]) - self.count[order]) // BLOCK, return_inverse=True)[1]
        return out


def _pivots(reference: DataFrame, width: int) -> np.ndarray:
    n = reference.count()
    wanted = int(min(PIVOTS, max(1, np.ceil(np.sqrt(n)))))
    drawn = reference.orderBy(F.xxhash64("_id", "_x"), "_id").limit(wanted).select("_x").toArrow()
    return np.unique(matrix(drawn.column(0).combine_chunks(), width), axis=0) if drawn.num_rows else np.zeros((0, width))


def _prepared(reference: DataFrame, width: int, spark) -> tuple[DataFrame, Cells]:
    cells = Cells(_pivots(reference, width))
    box = spark.sparkContext.broadcast(cells.pivots)
    schema = T.StructType([*reference.schema, T.StructField("cell", T.IntegerType()), T.StructField("away", T.DoubleType())])
    names, place = schema.fieldNames(), reference.columns.index("_x")

    def run(batches):
        at = Cells(box.value)
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE):
                part = batch.slice(first, SLICE)
                cell, away = at.home(matrix(part.column(place), width))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell, pa.int32()), pa.array(away)], names)

    table = settle(reference.mapInArrow(run, schema).withColumn("_u", F.monotonically_increasing_id()))
    for r in table.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("away").alias("lo"), F.max("away").alias("hi")).collect():
        cells.count[r.cell], cells.low[r.cell], cells.high[r.cell] = r.n, r.lo, r.hi
    return table, cells


def _exact(queries: np.ndarray, rows: np.ndarray, q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Distance of each pair; vectors of a bounded number of pairs are taken at once."""
    out = np.empty(len(q))
    for first in range(0, len(q), PAIRS):
        at = slice(first, first + PAIRS)
        out[at] = np.sqrt(((queries[q[at]] - rows[r[at]]) ** 2).sum(1))
    return out


def _best(queries: np.ndarray, bound: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, visits: np.ndarray | None = None, home: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of up to k rows per query within its bound, by distance and then id.

    With ``visits`` [query, cell] only rows whose cell ``home`` the query visits.
    """
    k = min(k, len(rows))
    longest, out = (rows * rows).sum(1).max(), []
    # rows at the same distance are candidates all of them, so their number per query has no bound but the block
    for first in range(0, len(queries), SLICE):
        x, limits = queries[first : first + SLICE], bound[first : first + SLICE]
        about = squares(x, rows)
        asked = True if visits is None else visits[first : first + SLICE][:, home]
        if visits is not None:
            about[~asked] = np.inf
        limit = np.minimum(np.partition(about, k - 1, axis=1)[:, k - 1], np.where(np.isfinite(limits), limits * limits, np.inf))
        size = (x * x).sum(1)[:, None] + longest
        q, r = np.nonzero((about <= limit[:, None] * (1 + 1e-9) + 1e-9 * (1 + size)) & asked)
        exact = _exact(x, rows, q, r)
        by = np.lexsort((ids[r], exact, q))
        q, r, exact = q[by], r[by], exact[by]
        start = np.searchsorted(q, np.arange(len(x)))
        keep = np.arange(len(q)) - start[q] < k
        out.append((q[keep] + first, r[keep], exact[keep]))
    return tuple(np.concatenate(parts) for parts in zip(*out))


def _routes(cells: Cells, batch: pa.RecordBatch, width: int, k: int, step: int, names: list[str]):
    """Batches (_q, _x, bound, cell) of the cells that the queries of a batch visit, each of at most ``PAIRS`` rows."""
    for first in range(0, batch.num_rows, SLICE):
        part = batch.slice(first, SLICE)
        bound = np.nan_to_num(part.column(2).to_numpy(zero_copy_only=False).astype(np.float64), nan=np.inf)
        q, cell = cells.visits(matrix(part.column(1), width), bound, k, step)
        part = part.set_column(2, "bound", pa.array(bound))
        for at in range(0, len(q), PAIRS):
            rows = part.take(pa.array(q[at : at + PAIRS]))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(cell[at : at + PAIRS], pa.int32())], names)


def _packed(routed: pa.RecordBatch, bins: np.ndarray, names: list[str]) -> pa.RecordBatch:
    """(_q, _x, bound, bin, cells): the rows of ``_routes`` as one per query and bin."""
    cell = routed.column(3).to_numpy()
    q = routed.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy()
    order = np.lexsort((cell, bins[cell], q))
    q, cell = q[order], cell[order]
    new = np.flatnonzero(np.concatenate((np.ones(min(1, len(q)), np.bool_), (q[1:] != q[:-1]) | (bins[cell[1:]] != bins[cell[:-1]]))))
    rows = routed.take(pa.array(order[new]))
    lists = pa.ListArray.from_arrays(pa.array(np.append(new, len(q)), pa.int32()), pa.array(cell, pa.int32()))
    return pa.RecordBatch.from_arrays([*rows.columns[:3], pa.array(bins[cell[new]], pa.int32()), lists], names)


def _meet(routed: DataFrame, table: DataFrame, cells: Cells, k: int, width: int, out: T.StructType) -> DataFrame:
    """Every routed query against the blocks of its bin: its k best of each block."""
    load = {r.bin: r.n for r in routed.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).collect()}
    bins = cells.bins()
    rows = np.bincount(bins, weights=cells.count).astype(np.int64)
    blocks = [max(1, -(-int(n) // BLOCK)) for n in rows]
    chunks = [max(1, -(-int(load.get(c, 0)) // BLOCK)) for c in range(len(blocks))]
    pick = lambda numbers: F.get(F.array(*[F.lit(int(n)) for n in numbers]), F.col("bin"))
    upto = lambda numbers: F.explode(F.sequence(F.lit(0), pick(numbers) - 1))
    asks = routed.select("*", F.pmod(F.xxhash64("_q"), pick(chunks)).cast("int").alias("chunk"), upto(blocks).alias("block"))
    has = table.select("_id", "_v", "_x", "_u", "cell", F.get(F.array(*[F.lit(int(n)) for n in bins]), F.col("cell")).alias("bin"))
    has = has.where(F.col("bin").isin(sorted(load))) if len(load) < len(blocks) else has
    has = has.select("*", F.pmod(F.xxhash64("_u"), pick(blocks)).cast("int").alias("block"), upto(chunks).alias("chunk")).drop("_u")
    names = out.fieldNames()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_arrays([pa.array([], f) for f in kinds], names)
        whole = lambda t, c: t.column(c).combine_chunks()
        x, y = matrix(whole(left, "_x"), width), matrix(whole(right, "_x"), width)
        ids = whole(right, "_id")
        rank = np.unique(np.array(ids.to_pylist()), return_inverse=True)[1]
        here, home = np.unique(whole(right, "cell").to_numpy(), return_inverse=True)
        asked = whole(left, "cells")
        cell, query = asked.flatten().to_numpy(), np.repeat(np.arange(len(x)), np.diff(asked.offsets.to_numpy()))
        at = np.minimum(np.searchsorted(here, cell), len(here) - 1)
        visits = np.zeros((len(x), len(here)), np.bool_)
        visits[query[here[at] == cell], at[here[at] == cell]] = True
        q, r, d = _best(x, whole(left, "bound").to_numpy(), y, rank, k, visits, home)
        take = lambda t, c, at: whole(t, c).take(pa.array(at))
        return pa.Table.from_arrays([take(left, "_q", q), ids.take(pa.array(r)), take(right, "_v", r), pa.array(d)], names)

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in out]
    keys = ["bin", "block", "chunk"]
    return asks.groupBy(*keys).cogroup(has.groupBy(*keys)).applyInArrow(run, out)


def nearest(queries: DataFrame, reference: DataFrame, *, query: str, row: str, array: str, value: str, width: int, k: int = 4) -> DataFrame:
    """(_q, _id, _v, distance, place): the k nearest reference rows of every query, or all where there are fewer.

    ``query`` tells the queries apart, ``row`` the reference rows (repeated ids are
    rows of their own); ``value`` of the reference comes along.
    """
    spark = queries.sparkSession
    x = F.col(array).cast("array<double>").alias("_x")
    ref = reference.select(F.col(row).alias("_id"), F.col(value).cast("double").alias("_v"), x)
    asked = settle(queries.select(F.col(query).alias("_q"), x))
    table, cells = _prepared(settle(ref), width, spark)
    out = T.StructType([asked.schema["_q"], table.schema["_id"], table.schema["_v"], T.StructField("distance", T.DoubleType())])
    top = Window.partitionBy("_q").orderBy("distance", "_id")
    if not cells.count.sum():
        return spark.createDataFrame([], out).withColumn("place", F.lit(0))
    shared = carried(spark, cells)
    found, bounds = None, None
    for step in range(3):
        rows = asked if bounds is None else asked.join(bounds, "_q", "left")
        rows = rows.select("_q", "_x", (F.lit(None).cast("double") if bounds is None else F.col("bound")).alias("bound"))
        schema = T.StructType([*rows.schema, T.StructField("bin", T.IntegerType()), T.StructField("cells", T.ArrayType(T.IntegerType()))])
        names = schema.fieldNames()

        def route(batches, step=step, names=names):
            cells = shared()
            bins = cells.bins()
            for batch in batches:
                for routed in _routes(cells, batch, width, k, step, [*names[:3], "cell"]):
                    yield _packed(routed, bins, names)

        routed = settle(rows.mapInArrow(route, schema))
        new = _meet(routed, table, cells, k, width, out)
        both = new if found is None else found.drop("place").unionByName(new)
        found = settle(both.withColumn("place", F.row_number().over(top)).where(F.col("place") <= k))
        bounds = found.where(F.col("place") == k).select("_q", F.col("distance").alias("bound"))
    return found


def vote(found: DataFrame) -> DataFrame:
    """(_q, prediction): the commonest value of the neighbours; ties go to the smaller value."""
    votes = found.groupBy("_q", "_v").agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy("_q").agg(F.min(F.struct((-F.col("n")).alias("n"), "_v")).getField("_v").alias("prediction"))


def average(found: DataFrame, weights: str = "distance") -> DataFrame:
    """(_q, prediction): mean of the neighbours' values, by inverse distance; neighbours at distance zero stand alone."""
    if weights == "uniform":
        return found.groupBy("_q").agg(F.avg("_v").alias("prediction"))
    zero = F.col("distance") == 0
    near = F.sum(F.when(~zero, F.col("_v") / F.col("distance"))) / F.sum(F.when(~zero, 1.0 / F.col("distance")))
    return found.groupBy("_q").agg(F.coalesce(F.avg(F.when(zero, F.col("_v"))), near).alias("prediction"))


class Neighbours:
    """An estimator over vector columns like those of Spark ML: the rows themselves are the model."""

    def __init__(self, k: int = 4, weights: str = "uniform", classify: bool = True):
        self.k, self.weights, self.classify, self.label, self.row = k, weights, classify, "label", "id"

    def setLabelCol(self, label: str) -> Neighbours:
        self.label = label
        return self

    def setRowCol(self, row: str) -> Neighbours:
        self.row = row
        return self

    def fit(self, rows: DataFrame) -> NeighbourModel:
        kept = settle(rows.select(F.col(self.row).alias("id"), F.col(self.label).cast("double").alias("v"), vector_to_array("features").alias("x")))
        first = kept.select(F.size("x")).head()
        if first is None:
            raise ValueError("no rows to fit")
        return NeighbourModel(self, kept, first[0])


class NeighbourModel:
    def __init__(self, settings: Neighbours, rows: DataFrame, width: int):
        self.settings, self.rows, self.width = settings, rows, width

    def transform(self, rows: DataFrame) -> DataFrame:
        s = self.settings
        asked = settle(rows.withColumn("_key", F.monotonically_increasing_id()))
        found = nearest(asked.select("_key", vector_to_array("features").alias("x")), self.rows, query="_key", row="id", array="x", value="v", width=self.width, k=s.k)
        said = vote(found) if s.classify and s.weights == "uniform" else average(found, s.weights)
        return asked.join(said.withColumnRenamed("_q", "_key"), "_key", "left").drop("_key")

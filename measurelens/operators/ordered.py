"""Running totals, ranks and exact quantiles without a single-task window.

A group may hold a third of all rows, so nothing here sorts one whole group in
one task.  Values are first collapsed to (group, value, count), then placed in
fine logarithmic buckets that follow the order of the values.  Totals of the
buckets before a bucket come from a window over the few buckets of a group;
totals inside a bucket come from a window over one (group, bucket) cell.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Buckets per factor of two: neighbouring values differ by under 0.07 %.
_PER_OCTAVE = 1024
_SHIFT = 1080 * _PER_OCTAVE


def value_bucket(value: Column) -> Column:
    """A whole number that never decreases when the finite value grows."""
    magnitude = F.floor(F.log2(F.abs(value)) * _PER_OCTAVE) + F.lit(_SHIFT)
    return F.when(value == 0, F.lit(0).cast("long")).when(value > 0, magnitude).otherwise(-magnitude)


def usable(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def prefix_sums(df: DataFrame, value: Column | str, sums: Mapping[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """One row per (keys, distinct value) with running totals of ``sums``.

    For each name ``m`` the result has ``m`` (this value), ``m_before`` (all
    smaller values) and ``m_total`` (the group).  The value column is ``v``.
    Rows with a null key or a value that is not a finite number are left out.
    """
    keys = list(keys)
    value = F.col(value) if isinstance(value, str) else value
    rows = df.select(*keys, value.cast("double").alias("v"), *[c.alias(m) for m, c in sums.items()])
    keep = usable(F.col("v"))
    for k in keys:
        keep = keep & F.col(k).isNotNull()
    # adding zero folds -0.0 into 0.0
    rows = rows.where(keep).withColumn("v", F.col("v") + F.lit(0.0)).withColumn("_b", value_bucket(F.col("v")))
    fine = rows.groupBy(*keys, "_b", "v").agg(*[F.sum(m).alias(m) for m in sums])
    coarse = fine.groupBy(*keys, "_b").agg(*[F.sum(m).alias(m) for m in sums])
    group = [F.col(k) for k in keys] or [F.lit(0)]
    in_order, whole = Window.partitionBy(*group).orderBy("_b"), Window.partitionBy(*group)
    coarse = coarse.select(
        *keys,
        "_b",
        *[(F.sum(m).over(in_order) - F.col(m)).alias(f"{m}_offset") for m in sums],
        *[F.sum(m).over(whole).alias(f"{m}_total") for m in sums],
    )
    cell = Window.partitionBy(*keys, "_b").orderBy("v")
    return fine.join(coarse, [*keys, "_b"]).select(
        *keys,
        "v",
        *sums,
        *[(F.sum(m).over(cell) - F.col(m) + F.col(f"{m}_offset")).alias(f"{m}_before") for m in sums],
        *[f"{m}_total" for m in sums],
    )


# A group with more rows than this goes through running totals.  There are at
# most (rows / HOT_ROWS) such groups, which bounds the broadcast list of them.
HOT_ROWS = 1_000_000


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: Column | str,
    probs: Mapping[str, float],
    *,
    method: str = "linear",
    hot_rows: int | None = None,
) -> DataFrame:
    """Exact quantiles per group: ``keys`` and one column per name in ``probs``.

    ``method`` is "linear" (interpolate) or "higher" (an observed value).

    Groups of moderate size use Spark's exact percentile, one shuffle.  Groups
    with more than ``hot_rows`` rows would fill one task's memory; they are
    found by a count and go through running totals over value buckets.  When
    there are none, adaptive execution drops that branch.
    """
    keys = list(keys)
    v = F.col("v")
    rows = df.select(*keys, (F.col(value) if isinstance(value, str) else value).cast("double").alias("v")).where(usable(v))
    if not keys or method != "linear":
        return _bucketed_quantiles(rows, keys, probs, method)
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    limit = HOT_ROWS if hot_rows is None else hot_rows
    hot = F.broadcast(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).select(*keys))
    cold = rows.join(hot, keys, "left_anti").groupBy(*keys).agg(F.percentile(v, list(probs.values())).alias("_q"))
    cold = cold.select(*keys, *[F.col("_q")[i].alias(name) for i, name in enumerate(probs)])
    return cold.unionByName(_bucketed_quantiles(rows.join(hot, keys, "left_semi"), keys, probs, method))


def _bucketed_quantiles(rows: DataFrame, keys: list[str], probs: Mapping[str, float], method: str) -> DataFrame:
    ranked = prefix_sums(rows, "v", {"n": F.lit(1).cast("long")}, keys)
    hit, out = F.lit(False), []
    aggs = []
    for i, (name, p) in enumerate(probs.items()):
        position = F.lit(float(p)) * (F.col("n_total") - 1)
        low, high = F.floor(position), F.ceil(position)
        if method == "higher":
            low = high
        at_low = (F.col("n_before") <= low) & (low < F.col("n_before") + F.col("n"))
        at_high = (F.col("n_before") <= high) & (high < F.col("n_before") + F.col("n"))
        hit = hit | at_low | at_high
        aggs += [
            F.max(F.when(at_low, F.col("v"))).alias(f"_lo{i}"),
            F.max(F.when(at_high, F.col("v"))).alias(f"_hi{i}"),
            F.max(position - low if method == "linear" else F.lit(0.0)).alias(f"_f{i}"),
        ]
        out.append((F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_f{i}")).alias(name))
    picked = ranked.where(hit).groupBy(*keys).agg(*aggs)
    return picked.select(*keys, *out)


def average_ranks(df: DataFrame, value: Column | str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, v, n, rank): average rank of each distinct value in its group."""
    ranked = prefix_sums(df, value, {"n": F.lit(1).cast("long")}, keys)
    return ranked.withColumn("rank", F.col("n_before") + (F.col("n") + 1) / F.lit(2.0))


def numbered(df: DataFrame, keys: Sequence[str], order: Column, name: str = "position", *, tie: Sequence[str] | None = None) -> DataFrame:
    """Zero-based position of each row in its group by ``order`` (a double).

    Every row has a position of its own: rows with an equal order value follow
    the columns ``tie`` (all columns by default).  Only such rows are sorted
    together.
    """
    keys = list(keys)
    marked = df.withColumn("_order", order.cast("double") + F.lit(0.0))
    ranked = prefix_sums(marked, "_order", {"n": F.lit(1).cast("long")}, keys)
    ranked = ranked.select(*keys, F.col("v").alias("_order"), F.col("n_before").alias(name), F.col("n_total").alias(f"{name}_of"))
    among = Window.partitionBy(*keys, "_order").orderBy(*(tie or df.columns))
    joined = marked.join(ranked, [*keys, "_order"])
    return joined.withColumn(name, F.col(name) + F.row_number().over(among) - 1).drop("_order")


def count_far_pairs(df: DataFrame, value: str, distance: float, keys: Sequence[str] = ()) -> DataFrame:
    """Pairs of rows in a group whose values differ by strictly more than ``distance``.

    Nothing is paired: each distinct value asks how many rows lie below it by
    more than the distance.  The running total answers for all values except
    those within rounding of the edge, and these few are compared exactly.
    Returns (keys, n_rows, far_pairs).
    """
    keys, d, eps = list(keys), float(distance), 1e-9
    v = F.col("v")
    histogram = (
        df.select(*keys, F.col(value).cast("double").alias("v"))
        .where(usable(v))
        .groupBy(*keys, "v")
        .agg(F.count(F.lit(1)).alias("c"))
    )
    points = histogram.select(*keys, v.alias("x"), F.col("c").alias("have"), F.lit(0).cast("long").alias("ask")).unionByName(
        histogram.select(*keys, (v - d - eps).alias("x"), F.lit(0).cast("long").alias("have"), F.col("c").alias("ask"))
    )
    totals = prefix_sums(points, "x", {"have": F.col("have"), "ask": F.col("ask")}, keys)
    sure = totals.groupBy(*keys) if keys else totals.groupBy()
    sure = sure.agg(
        F.coalesce(F.sum(F.col("ask") * F.col("have_before")), F.lit(0)).alias("sure"),
        F.coalesce(F.max("have_total"), F.lit(0)).alias("n_rows"),
    )
    cell = F.floor(v / (4 * eps))
    edge = (v - d) / (4 * eps)
    asks = histogram.select(*keys, v.alias("hi"), F.col("c").alias("c_hi"), F.explode(F.array(F.floor(edge) - 1, F.floor(edge), F.floor(edge) + 1)).alias("_cell"))
    near = (
        asks.join(histogram.select(*keys, v.alias("lo"), F.col("c").alias("c_lo"), cell.alias("_cell")), [*keys, "_cell"])
        .where((F.col("lo") >= F.col("hi") - d - eps) & (F.col("hi") - F.col("lo") > d))
    )
    near = (near.groupBy(*keys) if keys else near.groupBy()).agg(F.sum(F.col("c_hi") * F.col("c_lo")).alias("edge"))
    joined = sure.join(near, keys, "left") if keys else sure.join(F.broadcast(near))
    return joined.select(*keys, "n_rows", (F.col("sure") + F.coalesce(F.col("edge"), F.lit(0))).alias("far_pairs"))

"""Group statistics: enrichment, diversity, profiles, tests and series selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from measurelens.functions import stats
from measurelens.functions.stats import ratio
from measurelens.operators.ordered import prefix_sums, quantiles


def enrichment(df: DataFrame, *, scaffold: str, group: str, value: str, min_size: int = 1, confidence: float = 0.95) -> DataFrame:
    """Share of group one per scaffold over its share of all rows, with a Wilson bound.

    Rows without a scaffold count in the base rate only.  A table with no group
    one row has no defined factor, which is an error when the plan runs.
    """
    is_one = (F.col(group) == 1).cast("long")
    base = df.agg(ratio(F.sum(is_one), F.count(F.lit(1))).alias("base"))
    base = base.select(F.when(F.col("base") > 0, F.col("base")).otherwise(F.raise_error(F.lit("no row is in group one")).cast("double")).alias("base"))
    has = df.where(F.col(scaffold).isNotNull())
    agg = has.groupBy(scaffold).agg(F.count(F.lit(1)).alias("n"), F.sum(is_one).alias("n_group1"), F.max(value).alias("max_value")).where(F.col("n") >= min_size)
    agg = agg.join(quantiles(has, [scaffold], value, {"median_value": 0.5}), scaffold)
    frac = ratio(F.col("n_group1"), F.col("n"))
    return agg.join(F.broadcast(base)).select(
        F.col(scaffold).alias("scaffold"),
        "n",
        "n_group1",
        frac.alias("frac_group1"),
        (frac / F.col("base")).alias("ef"),
        (stats.wilson_lower(F.col("n_group1"), F.col("n"), confidence) / F.col("base")).alias("ef_lower"),
        "median_value",
        "max_value",
    )


def rank_enrichment(table: DataFrame) -> DataFrame:
    return table.orderBy(F.desc("ef_lower"), F.desc("n"), "scaffold")


def top_series(table: DataFrame, *, min_members: int = 8, max_scaffolds: int = 10) -> DataFrame:
    """The most populated series, largest first (the report's own top-k)."""
    return table.where(F.col("n") >= min_members).orderBy(F.desc("n"), F.desc("ef_lower"), "scaffold").limit(max_scaffolds)


def diversity(df: DataFrame, *, scaffold: str, skeleton: str, class_col: str) -> DataFrame:
    """Scaffold counts and ratios for the whole table and for each class.

    Singletons are counted within each row, so the scaffold counts are taken
    per (class, scaffold) and summed again for the "complete" row.
    """
    cells = df.groupBy(class_col, scaffold).agg(F.count(F.lit(1)).alias("n"))

    def summarise(rows: DataFrame, label) -> DataFrame:
        return rows.groupBy(label.alias("row")).agg(
            F.sum("n").alias("N"),
            F.coalesce(F.sum(F.when(F.col(scaffold).isNull(), F.col("n"))), F.lit(0)).alias("acyclic"),
            F.count(scaffold).alias("Ns"),
            F.count_if(F.col(scaffold).isNotNull() & (F.col("n") == 1)).alias("Nss"),
        )

    whole = cells.groupBy(scaffold).agg(F.sum("n").alias("n"))
    table = summarise(whole, F.lit("complete")).unionByName(summarise(cells, F.col(class_col)))
    bones = df.where(F.col(skeleton).isNotNull()).select(class_col, skeleton).distinct()
    ncsk = bones.select(F.lit("complete").alias("row"), skeleton).distinct().groupBy("row").agg(F.count(F.lit(1)).alias("Ncsk"))
    ncsk = ncsk.unionByName(bones.groupBy(F.col(class_col).alias("row")).agg(F.count(F.lit(1)).alias("Ncsk")))
    return table.join(ncsk, "row", "left").fillna(0, ["Ncsk"]).select(
        "row",
        "N",
        "acyclic",
        "Ns",
        "Nss",
        "Ncsk",
        ratio(F.col("Ns"), F.col("N")).alias("Ns_N"),
        ratio(F.col("Nss"), F.col("Ns")).alias("Nss_Ns"),
        ratio(F.col("Ncsk"), F.col("N")).alias("Ncsk_N"),
        ratio(F.col("Ncsk"), F.col("Ns")).alias("Ncsk_Ns"),
    )


def unpivot(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "property", value: str = "v") -> DataFrame:
    return df.unpivot(list(keys), list(columns), name, value)


def group_profile(df: DataFrame, columns: Sequence[str], group: str) -> DataFrame:
    """Per (property, group): n, extremes, mean, median and bias-corrected shape."""
    typed = df.select(group, *[F.col(c).cast("double").alias(c) for c in columns])
    long = unpivot(typed, [group], columns)
    n = F.count("v")
    base = long.groupBy("property", group).agg(
        n.alias("n"),
        F.max("v").alias("max"),
        F.min("v").alias("min"),
        F.avg("v").alias("mean"),
        stats.sample_skew(F.skewness("v"), n).alias("skew"),
        stats.sample_kurtosis(F.kurtosis("v"), n).alias("kurtosis"),
    )
    return base.join(quantiles(long, ["property", group], "v", {"median": 0.5}), ["property", group])


def rank_tests(long: DataFrame, keys: Sequence[str], value: str, in_first) -> DataFrame:
    """Two-sided rank test per key between rows where ``in_first`` holds and the rest.

    Ranks come from distributed running totals over distinct values, so a large
    pool is never sorted in one task.
    """
    keys = list(keys)
    one = F.when(in_first, 1).otherwise(0).cast("long")
    cells = prefix_sums(long, value, {"c1": one, "c": F.lit(1).cast("long")}, keys)
    rank = F.col("c_before") + (F.col("c") + 1) / F.lit(2.0)
    c = F.col("c").cast("double")
    sums = cells.groupBy(*keys).agg(
        F.sum("c1").alias("n1"),
        F.sum(F.col("c") - F.col("c1")).alias("n2"),
        F.sum(F.col("c1") * rank).alias("rank_sum"),
        F.sum(c * c * c - c).alias("ties"),
    )
    return sums.select(*keys, "n1", "n2", stats.mann_whitney(F.col("n1"), F.col("n2"), F.col("rank_sum"), F.col("ties")).alias("p_value"))


def group_tests(df: DataFrame, columns: Sequence[str], group: str) -> DataFrame:
    """Rank test of each property between the two groups of a table.

    A table that does not hold exactly two groups is an error.
    """
    levels = [r[0] for r in df.select(group).where(F.col(group).isNotNull()).distinct().orderBy(group).limit(3).collect()]
    if len(levels) != 2:
        raise ValueError(f"need exactly two groups in {group!r}, found {levels}")
    typed = df.select(group, *[F.col(c).cast("double").alias(c) for c in columns])
    return rank_tests(unpivot(typed, [group], columns), ["property"], "v", F.col(group) == levels[0])


def substituent_stats(series: DataFrame, positions: Sequence[str], *, value: str, min_count: int = 1) -> DataFrame:
    """Per (position, fragment): median against the rest of that position.

    The median and the ranks of "the rest" follow from the counts of the whole
    position minus the counts of the fragment, taken over distinct values: no
    position is gathered and no fragment is paired with the others.
    """
    long = unpivot(series.select(value, *[F.col(p).cast("string").alias(p) for p in positions]), [value], positions, "position", "fragment")
    long = long.where(F.col("fragment").isNotNull() & F.col(value).isNotNull()).withColumnRenamed(value, "v")
    mine = long.groupBy("position", "fragment").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("min_value"), F.max("v").alias("max_value"))
    mine = mine.where(F.col("n") >= min_count)
    mine = mine.join(quantiles(long, ["position", "fragment"], "v", {"median_value": 0.5}), ["position", "fragment"])
    others = median_without(long, mine.select("position", "fragment"))
    tests = fragment_rank_tests(long)
    out = mine.join(others, ["position", "fragment"], "left").join(tests, ["position", "fragment"], "left")
    return out.select(
        "position", "fragment", "n", "median_value", "median_other", (F.col("median_value") - F.col("median_other")).alias("delta"), "p_value", "min_value", "max_value"
    )


def fragment_rank_tests(long: DataFrame) -> DataFrame:
    """Rank test of every fragment against the rest of its position.

    Each value's pool rank depends on the position alone; the fragment needs the
    sum of the ranks of its own values.
    """
    pool = prefix_sums(long, "v", {"c": F.lit(1).cast("long")}, ["position"])
    c = F.col("c").cast("double")
    ranked = pool.select("position", "v", (F.col("c_before") + (F.col("c") + 1) / F.lit(2.0)).alias("rank"))
    totals = pool.groupBy("position").agg(F.sum("c").alias("pool"), F.sum(c * c * c - c).alias("ties"))
    own = long.withColumn("v", F.col("v").cast("double") + F.lit(0.0)).groupBy("position", "fragment", "v").agg(F.count(F.lit(1)).alias("k"))
    sums = own.join(ranked, ["position", "v"]).groupBy("position", "fragment").agg(F.sum("k").alias("n1"), F.sum(F.col("k") * F.col("rank")).alias("rank_sum"))
    # one row per position: a handful of named columns
    joined = sums.join(totals, "position").withColumn("n2", F.col("pool") - F.col("n1"))
    p = stats.mann_whitney(F.col("n1"), F.col("n2"), F.col("rank_sum"), F.col("ties"))
    # a constant pool with values on both sides says nothing: p is one
    return joined.select("position", "fragment", F.when(F.col("n2") > 0, F.coalesce(p, F.lit(1.0))).alias("p_value"))


def median_without(long: DataFrame, wanted: DataFrame) -> DataFrame:
    """Median of a position's values with one fragment left out.

    With m values left, the wanted ranks are those of the pool shifted by how
    many of the fragment's own values lie before.  Every own value v bounds a
    gap; inside a gap the shift is constant, so the pool rank is known and one
    lookup by rank gives the value.
    """
    one = F.lit(1).cast("long")
    pool = prefix_sums(long, "v", {"c": one}, ["position"])
    size = pool.groupBy("position").agg(F.max("c_total").alias("pool"))
    own_rows = long.join(wanted, ["position", "fragment"], "left_semi")
    own = prefix_sums(own_rows, "v", {"k": one}, ["position", "fragment"])
    own = own.join(pool.select("position", "v", "c", "c_before"), ["position", "v"])
    # the fragment's values between which the remaining ranks rise: rest_before(v) = c_before - k_before
    own = own.join(size, "position").withColumn("m", F.col("pool") - F.col("k_total"))
    low, high = F.floor((F.col("m") - 1) / 2), F.floor(F.col("m") / 2)
    rest_before = F.col("c_before") - F.col("k_before")
    rest_through = rest_before + F.col("c") - F.col("k")

    def shift(rank):
        # own values that lie wholly before the wanted remaining rank
        return F.coalesce(F.max(F.when(rest_through <= rank, F.col("k_before") + F.col("k"))), F.lit(0))

    def tied(rank):
        # the wanted rank falls on one of the fragment's own distinct values
        return F.max(F.when((rest_before <= rank) & (rank < rest_through), F.col("v")))

    need = own.where(F.col("m") > 0).groupBy("position", "fragment").agg(
        F.max(low + 0).alias("low"), F.max(high + 0).alias("high"), shift(low).alias("s_low"), shift(high).alias("s_high"), tied(low).alias("t_low"), tied(high).alias("t_high")
    )
    asks = need.select(
        "position",
        "fragment",
        F.explode(
            F.array(
                F.struct((F.col("low") + F.col("s_low")).alias("rank"), F.col("t_low").alias("known")),
                F.struct((F.col("high") + F.col("s_high")).alias("rank"), F.col("t_high").alias("known")),
            )
        ).alias("a"),
    ).select("position", "fragment", "a.*")
    # distinct asked ranks per position, looked up by rank range in blocks of equal size
    return value_at_rank(pool, asks)


def value_at_rank(pool: DataFrame, asks: DataFrame) -> DataFrame:
    """Mean of the values that hold the asked pool ranks (two per fragment).

    Ranges of equal values are cut at block borders, so that an ask and the
    value that covers its rank meet in one equi-join on (position, block).
    """
    width = F.lit(4096)
    spans = pool.select(
        "position",
        "v",
        F.col("c_before").alias("start"),
        (F.col("c_before") + F.col("c")).alias("stop"),
    )
    spans = spans.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("stop") - 1) / width))))
    open_asks = asks.withColumn("block", F.floor(F.col("rank") / width))
    hit = open_asks.alias("a").join(spans.alias("s"), ["position", "block"]).where((F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("stop")))
    return hit.groupBy("position", "fragment").agg(F.avg(F.coalesce("known", "v")).alias("median_other"))


def select_core_state(series: DataFrame, *, core: str, entity: str, group: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Keep the core state with most distinct entities (ties by text).

    Returns the kept rows and one row per group with the states and exclusions.
    """
    group = list(group)
    counts = series.groupBy(*group, core).agg(F.count_distinct(entity).alias("entities"), F.count(F.lit(1)).alias("rows"))
    best = (counts.groupBy(*group) if group else counts.groupBy()).agg(
        F.min(F.struct((-F.col("entities")).alias("k"), F.col(core).alias("core"))).alias("b"), F.count(F.lit(1)).alias("states"), F.sum("rows").alias("all_rows")
    )
    best = best.select(*group, F.col("b.core").alias(core), "states", "all_rows")
    kept = series.join(best.select(*group, core), [*group, core], "left_semi")
    report = best.join(counts, [*group, core]).select(*group, F.col(core).alias("chosen"), "states", "entities", (F.col("all_rows") - F.col("rows")).alias("excluded_rows"))
    return kept, report


def class_counts(df: DataFrame, class_col: str, classes: Sequence[str]) -> DataFrame:
    """Rows per class, in the given order, zero rows kept."""
    slots = F.explode(F.arrays_zip(F.array(*[F.lit(c) for c in classes]).alias("label"), F.sequence(F.lit(1), F.lit(len(classes))).alias("place")))
    counts = df.groupBy(class_col).agg(F.count(F.lit(1)).alias("n"))
    frame = counts.sparkSession.range(1).select(slots.alias("s")).select("s.label", "s.place")
    joined = frame.join(counts, frame.label == counts[class_col], "left")
    return joined.select(F.col("label").alias("activity_class"), "place", F.coalesce("n", F.lit(0)).alias("molecules"))


def most_common(df: DataFrame, column: str, k: int = 12) -> DataFrame:
    """Rows of the k most common values of a column (the chart's own selection)."""
    top = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(k)
    return df.join(F.broadcast(top.select(column)), column, "left_semi")


def histogram(df: DataFrame, value: str, *, bins: int, by: str | None = None) -> DataFrame:
    """Equal-width bins over the observed range; the last bin is closed."""
    span = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    index = F.least(F.floor(ratio(F.col(value) - F.col("lo"), F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    rows = df.where(F.col(value).isNotNull()).join(F.broadcast(span)).withColumn("bin", F.coalesce(index, F.lit(0)))
    return rows.groupBy("bin", *([by] if by else [])).agg(F.count(F.lit(1)).alias("n"), F.min(F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins).alias("bin_left"))


def similarity_histogram(df: DataFrame, similarity: str, status: str) -> DataFrame:
    left = F.least(F.floor(F.col(similarity) * 20), F.lit(19)) / F.lit(20.0)
    return df.where(F.col(similarity).isNotNull()).groupBy(left.alias("bin_left"), status).agg(F.count(F.lit(1)).alias("n")).withColumn("bin_right", F.col("bin_left") + 0.05)


def top_by_value(df: DataFrame, value: str, n: int = 4, tie: str | None = None) -> DataFrame:
    return df.orderBy(F.desc(value), *([tie] if tie else [])).limit(n)


def page(df: DataFrame, order: Sequence, number: int, size: int = 25) -> DataFrame:
    """One page of an ordered report."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def explained_variance(parts: DataFrame, order: str, share: str) -> DataFrame:
    """Running sum of the explained share over a fitted model's few components."""
    w = Window.partitionBy(F.lit(0)).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return parts.withColumn("cumulative", F.sum(share).over(w))

"""Train/test partitions that cannot leak by time, origin or group."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from measurelens.functions import scalar
from measurelens.functions.scalar import hash_long, hash_unit
from measurelens.operators.ordered import numbered


def _sides(early: DataFrame, late: DataFrame, key: str, flag: str) -> DataFrame:
    novel = late.join(early.select(key), key, "left_anti")
    return early.withColumn(flag, F.lit(False)).unionByName(novel.withColumn(flag, F.lit(True)))


def time_safe(measurements: DataFrame, curate, *, year: str, cutoff: int, key: str) -> DataFrame:
    """Split measurements by year before aggregating; test holds new entities only.

    Later records never change a training value.  ``curate`` turns measurements
    into one row per ``key``.  A missing year is an error.
    """
    checked = F.when(F.col(year).isNull(), F.raise_error(F.lit("time split needs a year for every measurement")).cast("int")).otherwise(F.col(year))
    rows = measurements.withColumn(year, checked)
    return _sides(curate(rows.where(F.col(year) <= cutoff)), curate(rows.where(F.col(year) > cutoff)), key, "is_test")


def origin_safe(measurements: DataFrame, curate, *, origin: str, held_out, key: str) -> DataFrame:
    """Split measurements by a held-out origin; entities seen elsewhere stay in train."""
    checked = F.when(F.col(origin).isNull(), F.raise_error(F.lit("origin split needs an origin for every measurement")).cast("string")).otherwise(F.col(origin).cast("string"))
    rows = measurements.withColumn("_origin", checked)
    train = curate(rows.where(F.col("_origin") != str(held_out)))
    test = curate(rows.where(F.col("_origin") == str(held_out)))
    return _sides(train, test, key, "is_test")


def singleton_groups(group: Column | str, identifier: Column | str) -> Column:
    """A row without a group forms a group of its own."""
    return F.coalesce(scalar.as_col(group).cast("string"), F.concat(F.lit("__acyclic_"), scalar.as_col(identifier).cast("string")))


def serpentine(position: Column, k: int) -> Column:
    """Deal positions 0,1,..,k-1,k-1,..,1,0,0,1,.. over k folds."""
    lap, place = F.floor(position / k), F.pmod(position, F.lit(k))
    return F.when(F.pmod(lap, F.lit(2)) == 0, place).otherwise(k - 1 - place).cast("int")


def group_folds(df: DataFrame, *, group: str, label: str, k: int, seed: int = 42, name: str = "fold") -> DataFrame:
    """Stratified k folds that never divide a group.

    Groups are ordered within their majority class by size and hash, and dealt
    back and forth over the folds.  Positions come from running totals, so no
    class is sorted in one task.
    """
    counts = df.groupBy(group, label).agg(F.count(F.lit(1)).alias("n"))
    groups = counts.groupBy(group).agg(F.max(F.struct("n", F.col(label).alias("major"))).alias("m"), F.sum("n").alias("size")).select(group, "m.major", "size")
    draw = F.floor(hash_unit(seed, F.col(group)) * F.lit(float(2**30))) / F.lit(float(2**30))
    placed = numbered(groups, ["major"], -F.col("size").cast("double") + draw, tie=[group])
    return df.join(placed.select(group, serpentine(F.col("position"), k).alias(name)), group)


def group_holdout(df: DataFrame, *, group: str, label: str, test_fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """Hold out the first of round(1/fraction) group folds."""
    k = max(2, round(1 / test_fraction))
    return group_folds(df, group=group, label=label, k=k, seed=seed).withColumn("is_test", F.col("fold") == 0).drop("fold")


def stratified_folds(df: DataFrame, *, identifier: str, label: str, k: int, seed: int = 42, name: str = "fold") -> DataFrame:
    """Stratified k folds over rows, dealt by hash order within each class."""
    placed = numbered(df, [label], hash_unit(seed, F.col(identifier)), tie=[identifier])
    return placed.withColumn(name, F.pmod(F.col("position"), F.lit(k)).cast("int")).drop("position", "position_of")


def stratified_holdout(df: DataFrame, *, identifier: str, label: str, test_fraction: float = 0.2, seed: int = 42) -> DataFrame:
    placed = numbered(df, [label], hash_unit(seed, F.col(identifier)), tie=[identifier])
    return placed.withColumn("is_test", F.col("position") < F.round(F.col("position_of") * test_fraction)).drop("position", "position_of")


def year_holdout(df: DataFrame, *, year: str, cutoff: int) -> DataFrame:
    return df.withColumn("is_test", F.col(year) > cutoff)


def expanding_year_folds(df: DataFrame, *, year: str, k: int) -> DataFrame:
    """The last k years validate in turn; all earlier rows fit.

    One row per (fold, row, role).  The fold years are k values.
    """
    years = df.select(year).distinct().orderBy(F.desc(year)).limit(k)
    folds = F.broadcast(years.withColumnRenamed(year, "fold_year"))
    joined = df.join(folds, F.col(year) <= F.col("fold_year"))
    return joined.withColumn("role", F.when(F.col(year) == F.col("fold_year"), "validate").otherwise("fit"))


def expanding_fold_check(df: DataFrame, *, year: str, label: str, k: int) -> DataFrame:
    """Per fold year: fit rows, validation rows and fit classes, from yearly counts."""
    cells = df.groupBy(year, label).agg(F.count(F.lit(1)).alias("n"))
    folds = expanding_year_folds(cells, year=year, k=k)
    fit = F.col("role") == "fit"
    return folds.groupBy("fold_year").agg(
        F.coalesce(F.sum(F.when(fit, F.col("n"))), F.lit(0)).alias("fit_rows"),
        F.coalesce(F.sum(F.when(~fit, F.col("n"))), F.lit(0)).alias("validation_rows"),
        F.count_distinct(F.when(fit, F.col(label))).alias("fit_classes"),
    )


def leave_one_out(df: DataFrame, *, identifier: str, split: str = "random") -> DataFrame:
    """Fold = the row's own id; refused where it would cross a group boundary."""
    if split != "random":
        raise ValueError("leave-one-out must not bypass group, origin or time boundaries")
    return df.withColumn("fold", F.col(identifier))


def oversample(df: DataFrame, *, identifier: str, label: str, seed: int = 42) -> DataFrame:
    """Add seeded copies of minority rows until every class matches the largest.

    A class draws with replacement: the copies are spread over chunks of a
    thousand draws, and each draw picks a member by its position in hash order.
    """
    placed = numbered(df, [label], hash_unit(seed, F.col(identifier)), tie=[identifier])
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    goal = sizes.agg(F.max("n").alias("goal"))
    missing = sizes.join(F.broadcast(goal)).select(label, "n", (F.col("goal") - F.col("n")).alias("missing")).where(F.col("missing") > 0)
    chunks = missing.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("missing") - 1) / 1000))))
    first = F.col("chunk") * 1000
    draws = chunks.withColumn("draw", F.explode(F.sequence(first, F.least(first + 999, F.col("missing") - 1))))
    picked = draws.select(label, "draw", F.floor(hash_unit(seed, "draw", F.col(label), F.col("draw")) * F.col("n")).alias("position"))
    copies = picked.join(placed, [label, "position"])
    return placed.withColumn("copy", F.lit(0).cast("long")).unionByName(copies.withColumn("copy", F.col("draw") + 1).drop("draw")).drop("position", "position_of")


def sample_rows(df: DataFrame, *, identifier: str, fraction: float, seed: int = 42) -> DataFrame:
    """A seeded uniform sample without replacement: about this share of the rows, whatever their number."""
    return df.where(hash_unit(seed, F.col(identifier)) < fraction)


def split_mapping_check(table: DataFrame, mapping: DataFrame, *, identifier: str, side: str) -> DataFrame:
    """Expectations on a prescribed split: complete, unique, both sides present."""
    per_id = mapping.groupBy(identifier).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(side).alias("sides"))
    joined = table.select(identifier).distinct().withColumn("_t", F.lit(1)).join(per_id, identifier, "full_outer")
    return joined.agg(
        F.count_if(F.col("n").isNull()).alias("unassigned"),
        F.count_if(F.col("_t").isNull()).alias("unknown"),
        F.count_if(F.col("n") > 1).alias("assigned_twice"),
        F.count_if(F.col("sides") > 1).alias("on_both_sides"),
    )


def partition_audit(df: DataFrame, *, flag: str, keys: dict[str, str]) -> DataFrame:
    """Per key column: distinct keys on each side, and keys on both sides."""
    out = None
    for name, column in keys.items():
        per_key = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.max(F.col(flag).cast("int")).alias("hi"), F.min(F.col(flag).cast("int")).alias("lo"), F.count(F.lit(1)).alias("n"))
        row = per_key.agg(
            F.count_if(F.col("lo") == 0).alias("train_keys"),
            F.count_if(F.col("hi") == 1).alias("test_keys"),
            F.count_if((F.col("lo") == 0) & (F.col("hi") == 1)).alias("shared_keys"),
            F.count_if(F.col("n") > 1).alias("repeated_keys"),
        ).select(F.lit(name).alias("audit"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def modelability(df: DataFrame, *, label: str, group: str, k: int, test_fraction: float = 0.2, split: str = "scaffold") -> DataFrame:
    """Why a model step cannot run, or an empty reason, from class and group counts."""
    classes = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("classes"), F.min("n").alias("smallest"))
    per_group = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    groups = per_group.agg(F.count_if(F.col(group).isNotNull()).alias("named"), F.coalesce(F.sum(F.when(F.col(group).isNull(), F.col("n"))), F.lit(0)).alias("lone"))
    one = classes.join(F.broadcast(groups)).withColumn("groups", F.col("named") + F.col("lone"))
    needed = max(max(2, round(1 / test_fraction)), math.ceil(k / (1 - test_fraction)))
    reason = F.when(F.col("classes") < 2, "every row falls in one class")
    if split not in ("time", "source"):
        reason = reason.when(F.col("smallest") < k, F.concat(F.lit("the smallest class has "), F.col("smallest").cast("string"), F.lit(f" rows, fewer than the {k} folds")))
    if split == "scaffold":
        reason = reason.when(F.col("groups") < needed, F.concat(F.lit(f"the split needs about {needed} groups and this table has "), F.col("groups").cast("string")))
    return one.select("classes", "smallest", "groups", reason.otherwise("").alias("reason"))


def nested_plan(df: DataFrame, *, group: str, label: str, test_fraction: float, k: int, inner_k: int | None = None, seed: int = 42) -> DataFrame:
    """Hold-out, outer fold and (with ``inner_k``) inner fold of every row, all by whole groups.

    The inner folds are dealt once over the training rows; inside an outer part they
    are the folds of the rows that are left.
    """
    outer = group_holdout(df, group=group, label=label, test_fraction=test_fraction, seed=seed)
    train = group_folds(outer.where(~F.col("is_test")), group=group, label=label, k=k, seed=seed + 1, name="outer_fold")
    if inner_k:
        train = group_folds(train, group=group, label=label, k=inner_k, seed=seed + 2, name="inner_fold")
    return train.unionByName(outer.where("is_test"), allowMissingColumns=True)


def plan_sizes(plan: DataFrame, *, k: int, group: str, min_train: int = 15, min_test: int = 3, min_inner: int = 5) -> DataFrame:
    """Sizes of every partition of a nested plan against the required minimum."""
    cells = plan.groupBy("is_test", "outer_fold").agg(F.count(F.lit(1)).alias("n"))
    train = ~F.col("is_test")
    sums = [F.sum(F.when(train, F.col("n")).otherwise(0)).alias("train"), F.sum(F.when(~train, F.col("n")).otherwise(0)).alias("test")]
    for f in range(k):
        sums.append(F.sum(F.when(train & (F.col("outer_fold") != f), F.col("n")).otherwise(0)).alias(f"fit{f}"))
    one = cells.agg(*sums)
    rows = [("train", F.col("train"), min_train), ("test", F.col("test"), min_test)] + [(f"outer fold {f} fit", F.col(f"fit{f}"), min_inner) for f in range(k)]
    structs = [F.struct(F.lit(n).alias("partition"), c.alias("rows"), F.lit(m).alias("minimum"), (c >= m).alias("passed")) for n, c, m in rows]
    return one.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def novel_keys(later: DataFrame, earlier: DataFrame, key: str) -> DataFrame:
    """Keys of the later table that the earlier one has never seen."""
    return later.select(key).distinct().join(earlier.select(key), key, "left_anti")


def drop_class(df: DataFrame, column: str, label: str) -> DataFrame:
    """Leave one class out of modelling."""
    return df.where(F.col(column) != label)


def subset(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")

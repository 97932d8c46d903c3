"""From raw records to one value per entity, with a log of what each step removed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from measurelens.functions import scalar, variants
from measurelens.operators.ordered import quantiles


@dataclass(frozen=True)
class CurationRules:
    """What to keep.  ``None`` means the filter is off (it is still logged)."""

    standard_types: Sequence[str] = ("IC50",)
    relations: Sequence[str] = ("=",)
    units: Sequence[str] = ("nM",)
    assay_types: Sequence[str] = ("B",)
    source_ids: Sequence[int] | None = None
    variant: str | None = None
    drop_duplicates: bool = True
    drop_flagged: bool = True
    formats: Sequence[str] | None = None
    assay_ids: Sequence[str] | None = None
    min_confidence: int | None = None
    max_year: int | None = None
    aggregate: str = "median"
    max_replicate_range: float | None = None
    bins: Sequence[tuple[str, float]] = field(default=scalar.DEFAULT_BINS)
    floor: str = scalar.DEFAULT_FLOOR
    group1: Sequence[str] = scalar.DEFAULT_GROUP1

    def check(self) -> None:
        unknown = [u for u in self.units if u not in scalar.MOLAR_OFFSETS]
        if unknown:
            raise ValueError(f"cannot convert units {unknown} to a molar scale")
        if self.min_confidence is not None and not 0 <= self.min_confidence <= 9:
            raise ValueError("min_confidence must be between 0 and 9")


# The filter names, in the order in which they are applied and logged.
STEPS = (
    "standard_type",
    "relation",
    "units",
    "assay_type",
    "source_origin",
    "variant",
    "potential_duplicate",
    "validity",
    "bao_format",
    "assay_id",
    "target_confidence",
    "document_year",
    "structure",
    "value",
)


def record_predicates(rules: CurationRules) -> dict[str, Column]:
    """One boolean per step over the raw record columns; null counts as failing."""
    rules.check()
    on = F.lit(True)

    def in_list(name: str, allowed: Sequence | None) -> Column:
        return on if allowed is None else F.col(name).isin(list(allowed))

    number = scalar.finite_number("standard_value")
    flagged = F.length(F.col("data_validity_comment")) > 0
    tests = {
        "standard_type": in_list("standard_type", rules.standard_types),
        "relation": in_list("standard_relation", rules.relations),
        "units": in_list("standard_units", rules.units),
        "assay_type": in_list("assay_type", rules.assay_types),
        "source_origin": on if rules.source_ids is None else scalar.origin_id("src_id").isin(list(rules.source_ids)),
        "variant": variants.matches(rules.variant, "assay_variant_mutation"),
        "potential_duplicate": ~F.coalesce(F.col("potential_duplicate") == 1, F.lit(False)) if rules.drop_duplicates else on,
        "validity": ~F.coalesce(flagged, F.lit(False)) if rules.drop_flagged else on,
        "bao_format": in_list("bao_label", rules.formats),
        "assay_id": in_list("assay_chembl_id", rules.assay_ids),
        "target_confidence": on if rules.min_confidence is None else scalar.finite_number("confidence_score") >= rules.min_confidence,
        "document_year": on if rules.max_year is None else F.col("document_year") <= rules.max_year,
        "structure": F.length("canonical_smiles") > 0,
        "value": number > 0,
    }
    return {name: F.coalesce(tests[name], F.lit(False)) for name in STEPS}


def mark_first_failure(records: DataFrame, predicates: Mapping[str, Column], name: str = "failed_step") -> DataFrame:
    """Add the index of the first predicate a row fails (their number if none)."""
    failed = F.lit(len(predicates))
    for i, predicate in reversed(list(enumerate(predicates.values()))):
        failed = F.when(~predicate, F.lit(i)).otherwise(failed)
    return records.withColumn(name, failed)


def filter_records(records: DataFrame, rules: CurationRules) -> DataFrame:
    """Measurements that pass every filter, converted to the log molar scale."""
    keep = F.lit(True)
    for predicate in record_predicates(rules).values():
        keep = keep & predicate
    entity = scalar.effective_id("parent_molecule_chembl_id", "molecule_chembl_id")
    return records.where(keep).select(
        entity.alias("molecule_id"),
        F.col("canonical_smiles").alias("smiles"),
        scalar.log_molar(scalar.finite_number("standard_value"), "standard_units").alias("pactivity"),
        F.col("activity_id").cast("string").alias("record_id"),
        *[c for c in records.columns if c not in ("molecule_chembl_id", "parent_molecule_chembl_id", "canonical_smiles", "activity_id", "pactivity")],
    )


def curation_log(records: DataFrame, predicates: Mapping[str, Column], entity: Column | str) -> DataFrame:
    """Per step: records in and out, and distinct entities among the survivors.

    One scan: an entity survives a step when its best record does, so the
    distinct counts come from the maximum failure index of each entity.
    """
    names = list(predicates)
    entity = scalar.as_col(entity)
    marked = mark_first_failure(records.withColumn("_entity", entity), predicates)
    per_pair = marked.groupBy("_entity", "failed_step").agg(F.count(F.lit(1)).alias("n"))
    rows = per_pair.groupBy("failed_step").agg(F.sum("n").alias("rows"), F.lit(0).cast("long").alias("entities"))
    best = per_pair.groupBy("_entity").agg(F.max("failed_step").alias("failed_step"))
    ids = best.groupBy("failed_step").agg(F.lit(0).cast("long").alias("rows"), F.count(F.lit(1)).alias("entities"))
    histogram = rows.unionByName(ids)
    # at most len(names) + 1 histogram rows per side: every step sums those that reach it
    steps = F.explode(F.arrays_zip(F.sequence(F.lit(0), F.lit(len(names) - 1)).alias("i"), F.array(*[F.lit(n) for n in names]).alias("name")))
    at = F.col("s.i")
    return (
        histogram.select("*", steps.alias("s"))
        .groupBy(at.alias("step"), F.col("s.name").alias("name"))
        .agg(
            F.sum(F.when(F.col("failed_step") >= at, F.col("rows")).otherwise(0)).alias("records_in"),
            F.sum(F.when(F.col("failed_step") > at, F.col("rows")).otherwise(0)).alias("records_out"),
            F.sum(F.when(F.col("failed_step") > at, F.col("entities")).otherwise(0)).alias("molecules_out"),
        )
        .withColumn("removed", F.col("records_in") - F.col("records_out"))
    )


def standardise(measurements: DataFrame, mapping: DataFrame, *, on: str = "smiles") -> tuple[DataFrame, DataFrame]:
    """Apply a supplied (structure -> standard structure, key, reason) mapping.

    Returns the accepted measurements and the rejected (id, structure, reason).
    The mapping has one row per distinct structure; a missing one is a reject.
    """
    joined = measurements.join(mapping, on, "left")
    reason = F.coalesce(F.col("reason"), F.when(F.col("std_structure").isNull(), F.lit("no standard structure")))
    joined = joined.withColumn("reason", reason)
    accepted = joined.where(F.col("reason").isNull()).drop("reason")
    rejected = joined.where(F.col("reason").isNotNull()).select("molecule_id", on, "reason").distinct()
    return accepted.withColumn("key", F.coalesce("key", "std_structure")), rejected


def aggregate_replicates(
    measurements: DataFrame,
    *,
    key: str,
    entity: str,
    value: str,
    carry: Sequence[str] = (),
    order: Sequence[str] = (),
    year: str | None = None,
    how: str = "median",
    list_ids: bool = True,
) -> DataFrame:
    """One row per key: representative id, median or mean value, count, range, first year.

    The representative is the smallest id by (length, text); ``carry`` columns
    come from its first record in ``order``.  ``merged_ids`` lists the distinct
    ids of an entity, which are collapsed before they are gathered.
    """
    v = F.col(value)
    rows = measurements.where(F.col(key).isNotNull())
    first = F.struct(F.length(entity).alias("len"), F.col(entity).alias("id"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], *[F.col(c) for c in carry])
    # per (key, id) first: it combines on the map side and spreads a hot key over its ids
    per_id = rows.groupBy(key, entity).agg(
        F.min(first).alias("first"),
        F.count(v).alias("n"),
        F.sum(v).alias("total"),
        F.min(v).alias("low"),
        F.max(v).alias("high"),
        (F.min(year) if year else F.lit(None).cast("int")).alias("year"),
    )
    gathered = [F.collect_list(F.struct("first.len", "first.id")).alias("ids")] if list_ids else []
    base = per_id.groupBy(key).agg(
        F.min("first").alias("first"),
        F.count(F.lit(1)).alias("n_ids"),
        F.sum("n").alias("n_measurements"),
        F.sum("total").alias("total"),
        (F.max("high") - F.min("low")).alias("value_range"),
        F.min("year").alias("year"),
        *gathered,
    )
    if how == "mean":
        base = base.withColumn("value", F.col("total") / F.col("n_measurements"))
    elif how == "median":
        base = base.join(quantiles(rows, [key], value, {"value": 0.5}), key, "left")
    else:
        raise ValueError("aggregate with 'median' or 'mean'")
    merged = F.array_join(F.transform(F.array_sort("ids"), lambda s: s["id"]), ";").alias("merged_ids")
    return base.select(
        key,
        F.col("first.id").alias("molecule_id"),
        *([merged] if list_ids else []),
        *[F.col(f"first.{c}").alias(c) for c in carry],
        F.col("value"),
        "n_ids",
        "n_measurements",
        "value_range",
        "year",
    )


def replicate_range_filter(entities: DataFrame, limit: float | None) -> DataFrame:
    return entities if limit is None else entities.where(F.col("value_range") <= F.lit(float(limit)))


def classify(entities: DataFrame, rules: CurationRules = CurationRules(), value: str = "value") -> DataFrame:
    """Add the value class and its group."""
    label = scalar.value_class(value, rules.bins, rules.floor)
    return entities.withColumn("activity_class", label).withColumn("group", scalar.class_group("activity_class", rules.group1))


def stage_log(measurements: DataFrame, accepted: DataFrame, entities: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """Log rows of the stages after the record filters."""

    def row(step: int, name: str, before: DataFrame, after: DataFrame, ids: Column) -> DataFrame:
        left = before.agg(F.count(F.lit(1)).alias("records_in"))
        right = after.agg(F.count(F.lit(1)).alias("records_out"), ids.alias("molecules_out"))
        return left.join(F.broadcast(right)).select(F.lit(step).alias("step"), F.lit(name).alias("name"), "*")

    log = row(len(STEPS), "standardisation", measurements, accepted, F.count_distinct("molecule_id"))
    log = log.unionByName(row(len(STEPS) + 1, "aggregation", accepted, entities, F.count(F.lit(1))))
    if kept is not None:
        log = log.unionByName(row(len(STEPS) + 2, "replicate_range", entities, kept, F.count(F.lit(1))))
    return log.withColumn("removed", F.col("records_in") - F.col("records_out"))


def curate(measurements: DataFrame, rules: CurationRules = CurationRules(), **columns) -> DataFrame:
    """Replicates -> one value per entity -> range filter -> class and group."""
    entities = aggregate_replicates(measurements, how=rules.aggregate, **columns)
    return classify(replicate_range_filter(entities, rules.max_replicate_range), rules)

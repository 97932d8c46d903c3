"""Measurement-level views: lineage, contexts, origins, breakdowns and input checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from measurelens.functions import scalar, variants
from measurelens.operators.common import stack_rows
from measurelens.operators.ordered import quantiles


def lineage(measurements: DataFrame, entities: DataFrame, *, key: str) -> DataFrame:
    """Each retained measurement under its curated id, with record addresses.

    The entity key travels with the measurement, so no list of merged ids is
    taken apart again.  Measurements of dropped entities disappear.
    """
    ids = entities.select(key, F.col("molecule_id").alias("curated_id"))
    joined = measurements.withColumnRenamed("molecule_id", "source_molecule_id").join(ids, key)
    out = joined.withColumnRenamed("curated_id", "molecule_id").withColumn(
        "activity_url", scalar.record_url("activity", "record_id", digits_only=True)
    )
    for kind in ("assay", "document"):
        column = f"{kind}_chembl_id"
        if column in measurements.columns:
            out = out.withColumn(f"{kind}_url", scalar.record_url(kind, column))
    return out


def value_breakdown(df: DataFrame, field: str) -> DataFrame:
    """Records and share per value of a field, nulls shown as "(none)"."""
    counts = df.groupBy(F.coalesce(F.col(field).cast("string"), F.lit("(none)")).alias("value")).agg(F.count(F.lit(1)).alias("records"))
    total = df.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("total"))
    return counts.join(F.broadcast(total)).select("value", "records", (F.col("records") / F.col("total")).alias("share"))


def field_summary(df: DataFrame, fields: Sequence[str], top: int = 6) -> DataFrame:
    """One line per field: its most common values and how many more there are."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f).cast("string"), F.lit("(none)")).alias("value")) for f in fields]))
    counts = df.select(pairs.alias("p")).groupBy("p.field", "p.value").agg(F.count(F.lit(1)).alias("n"))
    # the heads are taken per field and chunk first, so no task ranks all values of a field
    chunk = F.pmod(F.xxhash64("value"), F.lit(64))
    rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "value"))
    head = counts.withColumn("_r", rank("field", chunk)).where(F.col("_r") <= top)
    head = head.withColumn("_r", rank("field")).where(F.col("_r") <= top)
    lines = head.groupBy("field").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "value", "n"))), lambda s: F.concat(s["value"], F.lit(": "), s["n"].cast("string"))), ", ").alias("cells")
    )
    sizes = counts.groupBy("field").agg(F.count(F.lit(1)).alias("distinct_values"))
    more = F.when(F.col("distinct_values") > top, F.concat(F.lit(" (+"), (F.col("distinct_values") - top).cast("string"), F.lit(" more)"))).otherwise("")
    return lines.join(sizes, "field").select("field", F.concat("cells", more).alias("summary"), "distinct_values")


def assay_overview(evidence: DataFrame, fields: Sequence[str], *, record: str, entity: str) -> DataFrame:
    """Records and distinct entities per combination of context fields (nulls kept)."""
    return evidence.groupBy(*fields).agg(F.count(F.lit(1)).alias("records"), F.count_distinct(F.col(entity)).alias("molecules"))


def exact_records(evidence: DataFrame, *, relation: str | None = "standard_relation") -> DataFrame:
    return evidence if relation is None else evidence.where(F.col(relation) == "=")


def assay_contexts(evidence: DataFrame, *, assay: str, endpoint: str, variant: str, entity: str, relation: str | None = "standard_relation") -> DataFrame:
    """(assay, endpoint, variant scope) with distinct compounds and record counts."""
    rows = exact_records(evidence.dropna(subset=[assay, endpoint]), relation=relation)
    rows = rows.withColumn("variant_scope", variants.scope(variant))
    return rows.groupBy(assay, endpoint, "variant_scope").agg(F.count_distinct(entity).alias("compounds"), F.count(F.lit(1)).alias("records"))


def drop_record_copies(evidence: DataFrame, columns: Sequence[str], *, record: str) -> DataFrame:
    """Drop copies of one identified record; rows without a record id all stay.

    Equal values of different records are never treated as copies.
    """
    named = ~F.coalesce(F.trim(F.col(record)), F.lit("")).isin("", "None", "nan", "Unreported")
    salt = F.when(named, F.lit(None)).otherwise(F.monotonically_increasing_id())
    return evidence.withColumn("_copy", salt).dropDuplicates([*columns, record, "_copy"]).drop("_copy")


def context_values(evidence: DataFrame, *, entity: str, record: str, value: str, scope: Column, relation: str | None = "standard_relation") -> DataFrame:
    """Re-aggregate one context: median, count and range per entity.

    ``scope`` selects the (assay, endpoint, variant) to use.
    """
    rows = exact_records(evidence.where(F.coalesce(scope, F.lit(False))), relation=relation)
    rows = rows.withColumn(value, scalar.finite_number(value)).where(F.col(value).isNotNull())
    rows = rows.dropDuplicates([entity, record, value])
    base = rows.groupBy(entity).agg(F.count(F.lit(1)).alias("n_measurements"), (F.max(value) - F.min(value)).alias("value_range"))
    return base.join(quantiles(rows, [entity], value, {"value": 0.5}), entity)


def origin_summary(evidence: DataFrame, *, origin: str, entity: str, assay: str) -> DataFrame:
    """Per origin: records, entities, assays, and entities also seen elsewhere."""
    rows = evidence.select(
        scalar.origin_id(origin).alias("src_id"), scalar.origin_name(origin).alias("source"), F.col(entity).alias("_e"), F.col(assay).alias("_a")
    )
    per_entity = rows.groupBy("src_id", "source", "_e").agg(F.count(F.lit(1)).alias("n"))
    spread = per_entity.groupBy("_e").agg(F.count_distinct("source").alias("sources"))
    by_entity = per_entity.join(spread, "_e", "left").groupBy("src_id", "source").agg(
        F.sum("n").alias("records"),
        F.count("_e").alias("molecules"),
        F.count_if((F.col("sources") > 1) & F.col("_e").isNotNull()).alias("shared_molecules"),
    )
    assays = rows.groupBy("src_id", "source").agg(F.count_distinct("_a").alias("assays"))
    b, a = by_entity.alias("b"), assays.alias("a")
    same = F.col("b.src_id").eqNullSafe(F.col("a.src_id")) & (F.col("b.source") == F.col("a.source"))
    return b.join(a, same).select("b.src_id", "b.source", "records", "molecules", "assays", "shared_molecules")


def origin_disagreement(evidence: DataFrame, *, origin: str, entity: str, value: str, endpoint: str) -> DataFrame:
    """Entities measured in several origins: medians per origin and their spread."""
    rows = evidence.select(F.col(entity).alias("molecule_id"), scalar.origin_name(origin).alias("source"), F.col(value).alias("v"), F.col(endpoint).alias("endpoint"))
    rows = rows.where(F.col("molecule_id").isNotNull())
    medians = quantiles(rows, ["molecule_id", "source"], "v", {"median": 0.5})
    # an entity has at most as many entries here as there are origins
    per_entity = medians.groupBy("molecule_id").agg(
        F.count(F.lit(1)).alias("origin_count"),
        F.array_sort(F.collect_list(F.struct("source", "median"))).alias("entries"),
        (F.max("median") - F.min("median")).alias("spread"),
    ).where(F.col("origin_count") > 1)
    counts = rows.groupBy("molecule_id").agg(F.count(F.lit(1)).alias("measurements"))
    kinds = rows.where(F.col("endpoint").isNotNull()).select("molecule_id", "endpoint").distinct()
    kinds = kinds.groupBy("molecule_id").agg(F.array_join(F.array_sort(F.collect_list("endpoint")), "; ").alias("endpoint_types"))
    return (
        per_entity.join(counts, "molecule_id")
        .join(kinds, "molecule_id", "left")
        .select(
            "molecule_id",
            F.array_join(F.transform("entries", lambda e: e["source"]), "; ").alias("origins"),
            "origin_count",
            "measurements",
            F.coalesce("endpoint_types", F.lit("")).alias("endpoint_types"),
            F.array_join(F.transform("entries", lambda e: F.concat(e["source"], F.lit(": "), F.printf(F.lit("%.2f"), e["median"]))), "; ").alias("source_medians"),
            "spread",
        )
    )


def rule_counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Violations of per-row rules, all counted in one aggregate."""
    one = df.agg(*[F.count_if(F.coalesce(bad, F.lit(False))).alias(f"r{i}") for i, bad in enumerate(rules.values())])
    return stack_rows(one, [{"rule": F.lit(name), "violations": F.col(f"r{i}")} for i, name in enumerate(rules)])


def mixed_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A violation per context column that holds more than one value."""
    one = df.agg(*[F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("Unreported"))).alias(f"r{i}") for i, c in enumerate(columns)])
    return stack_rows(one, [{"rule": F.lit(f"mixed {c}"), "violations": F.greatest(F.col(f"r{i}") - 1, F.lit(0)).cast("long")} for i, c in enumerate(columns)])


def ambiguous_keys(df: DataFrame, key: str, columns: Sequence[str], rule: str) -> DataFrame:
    """Count keys that carry more than one combination of the columns."""
    distinct = df.where(F.col(key).isNotNull()).select(key, *columns).distinct()
    per_key = distinct.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(F.count_if(F.col("n") > 1).alias("violations")).select(F.lit(rule).alias("rule"), "violations")


def repeated_keys(df: DataFrame, key: str, rule: str) -> DataFrame:
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(F.count_if(F.col("n") > 1).alias("violations")).select(F.lit(rule).alias("rule"), "violations")


def unmatched_ids(left: DataFrame, right: DataFrame, key: str, rule: str) -> DataFrame:
    """Ids present on one side only."""
    a = left.select(key).distinct().withColumn("_l", F.lit(1))
    b = right.select(key).distinct().withColumn("_r", F.lit(1))
    both = a.join(b, key, "full_outer")
    return both.agg(F.count_if(F.col("_l").isNull() | F.col("_r").isNull()).alias("violations")).select(F.lit(rule).alias("rule"), "violations")


def median_mismatch(table: DataFrame, evidence: DataFrame, *, entity: str, value: str, record: str, rule: str, tolerance: float = 1e-9) -> DataFrame:
    """Entities whose table value is not the median of their evidence."""
    rows = evidence.dropDuplicates([entity, record, value])
    medians = quantiles(rows, [entity], value, {"_median": 0.5})
    joined = table.join(medians, entity)
    bad = F.abs(F.col(value) - F.col("_median")) > tolerance
    return joined.agg(F.count_if(bad).alias("violations")).select(F.lit(rule).alias("rule"), "violations")


def variant_evidence(evidence: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct variant evidence rows."""
    return evidence.select(*columns).distinct()


def filtered_medians(evidence: DataFrame, members: DataFrame, filters: dict, *, entity: str, value: str) -> DataFrame:
    """Members with the median of the records that pass the facet filters."""
    rows = evidence.join(members.select(entity).distinct(), entity, "left_semi").where(scalar.facet_filter(filters))
    rows = rows.withColumn(value, scalar.finite_number(value)).where(F.col(value).isNotNull())
    medians = quantiles(rows, [entity], value, {"_median": 0.5})
    return members.drop(value).join(medians.withColumnRenamed("_median", value), entity)


def curate_outcomes(calls: DataFrame, structures: DataFrame, *, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """Active/inactive calls per structure; contradictory structures are dropped.

    ``calls`` has (cid, outcome); ``structures`` maps cid to a structure key.
    Returns the curated table and one row of audit counters.
    """
    label = F.lower(F.trim(F.coalesce("outcome", F.lit(""))))
    rows = calls.withColumn("outcome", label).join(structures, "cid", "left")
    binary = F.col("outcome").isin("active", "inactive")
    usable = binary & F.col(key).isNotNull()
    # few values per (key, cid): a structure's ids are collapsed before they are listed
    per_id = rows.where(usable).groupBy(key, "cid").agg(F.min("outcome").alias("lo"), F.max("outcome").alias("hi"), F.count(F.lit(1)).alias("n"))
    grouped = per_id.groupBy(key).agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n_calls"), F.min("cid").alias("cid"), F.array_sort(F.collect_list("cid")).alias("cids")
    )
    table = grouped.where(F.col("lo") == F.col("hi")).select("cid", F.array_join(F.transform("cids", lambda c: c.cast("string")), ";").alias("cids"), key, F.col("lo").alias("outcome"), "n_calls")
    audit = rows.agg(
        F.count(F.lit(1)).alias("raw_calls"),
        F.count_if(~binary).alias("nonbinary_outcome"),
        F.count_if(binary & F.col(key).isNull()).alias("missing_cid_or_structure"),
    )
    conflicts = grouped.agg(F.count_if(F.col("lo") != F.col("hi")).alias("conflicting_structures"), F.count_if(F.col("lo") == F.col("hi")).alias("curated_compounds"))
    return table, audit.join(F.broadcast(conflicts))

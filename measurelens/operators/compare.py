"""Two panels side by side: shared entities, shared groups, coverage, contacts, parity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from measurelens.functions import scalar
from measurelens.functions.stats import ratio
from measurelens.operators.common import shared_elements, stack_rows
from measurelens.operators.ordered import quantiles


def shared_entities(a: DataFrame, b: DataFrame, *, key: str, value_a: str, value_b: str) -> DataFrame:
    """Entities measured on both panels, with their difference and preference."""
    joined = a.join(b, key)
    columns = scalar.selectivity_columns(value_a, value_b)
    return joined.select(
        "*",
        columns["delta"].alias("delta_a_minus_b"),
        columns["ratio"].alias("ratio_a_over_b"),
        columns["preferred"].alias("preferred"),
    )


def _side(df: DataFrame, scaffold: str, value: str, group: str, suffix: str) -> DataFrame:
    rows = df.where(F.col(scaffold).isNotNull())
    base = rows.groupBy(scaffold).agg(
        F.count(F.lit(1)).alias(f"n_{suffix}"), ratio(F.count_if(F.col(group) == 1), F.count(F.lit(1))).alias(f"active_fraction_{suffix}")
    )
    return base.join(quantiles(rows, [scaffold], value, {f"median_{suffix}": 0.5}), scaffold)


def shared_groups(a: DataFrame, b: DataFrame, shared: DataFrame, *, scaffold: str, value_a: str, value_b: str, group_a: str, group_b: str) -> DataFrame:
    """Groups present on both panels: activity shares, enrichment and selectivity."""
    sides = _side(a, scaffold, value_a, group_a, "a").join(_side(b, scaffold, value_b, group_b, "b"), scaffold)
    rows = shared.where(F.col(scaffold).isNotNull())
    delta = rows.groupBy(scaffold).agg(F.count(F.lit(1)).alias("shared_compounds"))
    delta = delta.join(quantiles(rows, [scaffold], "delta_a_minus_b", {"median_delta": 0.5}), scaffold)
    bases = a.agg(ratio(F.count_if(F.col(group_a) == 1), F.count(F.lit(1))).alias("base_a")).join(
        F.broadcast(b.agg(ratio(F.count_if(F.col(group_b) == 1), F.count(F.lit(1))).alias("base_b")))
    )
    joined = sides.join(delta, scaffold, "left").join(F.broadcast(bases))
    ea, eb = ratio(F.col("active_fraction_a"), F.col("base_a")), ratio(F.col("active_fraction_b"), F.col("base_b"))
    return joined.select(
        F.col(scaffold).alias("scaffold"),
        "n_a",
        "n_b",
        "median_a",
        "median_b",
        "active_fraction_a",
        "active_fraction_b",
        "shared_compounds",
        "median_delta",
        (F.col("active_fraction_a") - F.col("active_fraction_b")).alias("fraction_delta"),
        ea.alias("enrichment_a"),
        eb.alias("enrichment_b"),
        (ea - eb).alias("enrichment_delta"),
        scalar.enriched_side(ea, eb).alias("enriched_target"),
    )


def require_unique(df: DataFrame, key: str, side: str) -> DataFrame:
    """Fail, when the plan runs, on a key that occurs twice."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in df.columns if c != key])
    checked = F.when(F.col("_n") == 1, F.col(key)).otherwise(F.raise_error(F.lit(f"{side}: a key occurs more than once")).cast(df.schema[key].dataType))
    return per_key.select(checked.alias(key), *[c for c in df.columns if c != key])


def activity_matrix(a: DataFrame, b: DataFrame, *, key: str, value_a: str, value_b: str, label_a: str, label_b: str) -> DataFrame:
    """Full outer view of both panels; a missing value stays unknown."""
    left, right = require_unique(a, key, "a"), require_unique(b, key, "b")
    joined = left.join(right, key, "full_outer")
    on_a, on_b = F.col(value_a).isNotNull(), F.col(value_b).isNotNull()
    return joined.withColumns(
        {
            "structure": F.coalesce(label_a, label_b),
            "measured_on_a": on_a,
            "measured_on_b": on_b,
            "coverage": F.when(on_a & on_b, "both").when(on_a, "A only").otherwise("B only"),
        }
    )


def context_sets(evidence: DataFrame, *, entity: str, fields: dict[str, str]) -> DataFrame:
    """Distinct values of each context field per entity, sorted.

    Pairs are collapsed before they are listed; ``fields`` maps result names to
    columns.
    """
    out = None
    for name, column in fields.items():
        distinct = evidence.where(F.col(column).isNotNull()).select(entity, F.col(column).cast("string").alias("_x")).distinct()
        part = distinct.groupBy(entity).agg(F.array_sort(F.collect_list("_x")).alias(name))
        out = part if out is None else out.join(part, entity, "full_outer")
    return out


def context_quality(pairs: DataFrame, sets_a: DataFrame, sets_b: DataFrame, *, id_a: str, id_b: str, entity: str) -> DataFrame:
    """Grade how comparable two entities' measurement contexts are.

    Endpoint and format sets decide by their size and first member; documents
    are compared by an equi-join on (pair, document) rather than by list.
    """
    a = sets_a.select(F.col(entity).alias(id_a), *[F.col(c).alias(f"{c}_a") for c in sets_a.columns if c != entity])
    b = sets_b.select(F.col(entity).alias(id_b), *[F.col(c).alias(f"{c}_b") for c in sets_b.columns if c != entity])
    joined = pairs.join(a, id_a, "left").join(b, id_b, "left")

    def one_and_same(name: str) -> Column:
        return F.coalesce((F.size(f"{name}_a") == 1) & (F.col(f"{name}_a") == F.col(f"{name}_b")), F.lit(False))

    return joined.withColumn(
        "assay_context",
        F.when(~one_and_same("endpoint"), "endpoint mismatch or pooling")
        .when(~one_and_same("format"), "assay-format mismatch or pooling")
        .when(shared_elements(F.col("document_a"), F.col("document_b")), "same endpoint, format and document")
        .otherwise("same endpoint and format; different documents"),
    )


def contact_changes(a: DataFrame, b: DataFrame, *, keys: Sequence[str], distance: str) -> DataFrame:
    """Contacts kept, lost or gained between two states, with the closest distance."""
    left = a.groupBy(*keys).agg(F.min(distance).alias("distance_a"), F.lit(True).alias("in_a"))
    right = b.groupBy(*keys).agg(F.min(distance).alias("distance_b"), F.lit(True).alias("in_b"))
    joined = left.join(right, list(keys), "full_outer")
    change = F.when(F.col("in_a").isNotNull() & F.col("in_b").isNotNull(), "retained").when(F.col("in_a").isNotNull(), "lost").otherwise("gained")
    return joined.select(*keys, change.alias("change"), "distance_a", "distance_b")


def reconcile(a: DataFrame, b: DataFrame, *, key: str, alias: dict[str, str] | None, value_a: str, value_b: str, tolerance: float = 0.0051) -> DataFrame:
    """Two sources of one label: difference, rounding flag and identity flag."""
    name = F.col(key)
    if alias:
        name = F.coalesce(scalar.lookup(alias, name), name)
    joined = a.withColumn("_k", name).join(b.withColumnRenamed(key, "_other"), F.col("_k") == F.col("_other"), "full_outer")
    diff = F.col(value_a) - F.col(value_b)
    return joined.select(
        F.coalesce(key, "_other").alias(key),
        value_a,
        value_b,
        diff.alias("difference"),
        (F.abs(diff) > tolerance).alias("beyond_rounding"),
        (F.col(key).isNull() | F.col("_other").isNull()).alias("identity_mismatch"),
    )


def parity(a: DataFrame, b: DataFrame, *, keys: Sequence[str], value: str, tolerance: float) -> DataFrame:
    """Largest absolute difference and counts beyond tolerance between two tables.

    Differences are read to nine decimals: one that equals the tolerance is within
    it, whatever the order in which the values were added up.
    """
    left = a.select(*keys, F.col(value).alias("_a"), F.lit(True).alias("_in_a"))
    right = b.select(*keys, F.col(value).alias("_b"), F.lit(True).alias("_in_b"))
    joined = left.join(right, list(keys), "full_outer")
    diff = F.round(F.abs(F.col("_a") - F.col("_b")).cast("double"), 9)
    return joined.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("_in_a").isNull() | F.col("_in_b").isNull()).alias("unmatched"),
        F.max(diff).alias("max_abs_difference"),
        F.count_if(diff > tolerance).alias("beyond_tolerance"),
        F.count_if(diff <= 1e-8).alias("identical"),
    )


def paired_rmsd(a: DataFrame, b: DataFrame, *, group: str, point: str, coords: Sequence[str]) -> DataFrame:
    """Root mean square distance over given point pairs."""
    left = a.select(group, point, *[F.col(c).alias(f"{c}_a") for c in coords])
    right = b.select(group, point, *[F.col(c).alias(f"{c}_b") for c in coords])
    square = sum(((F.col(f"{c}_a") - F.col(f"{c}_b")) * (F.col(f"{c}_a") - F.col(f"{c}_b")) for c in coords), F.lit(0.0))
    return left.join(right, [group, point]).groupBy(group).agg(F.sqrt(F.avg(square)).alias("rmsd"), F.count(F.lit(1)).alias("pairs"))


def ranked_targets(targets: DataFrame, *, organism: str, kind: str, name: str, identifier: str, first_organism: str, first_kind: str, limit: int = 25) -> DataFrame:
    """A bounded page with the preferred organism and type first, beside the total."""
    total = targets.agg(F.count(F.lit(1)).alias("total"))
    order = [F.coalesce(F.col(organism) != first_organism, F.lit(True)), F.coalesce(F.col(kind) != first_kind, F.lit(True)), F.coalesce(F.col(name), F.lit("")), F.col(identifier)]
    return targets.orderBy(*order).limit(limit).join(F.broadcast(total))


def targets_for(targets: DataFrame, accessions: DataFrame, *, components: str, accession: str = "accession") -> DataFrame:
    """Targets with any of the wanted accessions among their components."""
    wanted = accessions.select(F.trim(accession).alias("_acc")).where(F.length("_acc") > 0).distinct()
    return targets.withColumn("_acc", F.explode(components)).join(wanted, "_acc", "left_semi").drop("_acc").distinct()


def variant_stability(predictions: DataFrame, variants: DataFrame, *, baseline: str = "baseline") -> DataFrame:
    """Change of each variant's predictions against the baseline on the same entity.

    ``variants`` lists every planned (variant, kind, completed); those without
    predictions stay as failed rows.
    """
    base = predictions.where(F.col("variant") == baseline).select("entity", F.col("prediction").alias("_base"))
    diffs = predictions.join(base, "entity").withColumn("change", F.abs(F.col("prediction") - F.col("_base")))
    top = diffs.groupBy("variant").agg(F.max("change").alias("change_max"), F.count(F.lit(1)).alias("entities"))
    summary = top.join(quantiles(diffs, ["variant"], "change", {"change_p95": 0.95}), "variant")
    joined = variants.join(summary, "variant", "left")
    limit = F.when(F.col("kind") == "numerical_control", F.col("change_max") <= 1e-8).otherwise((F.col("change_p95") <= 0.5) & (F.col("change_max") <= 1.0))
    done = F.coalesce(F.col("completed"), F.lit(False)) & F.col("entities").isNotNull()
    return joined.select("variant", "kind", done.alias("completed"), "change_p95", "change_max", F.coalesce(done & limit, F.lit(False)).alias("stable"))


def pose_ranges(predictions: DataFrame) -> DataFrame:
    """Range over variants per entity; any repeated (variant, entity) is dropped whole."""
    rows = predictions.withColumn("prediction", scalar.finite_number("prediction")).where(F.col("prediction").isNotNull())
    single = rows.groupBy("variant", "entity").agg(F.count(F.lit(1)).alias("n"), F.min("prediction").alias("prediction")).where(F.col("n") == 1)
    return single.groupBy("entity").agg(
        F.min("prediction").alias("low"), F.max("prediction").alias("high"), F.count(F.lit(1)).alias("checks"), (F.max("prediction") - F.min("prediction")).alias("range")
    )


def gate_table(values: DataFrame, gates: Sequence[tuple[str, Column, str, Column]]) -> DataFrame:
    """Named checks over a one-row table of values: (check, value, criterion, passed)."""
    rows = [
        {"place": F.lit(i), "check": F.lit(name), "value": value.cast("double"), "criterion": F.lit(criterion), "passed": F.coalesce(passed, F.lit(False))}
        for i, (name, value, criterion, passed) in enumerate(gates)
    ]
    return stack_rows(values, rows)


def gate_status(gates: DataFrame, prefix: str = "Unmet checks: ") -> DataFrame:
    """One line naming the unmet checks, in order (a handful of rows)."""
    unmet = F.array_sort(F.collect_list(F.when(~F.col("passed"), F.struct("place", "check"))))
    return gates.agg(
        F.count_if("passed").alias("passed"),
        F.count(F.lit(1)).alias("checks"),
        F.concat(F.lit(prefix), F.array_join(F.transform(unmet, lambda s: s["check"]), "; ")).alias("status"),
    )

"""Pairs that differ in exactly one attribute, and the evidence behind each claim."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from measurelens.functions import variants
from measurelens.operators.common import settle, shared_elements
from measurelens.operators.evidence import drop_record_copies
from measurelens.operators.matching import disjoint_pairs
from measurelens.operators.ordered import quantiles

# A context with more members than this is paired block against block.
_BLOCK = 2000


def block_pairs(members: DataFrame, keys: Sequence[str], left: dict[str, str], right: dict[str, str], spread: str, condition: Column, counted: DataFrame | None = None) -> DataFrame:
    """Equi self-join on ``keys``; crowded keys are split into blocks.

    A member of a crowded key joins all blocks of its key on the right and one on
    the left, so a key with n members becomes about n / block tasks instead of
    one.  There are at most (members / block) crowded keys, which bounds the
    broadcast list of them; all other members move once, for both sides.
    ``counted`` may have more rows per key than ``members``, where these cost more
    to make: a key that is crowded there only is paired in blocks as well.
    """
    keys = list(keys)
    counted = members if counted is None else counted
    crowded = F.broadcast(counted.groupBy(*keys).agg(F.count(F.lit(1)).alias("_load")).where(F.col("_load") > _BLOCK))
    calm = members.join(crowded.select(*keys), keys, "left_anti")
    side = lambda rows, names, *extra: rows.select(*keys, *[F.col(c).alias(n) for c, n in names.items()], *extra)
    pairs = side(calm, left).join(side(calm, right), keys).where(condition)
    sized = members.join(crowded, keys).withColumn("_blocks", F.ceil(F.col("_load") / _BLOCK).cast("int"))
    a = side(sized, left, F.pmod(F.xxhash64(spread), F.col("_blocks")).cast("int").alias("_block"))
    b = side(sized, right, F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block"))
    return pairs.unionByName(a.join(b, [*keys, "_block"]).where(condition).drop("_block"))


def assay_lists(evidence: DataFrame, *, entity: str, assay: str) -> DataFrame:
    """(id, assays): the distinct assays of each entity, as numbers.

    Assays are numbered from 0 on, so a list of them takes four bytes an assay.
    """
    rows = evidence.where(F.col(assay).isNotNull()).select(F.col(entity).cast("string").alias("id"), F.col(assay).cast("string").alias("_assay"))
    # a number is the part of the table and the row in it
    names = settle(rows.select("_assay").distinct().withColumn("_n", F.monotonically_increasing_id()))
    part, row = F.shiftright("_n", 33), F.col("_n").bitwiseAND((1 << 33) - 1)
    wide, parts = names.agg(F.max(row) + 1, F.max(part) + 1).first()
    kind = "int" if (wide or 0) * (parts or 0) < 1 << 31 else "long"
    names = names.select("_assay", (part * F.lit(wide or 1) + row).cast(kind).alias("_number"))
    return rows.join(names, "_assay").groupBy("id").agg(F.collect_set("_number").alias("assays"))


def matched_pairs(members: DataFrame, *, context: str, entity: str, fragment: str, value: str, max_pairs: int | None = None, assays: DataFrame | None = None) -> DataFrame:
    """Pairs that share a context but differ in entity and fragment.

    The difference is b minus a, with (entity, fragment, value) of a first.
    ``max_pairs`` is the report's own budget, taken in context order; by default
    all pairs are returned.  With ``assays`` (see ``assay_lists``) a column
    ``shared`` tells whether the entities share one; the lists travel with the
    members, never with the pairs.
    """
    rows = members.select(F.col(context).alias("context"), F.col(entity).cast("string").alias("id"), F.col(fragment).cast("string").alias("fragment"), F.col(value).cast("double").alias("v"))
    copies = rows.select("context")
    rows = rows.distinct()
    key = lambda s: F.struct(f"id_{s}", f"fragment_{s}", f"value_{s}")
    names = lambda s: {"id": f"id_{s}", "fragment": f"fragment_{s}", "v": f"value_{s}"}
    extra = []
    if assays is not None:
        rows = rows.join(assays, "id", "left")
        own, extra = names, [shared_elements(F.col("assays_a"), F.col("assays_b")).alias("shared")]
        names = lambda s: {**own(s), "assays": f"assays_{s}"}
    wanted = (key("a") < key("b")) & (F.col("id_a") != F.col("id_b")) & (F.col("fragment_a") != F.col("fragment_b"))
    pairs = block_pairs(rows, ["context"], names("a"), names("b"), "id", wanted, copies)
    pairs = pairs.select("id_a", "id_b", "context", "fragment_a", "fragment_b", "value_a", "value_b", (F.col("value_b") - F.col("value_a")).alias("delta"), *extra)
    if max_pairs is None:
        return pairs
    return pairs.orderBy("context", "id_a", "fragment_a", "value_a", "id_b", "fragment_b", "value_b").limit(max_pairs)


def count_matched_pairs(members: DataFrame, *, context: str, entity: str, fragment: str, value: str) -> DataFrame:
    """How many matched pairs each context has, from counts alone."""
    rows = members.select(F.col(context).alias("context"), F.col(entity).cast("string").alias("id"), F.col(fragment).cast("string").alias("fragment"), F.col(value).alias("v")).distinct()
    cells = rows.groupBy("context", "id", "fragment").agg(F.count(F.lit(1)).alias("n"))
    two = lambda c: c * (c - 1) / 2
    both = cells.groupBy("context").agg(F.sum("n").alias("n"), F.sum(two(F.col("n"))).alias("both"))
    by_id = cells.groupBy("context", "id").agg(F.sum("n").alias("n")).groupBy("context").agg(F.sum(two(F.col("n"))).alias("same_id"))
    by_fragment = cells.groupBy("context", "fragment").agg(F.sum("n").alias("n")).groupBy("context").agg(F.sum(two(F.col("n"))).alias("same_fragment"))
    joined = both.join(by_id, "context").join(by_fragment, "context")
    count = (two(F.col("n")) - F.col("same_id") - F.col("same_fragment") + F.col("both")).cast("long")
    return joined.select("context", count.alias("pairs"))


def find_pairs(pairs: DataFrame, *, cutoff: float, text: str = "") -> DataFrame:
    """Pairs with a large enough difference whose ids contain a text."""
    from measurelens.functions.scalar import contains_text

    out = pairs.where(F.abs("delta") >= cutoff)
    return out.where(contains_text(text, "id_a", "id_b")) if text else out


def transformation_summary(pairs: DataFrame, evidence: DataFrame | None = None, *, entity: str = "", assay: str = "", examples: int = 5) -> DataFrame:
    """Per (fragment -> fragment, assay context): support, spread and first examples.

    Fragments are put in text order and the difference turned accordingly.
    ``shared`` of a pair comes from ``matched_pairs``; pairs without it are joined
    with the assays of ``evidence``, which moves two lists per pair.  The pairs
    are written once, since every statistic reads them.
    """
    if "shared" not in pairs.columns:
        for s in ("a", "b"):
            pairs = pairs.join(assay_lists(evidence, entity=entity, assay=assay).toDF(f"id_{s}", f"assays_{s}"), f"id_{s}", "left")
        pairs = pairs.withColumn("shared", shared_elements(F.col("assays_a"), F.col("assays_b")))
    turned = F.col("fragment_a") > F.col("fragment_b")
    marked = settle(
        pairs.select(
            "id_a",
            "id_b",
            "context",
            F.least("fragment_a", "fragment_b").alias("fragment_from"),
            F.greatest("fragment_a", "fragment_b").alias("fragment_to"),
            F.when(turned, -F.col("delta")).otherwise(F.col("delta")).alias("delta"),
            F.when(F.col("shared"), "shared assay").otherwise("unmatched or unknown").alias("assay_context"),
        )
    )
    keys = ["fragment_from", "fragment_to", "assay_context"]
    base = marked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("supporting_pairs"),
        F.count_distinct("context").alias("distinct_contexts"),
        F.count_if(F.col("delta") > 0).alias("positive_pairs"),
        F.count_if(F.col("delta") < 0).alias("negative_pairs"),
    )
    middle = quantiles(marked, keys, "delta", {"median_delta": 0.5, "q25_delta": 0.25, "q75_delta": 0.75})
    # the limit on the rank is applied before rows move, so a task sends a few rows per key
    order = [F.length("id_a"), F.col("id_a"), F.length("id_b"), F.col("id_b"), F.col("context")]
    head = marked.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= examples)
    shown = F.transform(F.array_sort(F.collect_list(F.struct("_r", "id_a", "id_b"))), lambda s: F.concat(s["id_a"], F.lit(" → "), s["id_b"]))
    head = head.groupBy(*keys).agg(F.array_join(shown, "; ").alias("example_ids"))
    return base.join(middle, keys).join(head, keys)


def _measured_rows(evidence: DataFrame, *, entity: str, assay: str, endpoint: str, variant: str, value: str, record: str, relation: str | None) -> DataFrame:
    """(entity, assay, endpoint, variant, v, record): the exact, finite records."""
    from measurelens.functions.scalar import finite_number

    rows = evidence if relation is None else evidence.where(F.col(relation) == "=")
    rows = rows.where(F.col(assay).isNotNull() & F.col(endpoint).isNotNull()).select(
        F.col(entity).cast("string").alias("entity"),
        F.col(assay).cast("string").alias("assay"),
        F.col(endpoint).cast("string").alias("endpoint"),
        variants.scope(variant).alias("variant"),
        finite_number(value).alias("v"),
        F.col(record).cast("string").alias("record"),
    )
    return rows.where(F.col("v").isNotNull() & F.col("entity").isNotNull())


def measured_cells(evidence: DataFrame, *, entity: str, assay: str, endpoint: str, variant: str, value: str, record: str, relation: str | None = "standard_relation") -> DataFrame:
    """The cells of ``measured_medians`` without their medians and records, for uses that ask only whether a cell is there."""
    rows = _measured_rows(evidence, entity=entity, assay=assay, endpoint=endpoint, variant=variant, value=value, record=record, relation=relation)
    return rows.select("entity", "assay", "endpoint", "variant").distinct().select("*", F.lit(None).cast("double").alias("value"), F.lit("").alias("records"))


def measured_medians(evidence: DataFrame, *, entity: str, assay: str, endpoint: str, variant: str, value: str, record: str, relation: str | None = "standard_relation") -> DataFrame:
    """Median per (entity, assay, endpoint, variant) over exact, finite records.

    Copies of one record count once.  The record ids are listed per cell, after
    they have been made distinct.
    """
    rows = _measured_rows(evidence, entity=entity, assay=assay, endpoint=endpoint, variant=variant, value=value, record=record, relation=relation)
    keys = ["entity", "assay", "endpoint", "variant"]
    # the least and the greatest record are all there is to a cell of one or two
    one = F.struct("record", "v")
    ends = settle(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(one).alias("_a"), F.max(one).alias("_b")))
    middle = F.least("_a.v", "_b.v") * 0.5 + F.greatest("_a.v", "_b.v") * 0.5
    listed = F.when(F.col("_a.record").eqNullSafe(F.col("_b.record")), F.coalesce("_a.record", F.lit(""))).otherwise(F.concat_ws(";", "_a.record", "_b.record"))
    few = ends.where(F.col("_n") <= 2).select(*keys, F.when(F.col("_a.v") == F.col("_b.v"), F.col("_a.v")).otherwise(middle).alias("value"), listed.alias("records"))
    many = settle(rows.join(ends.where(F.col("_n") > 2).select(*keys), keys, "left_semi"))
    values = drop_record_copies(many, [*keys, "v"], record="record")
    medians = quantiles(values, keys, "v", {"value": 0.5})
    ids = many.select(*keys, "record").distinct().groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("record")), ";").alias("records"))
    return few.unionByName(medians.join(ids, keys, "left"))


def position_pairs(series: DataFrame, *, core: Sequence[str] = (), positions: Sequence[str], entity: str, value: str) -> DataFrame:
    """Entities equal at all positions but one, within the same core.

    Each row is keyed once per position by its fragments at the other positions
    (nulls equal nulls), so the pairing is an equi-join.  ``from`` is the smaller
    fragment.
    """
    core = list(core)
    text = {p: F.col(p).cast("string") for p in positions}
    options = []
    for p in positions:
        others = F.map_from_arrays(F.array(*[F.lit(o) for o in sorted(positions) if o != p]), F.array(*[F.coalesce(text[o], F.lit("∅")) for o in sorted(positions) if o != p])) if len(positions) > 1 else F.lit("")
        context = F.to_json(others) if len(positions) > 1 else F.lit("{}")
        options.append(F.struct(F.lit(p).alias("position"), context.alias("context"), text[p].alias("fragment")))
    rows = series.select(*core, F.col(entity).cast("string").alias("id"), F.col(value).cast("double").alias("v"), F.explode(F.array(*options)).alias("o")).select(*core, "id", "v", "o.*")
    # read for the count and for both sides: the contexts are made once
    rows = settle(rows.where(F.col("fragment").isNotNull()))
    keys = [*core, "position", "context"]
    names = lambda s: {"id": f"id_{s}", "fragment": f"fragment_{s}", "v": f"pooled_{s}"}
    return block_pairs(rows, keys, names("from"), names("to"), "id", F.col("fragment_from") < F.col("fragment_to"))


def shared_evidence(pairs: DataFrame, measured: DataFrame) -> DataFrame:
    """One row per (assay, endpoint, variant) in which both entities of a pair were measured."""
    side = lambda s: measured.select(F.col("entity").alias(f"id_{s}"), "assay", "endpoint", "variant", F.col("value").alias(f"value_{s}"), F.col("records").alias(f"records_{s}"))
    both = pairs.join(side("from"), "id_from").join(side("to"), ["id_to", "assay", "endpoint", "variant"])
    return both.withColumn("evidence_tier", F.lit("shared assay"))


def resolve_evidence(pairs: DataFrame, measured: DataFrame) -> DataFrame:
    """One row per shared (assay, endpoint, variant) of a pair, else one pooled row."""
    # read twice: the pairs it leaves out are pooled
    shared = settle(shared_evidence(pairs, measured))
    keys = [c for c in pairs.columns if not c.startswith("pooled_")]
    lone = pairs.join(shared.select("id_from", "id_to").distinct(), ["id_from", "id_to"], "left_anti")
    blank = F.lit("")
    common = [*keys, "assay", "endpoint", "variant", "evidence_tier", "value_from", "value_to", "records_from", "records_to"]
    shared = shared.select(*common)
    pooled = lone.select(
        *keys, blank.alias("assay"), blank.alias("endpoint"), blank.alias("variant"), F.lit("pooled / unmatched").alias("evidence_tier"),
        F.col("pooled_from").alias("value_from"), F.col("pooled_to").alias("value_to"), blank.alias("records_from"), blank.alias("records_to"),
    )
    return shared.unionByName(pooled.select(*common)).withColumn("delta", F.col("value_to") - F.col("value_from"))


CLAIM = ("position", "fragment_from", "fragment_to", "evidence_tier", "endpoint", "variant")


def disjoint_counts(pairs: DataFrame, keys: Sequence[str], *, scope: Sequence[str] = ("context",)) -> DataFrame:
    """Pairs taken in (from, to) order as long as neither id was used before.

    For one position an entity has one fragment and one context, so the choice
    in one context never touches another: the counts of each (claim, context)
    are added.
    """
    keys = list(keys)
    taken = disjoint_pairs(pairs, [*keys, *scope], "id_from", "id_to")
    return taken.groupBy(*keys).agg(F.sum("taken").alias("disjoint_pairs"))


def pair_votes(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One effect per entity pair: the median over its assays.

    A pair has one row per assay context it was measured in, so the exact
    median of a group holds no more values than there are assay contexts.
    """
    return pairs.groupBy(*keys, "id_from", "id_to").agg(F.median("delta").alias("effect"))


def interpretation(delta: Column, agreement: Column, conflict: Column, threshold: Column | float) -> Column:
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    mixed = (F.abs(delta) < t) | (agreement < 0.8) | conflict
    return F.when(mixed, "mixed / small change").when(delta > 0, "increase").otherwise("decrease")


def effect_statistics(pairs: DataFrame, keys: Sequence[str], *, threshold: Column | float, scope: Sequence[str] = ("context",)) -> DataFrame:
    """Statistics of pair effects per key: one vote per pair of entities.

    ``threshold`` may be a column, which is then part of the keys.
    """
    keys, scope = list(keys), list(scope)
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    votes = pair_votes(pairs, keys)
    middle = quantiles(votes, keys, "effect", {"median_delta": 0.5, "q25_delta": 0.25, "q75_delta": 0.75})
    counts = votes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("supporting_pairs"), F.count_if(F.col("effect") > 0).alias("positive_pairs"), F.count_if(F.col("effect") < 0).alias("negative_pairs")
    )
    base = pairs.groupBy(*keys).agg(
        F.count_distinct(*scope).alias("distinct_contexts"),
        F.count_distinct(F.when(F.col("assay") != "", F.col("assay"))).alias("assays"),
        F.max("delta").alias("_hi"),
        F.min("delta").alias("_lo"),
    )
    joined = base.join(counts, keys).join(middle, keys).join(disjoint_counts(pairs, keys, scope=scope), keys)
    agreement = F.greatest("positive_pairs", "negative_pairs") / F.col("supporting_pairs")
    conflict = (F.col("_hi") > t) & (F.col("_lo") < -t)
    return joined.withColumn("direction_agreement", agreement).withColumn("interpretation", interpretation(F.col("median_delta"), F.col("direction_agreement"), conflict, t)).drop("_hi", "_lo")


def claims(pairs: DataFrame, *, core: Sequence[str] = (), threshold: float = 0.5, limited: bool = False) -> DataFrame:
    """Positional claims with counts, agreement, interpretation and evidence strength."""
    keys = [*core, *CLAIM]
    stats = effect_statistics(pairs, keys, threshold=threshold)
    firm = (F.col("evidence_tier") == "shared assay") & F.lit(not limited)
    strength = (
        F.when(F.col("interpretation") == "mixed / small change", "mixed")
        .when(firm & (F.col("disjoint_pairs") >= 3) & (F.col("distinct_contexts") >= 2), "strong")
        .when(firm & (F.col("disjoint_pairs") >= 2), "moderate")
        .otherwise("limited")
    )
    return stats.withColumn("evidence_strength", strength)


def claim_order(prefix: str = "") -> list[Column]:
    """Sort keys that put the best supported claim first."""
    c = lambda n: F.col(f"{prefix}{n}")
    priority = (
        F.when(c("evidence_strength") == "strong", 4)
        .when(c("evidence_strength") == "moderate", 3)
        .when((c("evidence_strength") == "mixed") & (c("disjoint_pairs") >= 2), 2)
        .when(c("evidence_strength") == "limited", 1)
        .otherwise(0)
    )
    return [(-priority).alias("k0"), (-c("disjoint_pairs")).alias("k1"), (-c("supporting_pairs")).alias("k2"), (-F.abs(c("median_delta"))).alias("k3")]


def rank_claims(table: DataFrame) -> DataFrame:
    return table.orderBy(*claim_order(), *CLAIM)


def best_claims(table: DataFrame, slots: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The best claim per position; positions without comparisons stay, marked so.

    ``slots`` lists the expected keys.  Ties fall to the smaller claim text.
    """
    keys = list(keys)
    rest = [c for c in CLAIM if c not in keys]
    best = table.groupBy(*keys).agg(F.min(F.struct(*claim_order(), *rest, "median_delta", "supporting_pairs", "evidence_strength")).alias("b"))
    joined = slots.join(best, keys, "left")
    none = F.col("b").isNull()
    arrow = F.when(F.col("b.evidence_strength") == "mixed", " ↔ ").otherwise(" → ")
    return joined.select(
        *keys,
        F.when(none, "No single-position comparisons").otherwise(F.concat("b.fragment_from", arrow, "b.fragment_to")).alias("label"),
        F.when(none, "Insufficient evidence")
        .otherwise(F.concat(F.lit("Δ "), F.printf(F.lit("%+.2f"), F.col("b.median_delta")), F.lit(" · "), F.col("b.supporting_pairs").cast("string"), F.lit(" pairs · "), F.col("b.evidence_strength")))
        .alias("detail"),
        F.col("b.endpoint").alias("endpoint"),
        F.col("b.variant").alias("variant"),
    )


def directed_evidence(pairs: DataFrame, parents: DataFrame) -> DataFrame:
    """Effects of leaving a parent's fragment: direct pairs and turned ones.

    ``parents`` has (position, fragment); the result always starts there.
    """
    turned = pairs.select(
        *[c for c in pairs.columns if c not in ("fragment_from", "fragment_to", "id_from", "id_to", "value_from", "value_to", "records_from", "records_to", "delta")],
        F.col("fragment_to").alias("fragment_from"),
        F.col("fragment_from").alias("fragment_to"),
        F.col("id_to").alias("id_from"),
        F.col("id_from").alias("id_to"),
        F.col("value_to").alias("value_from"),
        F.col("value_from").alias("value_to"),
        F.col("records_to").alias("records_from"),
        F.col("records_from").alias("records_to"),
        (-F.col("delta")).alias("delta"),
    )
    both = pairs.unionByName(turned.select(*pairs.columns))
    wanted = parents.select("position", F.col("fragment").alias("fragment_from")).distinct()
    return both.join(wanted, ["position", "fragment_from"], "left_semi")


def candidate_effects(directed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Support and median effect per proposed replacement."""
    keys = list(keys)
    votes = pair_votes(directed, keys)
    base = votes.groupBy(*keys).agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("effect") > 0).alias("positive"), F.count_if(F.col("effect") < 0).alias("negative"))
    return base.join(quantiles(votes, keys, "effect", {"median_effect": 0.5}), keys)


def pair_conflicts(candidates: DataFrame, evidence: DataFrame, *, candidate: str, predicted: str) -> DataFrame:
    """Per candidate: measured pairs whose effect opposes the predicted sign."""
    votes = pair_votes(evidence, [candidate])
    joined = candidates.join(votes, candidate, "left")
    p = F.col(predicted)
    opposing = ((p > 1e-8) & (F.col("effect") < -1e-8)) | ((p < -1e-8) & (F.col("effect") > 1e-8))
    counts = joined.groupBy(candidate, predicted).agg(F.count("effect").alias("measured_pairs"), F.count_if(F.coalesce(opposing, F.lit(False))).alias("opposing_measured_pairs"))
    status = (
        F.when(p.isNull() | F.isnan(p), "Not assessed (no numeric prediction)")
        .when(F.col("measured_pairs") == 0, "No measured-pair effects available")
        .when(F.col("opposing_measured_pairs") > 0, "Conflict")
        .otherwise("No opposite-direction measured pair found")
    )
    return counts.withColumn("pair_evidence", status)


def shared_pair_count(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct entity pairs with shared-assay evidence."""
    rows = pairs.where(F.col("evidence_tier") == "shared assay")
    return rows.groupBy(*keys).agg(F.count_distinct("id_from", "id_to").alias("shared_pairs"))



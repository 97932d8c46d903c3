"""Does a claim survive leaving evidence out?  Cycles, omissions, sweeps, verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from measurelens.operators.common import first_k, settle
from measurelens.operators.matching import disjoint_pairs
from measurelens.operators.ordered import numbered, prefix_sums, quantiles
from measurelens.operators.pairs import CLAIM, block_pairs, effect_statistics, interpretation

CELL = ("assay", "endpoint", "variant")


def _without(context: Column, position: Column) -> Column:
    """A context with one more position taken out, as text."""
    return F.to_json(F.map_filter(F.from_json(context, "map<string,string>"), lambda k, _: k != position))


def _by_other_position(pairs: DataFrame) -> DataFrame:
    """One row per other position: its fragment and what stays the same beside it."""
    parsed = F.from_json("context", "map<string,string>")
    return pairs.select("*", F.explode(parsed).alias("other_position", "other_fragment")).withColumn("rest", _without(F.col("context"), F.col("other_position")))


def pattern_members(series: DataFrame, *, core: Sequence[str], positions: Sequence[str], entity: str) -> DataFrame:
    """Per (core, position, context, fragment): whether one entity or several hold the pattern (``holders`` 1 or 2), and the smallest id."""
    core = list(core)
    options = []
    for p in positions:
        rest = sorted(o for o in positions if o != p)
        others = F.map_from_arrays(F.array(*[F.lit(o) for o in rest]), F.array(*[F.coalesce(F.col(o).cast("string"), F.lit("∅")) for o in rest]))
        options.append(F.struct(F.lit(p).alias("position"), F.to_json(others).alias("context"), F.col(p).cast("string").alias("fragment")))
    rows = series.select(*core, F.col(entity).cast("string").alias("id"), F.explode(F.array(*options)).alias("o")).select(*core, "id", "o.*")
    # the smallest and the greatest id are enough to know whether a pattern is unique
    ends = rows.groupBy(*core, "position", "context", "fragment").agg(F.min("id").alias("id"), F.max("id").alias("_last"))
    return ends.withColumn("holders", F.when(F.col("id") == F.col("_last"), 1).when(F.col("id").isNull(), 0).otherwise(2)).drop("_last")


def _pattern(core: Sequence[str], fragment: str) -> Column:
    """A pattern by its 64-bit code."""
    return F.xxhash64(*core, "position", "context", fragment)


def unambiguous(pairs: DataFrame, patterns: DataFrame, core: Sequence[str]) -> DataFrame:
    """Pairs whose two patterns each belong to a single entity; patterns go by 64-bit code."""
    core = list(core)
    lone = patterns.where(F.col("holders") == 1).select(_pattern(core, "fragment").alias("_pattern"))
    for side in ("from", "to"):
        pairs = pairs.withColumn("_pattern", _pattern(core, f"fragment_{side}")).join(lone, "_pattern", "left_semi")
    return pairs.drop("_pattern")


def interaction_cycles(pairs: DataFrame, patterns: DataFrame, *, core: Sequence[str] = ()) -> DataFrame:
    """Two parallel pairs that differ at one other position, in one assay context.

    The four entities form a square; the interaction is the second change minus
    the first, with the smaller fragment at the other position first.
    """
    core = list(core)
    shared = unambiguous(pairs.where(F.col("evidence_tier") == "shared assay"), patterns, core)
    rows = _by_other_position(shared)
    keys = [*core, "position", "fragment_from", "fragment_to", *CELL, "other_position", "rest"]
    left = {"other_fragment": "context_from", "id_from": "id_a", "id_to": "id_b", "delta": "delta_first"}
    right = {"other_fragment": "context_to", "id_from": "id_c", "id_to": "id_d", "delta": "delta_second"}
    squares = block_pairs(rows, keys, left, right, "id_from", F.col("context_from") < F.col("context_to"))
    return squares.drop("rest").withColumn("interaction_delta", F.col("delta_second") - F.col("delta_first"))


def missing_corners(pairs: DataFrame, patterns: DataFrame, measured: DataFrame, series: DataFrame, *, core: Sequence[str] = (), positions: Sequence[str], entity: str) -> DataFrame:
    """Squares with three measured corners: what to measure or make to complete them.

    The third corner shares the first one's fragment and differs at one other
    position; the fourth is the third with the replaced fragment.

    Assay contexts and what two corners share travel as 64-bit codes, the assay
    contexts of an entity as one list.
    """
    core = list(core)
    cell = F.xxhash64(*CELL)
    cells = measured.groupBy(F.col("entity").alias("id")).agg(F.collect_set(cell).alias("cells"))
    # read for both ends of a pair, the third corner and the fourth
    patterns = settle(patterns.join(cells, "id", "left"))
    shared = unambiguous(pairs.where(F.col("evidence_tier") == "shared assay").select(*core, "position", "context", "fragment_from", "fragment_to", *CELL, "id_from", "id_to"), patterns, core)
    side = lambda fragment: F.xxhash64(*core, "position", fragment, "other_position", "rest").alias("_side")
    legs = _by_other_position(shared).select(side("fragment_from"), cell.alias("_cell"), *core, "position", "context", "fragment_to", *CELL, "other_position", F.col("other_fragment").alias("a_fragment"), "id_from", "id_to")
    third = _by_other_position(patterns.where((F.col("holders") == 1) & F.col("cells").isNotNull()))
    third = third.select(side("fragment"), F.col("other_fragment").alias("c_fragment"), F.col("id").alias("third_id"), "cells")
    open_ = legs.join(third, "_side").where((F.col("a_fragment") != F.col("c_fragment")) & F.array_contains("cells", F.col("_cell")))
    # the context of the third corner: that of the first with the other fragment
    turned = F.transform_values(F.from_json("context", "map<string,string>"), lambda k, v: F.when(k == F.col("other_position"), F.col("c_fragment")).otherwise(v))
    open_ = open_.withColumn("context", F.to_json(turned)).drop("_side", "cells", "a_fragment", "c_fragment").withColumn("_pattern", _pattern(core, "fragment_to"))
    fourth = patterns.select(_pattern(core, "fragment").alias("_pattern"), "holders", F.col("id").alias("fourth_id"), "cells")
    joined = open_.join(fourth, "_pattern", "left").where(F.coalesce("holders", F.lit(0)) <= 1)
    todo = joined.where(~F.coalesce(F.array_contains("cells", F.col("_cell")), F.lit(False)))
    # one suggestion per (missing pattern, assay context), with its smallest support
    support = F.min(F.struct("id_from", "id_to", "third_id")).alias("s")
    out = todo.groupBy(*core, "position", "context", "fragment_to", *CELL).agg(support, F.first("fourth_id").alias("existing_id"), F.min("other_position").alias("other_position"))
    return out.select(
        F.when(F.col("existing_id").isNotNull(), "Measure existing analogue").otherwise("Complete missing analogue").alias("action"),
        *core,
        "position",
        "other_position",
        "context",
        F.col("fragment_to").alias("proposed_fragment"),
        *CELL,
        F.coalesce("existing_id", F.lit("")).alias("existing_id"),
        F.concat_ws(";", "s.id_from", "s.id_to", "s.third_id").alias("supporting_ids"),
    )


def conflicting_pairs(pairs: DataFrame, keys: Sequence[str], threshold: float) -> DataFrame:
    """Pairs whose effect changes sign beyond the threshold between assays, widest first per key."""
    keys = list(keys)
    span = pairs.groupBy(*keys, "id_from", "id_to").agg(F.min("delta").alias("low"), F.max("delta").alias("high"))
    bad = span.where((F.col("low") < -threshold) & (F.col("high") > threshold))
    best = bad.groupBy(*keys).agg(F.min(F.struct((-(F.col("high") - F.col("low"))).alias("w"), "id_from", "id_to", "low", "high")).alias("b"))
    return best.select(F.lit("Retest conflicting pair").alias("action"), *keys, "b.id_from", "b.id_to", "b.low", "b.high")


def sparse_pairs(stats: DataFrame, pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Claims with fewer than two disjoint pairs: their first pair is to be repeated."""
    keys = list(keys)
    few = stats.where(F.col("disjoint_pairs") < 2).select(*keys)
    first = pairs.join(few, keys, "left_semi").groupBy(*keys).agg(F.min(F.struct("id_from", "id_to", *CELL)).alias("p"))
    return first.select(F.lit("Remeasure sparse pair").alias("action"), *keys, "p.id_from", "p.id_to")


# fixed values: names that stand for no assay or publication
UNNAMED = ("", "Unreported", "None", "nan")


def _limited(options: DataFrame, cap: int | None, unnamed: Sequence[str] = ()) -> DataFrame:
    """What is left out per claim: rows (_claim, omitted, _row, again) without unnamed values, at most ``cap`` values per claim."""
    options = options.where(F.col("omitted").isNotNull())
    if unnamed:
        options = options.where(~F.col("omitted").isin(*unnamed))
    if cap is not None:
        first = first_k(options.select("_claim", "omitted").distinct(), ["_claim"], ["omitted"], cap, ["omitted"]).drop("_place")
        options = options.join(first, ["_claim", "omitted"], "left_semi")
    return options


def omission_checks(
    pairs: DataFrame,
    evidence: DataFrame,
    *,
    keys: Sequence[str] = CLAIM,
    threshold: float = 0.5,
    cap: int | None = None,
    entity: str,
    assay: str,
    endpoint: str,
    variant: Column | str,
    value: str,
    record: str,
    document: str | None = None,
) -> DataFrame:
    """Statistics of each claim with one compound, context, assay or publication left out.

    Compound and context omissions drop pairs.  Assay and publication omissions
    measure again from the raw records and never fall back to pooled values.
    ``cap`` keeps a report to so many omissions per axis; by default all are tested.

    No claim is copied per omission: every omission lists the rows it touches, and
    its statistics are those of the claim, less these rows, plus what is left of
    them.  Claims and omissions are told apart by 64-bit code.
    """
    keys = list(keys)
    t = float(threshold)
    shared = pairs.where(F.col("evidence_tier") == "shared assay").dropna(subset=keys)
    body = shared.select(*keys, "context", "assay", *[c for c in ("endpoint", "variant") if c not in keys], "id_from", "id_to", "delta")
    body = body.withColumn("_claim", F.xxhash64(*keys)).withColumn("_v", F.xxhash64("_claim", "id_from", "id_to")).withColumn("_row", F.monotonically_increasing_id())
    body = settle(body)
    gone = F.lit(None).cast("double").alias("again")
    axes = {
        "Leave one compound out": _limited(body.select("_claim", F.explode(F.array_distinct(F.array("id_from", "id_to"))).alias("omitted"), "_row", gone), cap),
        "Leave one chemical context out": _limited(body.select("_claim", F.col("context").cast("string").alias("omitted"), "_row", gone), cap),
        # a record belongs to one assay: without the assay its cells are gone and the others unchanged
        "Leave one assay out": _limited(body.select("_claim", F.col("assay").cast("string").alias("omitted"), "_row", gone), cap, UNNAMED),
    }
    if document is not None:
        fields = dict(entity=entity, assay=assay, endpoint=endpoint, variant=variant, value=value, record=record, document=document)
        axes["Leave one publication out"] = _limited(_without_publication(body, evidence, **fields), cap, UNNAMED)
    touched = None
    for test, rows in axes.items():
        rows = rows.select("_claim", F.lit(test).alias("test"), "omitted", "_row", "again")
        touched = rows if touched is None else touched.unionByName(rows)
    touched = touched.join(body.select("_row", "_v", "context", "assay", "delta"), "_row").withColumn("_g", F.xxhash64("_claim", "test", "omitted"))
    touched = settle(touched)
    claims = settle(body.select("_claim", *keys).distinct())
    plans = touched.select("_g", "_claim", "test", "omitted").distinct()
    plans = settle(plans.unionByName(claims.select(F.xxhash64("_claim", F.lit("Baseline"), F.lit("None")).alias("_g"), "_claim", F.lit("Baseline").alias("test"), F.lit("None").alias("omitted"))))

    checks = _vote_statistics(plans, body, touched)
    checks = checks.join(_row_statistics(plans, body, touched, t), "_g").join(_disjoint_left(plans, body, touched), "_g")
    none = F.col("supporting_pairs") == 0
    agreement = F.when(~none, F.greatest("positive_pairs", "negative_pairs") / F.col("supporting_pairs"))
    checks = checks.withColumn("direction_agreement", agreement)
    conflict = (F.col("_high") > 0) & (F.col("_low") > 0)
    checks = checks.withColumn("interpretation", F.when(none, "insufficient evidence").otherwise(interpretation(F.col("median_delta"), F.col("direction_agreement"), conflict, t)))
    names = ["supporting_pairs", "disjoint_pairs", "assays", "median_delta", "direction_agreement", "interpretation"]
    checks = settle(plans.join(checks.select("_g", *names), "_g").drop("_g"))
    direction = claims.join(checks.where(F.col("test") == "Baseline").select("_claim", F.col("interpretation").alias("_direction")), "_claim")
    retains = F.col("_direction").isin("increase", "decrease") & (F.col("interpretation") == F.col("_direction"))
    return checks.join(direction, "_claim").withColumn("retains_direction", retains).select(*keys, "omitted", "test", *names, "retains_direction")


def _less(plans: DataFrame, whole: DataFrame, change: DataFrame, names: Sequence[str]) -> DataFrame:
    """(_g, names): the totals of the claim in ``whole`` plus the change of the omission, if there is one."""
    joined = plans.select("_g", "_claim").join(whole, "_claim", "left").join(change.select("_g", *[F.col(n).alias(f"_d_{n}") for n in names]), "_g", "left")
    return joined.select("_g", "_claim", *[(F.coalesce(n, F.lit(0)) + F.coalesce(f"_d_{n}", F.lit(0))).alias(n) for n in names])


def _vote_statistics(plans: DataFrame, body: DataFrame, touched: DataFrame) -> DataFrame:
    """Number of votes, their signs and their exact median per omission.

    The votes of a claim are numbered once.  An omission takes some places out and
    puts changed votes in between; the place it needs in the remaining order is the
    place in the whole order, moved by what was taken or put in before it.
    """
    votes = body.groupBy("_claim", "_v").agg((F.median("delta") + F.lit(0.0)).alias("effect"))
    votes = settle(numbered(settle(votes), ["_claim"], F.col("effect"), "place", tie=["_v"]).select("_claim", "_v", "effect", F.col("place").cast("long").alias("place")))
    # a compound takes whole votes with it; of the others some rows may stay
    compound = F.col("test") == "Leave one compound out"
    lost = touched.where(compound).select("_g", "_claim", "_v").distinct().withColumn("new", F.lit(None).cast("double"))
    part = touched.where(~compound)
    again = part.select("_g", "_row", "again", F.lit(True).alias("_hit"))
    rest = part.select("_g", "_claim", "_v").distinct().join(body.select("_v", "_row", "delta"), "_v").join(again, ["_g", "_row"], "left")
    rest = rest.groupBy("_g", "_claim", "_v").agg((F.median(F.when(F.col("_hit"), F.col("again")).otherwise(F.col("delta"))) + F.lit(0.0)).alias("new"))
    changed = lost.unionByName(rest).join(votes.drop("_claim"), "_v").where(~F.col("new").eqNullSafe(F.col("effect")))
    changed = settle(changed)

    ups, downs = lambda c: F.count_if(F.col(c) > 0), lambda c: F.count_if(F.col(c) < 0)
    names = ["supporting_pairs", "positive_pairs", "negative_pairs"]
    whole = votes.groupBy("_claim").agg(F.count(F.lit(1)).alias(names[0]), ups("effect").alias(names[1]), downs("effect").alias(names[2]))
    change = changed.groupBy("_g").agg((F.count("new") - F.count(F.lit(1))).alias(names[0]), (ups("new") - ups("effect")).alias(names[1]), (downs("new") - downs("effect")).alias(names[2]))
    counts = settle(_less(plans, whole, change, names))

    # a changed vote goes in before the equal ones of the whole order
    added = changed.where(F.col("new").isNotNull()).select("_g", "_claim", F.col("new").alias("v"))
    points = votes.select("_claim", F.col("effect").alias("v"), F.lit(1).cast("long").alias("have")).unionByName(added.select("_claim", "v").distinct().withColumn("have", F.lit(0).cast("long")))
    before = prefix_sums(points, "v", {"have": F.col("have")}, ["_claim"]).select("_claim", "v", F.col("have_before").alias("place"))
    added = added.join(before, ["_claim", "v"]).select("_g", "place", "v", F.lit(0).alias("kind"))
    events = added.unionByName(changed.select("_g", "place", F.col("effect").alias("v"), F.lit(1).alias("kind")))
    so_far = Window.partitionBy("_g").orderBy("place", "kind", "v").rowsBetween(Window.unboundedPreceding, -1)
    moved = F.coalesce(F.sum(F.lit(1) - 2 * F.col("kind")).over(so_far), F.lit(0))
    sides = counts.where(F.col("supporting_pairs") > 0).select(
        "_g", "_claim", F.floor((F.col("supporting_pairs") - 1) / 2).alias("low"), F.ceil((F.col("supporting_pairs") - 1) / 2).alias("high")
    )
    final = events.withColumn("final", F.col("place") + moved).join(sides.drop("_claim"), "_g")
    is_new = F.col("kind") == 0
    aggs = []
    for side in ("low", "high"):
        aggs.append((F.count_if(~is_new & (F.col("final") <= F.col(side))) - F.count_if(is_new & (F.col("final") < F.col(side)))).alias(f"_m_{side}"))
        aggs.append(F.max(F.when(is_new & (F.col("final") == F.col(side)), F.col("v"))).alias(f"_new_{side}"))
    found = sides.join(final.groupBy("_g").agg(*aggs), "_g", "left")
    picks = F.array(*[F.struct((F.col(side) + F.coalesce(f"_m_{side}", F.lit(0))).alias("place"), F.col(f"_new_{side}").alias("v")) for side in ("low", "high")])
    found = found.select("_g", "_claim", F.explode(picks).alias("p")).select("_g", "_claim", "p.*")
    at = found.join(votes.select("_claim", "place", "effect"), ["_claim", "place"], "left")
    value = F.coalesce("v", "effect")
    median = at.groupBy("_g").agg((F.min(value) * 0.5 + F.max(value) * 0.5).alias("median_delta"))
    return counts.drop("_claim").join(median, "_g", "left")


def _row_statistics(plans: DataFrame, body: DataFrame, touched: DataFrame, t: float) -> DataFrame:
    """Number of assays, and of rows beyond the threshold on either side, per omission."""
    high, low = lambda c: F.count_if(F.col(c) > t), lambda c: F.count_if(F.col(c) < -t)
    has = F.col("assay") != ""
    per = body.groupBy("_claim", "assay").agg(F.count(F.lit(1)).alias("_rows"), high("delta").alias("_high"), low("delta").alias("_low"))
    whole = per.groupBy("_claim").agg(F.count_if(has).alias("assays"), F.sum("_high").alias("_high"), F.sum("_low").alias("_low"))
    out = touched.groupBy("_g", "_claim", "assay").agg(
        F.count_if(F.col("again").isNull()).alias("_out"), (high("again") - high("delta")).alias("_high"), (low("again") - low("delta")).alias("_low")
    )
    out = out.join(per.select("_claim", "assay", "_rows"), ["_claim", "assay"])
    change = out.groupBy("_g").agg((-F.count_if(has & (F.col("_out") == F.col("_rows")))).alias("assays"), F.sum("_high").alias("_high"), F.sum("_low").alias("_low"))
    return _less(plans, whole, change, ["assays", "_high", "_low"]).drop("_claim")


def _disjoint_left(plans: DataFrame, body: DataFrame, touched: DataFrame) -> DataFrame:
    """Disjoint pairs per omission: only the contexts that lose a row are gone through again."""
    cells = settle(disjoint_pairs(body, ["_claim", "context"], "id_from", "id_to"))
    dropped = touched.where(F.col("again").isNull())
    hit = settle(dropped.select("_g", "_claim", "test", "context").distinct())
    left = hit.where(F.col("test") != "Leave one chemical context out").join(body.select("_claim", "context", "_row", "id_from", "id_to"), ["_claim", "context"])
    left = left.join(dropped.select("_g", "_row"), ["_g", "_row"], "left_anti")
    new = disjoint_pairs(left, ["_g", "context"], "id_from", "id_to")
    old = hit.join(cells, ["_claim", "context"]).select("_g", (-F.col("taken")).alias("taken"))
    change = old.unionByName(new.select("_g", "taken")).groupBy("_g").agg(F.sum("taken").alias("disjoint_pairs"))
    whole = cells.groupBy("_claim").agg(F.sum("taken").alias("disjoint_pairs"))
    return _less(plans, whole, change, ["disjoint_pairs"]).drop("_claim")


def _without_publication(body, evidence, *, entity, assay, endpoint, variant, value, record, document):
    """(_claim, omitted, _row, again): the rows with a cell that a publication touches, measured without it."""
    from measurelens.functions.scalar import finite_number
    from measurelens.operators.evidence import drop_record_copies

    v = variant if isinstance(variant, Column) else F.col(variant)
    rows = evidence.select(
        F.col(entity).cast("string").alias("id"), F.col(assay).cast("string").alias("assay"), F.col(endpoint).cast("string").alias("endpoint"), v.alias("variant"),
        finite_number(value).alias("v"), F.col(record).cast("string").alias("record"), F.col(document).cast("string").alias("doc"),
    ).where(F.col("v").isNotNull())
    cell = ["id", *CELL]
    rows = settle(drop_record_copies(rows, [*cell, "v", "doc"], record="record"))
    touched = rows.where(F.col("doc").isNotNull()).select(*cell, F.col("doc").alias("omitted")).distinct()
    remaining = rows.join(touched, cell).where(~F.col("doc").eqNullSafe(F.col("omitted")))
    again = settle(touched.join(quantiles(remaining, [*cell, "omitted"], "v", {"again": 0.5}), [*cell, "omitted"], "left"))
    full = settle(quantiles(rows, cell, "v", {"whole": 0.5}))
    named = lambda df, side, *rest: df.select(F.col("id").alias(f"id_{side}"), *CELL, *rest)
    parts = None
    for side in ("from", "to"):
        part = body.select("_row", f"id_{side}", *CELL).join(named(again, side, "omitted", "again"), [f"id_{side}", *CELL])
        part = part.select("_row", "omitted", F.lit(side).alias("side"), "again")
        parts = part if parts is None else parts.unionByName(part)
    at = lambda side: F.col("side") == side
    cases = parts.groupBy("_row", "omitted").agg(*[f for s in ("from", "to") for f in (F.max(at(s)).alias(f"touched_{s}"), F.max(F.when(at(s), F.col("again"))).alias(f"again_{s}"))])
    cases = cases.join(body.select("_row", "_claim", "id_from", "id_to", *CELL), "_row")
    for side in ("from", "to"):
        cases = cases.join(named(full, side, F.col("whole").alias(f"whole_{side}")), [f"id_{side}", *CELL], "left")
        cases = cases.withColumn(f"value_{side}", F.when(F.col(f"touched_{side}"), F.col(f"again_{side}")).otherwise(F.col(f"whole_{side}")))
    return cases.select("_claim", "omitted", "_row", (F.col("value_to") - F.col("value_from")).alias("again"))


def context_breakdown(pairs: DataFrame, keys: Sequence[str] = CLAIM, *, threshold: float = 0.5) -> DataFrame:
    """Statistics per (assay, context) of each claim."""
    shared = pairs.where(F.col("evidence_tier") == "shared assay").withColumn("context_id", F.col("context"))
    return effect_statistics(shared, [*keys, "assay", "context_id"], threshold=threshold)


def threshold_sweep(pairs: DataFrame, keys: Sequence[str] = CLAIM, *, thresholds: Sequence[float] = (0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """Interpretation at several effect thresholds: one statistics pass, then re-read."""
    keys = list(keys)
    shared = pairs.where(F.col("evidence_tier") == "shared assay")
    stats = effect_statistics(shared, keys, threshold=float(thresholds[0])).drop("interpretation")
    span = shared.groupBy(*keys).agg(F.max("delta").alias("_hi"), F.min("delta").alias("_lo"))
    rows = stats.join(span, keys).withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in sorted(set(thresholds))])))
    t = F.col("threshold")
    conflict = (F.col("_hi") > t) & (F.col("_lo") < -t)
    return rows.withColumn("interpretation", interpretation(F.col("median_delta"), F.col("direction_agreement"), conflict, t)).drop("_hi", "_lo")


def verdicts(checks: DataFrame, keys: Sequence[str] = CLAIM) -> DataFrame:
    """One verdict per claim from its baseline and its omissions."""
    keys = list(keys)
    base = F.col("test") == "Baseline"
    tested = ~base & (F.col("supporting_pairs") > 0)
    one = checks.groupBy(*keys).agg(
        F.max(F.when(base, F.col("supporting_pairs"))).alias("pairs"),
        F.max(F.when(base, F.col("interpretation"))).alias("direction"),
        F.max(F.when(base, F.col("disjoint_pairs"))).alias("disjoint"),
        F.count_if(~base).alias("tested_omissions"),
        F.count_if(tested).alias("evaluable_omissions"),
        F.count_if(tested & ~F.col("retains_direction")).alias("lost"),
    )
    verdict = (
        F.when(F.coalesce(F.col("pairs"), F.lit(0)) == 0, "Insufficient shared-assay evidence")
        .when(F.col("direction") == "mixed / small change", "Mixed or below the selected effect threshold")
        .when(F.col("disjoint") < 2, "Too sparse to assess transferability")
        .when(F.col("lost") > 0, "Conclusion depends on the retained evidence")
        .otherwise("Direction retained in the tested subsets")
    )
    return one.select(*keys, verdict.alias("verdict"), "tested_omissions", "evaluable_omissions")

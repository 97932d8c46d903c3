"""Matched pairs, positional claims, cycles and omission tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from measurelens.operators import pairs as pr
from measurelens.operators import stress
from measurelens.operators.common import settle
from measurelens.plans import bindings as b
from measurelens.plans.bindings import MEASURED, RESOLVED, SERIES
from measurelens.plans.registry import query, rounded

# Matched pairs: the order is the context, the part's type the fragment.
PAIRS = """mem AS MATERIALIZED (SELECT DISTINCT l_orderkey AS context, CAST(l_partkey AS VARCHAR) AS id, p_type AS fragment, log10(p_retailprice) AS v FROM lineitem JOIN part ON p_partkey = l_partkey),
 mp AS (SELECT a.context, a.id AS id_a, b.id AS id_b, a.fragment AS fragment_a, b.fragment AS fragment_b, a.v AS value_a, b.v AS value_b, b.v - a.v AS delta
  FROM mem a JOIN mem b ON a.context = b.context AND a.id < b.id AND a.fragment <> b.fragment)"""


def order_members(spark, d):
    li, part = b.table(spark, d, "lineitem"), b.table(spark, d, "part")
    return li.join(part, li.l_partkey == part.p_partkey).select(F.col("l_orderkey").alias("context"), F.col("l_partkey").cast("string").alias("id"), F.col("p_type").alias("fragment"), F.log10("p_retailprice").alias("v"))


def _matched(spark, d):
    return pr.matched_pairs(order_members(spark, d), context="context", entity="id", fragment="fragment", value="v")


@query("J9_matched_pairs", f"WITH {PAIRS} SELECT * REPLACE (round(value_a, 6) AS value_a, round(value_b, 6) AS value_b, round(delta, 6) + 0.0 AS delta) FROM mp")
def j9(spark, d):
    return rounded(_matched(spark, d))


@query("J9_pair_counts", f"WITH {PAIRS}, c AS (SELECT context, count(*) AS n FROM mp GROUP BY 1) SELECT DISTINCT context, coalesce(n, 0) AS pairs FROM mem LEFT JOIN c USING (context)")
def j9b(spark, d):
    return pr.count_matched_pairs(order_members(spark, d), context="context", entity="id", fragment="fragment", value="v")


@query("J9_pair_budget", f"WITH {PAIRS} SELECT context, id_a, id_b FROM mp ORDER BY context, id_a, fragment_a, value_a, id_b, fragment_b, value_b LIMIT 1000")
def j9c(spark, d):
    """The report's own pair budget, in context order."""
    return pr.matched_pairs(order_members(spark, d), context="context", entity="id", fragment="fragment", value="v", max_pairs=1000).select("context", "id_a", "id_b")


@query("P21_find_pairs", f"WITH {PAIRS} SELECT context, id_a, id_b, round(delta, 6) AS delta FROM mp WHERE abs(delta) >= 0.02 AND (contains(id_a, '77') OR contains(id_b, '77'))")
def p21(spark, d):
    return rounded(pr.find_pairs(_matched(spark, d), cutoff=0.02, text="77").select("context", "id_a", "id_b", "delta"))


@query(
    "C18_transformation_summary",
    f"""WITH {PAIRS}, sup AS (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS id, l_suppkey || l_returnflag AS assay FROM lineitem),
     ids AS (SELECT DISTINCT id_a, id_b FROM mp), shp AS (SELECT DISTINCT id_a, id_b FROM ids JOIN sup a ON a.id = id_a JOIN sup c ON c.id = id_b AND a.assay = c.assay),
     t AS (SELECT mp.*, least(fragment_a, fragment_b) AS fragment_from, greatest(fragment_a, fragment_b) AS fragment_to, CASE WHEN fragment_a > fragment_b THEN -delta ELSE delta END AS dd,
       CASE WHEN shp.id_a IS NOT NULL THEN 'shared assay' ELSE 'unmatched or unknown' END AS assay_context FROM mp LEFT JOIN shp USING (id_a, id_b)),
     r AS (SELECT *, row_number() OVER (PARTITION BY fragment_from, fragment_to, assay_context ORDER BY length(id_a), id_a, length(id_b), id_b, context) AS rn FROM t)
    SELECT fragment_from, fragment_to, assay_context, count(*) AS supporting_pairs, count(DISTINCT context) AS distinct_contexts, count(*) FILTER (dd > 0) AS positive_pairs, count(*) FILTER (dd < 0) AS negative_pairs,
      round(median(dd), 6) + 0.0 AS median_delta, round(quantile_cont(dd, 0.25), 6) + 0.0 AS q25_delta, round(quantile_cont(dd, 0.75), 6) + 0.0 AS q75_delta,
      string_agg(id_a || ' → ' || id_b, '; ' ORDER BY rn) FILTER (rn <= 5) AS example_ids FROM r GROUP BY 1, 2, 3""",
)
def c18(spark, d):
    li = b.table(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), F.concat(F.col("l_suppkey").cast("string"), "l_returnflag").alias("assay"))
    pairs = pr.matched_pairs(order_members(spark, d), context="context", entity="id", fragment="fragment", value="v", assays=pr.assay_lists(li, entity="id", assay="assay"))
    return rounded(pr.transformation_summary(pairs))


POSITIONS = ["R1", "R2", "R3"]
EV = dict(entity="id", assay="assay", endpoint="endpoint", variant="variant", value="v", record="record")


def _position_pairs(spark, d):
    return pr.position_pairs(b.series(spark, d), core=["core"], positions=POSITIONS, entity="id", value="v")


def _measured(spark, d):
    return pr.measured_medians(b.series_evidence(spark, d), **EV, relation="relation")


def _resolved(spark, d, joint=True):
    """Pairs with their evidence, written once; ``joint`` puts the core into the context."""
    out = pr.resolve_evidence(settle(_position_pairs(spark, d)), settle(_measured(spark, d)))
    # every statistic below reads the resolved pairs several times
    return settle(out.withColumn("context", F.concat_ws(" ", F.col("core").cast("string"), "context")) if joint else out)


@query("J10_position_pairs", f"WITH {SERIES} SELECT core, position, context, id_from, id_to, fragment_from, fragment_to, round(pooled_from, 6) AS pooled_from, round(pooled_to, 6) AS pooled_to FROM pp")
def j10(spark, d):
    return rounded(_position_pairs(spark, d))


@query("J12_measured_medians", f"WITH {MEASURED} SELECT entity, assay, endpoint, variant, round(value, 6) AS value, records FROM (SELECT me.* REPLACE (rr AS records) FROM me JOIN (SELECT id, assay, endpoint, variant, string_agg(DISTINCT record, ';' ORDER BY record) AS rr FROM ev WHERE relation = '=' GROUP BY ALL) x ON x.id = entity AND x.assay = me.assay AND x.endpoint = me.endpoint AND x.variant = me.variant)")
def j12(spark, d):
    return rounded(_measured(spark, d))


@query(
    "J11_evidence_tiers",
    f"""WITH {SERIES}, {MEASURED}, {RESOLVED} SELECT core, position, context, fragment_from, fragment_to, id_from, id_to, assay, endpoint, variant, evidence_tier, round(value_from, 6) AS value_from, round(value_to, 6) AS value_to,
      records_from, records_to, round(delta, 6) + 0.0 AS delta FROM rp""",
)
def j11(spark, d):
    return rounded(_resolved(spark, d, joint=False))


def disjoint_sql(rows: str, keys: str) -> str:
    """Greedy disjoint pairs per (keys, context): a fold over the sorted pairs of a context."""
    return f"""dz AS (SELECT {keys}, context, list_sort(list(DISTINCT {{'f': id_from, 't': id_to}})) AS ps FROM {rows} GROUP BY ALL),
     dg AS (SELECT {keys}, list_reduce(list_transform(ps, lambda p: {{'n': 0, 'u': [p.f, p.t]}}), lambda acc, p: CASE WHEN list_has_any(acc.u, p.u) THEN acc ELSE {{'n': acc.n + 1, 'u': list_concat(acc.u, p.u)}} END) AS g FROM dz),
     dj AS (SELECT {keys}, CAST(sum(g.n + 1) AS BIGINT) AS disjoint_pairs FROM dg GROUP BY ALL)"""


KEYS = "position, fragment_from, fragment_to, evidence_tier, endpoint, variant"


def stats_sql(rows: str, keys: str, t: str = "0.5") -> str:
    return f"""vo AS (SELECT {keys}, id_from, id_to, median(delta) AS e FROM {rows} GROUP BY ALL),
     st AS (SELECT {keys}, count(*) AS supporting_pairs, count(*) FILTER (e > 0) AS positive_pairs, count(*) FILTER (e < 0) AS negative_pairs, median(e) AS md, quantile_cont(e, 0.25) AS q1, quantile_cont(e, 0.75) AS q3,
       greatest(count(*) FILTER (e > 0), count(*) FILTER (e < 0))::DOUBLE / count(*) AS agr FROM vo GROUP BY ALL),
     ba AS (SELECT {keys}, count(DISTINCT context) AS distinct_contexts, count(DISTINCT nullif(assay, '')) AS assays, max(delta) AS hi, min(delta) AS lo FROM {rows} GROUP BY ALL),
     {disjoint_sql(rows, keys)},
     cs AS (SELECT *, CASE WHEN abs(md) < {t} OR agr < 0.8 OR (hi > {t} AND lo < -{t}) THEN 'mixed / small change' WHEN md > 0 THEN 'increase' ELSE 'decrease' END AS interpretation FROM ba JOIN st USING ({keys}) JOIN dj USING ({keys}))"""


# Claims run over all cores: the core is part of the context, and an order has one core.
CLAIMS = f"""{SERIES}, {MEASURED}, {RESOLVED}, {stats_sql('gp', KEYS, '0.05')},
 cl AS (SELECT {KEYS}, distinct_contexts, assays, supporting_pairs, positive_pairs, negative_pairs, md AS median_delta, q1 AS q25_delta, q3 AS q75_delta, disjoint_pairs, agr AS direction_agreement, interpretation,
  CASE WHEN interpretation = 'mixed / small change' THEN 'mixed' WHEN evidence_tier = 'shared assay' AND disjoint_pairs >= 3 AND distinct_contexts >= 2 THEN 'strong' WHEN evidence_tier = 'shared assay' AND disjoint_pairs >= 2 THEN 'moderate' ELSE 'limited' END AS evidence_strength FROM cs)"""
ROUND = "round(median_delta, 6) + 0.0 AS median_delta, round(q25_delta, 6) + 0.0 AS q25_delta, round(q75_delta, 6) + 0.0 AS q75_delta, round(direction_agreement, 6) AS direction_agreement"


def _claims(spark, d):
    return pr.claims(_resolved(spark, d), threshold=0.05)


@query("C19_claims", f"WITH {CLAIMS} SELECT cl.* REPLACE ({ROUND}) FROM cl")
def c19(spark, d):
    return rounded(pr.rank_claims(_claims(spark, d)))


@query("C20_disjoint_pairs", f"WITH {SERIES}, {MEASURED}, {RESOLVED}, {disjoint_sql('gp', 'position, fragment_from, fragment_to, evidence_tier')} SELECT * FROM dj")
def c20(spark, d):
    return pr.disjoint_counts(_resolved(spark, d), ["position", "fragment_from", "fragment_to", "evidence_tier"])


PRIORITY = "CASE WHEN evidence_strength = 'strong' THEN 4 WHEN evidence_strength = 'moderate' THEN 3 WHEN evidence_strength = 'mixed' AND disjoint_pairs >= 2 THEN 2 WHEN evidence_strength = 'limited' THEN 1 ELSE 0 END"


@query(
    "C21_C22_best_claims",
    f"""WITH {CLAIMS}, rk AS (SELECT *, row_number() OVER (PARTITION BY position ORDER BY {PRIORITY} DESC, disjoint_pairs DESC, supporting_pairs DESC, abs(median_delta) DESC, fragment_from, fragment_to, evidence_tier, endpoint, variant) AS rn FROM cl),
     s AS (SELECT unnest(['R1', 'R2', 'R3', 'R4']) AS position)
    SELECT position, CASE WHEN rn IS NULL THEN 'No single-position comparisons' ELSE fragment_from || CASE WHEN evidence_strength = 'mixed' THEN ' ↔ ' ELSE ' → ' END || fragment_to END AS label,
      CASE WHEN rn IS NULL THEN 'Insufficient evidence' ELSE 'Δ ' || CASE WHEN median_delta < 0 THEN '' ELSE '+' END || printf('%.2f', median_delta) || ' · ' || supporting_pairs || ' pairs · ' || evidence_strength END AS detail, endpoint, variant
    FROM s LEFT JOIN rk USING (position) WHERE coalesce(rn, 1) = 1""",
)
def c22(spark, d):
    slots = spark.range(1).select(F.explode(F.array(*[F.lit(p) for p in [*POSITIONS, "R4"]])).alias("position"))
    return pr.best_claims(_claims(spark, d), slots, ["position"])


@query("C50_shared_pairs", f"WITH {SERIES}, {MEASURED}, {RESOLVED} SELECT core, count(DISTINCT (id_from, id_to)) AS shared_pairs FROM rp WHERE evidence_tier = 'shared assay' GROUP BY 1")
def c50(spark, d):
    return pr.shared_pair_count(_resolved(spark, d, joint=False), ["core"])


DIRECTED = f"""{SERIES}, {MEASURED}, {RESOLVED}, par AS (SELECT unnest(['R1', 'R2', 'R3']) AS position, unnest(['3-MEDIUM', 'O', '1998']) AS frag),
 di AS (SELECT position, fragment_from, fragment_to, id_from, id_to, delta FROM gp UNION ALL SELECT position, fragment_to, fragment_from, id_to, id_from, -delta FROM gp),
 dd AS (SELECT di.* FROM di JOIN par ON par.position = di.position AND par.frag = di.fragment_from),
 dv AS (SELECT position, fragment_from, fragment_to, id_from, id_to, median(delta) AS e FROM dd GROUP BY ALL)"""


def _directed(spark, d):
    parents = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(p).alias("position"), F.lit(f).alias("fragment")) for p, f in (("R1", "3-MEDIUM"), ("R2", "O"), ("R3", "1998"))])).alias("s")).select("s.*")
    return pr.directed_evidence(_resolved(spark, d), parents)


@query(
    "J24_candidate_effects",
    f"WITH {DIRECTED} SELECT position, fragment_from, fragment_to, count(*) AS pairs, count(*) FILTER (e > 0) AS positive, count(*) FILTER (e < 0) AS negative, round(median(e), 6) + 0.0 AS median_effect FROM dv GROUP BY 1, 2, 3",
)
def j24(spark, d):
    return rounded(pr.candidate_effects(_directed(spark, d), ["position", "fragment_from", "fragment_to"]))


@query(
    "C46_pair_conflicts",
    f"""WITH {DIRECTED}, cand AS (SELECT position || ':' || fragment_to AS candidate, avg(delta) * 10 - 0.05 AS predicted FROM dd WHERE fragment_to <> '1-URGENT' GROUP BY 1 UNION ALL SELECT 'R1:1-URGENT', NULL UNION ALL SELECT 'R9:none', 0.3),
     x AS (SELECT candidate, predicted, e FROM cand LEFT JOIN (SELECT position || ':' || fragment_to AS candidate, e FROM dv) USING (candidate)),
     y AS (SELECT candidate, predicted, count(e) AS measured_pairs, count(*) FILTER ((predicted > 1e-8 AND e < -1e-8) OR (predicted < -1e-8 AND e > 1e-8)) AS opp FROM x GROUP BY 1, 2)
    SELECT candidate, round(predicted, 5) + 0.0 AS predicted, measured_pairs, opp AS opposing_measured_pairs, CASE WHEN predicted IS NULL THEN 'Not assessed (no numeric prediction)' WHEN measured_pairs = 0 THEN 'No measured-pair effects available'
      WHEN opp > 0 THEN 'Conflict' ELSE 'No opposite-direction measured pair found' END AS pair_evidence FROM y""",
)
def c46(spark, d):
    rows = _directed(spark, d).withColumn("candidate", F.concat_ws(":", "position", "fragment_to"))
    cand = rows.where("fragment_to <> '1-URGENT'").groupBy("candidate").agg((F.avg("delta") * 10 - 0.05).alias("predicted"))
    extra = spark.range(1).select(F.explode(F.array(F.struct(F.lit("R1:1-URGENT").alias("candidate"), F.lit(None).cast("double").alias("predicted")), F.struct(F.lit("R9:none").alias("candidate"), F.lit(0.3).alias("predicted")))).alias("s")).select("s.*")
    return rounded(pr.pair_conflicts(cand.unionByName(extra), rows, candidate="candidate", predicted="predicted"), 5)


UNIQUE = """pat AS (SELECT core, position, context, fragment, count(DISTINCT id) AS holders, min(id) AS id FROM pos GROUP BY 1, 2, 3, 4),
 lone AS MATERIALIZED (SELECT core, position, context, fragment, id FROM pat WHERE holders = 1),
 shu AS MATERIALIZED (SELECT rp.* FROM rp JOIN lone a ON a.core = rp.core AND a.position = rp.position AND a.context = rp.context AND a.fragment = fragment_from
   JOIN lone c ON c.core = rp.core AND c.position = rp.position AND c.context = rp.context AND c.fragment = fragment_to WHERE evidence_tier = 'shared assay'),
 att AS (SELECT id, R1, R2, R3 FROM ser), oth AS (SELECT unnest(['R1','R2','R3']) AS o),
 leg AS MATERIALIZED (SELECT shu.*, o AS other_position, CASE o WHEN 'R1' THEN R1 WHEN 'R2' THEN R2 ELSE R3 END AS of_, CASE WHEN 'R1' NOT IN (position, o) THEN R1 WHEN 'R2' NOT IN (position, o) THEN R2 ELSE R3 END AS rest
   FROM shu JOIN att ON att.id = id_from JOIN oth ON o <> position)"""


def _patterns(spark, d):
    return stress.pattern_members(b.series(spark, d), core=["core"], positions=POSITIONS, entity="id")


@query(
    "J16_interaction_cycles",
    f"""WITH {SERIES}, {MEASURED}, {RESOLVED}, {UNIQUE} SELECT a.core, a.position, a.fragment_from, a.fragment_to, a.assay, a.endpoint, a.variant, a.other_position, a.of_ AS context_from, c.of_ AS context_to,
      a.id_from AS id_a, a.id_to AS id_b, c.id_from AS id_c, c.id_to AS id_d, round(a.delta, 6) + 0.0 AS delta_first, round(c.delta, 6) + 0.0 AS delta_second, round(c.delta - a.delta, 6) + 0.0 AS interaction_delta
    FROM leg a JOIN leg c USING (core, position, fragment_from, fragment_to, assay, endpoint, variant, other_position, rest) WHERE a.of_ < c.of_""",
)
def j16(spark, d):
    return rounded(stress.interaction_cycles(_resolved(spark, d, joint=False), _patterns(spark, d), core=["core"]))


@query(
    "J17_missing_corners",
    f"""WITH {SERIES}, {MEASURED}, {RESOLVED}, {UNIQUE},
     th AS (SELECT l.core, l.position, l.fragment AS fragment_from, l.context, l.id AS third_id, me.assay, me.endpoint, me.variant, o AS other_position, CASE o WHEN 'R1' THEN R1 WHEN 'R2' THEN R2 ELSE R3 END AS cf,
       CASE WHEN 'R1' NOT IN (position, o) THEN R1 WHEN 'R2' NOT IN (position, o) THEN R2 ELSE R3 END AS rest FROM lone l JOIN me ON me.entity = l.id JOIN att ON att.id = l.id JOIN oth ON o <> position),
     op AS (SELECT leg.core, leg.position, th.context, leg.fragment_to, leg.assay, leg.endpoint, leg.variant, leg.other_position, leg.id_from, leg.id_to, third_id FROM leg JOIN th USING (core, position, fragment_from, assay, endpoint, variant, other_position, rest) WHERE of_ <> cf),
     fo AS (SELECT op.*, pat.id AS fid FROM op LEFT JOIN pat ON pat.core = op.core AND pat.position = op.position AND pat.context = op.context AND pat.fragment = op.fragment_to WHERE coalesce(holders, 0) <= 1),
     td AS (SELECT * FROM fo WHERE NOT EXISTS (SELECT 1 FROM me WHERE me.entity = fid AND me.assay = fo.assay AND me.endpoint = fo.endpoint AND me.variant = fo.variant))
    SELECT CASE WHEN any_value(fid) IS NOT NULL THEN 'Measure existing analogue' ELSE 'Complete missing analogue' END AS action, core, position, min(other_position) AS other_position, context, fragment_to AS proposed_fragment, assay, endpoint, variant,
      coalesce(any_value(fid), '') AS existing_id, min({{'a': id_from, 'b': id_to, 'c': third_id}}).a || ';' || min({{'a': id_from, 'b': id_to, 'c': third_id}}).b || ';' || min({{'a': id_from, 'b': id_to, 'c': third_id}}).c AS supporting_ids FROM td GROUP BY core, position, context, fragment_to, assay, endpoint, variant""",
)
def j17(spark, d):
    # which cells are there is all that counts here, not their values, and pooled pairs make no square
    measured = settle(pr.measured_cells(b.series_evidence(spark, d), **EV, relation="relation"))
    valueless = b.series(spark, d).withColumn("v", F.lit(None).cast("double"))
    pairs = pr.shared_evidence(pr.position_pairs(valueless, core=["core"], positions=POSITIONS, entity="id", value="v"), measured)
    out = stress.missing_corners(pairs, _patterns(spark, d), measured, b.series(spark, d), core=["core"], positions=POSITIONS, entity="id")
    return out.select("action", "core", "position", "other_position", "context", "proposed_fragment", "assay", "endpoint", "variant", "existing_id", "supporting_ids")


@query(
    "J17_conflicting_pairs",
    f"""WITH {SERIES}, {MEASURED}, {RESOLVED}, s AS (SELECT position, fragment_from, fragment_to, id_from, id_to, min(delta) AS lo, max(delta) AS hi FROM gp WHERE evidence_tier = 'shared assay' GROUP BY ALL),
     r AS (SELECT *, row_number() OVER (PARTITION BY position, fragment_from, fragment_to ORDER BY hi - lo DESC, id_from, id_to) AS rn FROM s WHERE lo < -0.05 AND hi > 0.05)
    SELECT 'Retest conflicting pair' AS action, position, fragment_from, fragment_to, id_from, id_to, round(lo, 6) AS low, round(hi, 6) AS high FROM r WHERE rn = 1""",
)
def j17b(spark, d):
    rows = _resolved(spark, d).where("evidence_tier = 'shared assay'")
    return rounded(stress.conflicting_pairs(rows, ["position", "fragment_from", "fragment_to"], 0.05))


@query(
    "J17_sparse_pairs",
    f"""WITH {CLAIMS}, f AS (SELECT {KEYS} FROM cl WHERE disjoint_pairs < 2), r AS (SELECT gp.*, row_number() OVER (PARTITION BY {KEYS} ORDER BY id_from, id_to, assay, endpoint, variant) AS rn FROM gp JOIN f USING ({KEYS}))
    SELECT 'Remeasure sparse pair' AS action, {KEYS}, id_from, id_to FROM r WHERE rn = 1""",
)
def j17c(spark, d):
    rows = _resolved(spark, d)
    return stress.sparse_pairs(pr.claims(rows, threshold=0.05), rows, list(pr.CLAIM))


# Omission tests of every claim with shared-assay evidence.
OMIT_KEYS = "position, fragment_from, fragment_to, evidence_tier, endpoint, variant"
CHOSEN = f"""{SERIES}, {MEASURED}, {RESOLVED}, one AS (SELECT * FROM gp WHERE evidence_tier = 'shared assay')"""
OMIT = f"""{CHOSEN},
 oi AS (SELECT DISTINCT {OMIT_KEYS}, unnest([id_from, id_to]) AS omitted FROM one),
 oc AS (SELECT DISTINCT {OMIT_KEYS}, omitted FROM oi),
 ox AS (SELECT DISTINCT {OMIT_KEYS}, context AS omitted FROM one),
 oa AS (SELECT DISTINCT {OMIT_KEYS}, assay AS omitted FROM one),
 rc AS (SELECT DISTINCT id, assay, endpoint, variant, v, record, document FROM ev WHERE relation = '='),
 tc AS (SELECT DISTINCT id, assay, endpoint, variant, document FROM rc),
 us_ AS (SELECT DISTINCT {OMIT_KEYS}, assay, unnest([id_from, id_to]) AS id FROM one),
 od AS (SELECT DISTINCT {OMIT_KEYS}, document AS omitted FROM us_ JOIN tc USING (id, assay, endpoint, variant)),
 ag AS (SELECT tc.id, tc.assay, tc.endpoint, tc.variant, tc.document AS omitted, median(rc.v) AS again FROM tc LEFT JOIN rc ON rc.id = tc.id AND rc.assay = tc.assay AND rc.endpoint = tc.endpoint AND rc.variant = tc.variant AND rc.document <> tc.document GROUP BY ALL),
 wd AS (SELECT one.* EXCLUDE (value_from, value_to, delta), od.omitted, CASE WHEN a.id IS NULL THEN value_from ELSE a.again END AS value_from, CASE WHEN c.id IS NULL THEN value_to ELSE c.again END AS value_to
  FROM one JOIN od USING ({OMIT_KEYS}) LEFT JOIN ag a ON a.id = id_from AND a.assay = one.assay AND a.endpoint = one.endpoint AND a.variant = one.variant AND a.omitted = od.omitted
   LEFT JOIN ag c ON c.id = id_to AND c.assay = one.assay AND c.endpoint = one.endpoint AND c.variant = one.variant AND c.omitted = od.omitted),
 om AS (SELECT {OMIT_KEYS}, context, assay, id_from, id_to, delta, 'Baseline' AS test, 'None' AS omitted FROM one
  UNION ALL SELECT {OMIT_KEYS}, context, assay, id_from, id_to, delta, 'Leave one compound out', omitted FROM one JOIN oc USING ({OMIT_KEYS}) WHERE omitted NOT IN (id_from, id_to)
  UNION ALL SELECT {OMIT_KEYS}, context, assay, id_from, id_to, delta, 'Leave one chemical context out', omitted FROM one JOIN ox USING ({OMIT_KEYS}) WHERE omitted <> context
  UNION ALL SELECT {OMIT_KEYS}, context, assay, id_from, id_to, delta, 'Leave one assay out', omitted FROM one JOIN oa USING ({OMIT_KEYS}) WHERE omitted <> assay
  UNION ALL SELECT {OMIT_KEYS}, context, assay, id_from, id_to, value_to - value_from, 'Leave one publication out', omitted FROM wd WHERE value_from IS NOT NULL AND value_to IS NOT NULL),
 pl AS (SELECT {OMIT_KEYS}, 'Baseline' AS test, 'None' AS omitted FROM one GROUP BY ALL UNION ALL SELECT {OMIT_KEYS}, 'Leave one compound out', omitted FROM oc UNION ALL SELECT {OMIT_KEYS}, 'Leave one chemical context out', omitted FROM ox
  UNION ALL SELECT {OMIT_KEYS}, 'Leave one assay out', omitted FROM oa UNION ALL SELECT {OMIT_KEYS}, 'Leave one publication out', omitted FROM od),
 {stats_sql('om', OMIT_KEYS + ', test, omitted', '0.01')},
 ck AS (SELECT {OMIT_KEYS}, test, omitted, coalesce(supporting_pairs, 0) AS supporting_pairs, coalesce(disjoint_pairs, 0) AS disjoint_pairs, coalesce(assays, 0) AS assays, md AS median_delta, agr AS direction_agreement,
  coalesce(interpretation, 'insufficient evidence') AS interpretation FROM pl LEFT JOIN cs USING ({OMIT_KEYS}, test, omitted)),
 cr AS (SELECT ck.*, bs.interpretation IN ('increase', 'decrease') AND ck.interpretation = bs.interpretation AS retains_direction FROM ck JOIN (SELECT {OMIT_KEYS}, interpretation FROM ck WHERE test = 'Baseline') bs USING ({OMIT_KEYS}))"""


def _checks(spark, d):
    ev = b.series_evidence(spark, d).where("relation = '='")
    return stress.omission_checks(_resolved(spark, d), ev, threshold=0.01, entity="id", assay="assay", endpoint="endpoint", variant="variant", value="v", record="record", document="document")


@query(
    "R13_omission_checks",
    f"WITH {OMIT} SELECT cr.* REPLACE (round(median_delta, 6) + 0.0 AS median_delta, round(direction_agreement, 6) AS direction_agreement) FROM cr",
)
def r13(spark, d):
    return rounded(_checks(spark, d))


@query(
    "R14_context_breakdown",
    f"""WITH {CHOSEN}, two AS (SELECT *, context AS context_id FROM one), {stats_sql('two', OMIT_KEYS + ', assay, context_id', '0.01').replace("count(DISTINCT nullif(assay, '')) AS assays", "1 AS assays_")}
    SELECT {OMIT_KEYS}, assay, context_id, distinct_contexts, CAST(1 AS BIGINT) AS assays, supporting_pairs, positive_pairs, negative_pairs, round(md, 6) + 0.0 AS median_delta, round(q1, 6) + 0.0 AS q25_delta, round(q3, 6) + 0.0 AS q75_delta, disjoint_pairs,
      round(agr, 6) AS direction_agreement, interpretation FROM cs""",
)
def r14(spark, d):
    return rounded(stress.context_breakdown(_resolved(spark, d), threshold=0.01))


@query(
    "R14_threshold_sweep",
    f"""WITH {CHOSEN}, {stats_sql('one', OMIT_KEYS, '0.01')}, t AS (SELECT unnest([0.005, 0.01, 0.25, 1.0])::DOUBLE AS threshold)
    SELECT {OMIT_KEYS}, threshold, distinct_contexts, assays, supporting_pairs, positive_pairs, negative_pairs, round(md, 6) + 0.0 AS median_delta, round(q1, 6) + 0.0 AS q25_delta, round(q3, 6) + 0.0 AS q75_delta, disjoint_pairs, round(agr, 6) AS direction_agreement,
      CASE WHEN abs(md) < threshold OR agr < 0.8 OR (hi > threshold AND lo < -threshold) THEN 'mixed / small change' WHEN md > 0 THEN 'increase' ELSE 'decrease' END AS interpretation FROM cs, t""",
)
def r14b(spark, d):
    return rounded(stress.threshold_sweep(_resolved(spark, d), thresholds=(0.005, 0.01, 0.25, 1.0)))


@query(
    "R15_verdicts",
    f"""WITH {OMIT}, g AS (SELECT {OMIT_KEYS}, max(supporting_pairs) FILTER (test = 'Baseline') AS p, max(interpretation) FILTER (test = 'Baseline') AS dir, max(disjoint_pairs) FILTER (test = 'Baseline') AS dj_, count(*) FILTER (test <> 'Baseline') AS tested_omissions,
      count(*) FILTER (test <> 'Baseline' AND supporting_pairs > 0) AS evaluable_omissions, count(*) FILTER (test <> 'Baseline' AND supporting_pairs > 0 AND NOT retains_direction) AS lost FROM cr GROUP BY ALL)
    SELECT {OMIT_KEYS}, CASE WHEN coalesce(p, 0) = 0 THEN 'Insufficient shared-assay evidence' WHEN dir = 'mixed / small change' THEN 'Mixed or below the selected effect threshold' WHEN dj_ < 2 THEN 'Too sparse to assess transferability'
      WHEN lost > 0 THEN 'Conclusion depends on the retained evidence' ELSE 'Direction retained in the tested subsets' END AS verdict, tested_omissions, evaluable_omissions FROM g""",
)
def r15(spark, d):
    return stress.verdicts(_checks(spark, d))

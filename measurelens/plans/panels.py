"""Two-panel comparison, reconciliation, stability and lookup queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from measurelens.operators import compare
from measurelens.operators.ordered import quantiles
from measurelens.plans import bindings as b
from measurelens.plans.bindings import M
from measurelens.plans.registry import query, rounded

# An entity is a part of one supplier.  Panel A measures it on lines with status F, panel B on those with status O;
# most entities are on one panel only.
PANELS = """li AS (SELECT *, l_partkey * 100000 + l_suppkey AS key, log10(l_extendedprice) AS v FROM lineitem),
 pa AS (SELECT key, l_partkey, median(v) AS va FROM li WHERE l_linestatus = 'F' GROUP BY 1, 2),
 pb AS (SELECT key, l_partkey, median(v) AS vb FROM li WHERE l_linestatus = 'O' GROUP BY 1, 2),
 a AS (SELECT key, nullif(p_name, 'red widget') AS murcko, va, CASE WHEN va >= 4.5 THEN 1 ELSE 2 END AS ga FROM pa JOIN part ON p_partkey = l_partkey),
 c AS (SELECT key, nullif(p_name, 'red widget') AS murcko, vb, CASE WHEN vb >= 4.4 THEN 1 ELSE 2 END AS gb FROM pb JOIN part ON p_partkey = l_partkey)"""


def panels(spark, d):
    li = b.table(spark, d, "lineitem").select((F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("key"), "l_partkey", "l_linestatus", F.log10("l_extendedprice").alias("v"))
    part = b.table(spark, d, "part").select("p_partkey", F.nullif(F.col("p_name"), F.lit("red widget")).alias("murcko"))

    def side(status, value, group, bound):
        medians = quantiles(li.where(F.col("l_linestatus") == status), ["key", "l_partkey"], "v", {value: 0.5})
        out = medians.join(part, medians.l_partkey == part.p_partkey)
        return out.select("key", "murcko", value, F.when(F.col(value) >= bound, 1).otherwise(2).alias(group))

    return side("F", "va", "ga", 4.5), side("O", "vb", "gb", 4.4)


@query(
    "J3_shared_entities",
    f"""WITH {PANELS} SELECT key, a.murcko, round(va, 6) AS va, ga, round(vb, 6) AS vb, gb, round(va - vb, 6) + 0.0 AS delta_a_minus_b, round(pow(10.0, va - vb), 6) AS ratio_a_over_b,
      CASE WHEN va > vb THEN 'A' WHEN va < vb THEN 'B' ELSE 'tie' END AS preferred FROM a JOIN c USING (key)""",
)
def j3(spark, d):
    a, c = panels(spark, d)
    return rounded(compare.shared_entities(a, c.drop("murcko"), key="key", value_a="va", value_b="vb"))


@query(
    "J4_shared_groups",
    f"""WITH {PANELS}, sa AS (SELECT murcko, count(*) AS n, median(va) AS m, avg(CASE WHEN ga = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS f FROM a WHERE murcko IS NOT NULL GROUP BY 1),
     sb AS (SELECT murcko, count(*) AS n, median(vb) AS m, avg(CASE WHEN gb = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS f FROM c WHERE murcko IS NOT NULL GROUP BY 1),
     sh AS (SELECT a.murcko, count(*) AS k, median(va - vb) AS md FROM a JOIN c USING (key) WHERE a.murcko IS NOT NULL GROUP BY 1),
     bs AS (SELECT (SELECT avg(CASE WHEN ga = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FROM a) AS ba, (SELECT avg(CASE WHEN gb = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FROM c) AS bb),
     j AS (SELECT sa.murcko AS scaffold, sa.n AS n_a, sb.n AS n_b, sa.m AS ma, sb.m AS mb, sa.f AS fa, sb.f AS fb, k, md, sa.f / ba AS ea, sb.f / bb AS eb FROM sa JOIN sb USING (murcko) LEFT JOIN sh USING (murcko), bs)
    SELECT scaffold, n_a, n_b, round(ma, 6) AS median_a, round(mb, 6) AS median_b, round(fa, 6) AS active_fraction_a, round(fb, 6) AS active_fraction_b, k AS shared_compounds, round(md, 6) AS median_delta,
      round(fa - fb, 6) + 0.0 AS fraction_delta, round(ea, 6) AS enrichment_a, round(eb, 6) AS enrichment_b, round(ea - eb, 6) + 0.0 AS enrichment_delta,
      CASE WHEN ea > 1 AND eb <= 1 THEN 'A' WHEN eb > 1 AND ea <= 1 THEN 'B' WHEN ea > 1 AND eb > 1 THEN 'both' ELSE 'neither' END AS enriched_target FROM j""",
)
def j4(spark, d):
    a, c = panels(spark, d)
    shared = compare.shared_entities(a, c.drop("murcko"), key="key", value_a="va", value_b="vb")
    return rounded(compare.shared_groups(a, c, shared, scaffold="murcko", value_a="va", value_b="vb", group_a="ga", group_b="gb"))


@query(
    "J5_activity_matrix",
    f"""WITH {PANELS} SELECT key, round(va, 6) AS va, round(vb, 6) AS vb, coalesce(a.murcko, c.murcko) AS structure, va IS NOT NULL AS measured_on_a, vb IS NOT NULL AS measured_on_b,
      CASE WHEN va IS NOT NULL AND vb IS NOT NULL THEN 'both' WHEN va IS NOT NULL THEN 'A only' ELSE 'B only' END AS coverage FROM a FULL JOIN c USING (key)""",
)
def j5(spark, d):
    a, c = panels(spark, d)
    out = compare.activity_matrix(a.withColumnRenamed("murcko", "ma"), c.withColumnRenamed("murcko", "mb"), key="key", value_a="va", value_b="vb", label_a="ma", label_b="mb")
    return rounded(out.select("key", "va", "vb", "structure", "measured_on_a", "measured_on_b", "coverage"))


@query(
    "J6_context_quality",
    """WITH x AS (SELECT l_partkey * 100000 + l_suppkey AS id, l_linestatus AS side, l_returnflag AS ep, CASE WHEN l_quantity < 25 THEN 'small' ELSE 'large' END AS fmt, l_orderkey % 3 AS doc FROM lineitem),
     g AS (SELECT id, side, list_sort(list(DISTINCT ep)) AS ep, list_sort(list(DISTINCT fmt)) AS fmt, list(DISTINCT doc) AS doc FROM x GROUP BY 1, 2)
    SELECT a.id, CASE WHEN len(a.ep) <> 1 OR a.ep <> c.ep THEN 'endpoint mismatch or pooling' WHEN len(a.fmt) <> 1 OR a.fmt <> c.fmt THEN 'assay-format mismatch or pooling'
      WHEN list_has_any(a.doc, c.doc) THEN 'same endpoint, format and document' ELSE 'same endpoint and format; different documents' END AS assay_context
    FROM g a JOIN g c ON a.id = c.id AND a.side = 'F' AND c.side = 'O'""",
)
def j6(spark, d):
    li = b.table(spark, d, "lineitem").select(
        (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("id"), "l_linestatus", F.col("l_returnflag").alias("ep"), F.when(F.col("l_quantity") < 25, "small").otherwise("large").alias("fmt"), (F.col("l_orderkey") % 3).alias("doc")
    )
    fields = {"endpoint": "ep", "format": "fmt", "document": "doc"}
    a, c = (compare.context_sets(li.where(F.col("l_linestatus") == s), entity="id", fields=fields) for s in ("F", "O"))
    pairs = a.select("id").join(c.select("id"), "id").select(F.col("id").alias("id_a"), F.col("id").alias("id_b"))
    return compare.context_quality(pairs, a, c, id_a="id_a", id_b="id_b", entity="id").select(F.col("id_a").alias("id"), "assay_context")


@query(
    "J19_contact_changes",
    """WITH a AS (SELECT l_partkey AS k, l_suppkey AS f, min(l_quantity) AS da FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2),
     c AS (SELECT l_partkey AS k, l_suppkey AS f, min(l_quantity) AS db FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2)
    SELECT k AS residue, f AS interaction, CASE WHEN da IS NOT NULL AND db IS NOT NULL THEN 'retained' WHEN da IS NOT NULL THEN 'lost' ELSE 'gained' END AS change, da AS distance_a, db AS distance_b FROM a FULL JOIN c USING (k, f)""",
)
def j19(spark, d):
    li = b.table(spark, d, "lineitem").select(F.col("l_partkey").alias("residue"), F.col("l_suppkey").alias("interaction"), "l_quantity", "l_linestatus")
    a, c = li.where("l_linestatus = 'F'"), li.where("l_linestatus = 'O'")
    return compare.contact_changes(a, c, keys=["residue", "interaction"], distance="l_quantity")


@query(
    "J22_label_reconciliation",
    """WITH a AS (SELECT CASE c_mktsegment WHEN 'BUILDING' THEN 'CONSTRUCTION' ELSE c_mktsegment END || c_nationkey AS k, avg(c_acctbal) AS x FROM customer WHERE c_nationkey > 1 GROUP BY 1),
     c AS (SELECT CASE c_mktsegment WHEN 'BUILDING' THEN 'CONSTRUCTION' ELSE c_mktsegment END || c_nationkey AS k, floor(avg(c_acctbal) * 100 + 0.500001::DOUBLE) / 100 + CASE WHEN c_nationkey = 9 THEN 0.5 ELSE 0 END AS y FROM customer WHERE c_nationkey < 20 GROUP BY 1, c_nationkey)
    SELECT k AS name, round(x, 4) AS a, round(y, 4) AS b, round(x - y, 4) + 0.0 AS difference, abs(x - y) > 0.0051 AS beyond_rounding, x IS NULL OR y IS NULL AS identity_mismatch FROM a FULL JOIN c USING (k)""",
)
def j22(spark, d):
    c = b.table(spark, d, "customer")
    key = F.concat("c_mktsegment", F.col("c_nationkey").cast("string"))
    renamed = F.concat(F.when(F.col("c_mktsegment") == "BUILDING", "CONSTRUCTION").otherwise(F.col("c_mktsegment")), F.col("c_nationkey").cast("string"))
    a = c.where("c_nationkey > 1").groupBy(key.alias("name")).agg(F.avg("c_acctbal").alias("a"))
    other = c.where("c_nationkey < 20").groupBy(renamed.alias("name"), "c_nationkey").agg((F.floor(F.avg("c_acctbal") * 100 + 0.500001) / 100).alias("y"))
    other = other.select("name", (F.col("y") + F.when(F.col("c_nationkey") == 9, 0.5).otherwise(0.0)).alias("b"))
    alias = {f"BUILDING{i}": f"CONSTRUCTION{i}" for i in range(25)}
    out = compare.reconcile(a, other, key="name", alias=alias, value_a="a", value_b="b")
    named = F.when(F.col("name").startswith("BUILDING"), F.regexp_replace("name", "^BUILDING", "CONSTRUCTION")).otherwise(F.col("name"))
    return rounded(out.withColumn("name", named), 4)


@query(
    "J23_paired_rmsd",
    """WITH p AS (SELECT label, vec_id % 7 AS point, list_transform([1,2,3], lambda i: embedding[i]::DOUBLE) AS e, vec_id FROM embeddings), a AS (SELECT label, point, avg(e[1]) AS x, avg(e[2]) AS y, avg(e[3]) AS z FROM p GROUP BY 1, 2),
     c AS (SELECT label, point, max(e[1]) AS x, max(e[2]) AS y, max(e[3]) AS z FROM p GROUP BY 1, 2)
    SELECT label, round(sqrt(avg((a.x-c.x)*(a.x-c.x) + (a.y-c.y)*(a.y-c.y) + (a.z-c.z)*(a.z-c.z))), 6) AS rmsd, count(*) AS pairs FROM a JOIN c USING (label, point) GROUP BY 1""",
)
def j23(spark, d):
    e = b.table(spark, d, "embeddings").select("label", F.pmod("vec_id", F.lit(7)).alias("point"), *[F.get("embedding", i).cast("double").alias(c) for i, c in enumerate("xyz")])
    a = e.groupBy("label", "point").agg(*[F.avg(c).alias(c) for c in "xyz"])
    c = e.groupBy("label", "point").agg(*[F.max(x).alias(x) for x in "xyz"])
    return rounded(compare.paired_rmsd(a, c, group="label", point="point", coords=["x", "y", "z"]))


@query(
    "J25_target_ranking",
    """WITH t AS (SELECT p_partkey AS id, p_brand, p_type, p_name FROM part)
    SELECT id, p_name, p_brand, p_type, (SELECT count(*) FROM t) AS total FROM t ORDER BY p_brand <> 'Brand#3', p_type <> 'PROMO', p_name, id LIMIT 25""",
)
def j25(spark, d):
    t = b.table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_brand", "p_type", "p_name")
    return compare.ranked_targets(t, organism="p_brand", kind="p_type", name="p_name", identifier="id", first_organism="Brand#3", first_kind="PROMO")


@query(
    "J25_targets_by_component",
    """WITH o AS (SELECT l_orderkey, l_partkey FROM lineitem), w AS (SELECT DISTINCT p_partkey FROM part WHERE p_brand = 'Brand#3' AND p_size = 7)
    SELECT DISTINCT l_orderkey AS id FROM o WHERE l_partkey IN (SELECT p_partkey FROM w)""",
)
def j25b(spark, d):
    li, part = b.table(spark, d, "lineitem"), b.table(spark, d, "part")
    orders = li.select("l_orderkey", "l_partkey", "l_linenumber").distinct().groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.col("l_partkey").cast("string")).alias("parts"))
    wanted = part.where("p_brand = 'Brand#3' AND p_size = 7").select(F.concat(F.lit(" "), F.col("p_partkey").cast("string")).alias("accession"))
    return compare.targets_for(orders, wanted, components="parts").select("id")


@query(
    "J26_numeric_parity",
    """WITH a AS (SELECT l_suppkey AS k, l_returnflag AS f, avg(l_extendedprice) AS x FROM lineitem WHERE l_suppkey > 3 GROUP BY 1, 2), c AS (SELECT l_suppkey AS k, l_returnflag AS f, round(avg(l_extendedprice), 1) AS y FROM lineitem GROUP BY 1, 2)
    SELECT count(*) AS rows, count(*) FILTER (x IS NULL OR y IS NULL) AS unmatched, round(max(round(abs(x - y), 9)), 5) AS max_abs_difference, count(*) FILTER (round(abs(x - y), 9) > 0.04) AS beyond_tolerance,
      count(*) FILTER (round(abs(x - y), 9) <= 1e-8) AS identical FROM a FULL JOIN c USING (k, f)""",
)
def j26(spark, d):
    li = b.table(spark, d, "lineitem")
    a = li.where("l_suppkey > 3").groupBy("l_suppkey", "l_returnflag").agg(F.avg("l_extendedprice").alias("x"))
    c = li.groupBy("l_suppkey", "l_returnflag").agg(F.round(F.avg("l_extendedprice"), 1).alias("x"))
    return rounded(compare.parity(a, c, keys=["l_suppkey", "l_returnflag"], value="x", tolerance=0.04), 5)


VAR = f"""{M}, pr AS (SELECT CASE document_year WHEN 1995 THEN 'baseline' ELSE 'y' || document_year END AS variant, l_suppkey AS entity, avg(pactivity) AS prediction FROM m WHERE document_year <> 2001 GROUP BY 1, 2)"""


def variant_predictions(spark, d):
    m = b.measurements(spark, d).where("document_year <> 2001")
    name = F.when(F.col("document_year") == 1995, "baseline").otherwise(F.concat(F.lit("y"), F.col("document_year").cast("string")))
    return m.groupBy(name.alias("variant"), F.col("l_suppkey").alias("entity")).agg(F.avg("pactivity").alias("prediction"))


@query(
    "C39_variant_stability",
    f"""WITH {VAR}, x AS (SELECT p.variant, abs(p.prediction - q.prediction) AS c FROM pr p JOIN pr q ON p.entity = q.entity AND q.variant = 'baseline'),
     s AS (SELECT variant, quantile_cont(c, 0.95) AS p95, max(c) AS mx FROM x GROUP BY 1), v AS (SELECT DISTINCT CASE document_year WHEN 1995 THEN 'baseline' ELSE 'y' || document_year END AS variant FROM m)
    SELECT variant, CASE WHEN variant = 'y1996' THEN 'numerical_control' ELSE 'relative_pose' END AS kind, mx IS NOT NULL AS completed, round(p95, 6) AS change_p95, round(mx, 6) AS change_max,
      coalesce(CASE WHEN variant = 'y1996' THEN mx <= 1e-8 ELSE p95 <= 0.5 AND mx <= 1 END, false) AS stable FROM v LEFT JOIN s USING (variant)""",
)
def c39(spark, d):
    m = b.measurements(spark, d)
    name = F.when(F.col("document_year") == 1995, "baseline").otherwise(F.concat(F.lit("y"), F.col("document_year").cast("string")))
    plan = m.select(name.alias("variant")).distinct().select("variant", F.when(F.col("variant") == "y1996", "numerical_control").otherwise("relative_pose").alias("kind"), F.lit(True).alias("completed"))
    return rounded(compare.variant_stability(variant_predictions(spark, d), plan))


@query(
    "C40_pose_ranges",
    """WITH p AS (SELECT l_linenumber AS variant, l_orderkey AS entity, l_quantity AS q FROM lineitem), s AS (SELECT variant, entity, any_value(q) AS q FROM p GROUP BY 1, 2 HAVING count(*) = 1)
    SELECT entity, min(q) AS low, max(q) AS high, count(*) AS checks, max(q) - min(q) AS range FROM s GROUP BY 1""",
)
def c40(spark, d):
    li = b.table(spark, d, "lineitem").select(F.col("l_linenumber").alias("variant"), F.col("l_orderkey").alias("entity"), F.col("l_quantity").alias("prediction"))
    return compare.pose_ranges(li)


GATE = """v AS (SELECT count(*)::DOUBLE AS n, corr(l_quantity, l_extendedprice) AS r, avg(l_discount) AS d, max(l_tax) AS t FROM lineitem)"""


def _gates(spark, d):
    one = b.table(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("n"), F.corr("l_quantity", "l_extendedprice").alias("r"), F.avg("l_discount").alias("d"), F.max("l_tax").alias("t"))
    return compare.gate_table(
        one,
        [
            ("At least ten rows", F.col("n"), "n >= 10", F.col("n") >= 10),
            ("Correlation above 0.99", F.col("r"), "r > 0.99", F.col("r") > 0.99),
            ("Mean discount below five percent", F.col("d"), "d < 0.04", F.col("d") < 0.04),
            ("Tax bounded", F.col("t"), "t <= 0.08", F.col("t") <= 0.08),
        ],
    )


@query(
    "C38_gate_table",
    f"""WITH {GATE} SELECT 0 AS place, 'At least ten rows' AS "check", round(n, 6) AS value, 'n >= 10' AS criterion, n >= 10 AS passed FROM v UNION ALL SELECT 1, 'Correlation above 0.99', round(r, 6), 'r > 0.99', r > 0.99 FROM v
    UNION ALL SELECT 2, 'Mean discount below five percent', round(d, 6), 'd < 0.04', d < 0.04 FROM v UNION ALL SELECT 3, 'Tax bounded', round(t, 6), 't <= 0.08', t <= 0.08 FROM v""",
)
def c38(spark, d):
    return rounded(_gates(spark, d))


@query(
    "C38_gate_status",
    f"""WITH {GATE} SELECT CAST((n >= 10)::INT + (r > 0.99)::INT + (d < 0.04)::INT + (t <= 0.08)::INT AS BIGINT) AS passed, CAST(4 AS BIGINT) AS checks,
      'Unmet checks: ' || concat_ws('; ', CASE WHEN NOT n >= 10 THEN 'At least ten rows' END, CASE WHEN NOT r > 0.99 THEN 'Correlation above 0.99' END, CASE WHEN NOT d < 0.04 THEN 'Mean discount below five percent' END,
      CASE WHEN NOT t <= 0.08 THEN 'Tax bounded' END) AS status FROM v""",
)
def c38b(spark, d):
    return compare.gate_status(_gates(spark, d))


@query(
    "C50_quality_by_route",
    """SELECT l_returnflag AS route, count(DISTINCT (l_orderkey, l_suppkey)) AS pairs, round(median(l_extendedprice), 4) AS median_quality, max(l_extendedprice) AS max_quality FROM lineitem GROUP BY 1""",
)
def c50(spark, d):
    li = b.table(spark, d, "lineitem")
    base = li.groupBy("l_returnflag").agg(F.count_distinct("l_orderkey", "l_suppkey").alias("pairs"), F.max("l_extendedprice").alias("max_quality"))
    mid = quantiles(li, ["l_returnflag"], "l_extendedprice", {"median_quality": 0.5})
    return rounded(base.join(mid, "l_returnflag").select(F.col("l_returnflag").alias("route"), "pairs", "median_quality", "max_quality"), 4)



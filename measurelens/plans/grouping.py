"""Group statistics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from measurelens.operators import groups
from measurelens.operators.common import settle
from measurelens.plans import bindings as b
from measurelens.plans.bindings import E
from measurelens.plans.registry import query, rounded

Z = "1.959963984540054::DOUBLE"
ENRICH = f"""{E}, base AS (SELECT avg(CASE WHEN "group" = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS b FROM e),
 g AS (SELECT murcko AS scaffold, count(*) AS n, CAST(count(*) FILTER ("group" = 1) AS BIGINT) AS n_group1, median(pactivity) AS med, max(pactivity) AS mx FROM e WHERE murcko IS NOT NULL GROUP BY 1),
 en AS (SELECT scaffold, n, n_group1, n_group1::DOUBLE / n AS f, med, mx, b, n::DOUBLE AS nn FROM g, base),
 enr AS (SELECT scaffold, n, n_group1, round(f, 6) AS frac_group1, round(f / b, 6) AS ef,
  round((f + {Z}*{Z}/(2*nn) - {Z}*sqrt(f*(1-f)/nn + {Z}*{Z}/(4*nn*nn))) / (1 + {Z}*{Z}/nn) / b, 6) AS ef_lower, round(med, 6) AS median_value, round(mx, 6) AS max_value FROM en)"""


def _enrichment(spark, d):
    return groups.enrichment(b.entities(spark, d), scaffold="murcko", group="group", value="pactivity")


@query("C12_group_enrichment", f"WITH {ENRICH} SELECT * FROM enr")
def c12(spark, d):
    return rounded(groups.rank_enrichment(_enrichment(spark, d)))


@query("W1_top_series", f"WITH {ENRICH} SELECT scaffold, n, n_group1 FROM enr WHERE n >= 8 ORDER BY n DESC, ef_lower DESC, scaffold LIMIT 10")
def w1(spark, d):
    return groups.top_series(rounded(_enrichment(spark, d))).select("scaffold", "n", "n_group1")


DIV = """SELECT count(*) AS "N", count(*) FILTER (murcko IS NULL) AS acyclic, count(DISTINCT murcko) AS "Ns", count(DISTINCT skeleton) AS "Ncsk" FROM e"""


@query(
    "C11_scaffold_diversity",
    f"""WITH {E}, u AS (SELECT 'complete' AS "row", * FROM e UNION ALL SELECT activity_class, * FROM e),
     s AS (SELECT "row", count(*) FILTER (c = 1) AS nss FROM (SELECT "row", murcko, count(*) AS c FROM u WHERE murcko IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
     a AS (SELECT "row", count(*) AS n, count(*) FILTER (murcko IS NULL) AS acyclic, count(DISTINCT murcko) AS ns, count(DISTINCT skeleton) AS nc FROM u GROUP BY 1)
    SELECT "row", n AS "N", acyclic, ns AS "Ns", nss AS "Nss", nc AS "Ncsk", round(ns::DOUBLE / n, 6) AS "Ns_N", round(nss::DOUBLE / nullif(ns, 0), 6) AS "Nss_Ns", round(nc::DOUBLE / n, 6) AS "Ncsk_N",
      round(nc::DOUBLE / nullif(ns, 0), 6) AS "Ncsk_Ns" FROM a LEFT JOIN s USING ("row")""",
)
def c11(spark, d):
    return rounded(groups.diversity(b.entities(spark, d), scaffold="murcko", skeleton="skeleton", class_col="activity_class"))


PROP = f"""{E}, long AS (SELECT "group", 'p_size' AS property, p_size::DOUBLE AS v FROM e UNION ALL SELECT "group", 'p_retailprice', p_retailprice FROM e UNION ALL SELECT "group", 'pactivity', pactivity FROM e)"""


@query(
    "C13_group_profile",
    f"""WITH {PROP} SELECT property, CAST("group" AS INTEGER) AS "group", count(*) AS n, round(max(v), 6) AS max, round(min(v), 6) AS min, round(avg(v), 6) AS mean, round(skewness(v), 5) AS skew, round(kurtosis(v), 5) AS kurtosis,
      round(median(v), 6) AS median FROM long GROUP BY 1, 2""",
)
def c13(spark, d):
    return rounded(groups.group_profile(b.entities(spark, d), ["p_size", "p_retailprice", "pactivity"], "group"), skew=5, kurtosis=5)


ERFC = """(t * exp(-x*x - 1.26551223 + t*(1.00002368 + t*(0.37409196 + t*(0.09678418 + t*(-0.18628806 + t*(0.27886807 + t*(-1.13520398 + t*(1.48851587 + t*(-0.82215223 + t*0.17087277))))))))))"""


def utest(source: str, keys: str, first: str) -> str:
    """SQL of the two-sided rank test with tie and continuity correction."""
    return f"""rk AS (SELECT {keys}, {first} AS f, rank() OVER (PARTITION BY {keys} ORDER BY v) + (count(*) OVER (PARTITION BY {keys}, v) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY {keys}, v) AS c FROM {source}),
     us AS (SELECT {keys}, count(*) FILTER (f)::DOUBLE AS n1, count(*) FILTER (NOT f)::DOUBLE AS n2, sum(r) FILTER (f) AS rs, sum(c::DOUBLE * c - 1) AS ties FROM rk GROUP BY {keys}),
     uz AS (SELECT *, (greatest(rs - n1*(n1+1)/2, n1*n2 - (rs - n1*(n1+1)/2)) - n1*n2/2 - 0.5) / sqrt(n1*n2/12*((n1+n2+1) - ties/((n1+n2)*(n1+n2-1)))) / sqrt(2.0::DOUBLE) AS z FROM us),
     ux AS (SELECT *, greatest(z, 0.0::DOUBLE) AS x, 1.0::DOUBLE / (1 + 0.5 * greatest(z, 0.0::DOUBLE)) AS t FROM uz)"""


@query("C14_rank_tests", f"""WITH {PROP}, {utest('long', 'property', '"group" = 1')} SELECT property, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, round(least({ERFC}, 1), 5) AS p_value FROM ux""")
def c14(spark, d):
    out = groups.group_tests(b.entities(spark, d), ["p_size", "p_retailprice", "pactivity"], "group")
    return rounded(out, 5)


FRAG = f"""{E}, long AS (SELECT pactivity AS v, 'p_brand' AS position, p_brand AS fragment FROM e UNION ALL SELECT pactivity, 'p_type', p_type FROM e UNION ALL SELECT pactivity, 'p_size', CAST(p_size AS VARCHAR) FROM e),
 fr AS (SELECT position, fragment, count(*) AS n, median(v) AS med, min(v) AS lo, max(v) AS hi FROM long GROUP BY 1, 2),
 ot AS (SELECT a.position, a.fragment, median(l.v) AS med_o FROM fr a JOIN long l ON l.position = a.position AND l.fragment <> a.fragment GROUP BY 1, 2),
 rk AS (SELECT position, fragment, rank() OVER (PARTITION BY position ORDER BY v) + (count(*) OVER (PARTITION BY position, v) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY position, v) AS c FROM long),
 tt AS (SELECT position, count(*)::DOUBLE AS nt, sum(c::DOUBLE * c - 1) AS ties FROM rk GROUP BY 1),
 us AS (SELECT position, fragment, count(*)::DOUBLE AS n1, any_value(nt) - count(*) AS n2, sum(r) AS rs, any_value(ties) AS ties FROM rk JOIN tt USING (position) GROUP BY 1, 2),
 uz AS (SELECT *, (greatest(rs - n1*(n1+1)/2, n1*n2 - (rs - n1*(n1+1)/2)) - n1*n2/2 - 0.5) / sqrt(n1*n2/12*((n1+n2+1) - ties/((n1+n2)*(n1+n2-1)))) / sqrt(2.0::DOUBLE) AS z FROM us),
 ux AS (SELECT *, greatest(z, 0.0::DOUBLE) AS x, 1.0::DOUBLE / (1 + 0.5 * greatest(z, 0.0::DOUBLE)) AS t FROM uz)"""


@query(
    "C15_substituent_stats",
    f"""WITH RECURSIVE {FRAG},
 need AS (SELECT DISTINCT CAST(n1 + n2 AS BIGINT) AS total, CAST(least(n1, n2) AS BIGINT) AS s FROM us WHERE least(n1, n2) BETWEEN 1 AND 8 AND ties = 0),
 ways AS (SELECT 0::BIGINT AS k, 0::BIGINT AS j, 0::BIGINT AS u, 1::DOUBLE AS c
   UNION ALL SELECT k, j, u, sum(c) AS c FROM (
     SELECT k + 1 AS k, j, u, c FROM ways WHERE k < (SELECT max(total) FROM need)
     UNION ALL SELECT k + 1, j + 1, u + k + 1, c FROM ways WHERE k < (SELECT max(total) FROM need) AND j < (SELECT max(s) FROM need)) GROUP BY k, j, u),
 dist AS (SELECT total, s, u - s * (s + 1) // 2 AS u, c FROM need JOIN ways ON k = total AND j = s),
 small AS (SELECT position, fragment, CAST(least(n1, n2) AS BIGINT) AS s, CAST(n1 + n2 AS BIGINT) AS total, greatest(rs - n1*(n1+1)/2, n1*n2 - (rs - n1*(n1+1)/2)) AS high FROM us WHERE least(n1, n2) BETWEEN 1 AND 8 AND ties = 0),
 ex AS (SELECT position, fragment, least(1, 2 * sum(c) FILTER (u >= round(high)) / sum(c)) AS exact FROM small JOIN dist USING (s, total) GROUP BY 1, 2)
    SELECT position, fragment, n, round(med, 6) AS median_value, round(med_o, 6) AS median_other, round(med - med_o, 6) + 0.0 AS delta, round(coalesce(exact, least({ERFC}, 1)), 5) AS p_value, round(lo, 6) AS min_value, round(hi, 6) AS max_value
    FROM fr JOIN ot USING (position, fragment) JOIN ux USING (position, fragment) LEFT JOIN ex USING (position, fragment)""",
)
def c15(spark, d):
    return rounded(groups.substituent_stats(settle(b.entities(spark, d)), ["p_brand", "p_type", "p_size"], value="pactivity"), p_value=5)


@query(
    "C16_core_states",
    """WITH c AS (SELECT p_name, p_type, count(DISTINCT p_partkey) AS k, count(*) AS r FROM part GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY k DESC, p_type) AS rn, count(*) OVER (PARTITION BY p_name) AS states,
      sum(r) OVER (PARTITION BY p_name) AS allr FROM c)
    SELECT p_name, p_type AS chosen, states, k AS entities, CAST(allr - r AS BIGINT) AS excluded_rows FROM b WHERE rn = 1""",
)
def c16(spark, d):
    return groups.select_core_state(b.table(spark, d, "part"), core="p_type", entity="p_partkey", group=["p_name"])[1]


@query(
    "C16_core_members",
    """WITH c AS (SELECT p_name, p_type, count(*) AS k FROM part GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY k DESC, p_type) AS rn FROM c)
    SELECT p_partkey AS id FROM part JOIN b USING (p_name, p_type) WHERE rn = 1""",
)
def c16b(spark, d):
    return groups.select_core_state(b.table(spark, d, "part"), core="p_type", entity="p_partkey", group=["p_name"])[0].select(F.col("p_partkey").alias("id"))


@query(
    "C44_class_counts",
    f"""WITH {E}, s AS (SELECT unnest(['potent','active','intermediate','inactive','unclassified']) AS activity_class, unnest([1,2,3,4,5]) AS place)
    SELECT activity_class, place, count(id) AS molecules FROM s LEFT JOIN e USING (activity_class) GROUP BY 1, 2""",
)
def c44(spark, d):
    return groups.class_counts(b.entities(spark, d), "activity_class", ["potent", "active", "intermediate", "inactive", "unclassified"])


@query("C49_most_common", "SELECT p_partkey AS id, p_brand FROM part WHERE p_brand IN (SELECT p_brand FROM part GROUP BY 1 ORDER BY count(*) DESC, p_brand LIMIT 12)")
def c49(spark, d):
    return groups.most_common(b.table(spark, d, "part"), "p_brand").select(F.col("p_partkey").alias("id"), "p_brand")


@query(
    "C31_value_histogram",
    """WITH r AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer), x AS (SELECT least(floor((c_acctbal - lo) / (hi - lo) * 40), 39) AS bin, c_mktsegment, lo, hi FROM customer, r)
    SELECT CAST(bin AS BIGINT) AS bin, c_mktsegment, count(*) AS n, round(min(lo + bin * (hi - lo) / 40), 4) AS bin_left FROM x GROUP BY 1, 2""",
)
def c31(spark, d):
    return rounded(groups.histogram(b.table(spark, d, "customer"), "c_acctbal", bins=40, by="c_mktsegment"), 4)


@query(
    "C31_similarity_histogram",
    "SELECT round(least(floor(l_discount * 10 * 20), 19) / 20, 6) AS bin_left, l_returnflag, count(*) AS n, round(least(floor(l_discount * 10 * 20), 19) / 20 + 0.05, 6) AS bin_right FROM lineitem GROUP BY ALL",
)
def c31b(spark, d):
    li = b.table(spark, d, "lineitem").select((F.col("l_discount") * 10).alias("s"), "l_returnflag")
    return rounded(groups.similarity_histogram(li, "s", "l_returnflag"))


@query("W2_top_values", f"WITH {E} SELECT id, round(pactivity, 6) AS pactivity FROM e ORDER BY e.pactivity DESC, id LIMIT 4")
def w2(spark, d):
    return rounded(groups.top_by_value(b.entities(spark, d).select("id", "pactivity"), "pactivity", 4, "id"))


@query(
    "P16_selectivity",
    """WITH a AS (SELECT l_partkey, median(log10(l_extendedprice)) AS a FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1), c AS (SELECT l_partkey, median(log10(l_extendedprice)) AS b FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1)
    SELECT l_partkey AS id, round(a - b, 6) + 0.0 AS delta, round(pow(10.0, a - b), 5) AS ratio, CASE WHEN a > b THEN 'A' WHEN a < b THEN 'B' ELSE 'tie' END AS preferred FROM a JOIN c USING (l_partkey)""",
)
def p16(spark, d):
    from measurelens.functions.scalar import selectivity_columns
    from measurelens.operators.ordered import quantiles

    li = b.table(spark, d, "lineitem").select("l_partkey", "l_linestatus", F.log10("l_extendedprice").alias("v"))
    a = quantiles(li.where("l_linestatus = 'F'"), ["l_partkey"], "v", {"a": 0.5})
    c = quantiles(li.where("l_linestatus = 'O'"), ["l_partkey"], "v", {"b": 0.5})
    out = a.join(c, "l_partkey").select(F.col("l_partkey").alias("id"), *[x.alias(n) for n, x in selectivity_columns("a", "b").items()])
    return rounded(out, ratio=5)

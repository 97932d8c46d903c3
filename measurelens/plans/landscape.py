"""Set-similarity queries over the words of the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from measurelens.operators import groups, similarity
from measurelens.plans import bindings as b
from measurelens.plans.bindings import TOKENS
from measurelens.plans.registry import query, rounded

ARGS = dict(identifier="id", tokens="tokens", value="v")
SPELL = "CASE WHEN (length(x), x) <= (length(y), y) THEN x ELSE y END AS id_a, CASE WHEN (length(x), x) <= (length(y), y) THEN y ELSE x END AS id_b"


@query(
    "L1_region_counts",
    f"""WITH {TOKENS}, z AS (SELECT a.doc_id AS i, b.doc_id AS j, abs(a.v - b.v) AS d FROM doc a JOIN doc b ON a.doc_id < b.doc_id),
     f AS (SELECT z.d, coalesce(s, 0) AS s FROM z LEFT JOIN sim ON x = CAST(i AS VARCHAR) AND y = CAST(j AS VARCHAR))
    SELECT count(*) FILTER (s > 0.9 AND s < 1 AND d > 2) AS cliff, count(*) FILTER (s > 0.9 AND s < 1 AND d <= 2) AS smooth, count(*) FILTER (s <= 0.9 AND d <= 2) AS scaffold_hop,
      count(*) FILTER (s <= 0.9 AND d > 2) AS nondescript, count(*) FILTER (s >= 1) AS identical FROM f""",
)
def l1(spark, d):
    return similarity.region_counts(b.token_sets(spark, d), **ARGS)


@query("L1_cliffs", f"WITH {TOKENS} SELECT {SPELL}, round(s, 6) AS similarity, round(d, 6) AS delta, round(d / (1 - s), 4) AS sali FROM sim WHERE s > 0.9 AND s < 1 AND d > 2")
def l1b(spark, d):
    return rounded(similarity.ordered_cliffs(similarity.cliffs(b.token_sets(spark, d), **ARGS)), sali=4)


@query("L1_cliffs_low_threshold", f"WITH {TOKENS} SELECT {SPELL}, round(s, 6) AS similarity, round(d, 6) AS delta, round(d / (1 - s), 4) AS sali FROM sim WHERE s > 0.7 AND s < 1 AND d > 2.5")
def l1c(spark, d):
    return rounded(similarity.cliffs(b.token_sets(spark, d), **ARGS, t=0.7, a=2.5), sali=4)


@query(
    "L2_threshold_grid",
    f"""WITH {TOKENS}, g AS (SELECT unnest([0.85, 0.85, 0.85, 0.95]) AS t, unnest([1.5, 2.0, 2.5, 2.0]) AS a)
    SELECT t::DOUBLE AS similarity_threshold, a::DOUBLE AS activity_threshold, (SELECT count(*) FROM sim WHERE s > t AND s < 1 AND d > a) AS cliffs FROM g""",
)
def l2(spark, d):
    return similarity.threshold_grid(b.token_sets(spark, d), **ARGS, grid=[(0.85, 1.5), (0.85, 2.0), (0.85, 2.5), (0.95, 2.0)])


@query(
    "L3_identical_groups",
    f"""WITH {TOKENS}, g AS (SELECT list_sort(tokens) AS k, arg_min(id, (length(id), id)) AS first_id, count(*) AS members, max(v) - min(v) AS r FROM doc WHERE len(tokens) > 0 GROUP BY 1 HAVING count(*) > 1),
     f AS (SELECT list_sort(a.tokens) AS k, count(*) FILTER (abs(a.v - b.v) > 2) AS far FROM doc a JOIN doc b ON a.doc_id < b.doc_id AND list_sort(a.tokens) = list_sort(b.tokens) GROUP BY 1)
    SELECT first_id, members, CAST(members * (members - 1) / 2 AS BIGINT) AS pairs, round(r, 6) AS value_range, far AS far_pairs FROM g JOIN f USING (k)""",
)
def l3(spark, d):
    return rounded(similarity.identical_groups(b.token_sets(spark, d), **ARGS))


@query("L3_identical_pairs", f"WITH {TOKENS} SELECT {SPELL}, 1.0::DOUBLE AS similarity, round(d, 6) AS delta FROM sim WHERE s >= 1")
def l3b(spark, d):
    return rounded(similarity.identical_pairs(b.token_sets(spark, d), **ARGS))


CLIFF = f"""{TOKENS}, cl AS (SELECT {SPELL}, s, d FROM sim WHERE s > 0.85 AND s < 1 AND d > 1)"""


def _cliffs(spark, d):
    return similarity.cliffs(b.token_sets(spark, d), **ARGS, t=0.85, a=1.0)


@query(
    "C23_cliff_generators",
    f"""WITH {CLIFF}, c AS (SELECT id AS molecule_id, count(*) AS n_cliffs FROM (SELECT id_a AS id FROM cl UNION ALL SELECT id_b FROM cl) GROUP BY 1)
    SELECT molecule_id, n_cliffs, coalesce(n_cliffs > (SELECT avg(n_cliffs) + 2 * stddev_samp(n_cliffs) FROM c), false) AS is_generator FROM c""",
)
def c23(spark, d):
    return similarity.cliff_generators(_cliffs(spark, d))


@query(
    "W3_cliff_page",
    f"""WITH {CLIFF} SELECT id_a, id_b, round(s, 6) AS similarity, round(d, 6) AS delta FROM cl WHERE contains(id_a, '1') OR contains(id_b, '1') ORDER BY cl.d DESC, id_a, id_b LIMIT 10 OFFSET 10""",
)
def w3(spark, d):
    from measurelens.functions.scalar import contains_text

    rows = _cliffs(spark, d).where(contains_text("1", "id_a", "id_b"))
    return rounded(groups.page(rows, [F.desc("delta"), "id_a", "id_b"], 2, size=10).select("id_a", "id_b", "similarity", "delta"))


BIGRAMS = r"""bd AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents),
 bt AS (SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] AS t FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM bd)),
 bn AS (SELECT doc_id, count(*) AS n FROM bt GROUP BY 1),
 bc AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS c FROM bt a JOIN bt b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
 bs AS (SELECT CAST(i AS VARCHAR) AS x, CAST(j AS VARCHAR) AS y, c::DOUBLE / (p.n + q.n - c) AS s2 FROM bc JOIN bn p ON p.doc_id = i JOIN bn q ON q.doc_id = j)"""


def _two(spark, d):
    return {"words": _cliffs(spark, d), "bigrams": similarity.cliffs(b.word_pair_sets(spark, d), **ARGS, t=0.85, a=1.0)}


@query(
    "J18_consensus_pairs",
    f"""WITH {TOKENS}, {BIGRAMS} SELECT {SPELL}, round(d, 6) AS delta, round(s, 6) AS similarity_words, round(s2, 6) AS similarity_bigrams
    FROM sim JOIN bs USING (x, y) WHERE s > 0.85 AND s < 1 AND s2 > 0.85 AND s2 < 1 AND d > 1""",
)
def j18(spark, d):
    return rounded(similarity.consensus_pairs(_two(spark, d)))


@query(
    "J18_consensus_generators",
    f"""WITH {TOKENS}, {BIGRAMS}, c1 AS (SELECT x, y FROM sim WHERE s > 0.85 AND s < 1 AND d > 1), c2 AS (SELECT x, y FROM bs JOIN sim USING (x, y) WHERE s2 > 0.85 AND s2 < 1 AND d > 1),
     n1 AS (SELECT id, count(*) AS n FROM (SELECT x AS id FROM c1 UNION ALL SELECT y FROM c1) GROUP BY 1), n2 AS (SELECT id, count(*) AS n FROM (SELECT x AS id FROM c2 UNION ALL SELECT y FROM c2) GROUP BY 1)
    SELECT id AS molecule_id FROM n1 WHERE n > (SELECT avg(n) + 1 * stddev_samp(n) FROM n1) INTERSECT SELECT id FROM n2 WHERE n > (SELECT avg(n) + 1 * stddev_samp(n) FROM n2)""",
)
def j18b(spark, d):
    return similarity.consensus_generators(_two(spark, d), n_sd=1.0)


NN = f"""{TOKENS}, both_ AS (SELECT x AS a, y AS b, s FROM sim UNION ALL SELECT y, x, s FROM sim),
 nn AS (SELECT a AS id, max(s) AS s, arg_min(b, (-s, length(b), b)) AS r FROM both_ GROUP BY 1),
 fst AS (SELECT id, row_number() OVER (ORDER BY length(id), id) AS k FROM doc),
 near AS (SELECT doc.id, coalesce(nn.s, 0) AS similarity, coalesce(nn.r, CASE WHEN doc.id = (SELECT id FROM fst WHERE k = 1) THEN (SELECT id FROM fst WHERE k = 2) ELSE (SELECT id FROM fst WHERE k = 1) END) AS nearest_id FROM doc LEFT JOIN nn USING (id))"""


@query("J13_nearest_neighbours", f"WITH {NN} SELECT id, round(similarity, 6) AS similarity, nearest_id FROM near")
def j13(spark, d):
    sets = b.token_sets(spark, d)
    return rounded(similarity.nearest_neighbours(sets, sets, tokens="tokens", exclude_self=True))


BENCH = r"""bm AS (SELECT CAST(item_id AS VARCHAR) AS id, list_distinct(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')) AS tokens FROM benchmark),
 bk AS (SELECT id, unnest(tokens) AS t, len(tokens) AS n FROM bm),
 bx AS (SELECT tok.id AS q, bk.id AS r, count(*) AS c, any_value(bk.n) AS rn FROM tok JOIN bk USING (t) GROUP BY 1, 2),
 by_ AS (SELECT q, r, c::DOUBLE / (size.n + rn - c) AS s FROM bx JOIN size ON size.id = q),
 bz AS (SELECT q AS id, max(s) AS s, arg_min(r, (-s, length(r), r)) AS r FROM by_ GROUP BY 1)"""


@query(
    "J13_nearest_in_reference",
    f"WITH {TOKENS}, {BENCH} SELECT doc.id, round(coalesce(s, 0), 6) AS similarity, coalesce(r, (SELECT arg_min(id, (length(id), id)) FROM bm)) AS nearest_id FROM doc LEFT JOIN bz USING (id)",
)
def j13b(spark, d):
    items = b.table(spark, d, "benchmark")
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return rounded(similarity.nearest_neighbours(b.token_sets(spark, d), items.select(F.col("item_id").cast("string").alias("id"), words.alias("tokens")), tokens="tokens"))


@query("M4_domain_threshold", f"WITH {NN} SELECT round(quantile_cont(similarity, 0.05), 6) AS threshold FROM near")
def m4(spark, d):
    sets = b.token_sets(spark, d)
    return rounded(similarity.domain_threshold(similarity.nearest_neighbours(sets, sets, tokens="tokens", exclude_self=True)))


@query(
    "J15_near_cliff",
    rf"""WITH {CLIFF}, cm AS (SELECT id_a AS id FROM cl UNION SELECT id_b FROM cl UNION SELECT x FROM sim WHERE s >= 1 AND d > 1 UNION SELECT y FROM sim WHERE s >= 1 AND d > 1),
     bm AS (SELECT 'b' || item_id AS id, list_distinct(list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')) AS tokens FROM benchmark),
     bk AS (SELECT id, unnest(tokens) AS t, len(tokens) AS n FROM bm),
     x AS (SELECT bk.id AS q, tok.id AS r, count(*) AS c, any_value(bk.n) AS qn FROM bk JOIN tok USING (t) JOIN cm ON cm.id = tok.id GROUP BY 1, 2),
     w AS (SELECT q, r, c::DOUBLE / (qn + size.n - c) AS s FROM x JOIN size ON size.id = r), z AS (SELECT q AS id, max(s) AS s, arg_min(r, (-s, length(r), r)) AS r FROM w GROUP BY 1)
    SELECT bm.id, coalesce(s, 0) >= 0.85 AS near_activity_cliff, coalesce(r, (SELECT arg_min(id, (length(id), id)) FROM cm)) AS nearest_cliff_id, round(coalesce(s, 0), 6) AS similarity FROM bm LEFT JOIN z USING (id)""",
)
def j15(spark, d):
    sets = b.token_sets(spark, d)
    members = _cliffs(spark, d).select(F.explode(F.array("id_a", "id_b")).alias("id"))
    members = members.unionByName(similarity.far_copies(sets, **ARGS, a=1.0)).distinct()
    items = b.table(spark, d, "benchmark")
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    queries = items.select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("id"), words.alias("tokens"))
    near = similarity.nearest_neighbours(queries, sets.join(members, "id", "left_semi"), tokens="tokens")
    return rounded(similarity.near_cliff(near))

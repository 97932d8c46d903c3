"""Split, fold, sampling and audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from measurelens.operators import curate, splits
from measurelens.operators.common import settle
from measurelens.plans import bindings as b
from measurelens.plans.bindings import CLASS_SQL, E
from measurelens.plans.registry import query, rounded
from measurelens.plans.scoring import HASH

# Measurements for the leak-free tables: the value of an order line, the customer as entity.
LEAK = f"""lm AS (SELECT o_custkey AS key, 'C' || o_custkey AS molecule_id, log10(o_totalprice) AS v, CAST(year(o_orderdate) AS INTEGER) AS yr, o_orderpriority AS origin FROM orders)"""


def leak_rows(spark, d):
    o = b.table(spark, d, "orders")
    return o.select(F.col("o_custkey").alias("key"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("molecule_id"), F.log10("o_totalprice").alias("v"), F.year("o_orderdate").alias("yr"), F.col("o_orderpriority").alias("origin"))


def _curate(rows):
    rules = curate.CurationRules(bins=b.BINS)
    out = curate.curate(rows, rules, key="key", entity="molecule_id", value="v", list_ids=False)
    return out.select("key", "value", "n_measurements", "activity_class")


CUR = "SELECT key, median(v) AS value, count(*) AS n_measurements FROM {0} GROUP BY 1"
SAFE = """SELECT key, round(value, 6) AS value, n_measurements, {cls} AS activity_class, false AS is_test FROM e1 UNION ALL
    SELECT key, round(value, 6), n_measurements, {cls}, true FROM e2 WHERE key NOT IN (SELECT key FROM e1)""".format(cls=CLASS_SQL.format(v="value"))


@query("R1_time_safe", f"WITH {LEAK}, a AS (SELECT * FROM lm WHERE yr <= 1995), z AS (SELECT * FROM lm WHERE yr > 1995), e1 AS ({CUR.format('a')}), e2 AS ({CUR.format('z')}) {SAFE}")
def r1(spark, d):
    return rounded(splits.time_safe(leak_rows(spark, d), _curate, year="yr", cutoff=1995, key="key"))


@query("R2_origin_safe", f"WITH {LEAK}, a AS (SELECT * FROM lm WHERE origin <> '5-LOW'), z AS (SELECT * FROM lm WHERE origin = '5-LOW'), e1 AS ({CUR.format('a')}), e2 AS ({CUR.format('z')}) {SAFE}")
def r2(spark, d):
    return rounded(splits.origin_safe(leak_rows(spark, d), _curate, origin="origin", held_out="5-LOW", key="key"))


@query("J7_novel_keys", f"WITH {LEAK} SELECT DISTINCT key FROM lm WHERE yr > 1995 AND key NOT IN (SELECT key FROM lm WHERE yr <= 1995)")
def j7(spark, d):
    rows = leak_rows(spark, d)
    return splits.novel_keys(rows.where("yr > 1995"), rows.where("yr <= 1995"), "key")


# Rows for splits: orders, grouped by customer (missing for one segment), labelled by status.
ROWS = """rw AS (SELECT o_orderkey AS id, o_orderstatus AS label, CASE WHEN c_mktsegment <> 'BUILDING' THEN CAST(o_custkey AS VARCHAR) END AS block, CAST(year(o_orderdate) AS INTEGER) AS yr FROM orders JOIN customer ON c_custkey = o_custkey),
 gr AS (SELECT *, coalesce(block, '__acyclic_' || id) AS grp FROM rw)"""


def split_rows(spark, d):
    o, c = b.table(spark, d, "orders"), b.table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    rows = o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("label"), F.when(F.col("c_mktsegment") != "BUILDING", F.col("o_custkey").cast("string")).alias("block"), F.year("o_orderdate").alias("yr")
    )
    return rows.withColumn("grp", splits.singleton_groups("block", "id"))


def folds_sql(k: int, seed: int, rows: str = "gr", tag: str = "", place: str = "rank", tie: str = "") -> str:
    u = f"floor({HASH.format(f"'{seed}:' || grp")}::DOUBLE / 4503599627370496 * 1073741824) / 1073741824"
    return f"""gc{tag} AS (SELECT grp, label, count(*) AS n FROM {rows} GROUP BY 1, 2), gm{tag} AS (SELECT grp, arg_max(label, (n, label)) AS major, CAST(sum(n) AS BIGINT) AS size FROM gc{tag} GROUP BY 1),
     gp{tag} AS (SELECT grp, {place}() OVER (PARTITION BY major ORDER BY -size::DOUBLE + {u}{tie}) - 1 AS ps FROM gm{tag}),
     gf{tag} AS (SELECT grp, CAST(CASE WHEN (ps // {k}) % 2 = 0 THEN ps % {k} ELSE {k} - 1 - ps % {k} END AS INTEGER) AS fold FROM gp{tag})"""


# Groups of equal size and draw follow their names, so every group has a place of its own.
OWN_PLACE = dict(place="row_number", tie=", grp")
FOLDS = folds_sql(5, 42, **OWN_PLACE)


@query("R3_group_folds", f"WITH {ROWS}, {FOLDS} SELECT id, fold FROM gr JOIN gf USING (grp)")
def r3(spark, d):
    return splits.group_folds(split_rows(spark, d), group="grp", label="label", k=5).select("id", "fold")


@query("R3_group_holdout", f"WITH {ROWS}, {FOLDS} SELECT label, fold = 0 AS is_test, count(*) AS n FROM gr JOIN gf USING (grp) GROUP BY 1, 2")
def r3b(spark, d):
    return splits.group_holdout(split_rows(spark, d), group="grp", label="label").groupBy("label", "is_test").agg(F.count(F.lit(1)).alias("n"))


@query("R3_stratified_holdout", f"WITH {ROWS}, x AS (SELECT id, rank() OVER (PARTITION BY label ORDER BY {HASH.format("'42:' || id")}) - 1 AS p, count(*) OVER (PARTITION BY label) AS n FROM gr) SELECT id, p < round(n * 0.2) AS is_test FROM x")
def r3c(spark, d):
    return splits.stratified_holdout(split_rows(spark, d), identifier="id", label="label").select("id", "is_test")


@query("R3_year_holdout", f"WITH {ROWS} SELECT id, yr > 1999 AS is_test FROM rw")
def r3d(spark, d):
    return splits.year_holdout(split_rows(spark, d), year="yr", cutoff=1999).select("id", "is_test")


@query("R4_singleton_groups", f"WITH {ROWS} SELECT grp, count(*) AS n FROM gr GROUP BY 1")
def r4(spark, d):
    return split_rows(spark, d).groupBy("grp").agg(F.count(F.lit(1)).alias("n"))


@query("R5_stratified_folds", f"WITH {ROWS}, x AS (SELECT id, rank() OVER (PARTITION BY label ORDER BY {HASH.format("'42:' || id")}) - 1 AS p FROM gr) SELECT id, CAST(p % 10 AS INTEGER) AS fold FROM x")
def r5(spark, d):
    return splits.stratified_folds(split_rows(spark, d), identifier="id", label="label", k=10).select("id", "fold")


@query(
    "R5_expanding_years",
    f"""WITH {ROWS}, y AS (SELECT DISTINCT yr AS fold_year FROM rw ORDER BY 1 DESC LIMIT 3) SELECT fold_year, count(*) FILTER (yr < fold_year) AS fit_rows, count(*) FILTER (yr = fold_year) AS validation_rows, count(DISTINCT CASE WHEN yr < fold_year THEN label END) AS fit_classes
    FROM rw, y GROUP BY 1""",
)
def r5b(spark, d):
    return splits.expanding_fold_check(split_rows(spark, d), year="yr", label="label", k=3)


@query("R5_expanding_members", f"WITH {ROWS}, y AS (SELECT DISTINCT yr AS fold_year FROM rw ORDER BY 1 DESC LIMIT 2) SELECT fold_year, id, CASE WHEN yr = fold_year THEN 'validate' ELSE 'fit' END AS role FROM rw, y WHERE yr <= fold_year")
def r5c(spark, d):
    return splits.expanding_year_folds(split_rows(spark, d), year="yr", k=2).select("fold_year", "id", "role")


@query("R6_leave_one_out", "SELECT o_orderkey AS id, o_orderkey AS fold FROM orders")
def r6(spark, d):
    return splits.leave_one_out(split_rows(spark, d), identifier="id").select("id", "fold")


@query(
    "R7_oversample",
    f"""WITH {ROWS}, x AS (SELECT id, label, rank() OVER (PARTITION BY label ORDER BY {HASH.format("'42:' || id")}) - 1 AS position FROM rw), s AS (SELECT label, count(*) AS n FROM rw GROUP BY 1),
     dr AS (SELECT label, n, unnest(range((SELECT max(n) FROM s) - n)) AS draw FROM s), pk AS (SELECT label, draw, CAST(floor({HASH.format("'42:draw:' || label || ':' || draw")}::DOUBLE / 4503599627370496 * n) AS BIGINT) AS position FROM dr)
    SELECT id, label, CAST(0 AS BIGINT) AS "copy" FROM rw UNION ALL SELECT id, label, draw + 1 FROM pk JOIN x USING (label, position)""",
)
def r7(spark, d):
    return splits.oversample(split_rows(spark, d).select("id", "label"), identifier="id", label="label").select("id", "label", "copy")


@query(
    "R9_modelability",
    f"""WITH {E}, c AS (SELECT activity_class, count(*) AS n FROM e GROUP BY 1), x AS (SELECT (SELECT count(*) FROM c) AS classes, (SELECT min(n) FROM c) AS smallest, (SELECT count(DISTINCT murcko) + count(*) FILTER (murcko IS NULL) FROM e) AS groups)
    SELECT classes, smallest, groups, CASE WHEN classes < 2 THEN 'every row falls in one class' WHEN smallest < 10 THEN 'the smallest class has ' || smallest || ' rows, fewer than the 10 folds' WHEN groups < 13 THEN 'the split needs about 13 groups and this table has ' || groups ELSE '' END AS reason FROM x""",
)
def r9(spark, d):
    return splits.modelability(settle(b.entities(spark, d)), label="activity_class", group="murcko", k=10)


@query(
    "R10_nested_plan_sizes",
    f"""WITH {ROWS}, {FOLDS}, tr AS (SELECT gr.* FROM gr JOIN gf USING (grp) WHERE fold <> 0), {folds_sql(3, 43, 'tr', 'i', **OWN_PLACE)}, s AS (SELECT fold, count(*) AS n FROM tr JOIN gfi USING (grp) GROUP BY 1)
    SELECT 'train' AS partition, (SELECT count(*) FROM tr) AS rows, 15 AS minimum, (SELECT count(*) FROM tr) >= 15 AS passed UNION ALL SELECT 'test', (SELECT count(*) FROM gr) - (SELECT count(*) FROM tr), 3, (SELECT count(*) FROM gr) - (SELECT count(*) FROM tr) >= 3
    UNION ALL SELECT 'outer fold ' || fold || ' fit', (SELECT count(*) FROM tr) - n, 5, (SELECT count(*) FROM tr) - n >= 5 FROM s""",
)
def r10(spark, d):
    plan = settle(splits.nested_plan(split_rows(spark, d), group="grp", label="label", test_fraction=0.2, k=3))
    return splits.plan_sizes(plan, k=3, group="grp")


@query("R16_subset", f"WITH {ROWS} SELECT id, label FROM rw WHERE id IN (SELECT l_orderkey FROM lineitem WHERE l_tax = 0.0)")
def r16(spark, d):
    ids = b.table(spark, d, "lineitem").where("l_tax = 0.0").select(F.col("l_orderkey").alias("id"))
    return splits.subset(split_rows(spark, d), ids, "id").select("id", "label")


@query("R17_seeded_sample", f"SELECT o_orderkey AS id FROM orders WHERE {HASH.format("'42:' || o_orderkey")}::DOUBLE / 4503599627370496 < 0.1")
def r17(spark, d):
    """The chart sample: a seeded draw is the feature itself."""
    return splits.sample_rows(b.table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), identifier="id", fraction=0.1)


@query(
    "J20_split_mapping",
    """WITH t AS (SELECT c_custkey AS id FROM customer), m AS (SELECT o_custkey AS id, CASE WHEN min(year(o_orderdate)) < 1996 THEN 'train' ELSE 'test' END AS side FROM orders GROUP BY 1 UNION ALL SELECT c_custkey, 'test' FROM customer WHERE c_nationkey = 5 UNION ALL SELECT -1, 'test'),
     g AS (SELECT id, count(*) AS n, count(DISTINCT side) AS s FROM m GROUP BY 1)
    SELECT count(*) FILTER (g.id IS NULL) AS unassigned, count(*) FILTER (t.id IS NULL) AS unknown, count(*) FILTER (n > 1) AS assigned_twice, count(*) FILTER (s > 1) AS on_both_sides FROM t FULL JOIN g ON t.id = g.id""",
)
def j20(spark, d):
    c, o = b.table(spark, d, "customer"), b.table(spark, d, "orders")
    m = o.groupBy(F.col("o_custkey").alias("id")).agg(F.when(F.min(F.year("o_orderdate")) < 1996, "train").otherwise("test").alias("side"))
    m = m.unionByName(c.where("c_nationkey = 5").select(F.col("c_custkey").alias("id"), F.lit("test").alias("side"))).unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("id"), F.lit("test").alias("side")))
    return splits.split_mapping_check(c.select(F.col("c_custkey").alias("id")), m, identifier="id", side="side")


@query(
    "J21_partition_audit",
    f"""WITH {ROWS}, f AS (SELECT *, yr > 1999 AS t FROM rw), a AS (SELECT 'groups' AS audit, block AS k, t FROM f UNION ALL SELECT 'ids', CAST(id AS VARCHAR), t FROM f), g AS (SELECT audit, k, bool_or(t) AS hi, bool_or(NOT t) AS lo, count(*) AS n FROM a WHERE k IS NOT NULL GROUP BY 1, 2)
    SELECT audit, count(*) FILTER (lo) AS train_keys, count(*) FILTER (hi) AS test_keys, count(*) FILTER (lo AND hi) AS shared_keys, count(*) FILTER (n > 1) AS repeated_keys FROM g GROUP BY 1""",
)
def j21(spark, d):
    rows = splits.year_holdout(split_rows(spark, d), year="yr", cutoff=1999)
    return splits.partition_audit(rows, flag="is_test", keys={"groups": "block", "ids": "id"})

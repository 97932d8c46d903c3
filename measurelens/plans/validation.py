"""Nested selection, refitted permutation tests and leave-one-out over the embeddings.

The SQL solves the same systems by Gauss-Jordan steps in a recursive statement, over
all features, and scores the left-out rows one by one.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from measurelens.operators import features, metrics, models, neighbours, normal, splits
from measurelens.operators.common import settle
from measurelens.plans.modelling import WIDTH, _target
from measurelens.plans.partitions import folds_sql
from measurelens.plans.registry import query, rounded
from measurelens.plans.scoring import HASH

# Long features and the response of every embedding.
ROWS = f"""f AS MATERIALIZED (SELECT vec_id AS id, unnest(range({WIDTH})) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
 rw AS MATERIALIZED (SELECT vec_id AS id, 5 + 4 * e[1] + 2 * e[2] * e[3] + e[4] + label / 10.0::DOUBLE AS y FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings))"""


def solved(source: str, width: int = WIDTH) -> str:
    """Recursive steps that turn systems (t, i, j, v) into their solutions, in the columns j >= width."""
    return f"""g AS (SELECT 0 AS k, t, i, j, v FROM {source} UNION ALL SELECT k + 1, t, i, j, CASE WHEN i = k THEN v / pv ELSE v - cl * ro / pv END
     FROM (SELECT *, max(v) FILTER (i = k) OVER (PARTITION BY t, j) AS ro, max(v) FILTER (j = k) OVER (PARTITION BY t, i) AS cl, max(v) FILTER (i = k AND j = k) OVER (PARTITION BY t) AS pv FROM g WHERE k < {width})),
     sv AS MATERIALIZED (SELECT t, i, j - {width} AS b, v FROM g WHERE k = {width} AND j >= {width})"""


# Folds of single rows in hash order.
FOLDS = f"fo AS MATERIALIZED (SELECT id, (rank() OVER (ORDER BY {HASH.format("'42:' || id")}) - 1) % 3 AS fold FROM rw)"


@query(
    "R12_permutation_refit",
    f"""WITH RECURSIVE {ROWS}, {FOLDS}, rp AS (SELECT id, y, unnest(range(1, 101)) AS rep FROM rw), ra AS (SELECT rep, id, rank() OVER (PARTITION BY rep ORDER BY {HASH.format("'42:row:' || rep || ':' || id")}) AS k FROM rp),
     rc AS (SELECT rep, y, rank() OVER (PARTITION BY rep ORDER BY {HASH.format("'42:value:' || rep || ':' || id")}) AS k FROM rp), yy AS MATERIALIZED (SELECT id, rep AS b, y FROM ra JOIN rc USING (rep, k) UNION ALL SELECT id, 0, y FROM rw),
     pt AS (SELECT id, t, fold FROM fo, range(3) p(t)), mx AS MATERIALIZED (SELECT t, i, avg(v) AS m FROM f JOIN pt USING (id) WHERE fold <> t GROUP BY 1, 2), my AS MATERIALIZED (SELECT t, b, avg(y) AS m FROM yy JOIN pt USING (id) WHERE fold <> t GROUP BY 1, 2),
     fc AS MATERIALIZED (SELECT t, id, i, v - m AS v, fold <> t AS fit FROM f JOIN pt USING (id) JOIN mx USING (t, i)),
     ms AS MATERIALIZED (SELECT a.t, a.i, c.i AS j, sum(a.v * c.v) + CASE WHEN a.i = c.i THEN 10 ELSE 0 END AS v FROM fc a JOIN fc c ON a.t = c.t AND a.id = c.id WHERE a.fit AND c.fit GROUP BY 1, 2, 3 UNION ALL SELECT t, i, {WIDTH} + b, sum(v * y) FROM fc JOIN yy USING (id) WHERE fit GROUP BY 1, 2, 3),
     {solved('ms')}, pr AS (SELECT t, id, b, sum(fc.v * sv.v) AS p FROM fc JOIN sv USING (t, i) WHERE NOT fit GROUP BY 1, 2, 3),
     sq AS (SELECT b, sum((y - p - my.m) ** 2) AS e FROM pr JOIN my USING (t, b) JOIN yy USING (id, b) GROUP BY 1), q AS (SELECT b, 1 - e / (SELECT var_pop(y) * count(*) FROM rw) AS q FROM sq)
    SELECT round(max(q) FILTER (b = 0), 5) AS observed, CAST(count(*) FILTER (b > 0) AS INTEGER) AS permutations, round(max(q) FILTER (b > 0), 5) AS best_permuted, round((1 + count(*) FILTER (b > 0 AND q >= (SELECT q FROM q WHERE b = 0)))::DOUBLE / count(*), 6) AS p_value,
      (1 + count(*) FILTER (b > 0 AND q >= (SELECT q FROM q WHERE b = 0)))::DOUBLE / count(*) <= 0.05 AS passed FROM q""",
)
def r12_refit(spark, d):
    rows = splits.stratified_folds(_target(spark, d).withColumn("series", F.lit("series")), identifier="id", label="series", k=3)
    found = normal.permutation_test(settle(rows), row="id", array="x", target="y", fold="fold", width=WIDTH, penalty=10.0, repeats=100)
    return rounded(found, 5, p_value=6)


PENALTIES = [0.1, 1.0, 10.0, 100.0]

# Groups of five vectors; parts t: 0-8 outer x inner, 9-11 outer, 12 all training rows.
NESTED = f"""gr AS (SELECT vec_id AS id, vec_id // 5 AS grp, CAST(label AS VARCHAR) AS label FROM embeddings), {folds_sql(5, 42)}, tr AS (SELECT gr.* FROM gr JOIN gf USING (grp) WHERE fold <> 0), {folds_sql(3, 43, 'tr', 'o')}, {folds_sql(3, 44, 'tr', 'n')},
 pl AS MATERIALIZED (SELECT gr.id, gfo.fold AS o, gfn.fold AS n, gf.fold = 0 AS test FROM gr JOIN gf USING (grp) LEFT JOIN gfo USING (grp) LEFT JOIN gfn USING (grp)),
 pt AS MATERIALIZED (SELECT id, t, CASE WHEN t < 9 THEN NOT test AND o <> t // 3 AND n <> t % 3 WHEN t < 12 THEN NOT test AND o <> t - 9 ELSE NOT test END AS fit, CASE WHEN t < 9 THEN NOT test AND o <> t // 3 AND n = t % 3 WHEN t < 12 THEN NOT test AND o = t - 9 ELSE test END AS held FROM pl, range(13) p(t))"""


@query(
    "R10_nested_selection",
    f"""WITH RECURSIVE {ROWS}, {NESTED}, pe AS (SELECT unnest({PENALTIES})::DOUBLE AS a), mx AS MATERIALIZED (SELECT t, i, avg(v) AS m FROM f JOIN pt USING (id) WHERE fit GROUP BY 1, 2), my AS MATERIALIZED (SELECT t, avg(y) AS m FROM rw JOIN pt USING (id) WHERE fit GROUP BY 1),
     fc AS MATERIALIZED (SELECT t, id, i, v - m AS v, fit, held FROM f JOIN pt USING (id) JOIN mx USING (t, i) WHERE fit OR held), s0 AS MATERIALIZED (SELECT x.t, x.i, c.i AS j, sum(x.v * c.v) AS v FROM fc x JOIN fc c ON x.t = c.t AND x.id = c.id WHERE x.fit AND c.fit GROUP BY 1, 2, 3 UNION ALL SELECT t, i, {WIDTH}, sum(v * y) FROM fc JOIN rw USING (id) WHERE fit GROUP BY 1, 2),
     ms AS (SELECT (t, a) AS t, i, j, v + CASE WHEN i = j THEN a ELSE 0 END AS v FROM s0, pe), {solved('ms')}, be AS MATERIALIZED (SELECT t[1] AS t, t[2] AS a, i, v FROM sv),
     pr AS (SELECT t, a, id, sum(fc.v * be.v) AS p FROM fc JOIN be USING (t, i) WHERE held GROUP BY 1, 2, 3), sc AS MATERIALIZED (SELECT t, a, sqrt(avg((y - p - m) ** 2)) AS rmse, sum((y - p - m) ** 2) AS e, sum((y - m) ** 2) AS s, count(*) AS held_rows FROM pr JOIN my USING (t) JOIN rw USING (id) GROUP BY 1, 2),
     ch AS (SELECT CASE WHEN t < 9 THEN 9 + t // 3 ELSE 12 END AS t, a, avg(rmse) AS inner_rmse FROM sc WHERE t < 12 GROUP BY 1, 2), be1 AS (SELECT t, arg_min(a, (inner_rmse, a)) AS a, min(inner_rmse) AS inner_rmse FROM ch GROUP BY 1), nf AS (SELECT t, count(*) AS fit_rows FROM pt WHERE fit GROUP BY 1)
    SELECT CASE WHEN t = 12 THEN 'held out' ELSE 'outer ' || (t - 9) END AS stage, a AS penalty, round(inner_rmse, 5) AS inner_rmse, fit_rows, held_rows, round(rmse, 5) AS rmse, round(1 - e / s, 5) AS q2 FROM be1 JOIN sc USING (t, a) JOIN nf USING (t)""",
)
def r10_nested(spark, d):
    rows = _target(spark, d).withColumns({"grp": F.floor(F.col("id") / 5).cast("string"), "stratum": F.col("label").cast("int").cast("string")})
    plan = settle(splits.nested_plan(rows, group="grp", label="stratum", test_fraction=0.2, k=3, inner_k=3))
    return rounded(normal.nested_selection(plan, array="x", target="y", width=WIDTH, penalties=PENALTIES, k=3, inner_k=3), 5)


LOO = f"""{ROWS}, mx AS MATERIALIZED (SELECT i, avg(v) AS m FROM f GROUP BY 1), fc AS MATERIALIZED (SELECT id, i, v - m AS v FROM f JOIN mx USING (i)), my AS (SELECT avg(y) AS m, count(*) AS n FROM rw),
 ms AS MATERIALIZED (SELECT 0 AS t, x.i, c.i AS j, sum(x.v * c.v) + CASE WHEN x.i = c.i THEN 10 ELSE 0 END AS v FROM fc x JOIN fc c USING (id) GROUP BY 2, 3 UNION ALL SELECT 0, i, {WIDTH}, sum(v * y) FROM fc JOIN rw USING (id) GROUP BY 2 UNION ALL SELECT 0, a.i, {WIDTH} + 1 + b.i, CASE WHEN a.i = b.i THEN 1.0 ELSE 0 END FROM mx a, mx b),
 {solved('ms')}, h AS (SELECT fc.id, fc.i, sum(fc.v) FILTER (true) AS v FROM fc GROUP BY 1, 2), lv AS (SELECT id, sum(p * h.v) AS l FROM (SELECT h.id, sv.b - 1 AS i, sum(h.v * sv.v) AS p FROM h JOIN sv USING (i) WHERE b > 0 GROUP BY 1, 2) z JOIN h USING (id, i) GROUP BY 1),
 pd AS (SELECT id, sum(fc.v * sv.v) AS p FROM fc JOIN sv USING (i) WHERE b = 0 GROUP BY 1), lo AS (SELECT id, y, 1.0 / n + l AS leverage, y - (y - m - p) / (1 - 1.0 / n - l) AS loo_prediction FROM rw JOIN lv USING (id) JOIN pd USING (id), my)"""


def _loo(spark, d):
    return normal.leave_one_out(_target(spark, d).select("id", "x", "y"), array="x", target="y", width=WIDTH, penalty=10.0).drop("x")


@query("R6_loo_predictions", f"WITH RECURSIVE {LOO} SELECT id, round(y, 5) AS y, round(loo_prediction, 5) AS loo_prediction, round(leverage, 6) AS leverage FROM lo")
def r6_loo(spark, d):
    return rounded(_loo(spark, d), 5, leverage=6)


@query("C33_loo_q2", f"WITH RECURSIVE {LOO} SELECT round(1 - sum((y - loo_prediction) ** 2) / sum((y - my.m) ** 2), 6) AS q2 FROM lo, my")
def c33_loo(spark, d):
    return rounded(metrics.pooled_q2(settle(_loo(spark, d)), "y", "loo_prediction"))


# A fifth of the vectors of each label, by hash order, asks the others.
SPLIT = f"""sp AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS x, rank() OVER (PARTITION BY label ORDER BY {HASH.format("'42:' || vec_id")}) - 1 < round(count(*) OVER (PARTITION BY label) * 0.2) AS test FROM embeddings),
 di AS (SELECT q.id, q.label AS actual, r.id AS near, r.label, sqrt(list_sum(list_transform(range(1, {WIDTH} + 1), lambda i: (q.x[i] - r.x[i]) * (q.x[i] - r.x[i])))) AS d FROM sp q JOIN sp r ON q.test AND NOT r.test),
 nn AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, near) AS place FROM di QUALIFY place <= 4)"""


def _neighbours(spark, d):
    rows = settle(splits.stratified_holdout(_target(spark, d), identifier="id", label="stratum"))
    train, test = rows.where(~F.col("is_test")), rows.where("is_test")
    return test, neighbours.nearest(test, train, query="id", row="id", array="x", value="label", width=WIDTH, k=4)


@query("M1_nearest_rows", f"WITH {SPLIT} SELECT id, CAST(place AS INTEGER) AS place, near, round(d, 6) AS distance FROM nn")
def m1_nearest(spark, d):
    return rounded(_neighbours(spark, d)[1].select(F.col("_q").alias("id"), "place", F.col("_id").alias("near"), "distance"))


@query(
    "M1_neighbour_models",
    f"""WITH {SPLIT}, vo AS (SELECT id, actual, label, count(*) AS n FROM nn GROUP BY 1, 2, 3), cl AS (SELECT id, actual, arg_min(label, (-n, label))::DOUBLE AS voted FROM vo GROUP BY 1, 2),
     av AS (SELECT id, coalesce(avg(label) FILTER (d = 0), sum(label / d) FILTER (d > 0) / sum(1 / d) FILTER (d > 0)) AS averaged FROM nn GROUP BY 1) SELECT id, actual::DOUBLE AS actual, voted, round(averaged, 6) AS averaged FROM cl JOIN av USING (id)""",
)
def m1_models(spark, d):
    test, found = _neighbours(spark, d)
    said = neighbours.vote(found).withColumnRenamed("prediction", "voted").join(neighbours.average(found).withColumnRenamed("prediction", "averaged"), "_q")
    return rounded(test.select("id", F.col("label").alias("actual")).join(said, F.col("id") == F.col("_q")).drop("_q"))


@query(
    "M7_permutation_importance",
    f"""WITH RECURSIVE {ROWS}, mx AS MATERIALIZED (SELECT i, avg(v) AS m FROM f GROUP BY 1), fc AS MATERIALIZED (SELECT id, i, v - m AS v FROM f JOIN mx USING (i)), my AS (SELECT avg(y) AS m FROM rw),
     ms AS MATERIALIZED (SELECT 0 AS t, x.i, c.i AS j, sum(x.v * c.v) + CASE WHEN x.i = c.i THEN 10 ELSE 0 END AS v FROM fc x JOIN fc c USING (id) GROUP BY 2, 3 UNION ALL SELECT 0, i, {WIDTH}, sum(v * y) FROM fc JOIN rw USING (id) GROUP BY 2), {solved('ms')},
     er AS (SELECT id, y - my.m - p AS e FROM rw JOIN (SELECT id, sum(fc.v * sv.v) AS p FROM fc JOIN sv USING (i) GROUP BY 1) USING (id), my), rp AS (SELECT id, unnest(range(1, 6)) AS rep FROM rw),
     th AS (SELECT rep, id, rank() OVER (PARTITION BY rep ORDER BY {HASH.format("'42:to:' || rep || ':' || id")}) AS k FROM rp), fr AS (SELECT rep, id AS donor, rank() OVER (PARTITION BY rep ORDER BY {HASH.format("'42:from:' || rep || ':' || id")}) AS k FROM rp),
     rm AS (SELECT rep, a.i, sqrt(avg((e - sv.v * (d.v - a.v)) ** 2)) - (SELECT sqrt(avg(e * e)) FROM er) AS r FROM th JOIN fr USING (rep, k) JOIN er USING (id) JOIN fc a USING (id) JOIN fc d ON d.id = donor AND d.i = a.i JOIN sv ON sv.i = a.i GROUP BY 1, 2)
    SELECT CAST(i AS INTEGER) AS feature, round(avg(r), 5) + 0.0 AS importance, round(stddev_pop(r), 5) AS sd FROM rm GROUP BY 1""",
)
def m7(spark, d):
    rows = settle(features.take_features(_target(spark, d), "x", list(range(WIDTH)), width=WIDTH))
    model = models.REGRESSORS["ridge"](42).setLabelCol("y").fit(rows)
    return rounded(models.permutation_importance(model, rows, row="id", target="y", width=WIDTH, repeats=5), 5)

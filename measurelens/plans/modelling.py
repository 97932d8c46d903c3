"""Feature, field, model and shortlist queries over the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from measurelens.operators import features, groups, models, shortlist, similarity
from measurelens.operators.common import settle
from measurelens.plans import bindings as b
from measurelens.plans.landscape import NN
from measurelens.plans.registry import query, rounded

WIDTH = 64
EMB = "f AS (SELECT vec_id AS id, label, unnest(range(64)) AS feature, unnest(embedding)::DOUBLE AS v FROM embeddings)"


def emb(spark, d):
    return b.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("x"), F.col("label").cast("double").alias("label"))


def long(spark, d):
    return features.long_array(emb(spark, d), "id", "x")


@query("F1_variance_filter", f"WITH {EMB} SELECT CAST(feature AS INTEGER) AS feature, round(var_pop(v), 7) AS variance, count(*) AS n, var_pop(v) > 0.0156 AS kept FROM f GROUP BY 1")
def f1(spark, d):
    return rounded(features.variance_table(long(spark, d), 0.0156), 7)


@query("F2_correlated_pairs", f"WITH {EMB} SELECT CAST(a.feature AS INTEGER) AS f_a, CAST(c.feature AS INTEGER) AS f_b FROM f a JOIN f c ON a.id = c.id AND a.feature < c.feature GROUP BY 1, 2 HAVING abs(corr(a.v, c.v)) > 0.1")
def f2(spark, d):
    return features.correlated_features(emb(spark, d), "x", list(range(WIDTH)), 0.1)


@query(
    "F2_greedy_filter",
    f"""WITH RECURSIVE {EMB}, vf AS (SELECT feature FROM f GROUP BY 1 HAVING var_pop(v) > 0.01), ed AS MATERIALIZED (SELECT a.feature AS x, c.feature AS y FROM f a JOIN f c ON a.id = c.id AND a.feature < c.feature GROUP BY 1, 2 HAVING abs(corr(a.v, c.v)) > 0.1),
     tie AS MATERIALIZED (SELECT y, list(x) AS xs FROM ed GROUP BY 1), r(i, kept) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL SELECT i + 1, CASE WHEN i IN (SELECT feature FROM vf) AND NOT coalesce(list_has_any(kept, (SELECT xs FROM tie WHERE y = i)), false) THEN list_append(kept, i) ELSE kept END FROM r WHERE i < 64)
    SELECT CAST(unnest(kept) AS INTEGER) AS feature FROM r WHERE i = 64""",
)
def f2b(spark, d):
    kept = features.select_features(emb(spark, d), "x", row="id", variance=0.01, correlation=0.1)
    return spark.createDataFrame([(k,) for k in kept], "feature int")


GAPS = f"{EMB}, g AS (SELECT id, label, feature, CASE WHEN feature = 7 THEN NULL WHEN v > 0.2 THEN NULL ELSE v END AS v FROM f), md AS (SELECT feature, coalesce(median(v), 0) AS median, count(*) - count(v) AS missing FROM g GROUP BY 1), fi AS (SELECT feature, avg(coalesce(v, median)) AS mean, stddev_pop(coalesce(v, median)) AS sd, any_value(median) AS median, any_value(missing) AS missing FROM g JOIN md USING (feature) GROUP BY 1)"


def gappy(spark, d):
    return long(spark, d).withColumn("v", F.when((F.col("feature") != 7) & ~(F.col("v") > 0.2), F.col("v")))


@query("F3_impute_scale_fit", f"WITH {GAPS} SELECT CAST(feature AS INTEGER) AS feature, round(median, 6) + 0.0 AS median, round(mean, 6) + 0.0 AS mean, round(sd, 6) AS sd, missing FROM fi")
def f3(spark, d):
    return rounded(features.impute_scale_fit(gappy(spark, d)))


@query("F3_impute_scale_apply", f"WITH {GAPS} SELECT id, round(sum((coalesce(v, median) - mean) / CASE WHEN sd > 0 THEN sd ELSE 1 END), 4) + 0.0 AS z_sum FROM g JOIN fi USING (feature) GROUP BY 1")
def f3b(spark, d):
    rows = gappy(spark, d)
    return rounded(features.impute_scale_apply(rows, features.impute_scale_fit(rows)).groupBy("id").agg(F.sum("z").alias("z_sum")), 4)


@query("F4_fitted_support", f"WITH {EMB} SELECT id, round(sum(v), 5) + 0.0 AS total FROM f WHERE feature IN (1, 4, 9) GROUP BY 1")
def f4(spark, d):
    from pyspark.ml.functions import vector_to_array

    rows = features.take_features(emb(spark, d), "x", [1, 4, 9], width=WIDTH)
    return rounded(rows.select("id", F.aggregate(vector_to_array("features"), F.lit(0.0), lambda a, x: a + x).alias("total")), 5)


SCREEN = f"""{EMB}, bk AS (SELECT *, feature // 16 AS block FROM f), pe AS (SELECT block, feature, count(*) AS n, count(*) FILTER (NOT (feature = 7 AND label = 0)) AS known, avg(v) FILTER (NOT (feature = 7 AND label = 0)) AS mean, stddev_samp(v) AS sd0 FROM bk GROUP BY 1, 2),
 el AS (SELECT *, known = n AS ok, CASE WHEN known = n THEN sd0 ELSE 0 END AS sd FROM pe), rk AS (SELECT *, row_number() OVER (PARTITION BY block, ok ORDER BY sd DESC, feature) AS rn, count(*) OVER (PARTITION BY block, ok) AS pool FROM el),
 sc AS (SELECT *, ok AND rn <= greatest(1, ceil(pool * 0.3)) AND block <> 3 AS retained FROM rk)"""


def screened(spark, d):
    rows = long(spark, d).withColumn("block", F.floor(F.col("feature") / 16)).join(emb(spark, d).select("id", "label"), "id")
    rows = rows.withColumn("v", F.when((F.col("feature") == 7) & (F.col("label") == 0), F.lit(float("nan"))).when(F.col("block") == 3, F.lit(0.5)).otherwise(F.col("v")))
    return rows, features.screen_field_columns(rows, block="block", keep_fraction=0.3, max_features=2000, blocks=4, scaling="column_std")


@query(
    "F5_field_screen",
    f"WITH {SCREEN} SELECT CAST(block AS BIGINT) AS block, CAST(feature AS INTEGER) AS feature, n - known AS missing, round(CASE WHEN block = 3 THEN 0.5 ELSE mean END, 6) + 0.0 AS mean, round(CASE WHEN block = 3 THEN 0 ELSE sd END, 6) AS sd, retained, round(CASE WHEN retained THEN sd ELSE 1 END, 6) AS scale FROM sc",
)
def f5(spark, d):
    return rounded(screened(spark, d)[1])


@query(
    "F5_missing_counts",
    f"""WITH {SCREEN} SELECT bk.id, count(*) FILTER (sc.retained AND bk.feature = 7 AND bk.label = 0) AS missing_retained FROM bk JOIN sc USING (feature) GROUP BY 1""",
)
def f5b(spark, d):
    rows, fitted = screened(spark, d)
    return features.missing_counts(rows, fitted, "id", "block")


@query(
    "C52_empty_blocks",
    f"""WITH {SCREEN}, e AS (SELECT CAST(CAST(block AS BIGINT) AS VARCHAR) AS block FROM sc GROUP BY block HAVING NOT bool_or(retained))
    SELECT CASE WHEN count(*) > 0 THEN 'Filtering retained no columns for: ' || string_agg(block, ', ' ORDER BY block) ELSE '' END AS warning FROM e""",
)
def c52(spark, d):
    return features.empty_blocks(screened(spark, d)[1], "block")


@query(
    "C41_contribution_shares",
    f"""WITH {EMB}, s AS (SELECT feature, feature // 16 AS block, stddev_samp(v) * CASE WHEN feature % 3 = 0 THEN 0 ELSE (feature - 30) / 10.0::DOUBLE END AS c FROM f GROUP BY 1), t AS (SELECT sum(abs(c)) AS t FROM s)
    SELECT CAST(block AS BIGINT) AS block, round(100 * sum(abs(c)) / any_value(t), 5) AS percent, count(*) FILTER (c <> 0) AS retained_columns, round(quantile_cont(c, 0.8) FILTER (c > 0), 6) AS positive_level, round(-quantile_cont(-c, 0.8) FILTER (c < 0), 6) AS negative_level,
      100 * sum(abs(c)) / any_value(t) >= 95 AS dominant FROM s, t GROUP BY 1""",
)
def c41(spark, d):
    per = long(spark, d).groupBy("feature").agg(F.stddev_samp("v").alias("sd")).withColumn("block", F.floor(F.col("feature") / 16))
    per = per.withColumn("coef", F.when(F.pmod("feature", F.lit(3)) == 0, F.lit(0.0)).otherwise((F.col("feature") - 30) / 10.0))
    return rounded(features.contribution_shares(per, block="block", coefficient="coef", sd="sd"), percent=5)


@query("F6_components")
def f6(spark, d):
    e = b.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("size"), "p_retailprice", F.length("p_name").cast("double").alias("name"))
    return features.components(e, ["size", "p_retailprice", "name"], 2)[0].select("id", "PC1", "PC2")


@query("W6_explained_variance")
def w6(spark, d):
    e = b.table(spark, d, "part").select(F.col("p_size").cast("double").alias("size"), "p_retailprice", F.length("p_name").cast("double").alias("name"))
    shares = features.components(e, ["size", "p_retailprice", "name"], 3)[2]
    return groups.explained_variance(spark.createDataFrame(list(enumerate(shares, 1)), "component int, share double"), "component", "share")


# Atoms: each embedding is an atom of the molecule named by its label.
ATOMS = """atm AS (SELECT label AS entity, vec_id, embedding[1]::DOUBLE * 10 AS x, embedding[2]::DOUBLE * 10 AS y, embedding[3]::DOUBLE * 10 AS z, abs(embedding[4]::DOUBLE) + 0.1 AS w1, embedding[5]::DOUBLE AS w2 FROM embeddings),
 gs AS (SELECT floor((min(x) - 4) / 3) * 3 AS x0, floor((min(y) - 4) / 3) * 3 AS y0, floor((min(z) - 4) / 3) * 3 AS z0, CAST(round((ceil((max(x) + 4) / 3) * 3 - floor((min(x) - 4) / 3) * 3) / 3) AS INTEGER) + 1 AS nx,
  CAST(round((ceil((max(y) + 4) / 3) * 3 - floor((min(y) - 4) / 3) * 3) / 3) AS INTEGER) + 1 AS ny, CAST(round((ceil((max(z) + 4) / 3) * 3 - floor((min(z) - 4) / 3) * 3) / 3) AS INTEGER) + 1 AS nz FROM atm),
 gp AS (SELECT CAST(p AS INTEGER) AS point, x0 + 3 * (p // (nz * ny)) AS gx, y0 + 3 * ((p // nz) % ny) AS gy, z0 + 3 * (p % nz) AS gz FROM gs, range(100000) t(p) WHERE p < nx * ny * nz),
 dd AS (SELECT *, (x-gx)*(x-gx) + (y-gy)*(y-gy) + (z-gz)*(z-gz) AS d2 FROM atm, gp)"""


def atoms(spark, d):
    e = b.table(spark, d, "embeddings")
    dim = lambda i: F.get("embedding", i).cast("double")
    return e.select(F.col("label").alias("entity"), "vec_id", (dim(0) * 10).alias("x"), (dim(1) * 10).alias("y"), (dim(2) * 10).alias("z"), (F.abs(dim(3)) + 0.1).alias("w1"), dim(4).alias("w2"))


@query("C45_grid_spec", f"WITH {ATOMS} SELECT x0, y0, z0, nx, ny, nz, 3.0::DOUBLE AS spacing, nx * ny * nz AS points FROM gs")
def c45(spark, d):
    return features.grid_spec(atoms(spark, d), spacing=3.0)


@query(
    "C45_padded_box",
    f"""WITH {ATOMS} SELECT round((min(x) + max(x)) / 2, 6) + 0.0 AS center_x, round((min(y) + max(y)) / 2, 6) + 0.0 AS center_y, round((min(z) + max(z)) / 2, 6) + 0.0 AS center_z, round(greatest(max(x) - min(x) + 8, 6), 6) AS size_x, round(greatest(max(y) - min(y) + 8, 6), 6) AS size_y,
      round(greatest(max(z) - min(z) + 8, 6), 6) AS size_z, greatest(max(x) - min(x) + 8, max(y) - min(y) + 8, max(z) - min(z) + 8, 6) <= 25 AS fits FROM atm""",
)
def c45b(spark, d):
    return rounded(features.padded_box(atoms(spark, d)))


@query("F7_gaussian_field", f"WITH {ATOMS} SELECT entity, point, round(sum(w1 * exp(-0.3 * d2)), 5) + 0.0 AS w1, round(sum(w2 * exp(-0.3 * d2)), 5) + 0.0 AS w2 FROM dd GROUP BY 1, 2")
def f7(spark, d):
    a = atoms(spark, d)
    return rounded(features.gaussian_field(a, features.grid_spec(a, spacing=3.0), ["w1", "w2"]), 5)


@query(
    "F8_probe_field",
    f"""WITH {ATOMS}, q AS (SELECT entity, point, w1, w2, greatest(sqrt(d2), 0.3) AS r FROM dd), s AS (SELECT entity, point, sum(w1 * (pow((w1 + 3.4) / r, 12) - 2 * pow((w1 + 3.4) / r, 6))) AS st, 332.0636 * sum(w2 / r) AS el FROM q GROUP BY 1, 2)
    SELECT entity, point, round(least(st, 30), 3) + 0.0 AS steric, CASE WHEN st < 30 THEN round(el, 3) + 0.0 END AS electrostatic FROM s""",
)
def f8(spark, d):
    a = atoms(spark, d).select("entity", "x", "y", "z", (F.col("w1") + 1.7).alias("radius"), F.col("w1").alias("epsilon"), F.col("w2").alias("charge"))
    return rounded(features.probe_field(a, features.grid_spec(a, spacing=3.0)), 3)


@query("F9_pose_perturbation")
def f9(spark, d):
    return rounded(features.perturb_poses(atoms(spark, d), seed=7, fixed=F.col("entity") == 0))


MODEL = dict(row="id", array="x", width=WIDTH, k=3, variance=0.01, correlation=0.95)


@query("M1_classifier_comparison")
def m1(spark, d):
    return models.compare_classifiers(emb(spark, d), label="label", group=None, names=["decision_tree", "naive_bayes", "nearest_neighbors", "small_forest"], **MODEL)[0]


@query("R8_naive_protocol")
def r8(spark, d):
    return models.naive_classifier(emb(spark, d), row="id", array="x", label="label", width=WIDTH, name="decision_tree")


def _target(spark, d):
    x = F.col("x")
    y = 5 + 4 * F.get(x, 0) + 2 * F.get(x, 1) * F.get(x, 2) + F.get(x, 3) + F.col("label") / 10
    return emb(spark, d).withColumn("y", y).withColumn("stratum", F.col("label").cast("string"))


@query("M2_regressor_comparison")
def m2(spark, d):
    return models.compare_regressors(_target(spark, d), target="y", stratum="stratum", group=None, names=["nearest_neighbors", "ridge", "small_forest"], **MODEL)[0]


@query("M3_deployment_refit")
def m3(spark, d):
    rows = settle(_target(spark, d))
    kept, model = models.fit_deployment(rows, row="id", array="x", target="y", width=WIDTH, name="ridge")
    return model.transform(features.take_features(rows, "x", kept, width=WIDTH)).select("id", "y", "prediction")


@query("M5_bounding_box_domain")
def m5(spark, d):
    rows = emb(spark, d)
    return features.bounding_box_domain(rows.where("label <> 3"), rows, "x").select("id", "label", "in_domain")


@query("M6_batch_status", "SELECT p_partkey AS id, CASE WHEN p_brand = 'Brand#7' THEN 'invalid structure' WHEN p_type = 'PROMO' THEN 'not predicted' ELSE 'predicted' END AS status FROM part")
def m6(spark, d):
    p = b.table(spark, d, "part")
    source = p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_brand") != "Brand#7", F.col("p_name")).alias("structure"))
    return shortlist.batch_status(source, p.where("p_type <> 'PROMO'").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("prediction")), key="id").select("id", "status")


@query("M7_impurity_importance")
def m7b(spark, d):
    rows = settle(features.take_features(_target(spark, d), "x", list(range(WIDTH)), width=WIDTH))
    return models.impurity_importance(models.REGRESSORS["small_forest"](42).setLabelCol("y").fit(rows), spark)


@query("M8_target_benchmark")
def m8(spark, d):
    rows = _target(spark, d).withColumn("panel", F.when(F.col("label") < 3, "a").when(F.col("label") < 6, "b").otherwise("c"))
    return models.group_benchmark(rows, ["a", "b", "c"], "panel", target="y", stratum="stratum", group=None, names=["ridge"], **MODEL)


@query(
    "J14_prediction_enrichment",
    f"""WITH {NN}, pr AS (SELECT id, v * 0.9 AS prediction FROM doc) SELECT pr.id, round(prediction, 6) AS prediction, round(similarity, 6) AS max_training_similarity, near.nearest_id, round(n.v, 6) AS nearest_value, similarity >= 0.5 AS in_domain,
      md5(dq.text) = md5(dn.text) AS already_measured, round(prediction - 0.4, 6) AS empirical_lower, round(prediction + 0.4, 6) AS empirical_upper
    FROM pr JOIN near USING (id) JOIN doc n ON n.id = near.nearest_id JOIN documents dq ON CAST(dq.doc_id AS VARCHAR) = pr.id JOIN documents dn ON CAST(dn.doc_id AS VARCHAR) = near.nearest_id""",
)
def j14(spark, d):
    sets = b.token_sets(spark, d)
    near = similarity.nearest_neighbours(sets, sets, tokens="tokens", exclude_self=True)
    texts = b.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.md5(F.col("text").cast("binary")).alias("structure"))
    rows = sets.join(texts, "id").select("id", "structure", (F.col("v") * 0.9).alias("prediction"))
    known = sets.join(texts, "id").select("id", "structure", F.col("v").alias("value"))
    out = shortlist.enrich_predictions(rows, near, known, key="id", threshold=0.5, half_width=0.4)
    return rounded(out.select("id", "prediction", "max_training_similarity", "nearest_id", "nearest_value", "in_domain", "already_measured", "empirical_lower", "empirical_upper"))


@query("W4_diverse_shortlist")
def w4(spark, d):
    docs = b.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "lang", F.md5(F.col("text").cast("binary")).alias("structure"), "n_chars")
    rows = b.token_sets(spark, d).join(docs, "id").select("id", "lang", "structure", "tokens", F.col("v").alias("prediction"), F.lit("predicted").alias("status"), (F.col("n_chars") < 20000).alias("in_domain"), "n_chars")
    return rounded(shortlist.diverse_shortlist(rows, group=["lang"], structure="structure", entity="id", caps={"n_chars": 4000}, n=10).drop("structure"))


@query(
    "P19_qualification",
    """SELECT p_partkey AS id, CASE WHEN p_type = 'PROMO' THEN 'withheld: standardisation changed the proposed structure' WHEN p_size > 45 THEN 'withheld: unresolved stereochemistry' WHEN p_retailprice > 1050 THEN 'withheld: outside applicability domain'
      WHEN p_brand = 'Brand#7' THEN 'withheld: non-finite model prediction' ELSE 'scored: hypothesis, not a confirmed improvement' END AS prediction_status FROM part""",
)
def p19(spark, d):
    p = b.table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), (F.col("p_type") == "PROMO").alias("structure_changed"), (F.col("p_size") > 45).alias("unresolved_stereo"), (F.col("p_retailprice") <= 1050).alias("in_domain"),
        F.when(F.col("p_brand") != "Brand#7", F.col("p_retailprice")).alias("prediction"),
    )
    return shortlist.qualification(p, model_ok=F.lit(True), parent_ok=F.lit(True)).select("id", "prediction_status")



"""Classifier, regressor, calibration and resampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from measurelens.operators import metrics, permutation
from measurelens.plans import bindings as b
from measurelens.plans.bindings import P
from measurelens.plans.registry import query, rounded

# A classifier over orders: the actual class follows the price, the called one the prediction.
CLS = f"""{P}, c AS (SELECT *, CASE WHEN truth >= 5.5 THEN 'high' WHEN truth >= 5.2 THEN 'mid' ELSE 'low' END AS actual, CASE WHEN prediction >= 5.25 THEN 'high' WHEN prediction >= 5.2 THEN 'mid' WHEN prediction >= 5.12 THEN 'low' ELSE 'none' END AS called FROM p)"""


def calls(spark, d):
    t, p = F.col("truth"), F.col("prediction")
    return b.predictions(spark, d).withColumns(
        {
            "actual": F.when(t >= 5.5, "high").when(t >= 5.2, "mid").otherwise("low"),
            "called": F.when(p >= 5.25, "high").when(p >= 5.2, "mid").when(p >= 5.12, "low").otherwise("none"),
        }
    )


@query("C24_confusion", f"WITH {CLS} SELECT actual, called AS predicted, count(*) AS n FROM c GROUP BY 1, 2")
def c24(spark, d):
    return metrics.confusion(calls(spark, d), "actual", "called")


@query(
    "C24_confusion_matrix",
    f"WITH {CLS} SELECT actual, count(*) FILTER (called = 'high') AS predicted_high, count(*) FILTER (called = 'mid') AS predicted_mid, count(*) FILTER (called = 'low') AS predicted_low, count(*) FILTER (called = 'none') AS predicted_none FROM c GROUP BY 1",
)
def c24m(spark, d):
    return metrics.confusion_matrix(calls(spark, d), "actual", "called", ["high", "mid", "low", "none"])


@query(
    "C24_class_report",
    f"""WITH {CLS}, l AS (SELECT actual AS label FROM c UNION SELECT called FROM c), x AS (SELECT label, count(*) FILTER (actual = label) AS s, count(*) FILTER (called = label) AS k, count(*) FILTER (actual = label AND called = label) AS h, count(*) AS n FROM l, c GROUP BY 1)
    SELECT label, s AS support, round(s::DOUBLE / n, 6) AS prevalence, round(coalesce(h::DOUBLE / nullif(k, 0), 0), 6) AS precision, round(coalesce(h::DOUBLE / nullif(s, 0), 0), 6) AS recall, round(coalesce(2.0::DOUBLE * h / nullif(k + s, 0), 0), 6) AS f1 FROM x""",
)
def c24r(spark, d):
    return rounded(metrics.class_report(calls(spark, d), "actual", "called"))


@query(
    "C25_accuracy_scores",
    f"""WITH {CLS}, l AS (SELECT actual AS label FROM c UNION SELECT called FROM c), x AS (SELECT label, count(*) FILTER (actual = label)::DOUBLE AS t, count(*) FILTER (called = label)::DOUBLE AS p, count(*) FILTER (actual = label AND called = label)::DOUBLE AS h FROM l, c GROUP BY 1),
     s AS (SELECT sum(t) AS s, sum(h) AS c, sum(t*p) AS tp, sum(t*t) AS tt, sum(p*p) AS pp, avg(h / nullif(t, 0)) AS ba FROM x)
    SELECT round(c / s, 6) AS accuracy, round(ba, 6) AS balanced_accuracy, round((c*s - tp) / sqrt((s*s - pp) * (s*s - tt)), 6) AS mcc FROM s""",
)
def c25(spark, d):
    return rounded(metrics.accuracy_scores(calls(spark, d), "actual", "called"))


# One-vs-rest scores: the closeness of the prediction to each class centre.
OVR = f"""{CLS}, ce AS (SELECT unnest(['high', 'mid', 'low', 'never']) AS label, unnest([5.3, 5.21, 5.1, 5.0])::DOUBLE AS centre),
 sc AS (SELECT label, actual = label AS pos, -round(abs(prediction - centre), 3) AS score FROM c, ce),
 ct AS (SELECT label, score, count(*) FILTER (pos) AS p, count(*) AS a FROM sc GROUP BY 1, 2),
 cu AS (SELECT *, sum(p) OVER w AS cp, sum(a) OVER w AS ca, sum(p) OVER (PARTITION BY label) AS tp, sum(a) OVER (PARTITION BY label) AS ta FROM ct WINDOW w AS (PARTITION BY label ORDER BY score DESC)),
 rs AS (SELECT label, CASE WHEN any_value(tp) > 0 THEN sum(p * ((ta - tp) - (ca - cp)) + p * (a - p) / 2.0::DOUBLE)::DOUBLE / any_value(tp::DOUBLE * (ta - tp)) END AS auc, CASE WHEN any_value(tp) > 0 THEN sum(p::DOUBLE / nullif(tp, 0) * cp / ca) END AS ap FROM cu GROUP BY 1)"""


def ovr_scores(spark, d):
    centres = {"high": 5.3, "mid": 5.21, "low": 5.1, "never": 5.0}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("label"), F.lit(c).alias("centre")) for k, c in centres.items()]))
    rows = calls(spark, d).select("id", "actual", "prediction", each.alias("c")).select("id", "actual", "prediction", "c.*")
    return rows.select("id", "label", (F.col("actual") == F.col("label")).alias("pos"), (-F.round(F.abs(F.col("prediction") - F.col("centre")), 3)).alias("score"))


@query("C26_ranking_scores", f"WITH {OVR} SELECT label, round(auc, 6) AS roc_auc, round(ap, 6) AS average_precision FROM rs")
def c26(spark, d):
    return rounded(metrics.ranking_scores(ovr_scores(spark, d), label="label", positive="pos", score="score"))


@query("C26_macro_ranking", f"WITH {OVR} SELECT round(avg(auc), 6) AS roc_auc_ovr, round(avg(ap), 6) AS pr_auc_ovr, count(auc) AS auc_classes FROM rs")
def c26m(spark, d):
    return rounded(metrics.macro_ranking(metrics.ranking_scores(ovr_scores(spark, d), label="label", positive="pos", score="score")))


@query(
    "C27_curve_points",
    f"WITH {OVR} SELECT label, round(score, 6) + 0.0 AS threshold, round((ca - cp)::DOUBLE / (ta - tp), 6) AS false_positive_rate, round(cp::DOUBLE / nullif(tp, 0), 6) AS recall, round(cp::DOUBLE / ca, 6) AS precision FROM cu",
)
def c27(spark, d):
    return rounded(metrics.curve_points(ovr_scores(spark, d), label="label", positive="pos", score="score"))


def spear(source: str, by: str) -> str:
    k = f"PARTITION BY {by}" if by else ""
    sel = f"{by}," if by else ""
    grp = f"GROUP BY {by}" if by else ""
    w = lambda c: f"PARTITION BY {by + ',' if by else ''} {c}"
    return f"""sr AS (SELECT {sel} rank() OVER ({k} ORDER BY truth) + (count(*) OVER ({w('truth')}) - 1) / 2.0::DOUBLE AS ra, rank() OVER ({k} ORDER BY prediction) + (count(*) OVER ({w('prediction')}) - 1) / 2.0::DOUBLE AS rb FROM {source}),
     sp AS (SELECT {sel} corr(ra, rb) AS rho FROM sr {grp})"""


BASE = "count(*) AS n, 1 - sum((truth - prediction)*(truth - prediction)) / (var_pop(truth) * count(*)) AS r2, sqrt(avg((truth - prediction)*(truth - prediction))) AS rmse, avg(abs(truth - prediction)) AS mae"


@query(
    "C28_regression_scores",
    f"WITH {P}, {spear('p', 'year')}, g AS (SELECT year, {BASE} FROM p GROUP BY 1) SELECT year, n, round(r2, 6) AS r2, round(rmse, 6) AS rmse, round(mae, 6) AS mae, round(rho, 6) AS spearman FROM g JOIN sp USING (year)",
)
def c28(spark, d):
    return rounded(metrics.regression_scores(b.predictions(spark, d), "truth", "prediction", ["year"]))


@query(
    "C29_regression_summary",
    f"""WITH {P}, {spear('p', '')}, g AS (SELECT {BASE}, avg((abs(truth - prediction) <= log10(3))::INT)::DOUBLE AS w3, avg((abs(truth - prediction) <= 1)::INT)::DOUBLE AS w10, avg(truth - prediction) AS bias, sqrt(avg((truth - baseline)*(truth - baseline))) AS bs, median(abs(truth - prediction)) AS mid FROM p),
     v AS (SELECT unnest(['Test R²', 'Test RMSE', 'Test MAE', 'Test Spearman', 'Median absolute error', 'Typical fold error', 'Within 3-fold', 'Within 10-fold', 'Mean residual', 'Training-mean baseline RMSE', 'RMSE gain versus baseline']) AS metric,
       unnest([r2, rmse, mae, rho, mid, pow(10, mid), w3, w10, bias, bs, bs - rmse]) AS value FROM g, sp)
    SELECT metric, round(value, 6) + 0.0 AS value FROM v""",
)
def c29(spark, d):
    return rounded(metrics.regression_summary(b.predictions(spark, d), "truth", "prediction", "baseline"))


@query(
    "C30_novelty_table",
    f"""WITH {P}, x AS (SELECT abs(truth - prediction) AS e, (year - 1995) / 6.0::DOUBLE AS s FROM p), y AS (SELECT e, CASE WHEN s > -0.001 AND s <= 0.3 THEN '≤0.3' WHEN s > 0.3 AND s <= 0.5 THEN '0.3–0.5' WHEN s > 0.5 AND s <= 0.7 THEN '0.5–0.7' ELSE '>0.7' END AS k FROM x)
    SELECT k AS nearest_similarity, count(*) AS n, round(sqrt(avg(e*e)), 6) AS rmse, round(avg(e), 6) AS mae, round(avg((e <= log10(3))::INT), 6) AS within_3_fold, round(avg((e <= 1)::INT), 6) AS within_10_fold FROM y GROUP BY 1""",
)
def c30(spark, d):
    rows = b.predictions(spark, d).select(F.abs(F.col("truth") - F.col("prediction")).alias("e"), ((F.col("year") - 1995) / 6.0).alias("s"))
    return rounded(metrics.novelty_table(rows, "s", "e"))


@query(
    "C32_subset_performance",
    f"""WITH {CLS}, f AS (SELECT *, c_mktsegment = 'MACHINERY' AS flag FROM c), {spear('f', 'flag')}, g AS (SELECT flag, {BASE}, avg((actual = called)::INT)::DOUBLE AS acc FROM f GROUP BY 1)
    SELECT flag, n, round(r2, 6) AS r2, round(rmse, 6) AS rmse, round(mae, 6) AS mae, round(rho, 6) AS spearman, round(acc, 6) AS accuracy FROM g JOIN sp USING (flag)""",
)
def c32(spark, d):
    rows = calls(spark, d).withColumn("flag", F.col("c_mktsegment") == "MACHINERY")
    return rounded(metrics.subset_performance(rows, "flag", "truth", "prediction", "actual", "called"))


@query(
    "C33_pooled_q2",
    f"WITH {P}, m AS (SELECT avg(truth) AS mu FROM p) SELECT round(1 - sum((truth - prediction)*(truth - prediction)) / sum((truth - mu)*(truth - mu)), 6) AS q2 FROM p, m WHERE year < 2000",
)
def c33(spark, d):
    rows = b.predictions(spark, d).withColumn("prediction", F.when(F.col("year") < 2000, F.col("prediction")))
    return rounded(metrics.pooled_q2(rows, "truth", "prediction"))


@query(
    "C34_calibration",
    f"""WITH {P}, s AS (SELECT count(*)::DOUBLE AS n, sum(truth*prediction) AS yp, sum(truth*truth) AS yy, sum(prediction*prediction) AS pp, corr(truth, prediction) AS r, var_pop(truth) AS vy, var_pop(prediction) AS vp FROM p),
     k AS (SELECT *, yp / pp AS k, yp / yy AS kp, r * r AS r2 FROM s), z AS (SELECT *, 1 - (yy - 2*k*yp + k*k*pp) / (n*vy) AS r0, 1 - (pp - 2*kp*yp + kp*kp*yy) / (n*vp) AS r0p FROM k)
    SELECT round(r2, 5) AS pearson_r2, round(k, 5) AS k, round(kp, 5) AS k_prime, round(r0, 5) AS r0_squared, round(r0p, 4) AS r0_prime_squared,
      r2 > 0.6 AND (((r2 - r0) / r2 < 0.1 AND k BETWEEN 0.85 AND 1.15) OR ((r2 - r0p) / r2 < 0.1 AND kp BETWEEN 0.85 AND 1.15)) AS passes FROM z""",
)
def c34(spark, d):
    return rounded(metrics.calibration(b.predictions(spark, d), "truth", "prediction"), 5, r0_prime_squared=4)


@query(
    "C35_empirical_band",
    f"""WITH {P}, e AS (SELECT abs(truth - prediction) AS e, year FROM p), o AS (SELECT e, row_number() OVER (ORDER BY e) - 1 AS r, count(*) OVER () AS n FROM e WHERE year < 2000), h AS (SELECT e AS hw FROM o WHERE r = ceil((n - 1) * 0.9))
    SELECT round(any_value(hw), 6) AS half_width, round(avg((e <= hw)::INT), 6) AS coverage FROM e, h WHERE year >= 2000""",
)
def c35(spark, d):
    rows = b.predictions(spark, d).select("year", F.abs(F.col("truth") - F.col("prediction")).alias("e"))
    return rounded(metrics.empirical_band(rows.where("year < 2000"), "e", rows.where("year >= 2000"), "e"))


@query(
    "C36_fold_rollup",
    f"""WITH {P}, f AS (SELECT o_orderstatus AS algorithm, year, sqrt(avg((truth - prediction)*(truth - prediction))) AS rmse, CASE WHEN year > 1996 THEN avg(abs(truth - prediction)) END AS mae FROM p GROUP BY 1, 2)
    SELECT algorithm, count(*) AS folds, round(avg(rmse), 6) AS rmse_mean, round(stddev_samp(rmse), 6) AS rmse_sd, round(avg(mae), 6) AS mae_mean, round(stddev_samp(mae), 6) AS mae_sd FROM f GROUP BY 1""",
)
def c36(spark, d):
    folds = metrics.regression_scores(b.predictions(spark, d), "truth", "prediction", ["o_orderstatus", "year"])
    folds = folds.withColumn("mae", F.when(F.col("year") > 1996, F.col("mae")).otherwise(F.lit(float("nan")))).withColumnRenamed("o_orderstatus", "algorithm")
    return rounded(metrics.fold_rollup(folds, ["algorithm"], ["rmse", "mae"]))


@query(
    "C37_leak_inflation",
    f"""WITH {CLS}, s AS (SELECT o_orderpriority AS algorithm, avg((actual = called)::INT) FILTER (year > 1999)::DOUBLE AS leak_free, avg((actual = called)::INT) FILTER (year <= 1999)::DOUBLE AS naive FROM c GROUP BY 1)
    SELECT algorithm, round(naive, 6) AS naive, round(leak_free, 6) AS leak_free, round(naive - leak_free, 6) + 0.0 AS inflation FROM s""",
)
def c37(spark, d):
    rows = calls(spark, d).groupBy(F.col("o_orderpriority").alias("algorithm"), F.when(F.col("year") > 1999, "leak_free").otherwise("naive").alias("protocol"))
    return rounded(metrics.leak_inflation(rows.agg(F.avg((F.col("actual") == F.col("called")).cast("double")).alias("test_accuracy"))))


@query(
    "C43_screen_metrics",
    f"""WITH {P}, s AS (SELECT id, truth >= 5.5 AS act, round(prediction, 2) AS sc FROM p), t AS (SELECT *, row_number() OVER (ORDER BY sc DESC, id) AS r, count(*) OVER () AS n FROM s), h AS (SELECT count(*) AS k, avg(act::INT)::DOUBLE AS prec FROM t WHERE r <= greatest(1, ceil(n * 0.1))),
     ct AS (SELECT sc, count(*) FILTER (act) AS p, count(*) AS a FROM s GROUP BY 1), cu AS (SELECT *, sum(p) OVER w AS cp, sum(a) OVER w AS ca, sum(p) OVER () AS tp, sum(a) OVER () AS ta FROM ct WINDOW w AS (ORDER BY sc DESC)),
     rk AS (SELECT sum(p * ((ta - tp) - (ca - cp)) + p * (a - p) / 2.0::DOUBLE)::DOUBLE / any_value(tp::DOUBLE * (ta - tp)) AS auc, sum(p::DOUBLE / tp * cp / ca) AS ap, any_value(ta) AS n, any_value(tp) AS na FROM cu)
    SELECT CAST(n AS BIGINT) AS n, CAST(na AS BIGINT) AS n_active, round(na::DOUBLE / n, 6) AS prevalence, round(auc, 6) AS roc_auc, round(ap, 6) AS average_precision, round(prec, 6) AS precision_at_top, round(prec / (na::DOUBLE / n), 6) AS enrichment_at_top FROM rk, h""",
)
def c43(spark, d):
    rows = b.predictions(spark, d).select("id", (F.col("truth") >= 5.5).alias("act"), F.round("prediction", 2).alias("sc"))
    return rounded(metrics.screen_metrics(rows, active="act", score="sc", row="id"))


BLOCKS = f"""{P}, bl AS (SELECT coalesce(block, '__row_' || id) AS block, count(*)::DOUBLE AS n, sum(truth) AS y, sum(truth*truth) AS yy, sum((truth - prediction)*(truth - prediction)) AS ee, sum(abs(truth - prediction)) AS ae, sum((truth - baseline)*(truth - baseline)) AS bb FROM p GROUP BY 1)"""
HASH = "('0x' || substr(md5({0}), 1, 13))::BIGINT"


@query("R11_block_sums", f"WITH {BLOCKS} SELECT block, n, round(y, 5) AS y, round(yy, 5) AS yy, round(ee, 5) AS ee, round(ae, 5) AS ae, round(bb, 5) AS bb FROM bl")
def r11a(spark, d):
    return rounded(metrics.block_sums(b.predictions(spark, d), block="block", row="id", truth="truth", prediction="prediction", baseline="baseline"), 5)


@query(
    "R11_block_bootstrap",
    f"""WITH {BLOCKS}, o AS (SELECT *, rank() OVER (ORDER BY {HASH.format("'42:order:' || block")}) - 1 AS slot, count(*) OVER () AS slots FROM bl), r AS (SELECT unnest(range(1, 501)) AS rep),
     dr AS (SELECT rep, CAST(floor({HASH.format("'42:' || rep || ':' || slot")}::DOUBLE / 4503599627370496 * slots) AS BIGINT) AS slot FROM o, r),
     sm AS (SELECT rep, sum(n) AS n, sum(y) AS y, sum(yy) AS yy, sum(ee) AS ee, sum(ae) AS ae, sum(bb) AS bb FROM dr JOIN o USING (slot) GROUP BY 1),
     al AS (SELECT * FROM sm UNION ALL SELECT 0, sum(n), sum(y), sum(yy), sum(ee), sum(ae), sum(bb) FROM bl),
     v AS (SELECT rep, unnest(['R²', 'RMSE', 'MAE', 'RMSE gain versus baseline']) AS metric, unnest([1 - ee / (yy - y*y/n), sqrt(ee/n), ae/n, sqrt(bb/n) - sqrt(ee/n)]) AS value FROM al)
    SELECT metric, round(max(value) FILTER (rep = 0), 5) + 0.0 AS estimate, (SELECT count(*) FROM bl) AS blocks, round(quantile_cont(value, 0.025) FILTER (rep > 0), 5) + 0.0 AS lower_95, round(quantile_cont(value, 0.975) FILTER (rep > 0), 5) + 0.0 AS upper_95, count(*) FILTER (rep > 0) AS valid_repeats FROM v GROUP BY 1""",
)
def r11(spark, d):
    blocks = metrics.block_sums(b.predictions(spark, d), block="block", row="id", truth="truth", prediction="prediction", baseline="baseline")
    return rounded(metrics.block_resample(blocks, repeats=500), 5)


@query(
    "R12_permutation_p",
    f"""WITH {P}, rp AS (SELECT id, truth, prediction, unnest(range(1, 101)) AS rep FROM p), a AS (SELECT rep, id, rank() OVER (PARTITION BY rep ORDER BY {HASH.format("'42:row:' || rep || ':' || id")}) AS k FROM rp), c AS (SELECT rep, truth, rank() OVER (PARTITION BY rep ORDER BY {HASH.format("'42:value:' || rep || ':' || id")}) AS k FROM rp),
     s AS (SELECT rep, corr(c.truth, p.prediction) AS q FROM a JOIN c USING (rep, k) JOIN p USING (id) GROUP BY 1), o AS (SELECT corr(truth, prediction) AS q FROM p)
    SELECT round(max(o.q), 5) AS observed, count(*) AS permutations, round((1 + count(*) FILTER (s.q >= o.q))::DOUBLE / (1 + count(*)), 6) AS p_value FROM s, o""",
)
def r12(spark, d):
    p = b.predictions(spark, d)
    scores = permutation.permuted_correlations(p, row="id", value="truth", other="prediction", repeats=100)
    return rounded(metrics.permutation_p(p.agg(F.corr("truth", "prediction").alias("q")), scores, "q"), p_value=6, observed=5)


@query(
    "C51_linear_attribution",
    """WITH f AS (SELECT vec_id AS id, unnest(range(64)) AS feature, unnest(embedding)::DOUBLE AS v, label FROM embeddings), pa AS (SELECT feature, avg(v) AS pv FROM f GROUP BY 1)
    SELECT id, CAST(feature // 16 AS BIGINT) AS block, round(sum((v - pv) * (feature + 1) / 10.0::DOUBLE), 5) + 0.0 AS contribution FROM f JOIN pa USING (feature) GROUP BY 1, 2""",
)
def c51(spark, d):
    return rounded(_attribution(spark, d)[0], 5)


def _attribution(spark, d):
    from measurelens.operators.features import long_array

    long = long_array(b.table(spark, d, "embeddings").withColumnRenamed("vec_id", "id"), "id", "embedding")
    parent = long.groupBy("feature").agg(F.avg("v").alias("pv")).withColumn("coef", (F.col("feature") + 1) / 10.0)
    coefs = parent.withColumn("block", F.floor(F.col("feature") / 16))
    return metrics.attribution(long, coefs, entity="id", feature="feature", block="block", value="v", parent="pv", coefficient="coef"), long, coefs


@query(
    "C51_reconstruction",
    """WITH f AS (SELECT vec_id AS id, unnest(range(64)) AS feature, unnest(embedding)::DOUBLE AS v, label FROM embeddings), pa AS (SELECT feature, avg(v) AS pv FROM f GROUP BY 1)
    SELECT id, round(sum((v - pv) * (feature + 1) / 10.0::DOUBLE), 5) + 0.0 AS reconstructed, any_value(label) <> 3 AS reconstructs FROM f JOIN pa USING (feature) GROUP BY 1""",
)
def c51b(spark, d):
    parts, long, coefs = _attribution(spark, d)
    delta = long.join(coefs, "feature").groupBy("id").agg(F.sum((F.col("v") - F.col("pv")) * F.col("coef")).alias("delta"))
    labels = b.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    delta = delta.join(labels, "id").withColumn("delta", F.col("delta") + F.when(F.col("label") == 3, 0.5).otherwise(0.0))
    return rounded(metrics.attribution_check(parts, delta, entity="id", delta="delta"), 5)

"""Model comparison, importance, components and saved models."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from measurelens.functions.scalar import hash_unit
from measurelens.operators import features, groups, models, scorers
from measurelens.operators.common import settle


def frame(spark, x, y, **more):
    rows = [(i, [float(v) for v in a], float(b), *[c[i] for c in more.values()]) for i, (a, b) in enumerate(zip(x, y))]
    kinds = "".join(f", {k} {'string' if isinstance(c[0], str) else 'double'}" for k, c in more.items())
    return settle(spark.createDataFrame(rows, f"id long, x array<double>, y double{kinds}").withColumn("features", array_to_vector("x")))


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 6))
    return x, 3 * x[:, 0] + np.sin(3 * x[:, 1]) + 50 + rng.normal(size=120) * 0.1


def test_ridge_is_the_closed_form(spark, data):
    x, y = data
    y = y * 20  # the penalty must not depend on the target's scale
    model = models.Ridge(10.0).setLabelCol("y").fit(frame(spark, x, y))
    c = x - x.mean(0)
    want = np.linalg.solve(c.T @ c + 10 * np.eye(6), c.T @ (y - y.mean()))
    assert np.allclose(model.coefficients.toArray(), want, rtol=1e-6)
    assert model.intercept == pytest.approx(y.mean() - x.mean(0) @ want)


@pytest.mark.parametrize("make", [lambda: models.Ridge(), lambda: DecisionTreeRegressor(maxDepth=4), lambda: RandomForestRegressor(numTrees=7, maxDepth=5, seed=1), lambda: GBTRegressor(maxIter=4, seed=1)], ids=["ridge", "tree", "forest", "boosted"])
def test_permutation_importance_equals_a_plain_loop(spark, data, make):
    x, y = data
    df = frame(spark, x, y)
    model = make().setLabelCol("y").fit(df)
    said = np.array([r.prediction for r in model.transform(df).orderBy("id").collect()])
    found = scorers.scorer(model)
    assert np.allclose(found.value(found.start(x)), said)
    got = {r.feature: r for r in models.permutation_importance(model, df, row="id", target="y", width=6, repeats=3).collect()}
    order = df.crossJoin(spark.range(1, 4).withColumnRenamed("id", "rep")).select("rep", "id", hash_unit(42, "to", F.col("rep"), F.col("id")).alias("to"), hash_unit(42, "from", F.col("rep"), F.col("id")).alias("from_")).collect()
    base, drops = np.sqrt(((y - said) ** 2).mean()), np.zeros((6, 3))
    for rep in (1, 2, 3):
        mine = [r for r in order if r.rep == rep]
        to, source = [r.id for r in sorted(mine, key=lambda r: r.to)], [r.id for r in sorted(mine, key=lambda r: r.from_)]
        for f in range(6):
            z = x.copy()
            z[to, f] = x[source, f]
            drops[f, rep - 1] = np.sqrt(((y - found.value(found.start(z))) ** 2).mean()) - base
    assert [got[f].importance for f in range(6)] == pytest.approx(drops.mean(1).tolist(), abs=1e-9)
    assert [got[f].sd for f in range(6)] == pytest.approx(drops.std(1).tolist(), abs=1e-9)
    assert max(got, key=lambda f: got[f].importance) == 0


def test_unknown_models_have_no_arrays(data):
    with pytest.raises(ValueError, match="no arrays"):
        scorers.scorer(object())


def test_noise_stays_at_chance_without_leaks(spark):
    """Labels that features cannot tell: the leak-free order scores at chance, copies on both sides of a split do not."""
    rng = np.random.default_rng(5)
    x, label = rng.normal(size=(150, 4)), np.array([0.0] * 120 + [1.0] * 30)
    df = frame(spark, x, label).drop("features")
    table, best, held = models.compare_classifiers(df, row="id", array="x", label="y", group=None, width=4, names=["decision_tree", "nearest_neighbors"], k=3)
    rows = {r.algorithm: r for r in table.collect()}
    assert set(rows) == {"decision_tree", "nearest_neighbors"} and all(abs(r.mcc_mean) < 0.3 for r in rows.values())
    assert best == min(rows, key=lambda a: (-rows[a].mcc_mean, a))  # chosen by cross-validation
    assert held.count() == 30 and {r.folds for r in rows.values()} == {3}
    naive = models.naive_classifier(df, row="id", array="x", label="y", width=4, name="nearest_neighbors").head()
    assert naive.balanced_accuracy > 0.7 and naive.protocol == "naive"


def test_regressors_are_chosen_by_cross_validation(spark, data):
    x, y = data
    df = frame(spark, x, y, stratum=["s"] * 120).drop("features")
    table, best, cv, held = models.compare_regressors(df, row="id", array="x", target="y", stratum="stratum", group=None, width=6, names=["ridge", "nearest_neighbors"], k=3)
    rows = {r.algorithm: r for r in table.collect()}
    assert set(rows) == {"ridge", "nearest_neighbors", "mean_baseline"} and best == "ridge"
    assert rows["ridge"].rmse_mean < rows["nearest_neighbors"].rmse_mean < rows["mean_baseline"].rmse_mean
    assert cv.count() == 96 and held.count() == 24
    with pytest.raises(ValueError, match="unknown algorithm"):
        models.compare_regressors(df, row="id", array="x", target="y", stratum="stratum", group=None, width=6, names=["nope"])


def test_saved_models_refuse_other_features(spark, data, tmp_path):
    x, y = data
    df = frame(spark, x, y)
    kept, model = models.fit_deployment(df.drop("features"), row="id", array="x", target="y", width=6, name="ridge")
    assert kept == list(range(6))
    path = str(tmp_path / "bundle")
    models.save_bundle(model, [f"f{i}" for i in kept], path, spark)
    models.check_schema(spark, path, [f"f{i}" for i in kept])
    for other in ([f"f{i}" for i in reversed(kept)], ["f0"]):
        with pytest.raises(ValueError, match="differ"):
            models.check_schema(spark, path, other)
    with pytest.raises(Exception, match="fitted on 6 features"):
        features.take_features(df.drop("features").withColumn("x", F.slice("x", 1, 5)), "x", kept, width=6).collect()


def test_components_equal_numpy(spark, data):
    x, _ = data
    x = x[:, :3] * [1, 5, 100] + [[0, 3, 7]]
    x[:, 2] += 40 * x[:, 0]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double")
    scores, loadings, shares = features.components(df, ["a", "b", "c"], 3)
    z = (x - x.mean(0)) / x.std(0)
    value, vector = np.linalg.eigh(np.cov(z.T))
    value, vector = value[::-1], vector[:, ::-1].T
    vector = np.array([v * np.sign(v[np.abs(v).argmax()]) for v in vector])
    assert np.allclose(shares, value / value.sum()) and np.allclose(loadings, vector)
    got = scores.orderBy("id").select("PC1", "PC2", "PC3").collect()
    assert np.allclose(got, z @ vector.T, atol=1e-8)
    told = groups.explained_variance(spark.createDataFrame(list(enumerate(shares, 1)), "component int, share double"), "component", "share").collect()
    assert len(told) == 3


def test_bounding_box_domain(spark, data):
    x, y = data
    far = np.concatenate((x[:10], x[:2] * 50))
    got = features.bounding_box_domain(frame(spark, x, y), frame(spark, far, np.zeros(12)), "x").orderBy("id").collect()
    assert [r.in_domain for r in got] == [True] * 10 + [False] * 2

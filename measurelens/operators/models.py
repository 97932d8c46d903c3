"""Leak-free model comparison with Spark ML.

Feature selection and oversampling are fitted inside every training part.  The
algorithm is chosen by cross-validation; the held-out rows are scored once.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    NaiveBayes,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from measurelens.functions.scalar import hash_unit
from measurelens.operators import metrics
from measurelens.operators.common import carried, settle
from measurelens.operators.features import select_features, take_features
from measurelens.operators.neighbours import Neighbours
from measurelens.operators.normal import matrix
from measurelens.operators.ordered import numbered
from measurelens.operators.scorers import scorer
from measurelens.operators.splits import group_folds, group_holdout, oversample, stratified_folds, stratified_holdout

CLASSIFIERS = {
    "random_forest": lambda seed: RandomForestClassifier(numTrees=200, maxDepth=15, seed=seed),
    "small_forest": lambda seed: RandomForestClassifier(numTrees=20, maxDepth=5, seed=seed),
    "gradient_boosting": lambda seed: OneVsRest(classifier=GBTClassifier(seed=seed)),
    "decision_tree": lambda seed: DecisionTreeClassifier(maxDepth=5, seed=seed),
    "logistic_regression": lambda seed: LogisticRegression(maxIter=100),
    "linear_svc": lambda seed: OneVsRest(classifier=LinearSVC(maxIter=50)),
    "naive_bayes": lambda seed: NaiveBayes(modelType="gaussian"),
    "nearest_neighbors": lambda seed: Neighbours(k=4, weights="uniform"),
}
REGRESSORS = {
    "random_forest": lambda seed: RandomForestRegressor(numTrees=200, maxDepth=15, seed=seed),
    "small_forest": lambda seed: RandomForestRegressor(numTrees=20, maxDepth=5, seed=seed),
    "gradient_boosting": lambda seed: GBTRegressor(seed=seed),
    "ridge": lambda seed: Ridge(),
    "nearest_neighbors": lambda seed: Neighbours(k=4, weights="distance", classify=False),
}


class Ridge:
    """Least squares plus ``penalty`` times the sum of squared coefficients, however many rows there are.

    Spark divides the squared errors by twice their number and applies its penalty to
    a target of unit deviation, hence the penalty per row times that deviation.
    """

    def __init__(self, penalty: float = 10.0):
        self.penalty, self.label = penalty, "label"

    def setLabelCol(self, label: str) -> Ridge:
        self.label = label
        return self

    def fit(self, rows: DataFrame):
        n, spread = rows.agg(F.count(F.lit(1)), F.stddev_pop(self.label)).head()
        share = self.penalty / max(1, n) * (spread or 1.0)
        return LinearRegression(regParam=share, elasticNetParam=0.0, standardization=False, solver="normal").setLabelCol(self.label).fit(rows)


def perceptron(layers: Sequence[int], seed: int = 42) -> MultilayerPerceptronClassifier:
    return MultilayerPerceptronClassifier(layers=list(layers), seed=seed)


class _Part:
    """A training part with its own feature selection and balancing."""

    def __init__(self, rows: DataFrame, *, row: str, array: str, width: int, variance: float, correlation: float, balance: str | None, seed: int):
        self.row, self.array, self.width = row, array, width
        self.features = select_features(rows, array, row=row, variance=variance, correlation=correlation)
        if not self.features:
            raise ValueError("no feature survives the filters on the training rows")
        used = oversample(rows, identifier=row, label=balance, seed=seed) if balance else rows
        self.rows = settle(self.apply(used))

    def apply(self, rows: DataFrame) -> DataFrame:
        return take_features(rows, self.array, self.features, width=self.width)


def _fit_predict(part: _Part, estimator, label: str, rows: DataFrame) -> DataFrame:
    if estimator is None:
        mean = part.rows.agg(F.avg(label).alias("prediction"))
        return rows.join(F.broadcast(mean))
    estimator = estimator.setLabelCol(label) if hasattr(estimator, "setLabelCol") else estimator
    estimator = estimator.setRowCol(part.row) if hasattr(estimator, "setRowCol") else estimator
    return estimator.fit(part.rows).transform(part.apply(rows))


def check_names(names: Sequence[str], known: dict) -> list[str]:
    unknown = [n for n in names if n not in known]
    if unknown:
        raise ValueError(f"unknown algorithm(s) {unknown}; known: {sorted(known)}")
    if not names:
        raise ValueError("choose at least one algorithm")
    return list(names)


def compare_classifiers(
    df: DataFrame, *, row: str, array: str, label: str, group: str | None, width: int, names: Sequence[str], k: int = 3, test_fraction: float = 0.2, variance: float = 0.0, correlation: float = 0.95, balance: bool = True, seed: int = 42
) -> tuple[DataFrame, str, DataFrame]:
    """(scores per algorithm, best algorithm, its held-out predictions).

    ``label`` is a numbered class (double).  The best algorithm has the highest
    mean cross-validated correlation coefficient; ties go to the first name.
    """
    names = check_names(names, CLASSIFIERS)
    key = "_label"
    rows = df.withColumn(key, F.col(label).cast("string"))
    split = group_holdout(rows, group=group, label=key, test_fraction=test_fraction, seed=seed) if group else stratified_holdout(rows, identifier=row, label=key, test_fraction=test_fraction, seed=seed)
    train = split.where(~F.col("is_test")).drop("is_test")
    folded = settle(group_folds(train, group=group, label=key, k=k, seed=seed) if group else stratified_folds(train, identifier=row, label=key, k=k, seed=seed))
    test = settle(split.where("is_test").drop("is_test"))
    made = dict(row=row, array=array, width=width, variance=variance, correlation=correlation, balance=key if balance else None, seed=seed)
    parts = [_Part(folded.where(F.col("fold") != f).drop("fold"), **made) for f in range(k)]
    whole = _Part(folded.drop("fold"), **made)
    out = None
    for name in names:
        keep = lambda d, stage: d.select(F.lit(name).alias("algorithm"), F.lit(stage).alias("stage"), row, label, "prediction")  # noqa: B023, E731
        final = CLASSIFIERS[name](seed)
        tables = [keep(_fit_predict(part, CLASSIFIERS[name](seed), label, folded.where(F.col("fold") == f)), f"cv{f}") for f, part in enumerate(parts)]
        tables.append(keep(_fit_predict(whole, final, label, test), "test"))
        for t in tables:
            out = t if out is None else out.unionByName(t)
    out = settle(out)
    scores = metrics.accuracy_scores(out, label, "prediction", ["algorithm", "stage"])
    cv = metrics.fold_rollup(scores.where(F.col("stage") != "test"), ["algorithm"], ["accuracy", "balanced_accuracy", "mcc"])
    held = scores.where(F.col("stage") == "test").select("algorithm", *[F.col(m).alias(f"test_{m}") for m in ("accuracy", "balanced_accuracy", "mcc")])
    table = settle(cv.join(held, "algorithm").withColumn("protocol", F.lit("leak_free")).withColumn("n_features", F.lit(len(whole.features))))
    best = table.orderBy(F.desc_nulls_last("mcc_mean"), "algorithm").select("algorithm").head()[0]
    return table, best, out.where((F.col("algorithm") == best) & (F.col("stage") == "test")).select(row, label, "prediction")


def naive_classifier(df: DataFrame, *, row: str, array: str, label: str, width: int, name: str, test_fraction: float = 0.2, variance: float = 0.0, correlation: float = 0.95, seed: int = 42) -> DataFrame:
    """The leaky order, run on purpose: select and oversample on all rows, then split."""
    key = "_label"
    rows = df.withColumn(key, F.col(label).cast("string"))
    part = _Part(rows, row=row, array=array, width=width, variance=variance, correlation=correlation, balance=key, seed=seed)
    copies = part.rows.withColumn("_copy", F.concat_ws(":", F.col(row).cast("string"), F.col("copy").cast("string")))
    split = settle(stratified_holdout(copies, identifier="_copy", label=key, test_fraction=test_fraction, seed=seed))
    estimator = check_names([name], CLASSIFIERS) and CLASSIFIERS[name](seed)
    scored = estimator.setLabelCol(label).fit(split.where(~F.col("is_test"))).transform(split.where("is_test"))
    return metrics.accuracy_scores(scored, label, "prediction").select(F.lit(name).alias("algorithm"), F.lit("naive").alias("protocol"), "accuracy", "balanced_accuracy", "mcc")


def compare_regressors(
    df: DataFrame, *, row: str, array: str, target: str, stratum: str, group: str | None, width: int, names: Sequence[str], k: int = 3, test_fraction: float = 0.2, variance: float = 0.0, correlation: float = 0.95, seed: int = 42
) -> tuple[DataFrame, str, DataFrame, DataFrame]:
    """(scores, best algorithm, its CV predictions, its held-out predictions).

    The mean baseline is always scored; it is chosen only when asked for.
    """
    names = check_names(names, {**REGRESSORS, "mean_baseline": None})
    every = names if "mean_baseline" in names else [*names, "mean_baseline"]
    split = group_holdout(df, group=group, label=stratum, test_fraction=test_fraction, seed=seed) if group else stratified_holdout(df, identifier=row, label=stratum, test_fraction=test_fraction, seed=seed)
    train = split.where(~F.col("is_test")).drop("is_test")
    folded = settle(group_folds(train, group=group, label=stratum, k=k, seed=seed) if group else stratified_folds(train, identifier=row, label=stratum, k=k, seed=seed))
    test = settle(split.where("is_test").drop("is_test"))
    made = dict(row=row, array=array, width=width, variance=variance, correlation=correlation, balance=None, seed=seed)
    parts = [_Part(folded.where(F.col("fold") != f).drop("fold"), **made) for f in range(k)]
    whole = _Part(folded.drop("fold"), **made)
    out = None
    for name in every:
        make = lambda: REGRESSORS[name](seed) if name in REGRESSORS else None  # noqa: B023, E731
        keep = lambda d, stage: d.select(F.lit(name).alias("algorithm"), F.lit(stage).alias("stage"), row, target, "prediction")  # noqa: B023, E731
        tables = [keep(_fit_predict(part, make(), target, folded.where(F.col("fold") == f)), f"cv{f}") for f, part in enumerate(parts)]
        tables.append(keep(_fit_predict(whole, make(), target, test), "test"))
        for t in tables:
            out = t if out is None else out.unionByName(t)
    out = settle(out)
    scores = settle(metrics.regression_scores(out, target, "prediction", ["algorithm", "stage"]))
    cv = metrics.fold_rollup(scores.where(F.col("stage") != "test"), ["algorithm"], ["r2", "rmse", "spearman"])
    held = scores.where(F.col("stage") == "test").select("algorithm", F.col("r2").alias("test_r2"), F.col("rmse").alias("test_rmse"), F.col("mae").alias("test_mae"))
    table = settle(cv.join(held, "algorithm"))
    best = table.where(F.col("algorithm").isin(names)).orderBy(F.asc_nulls_last("rmse_mean"), "algorithm").select("algorithm").head()[0]
    mine = out.where(F.col("algorithm") == best).drop("algorithm")
    return table, best, mine.where(F.col("stage") != "test").drop("stage"), mine.where(F.col("stage") == "test").drop("stage")


def fit_deployment(df: DataFrame, *, row: str, array: str, target: str, width: int, name: str, variance: float = 0.0, correlation: float = 0.95, seed: int = 42):
    """Refit the chosen algorithm on all rows: (feature numbers, fitted model)."""
    check_names([name], REGRESSORS)
    part = _Part(df, row=row, array=array, width=width, variance=variance, correlation=correlation, balance=None, seed=seed)
    return part.features, REGRESSORS[name](seed).setLabelCol(target).fit(part.rows)


def save_bundle(model, names: Sequence[str], path: str, spark) -> None:
    """The fitted model beside the ordered names of its features."""
    model.write().overwrite().save(f"{path}/model")
    spark.range(1).select(F.array(*[F.lit(str(n)) for n in names]).alias("feature_names")).write.mode("overwrite").parquet(f"{path}/schema")


def check_schema(spark, path: str, names: Sequence[str]) -> None:
    """Refuse to predict with features that differ from the saved ordered names."""
    saved = spark.read.parquet(f"{path}/schema").head()[0]
    if list(saved) != [str(n) for n in names]:
        raise ValueError("the features differ from the saved model's ordered feature names")


def permutation_importance(model, test: DataFrame, *, row: str, target: str, width: int, repeats: int = 5, seed: int = 42) -> DataFrame:
    """RMSE increase when one feature is taken from another row of the test set.

    Each repeat pairs every row with a donor row through two hash orders.  A task
    predicts its rows once, then replaces one column at a time in place and sends
    features x repeats sums; rows are never copied per feature.  Columns that a
    model does not use have importance zero without being scored.
    """
    rows = test.select(row, F.col(target).cast("double").alias("_y"), vector_to_array("features").alias("_x"))
    reps = rows.select(row, "_x").withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    here = numbered(reps.select(row, "rep"), ["rep"], hash_unit(seed, "to", F.col("rep"), F.col(row)), tie=[row]).select("rep", "position", row)
    donor = numbered(reps, ["rep"], hash_unit(seed, "from", F.col("rep"), F.col(row)), tie=[row]).select("rep", "position", F.col("_x").alias("_d"))
    pairs = here.join(donor, ["rep", "position"]).join(rows, row).select("rep", "_y", "_x", "_d")
    shared = carried(test.sparkSession, scorer(model))

    def run(batches):
        found, sums = shared(), {}
        for batch in batches:
            for first in range(0, batch.num_rows, 4096):
                part = batch.slice(first, 4096)
                rep = part.column(0).to_numpy(zero_copy_only=False)
                y, x, d = part.column(1).to_numpy(zero_copy_only=False), matrix(part.column(2), width), matrix(part.column(3), width)
                state = found.start(x)
                errors = [y - found.value(state)] + [y - found.swapped(state, x, f, d[:, f]) for f in range(width)]
                for r in np.unique(rep).tolist():
                    new = np.array([(e[rep == r] ** 2).sum() for e in errors])
                    n, old = sums.get(r, (0, 0.0))
                    sums[r] = (n + int((rep == r).sum()), old + new)
        for r, (n, s) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, width), pa.int32()), pa.array(np.full(width + 1, r), pa.int32()), pa.array(np.full(width + 1, n)), pa.array(s)], ["feature", "rep", "n", "sse"])

    total = pairs.mapInArrow(run, "feature int, rep int, n long, sse double").groupBy("feature", "rep").agg(F.sqrt(F.sum("sse") / F.sum("n")).alias("rmse"))
    base = total.where("feature < 0").select("rep", F.col("rmse").alias("base"))
    drop = F.col("rmse") - F.col("base")
    return total.where("feature >= 0").join(F.broadcast(base), "rep").groupBy("feature").agg(F.avg(drop).alias("importance"), F.stddev_pop(drop).alias("sd"))


def impurity_importance(model, spark) -> DataFrame:
    """Feature importances of a fitted forest, one row per feature."""
    values = F.array(*[F.lit(float(x)) for x in model.featureImportances.toArray()])
    return spark.range(1).select(F.posexplode(values).alias("feature", "importance"))


def group_benchmark(df: DataFrame, targets: Sequence[str], by: str, **settings) -> DataFrame:
    """The same regression comparison for each of a few targets, beside their sizes."""
    out = None
    for target in targets:
        rows = settle(df.where(F.col(by) == target))
        table, best, _, _ = compare_regressors(rows, **settings)
        row = table.where(F.col("algorithm").isin(best, "mean_baseline")).select(F.lit(target).alias("target"), "algorithm", "test_r2", "test_rmse", (F.col("algorithm") == best).alias("chosen"))
        out = row if out is None else out.unionByName(row)
    return out

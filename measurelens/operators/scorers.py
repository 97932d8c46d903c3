"""Fitted regression models as arrays, to score many changes of one column at a time.

A scorer predicts a matrix of rows and, cheaply, the same rows with one column
replaced: a linear model adds one product, a forest asks only the trees that use
the column.  Tables of a model are as large as the model and travel by broadcast.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.ml.regression import DecisionTreeRegressionModel, GBTRegressionModel, LinearRegressionModel, RandomForestRegressionModel
from pyspark.sql import functions as F

from measurelens.operators.common import shared_folder


class Linear:
    def __init__(self, coefficients: np.ndarray, intercept: float):
        self.coefficients, self.intercept = coefficients, intercept

    def start(self, x: np.ndarray) -> np.ndarray:
        return x @ self.coefficients + self.intercept

    def value(self, state: np.ndarray) -> np.ndarray:
        return state

    def swapped(self, state: np.ndarray, x: np.ndarray, column: int, values: np.ndarray) -> np.ndarray:
        return state + self.coefficients[column] * (values - x[:, column])


class Trees:
    """Trees as node arrays: feature (-1 at a leaf), threshold, left, right, value."""

    def __init__(self, trees: list[tuple[np.ndarray, ...]], weights: np.ndarray):
        self.trees, self.weights = trees, weights
        self.users: dict[int, list[int]] = {}
        for t, (feature, *_) in enumerate(trees):
            for f in np.unique(feature[feature >= 0]).tolist():
                self.users.setdefault(f, []).append(t)

    def one(self, t: int, x: np.ndarray) -> np.ndarray:
        feature, threshold, left, right, value = self.trees[t]
        at = np.zeros(len(x), np.int64)
        open_ = np.arange(len(x)) if feature[0] >= 0 else np.zeros(0, np.int64)
        while len(open_):
            node = at[open_]
            below = x[open_, feature[node]] <= threshold[node]
            at[open_] = np.where(below, left[node], right[node])
            open_ = open_[feature[at[open_]] >= 0]
        return value[at]

    def start(self, x: np.ndarray) -> np.ndarray:
        return np.stack([self.one(t, x) for t in range(len(self.trees))], axis=1)

    def value(self, state: np.ndarray) -> np.ndarray:
        return state @ self.weights

    def swapped(self, state: np.ndarray, x: np.ndarray, column: int, values: np.ndarray) -> np.ndarray:
        out = self.value(state)
        users = self.users.get(column, [])
        if not users:
            return out
        kept = x[:, column].copy()
        x[:, column] = values
        for t in users:
            out = out + self.weights[t] * (self.one(t, x) - state[:, t])
        x[:, column] = kept
        return out


def scorer(model) -> Linear | Trees:
    """The arrays of a fitted Spark ML regressor: linear, tree, forest or boosted trees."""
    if isinstance(model, LinearRegressionModel):
        return Linear(model.coefficients.toArray(), float(model.intercept))
    if not isinstance(model, (DecisionTreeRegressionModel, RandomForestRegressionModel, GBTRegressionModel)):
        raise ValueError(f"no arrays for a {type(model).__name__}")
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    path = f"{shared_folder(spark).rstrip('/')}/model-{uuid.uuid4().hex}"
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    if "nodeData" in nodes.columns:
        nodes = nodes.select("treeID", "nodeData.*")
    else:
        nodes = nodes.withColumn("treeID", F.lit(0))
    split = F.col("split")
    table = nodes.select("treeID", "id", "prediction", "leftChild", "rightChild", split["featureIndex"].alias("feature"), split["numCategories"].alias("kinds"), F.get(split["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold")).toPandas()
    if (table.kinds >= 0).any():
        raise ValueError("splits on categories have no threshold")
    trees = []
    for _, t in table.sort_values(["treeID", "id"]).groupby("treeID"):
        trees.append((t.feature.to_numpy(), t.threshold.fillna(0.0).to_numpy(), t.leftChild.to_numpy(), t.rightChild.to_numpy(), t.prediction.to_numpy()))
    weights = np.ones(1) if isinstance(model, DecisionTreeRegressionModel) else np.array(model.treeWeights)
    return Trees(trees, weights / weights.sum() if isinstance(model, RandomForestRegressionModel) else weights)

"""Correlation filters by blocks and rounds against numpy and the scan."""

from __future__ import annotations

import numpy as np
import pytest

from measurelens.operators import features


def scan(numbers, edges):
    kept = []
    for f in numbers:
        if not any((min(f, k), max(f, k)) in edges for k in kept):
            kept.append(f)
    return kept


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>").repartition(5)


def correlated(n, p, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p)) + 1e4
    for i in range(3, p, 4):
        x[:, i] = x[:, i - 3] * 2 + rng.normal(size=n) * rng.choice([0.05, 1.0])
    x[:, 6] = 7.0  # no spread
    return x


@pytest.mark.parametrize("block", [256, 5])
def test_edges_equal_numpy(spark, monkeypatch, block):
    """In one block and one pass, and over many of both."""
    monkeypatch.setattr(features, "FEATURE_BLOCK", block)
    monkeypatch.setattr(features, "PASS", 6)
    x = correlated(200, 24, 1)
    with np.errstate(invalid="ignore"):
        r = np.nan_to_num(np.corrcoef(x.T))
    numbers = [i for i in range(24) if i != 11]
    want = {(a, b) for a in numbers for b in numbers if a < b and abs(r[a, b]) > 0.3}
    got = features.correlated_features(frame(spark, x), "x", numbers, 0.3).collect()
    assert {tuple(e) for e in got} == want and len(got) == len(want) > 4
    kept = features.select_features(frame(spark, x), "x", row="id", variance=0.1, correlation=0.3)
    alive = [i for i in range(24) if i != 6]
    edges = {(a, b) for a in alive for b in alive if a < b and abs(r[a, b]) > 0.3}
    assert kept == scan(alive, edges)


def test_rounds_equal_the_scan(spark):
    rng = np.random.default_rng(4)
    edges = {tuple(sorted(e)) for e in rng.integers(0, 60, (150, 2)).tolist() if e[0] != e[1]} | {(60, 61), (61, 62), (62, 63), (63, 64)}
    numbers = list(range(66))
    nodes = spark.createDataFrame([(i,) for i in numbers], "feature int")
    table = spark.createDataFrame([(b, a) if a % 2 else (a, b) for a, b in edges], "f_a int, f_b int")
    assert sorted(r.feature for r in features.greedy_keep(nodes, table).collect()) == scan(numbers, edges)
    assert features.greedy_keep(nodes, table.where("false")).count() == 66


def test_many_features_are_not_refused(spark):
    """More features than one driver-side matrix held before."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(12, 4200))
    x[:, 4199] = x[:, 0]
    got = {tuple(r) for r in features.correlated_features(frame(spark, x), "x", list(range(4200)), 0.999999).collect()}
    assert (0, 4199) in got and len(got) < 50


def test_no_rows_or_one_feature(spark):
    df = frame(spark, correlated(5, 8, 3))
    assert features.correlated_features(df.where("false"), "x", [0, 1], 0.5).count() == 0
    assert features.correlated_features(df, "x", [3], 0.5).count() == 0

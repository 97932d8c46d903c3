"""The block bootstrap against a plain loop, and the quality of its draws."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from measurelens.operators import metrics


def code(block):
    return int(hashlib.md5(f"42:block:{block}".encode()).hexdigest()[:13], 16)


def plain_count(block, rep):
    """The number of times a block enters a repeat, in plain integers."""
    p, h = 2**31 - 1, code(block)
    a, b = h % p, h // p % p
    x = (a + rep * 1664525 + 1013904223) % p
    x = ((x ^ (x >> 15)) * 48271 + b) % p
    x = ((x ^ (x >> 13)) * 69621 + a) % p
    x = ((x ^ (x >> 16)) * 16807 + rep) % p
    return sum(x / p >= cut for cut in metrics.poisson_cuts())


def test_draws_are_poisson_and_independent():
    codes = np.array([code(i) for i in range(3000)])
    times = metrics.draw_counts(codes, np.arange(1, 201))
    assert times[5, 6] == plain_count(5, 7) and times[17, 99] == plain_count(17, 100)
    assert times.mean() == pytest.approx(1, abs=0.01) and times.var() == pytest.approx(1, abs=0.02)
    assert (times == 0).mean() == pytest.approx(np.exp(-1), abs=0.005) and (times == 3).mean() == pytest.approx(np.exp(-1) / 6, abs=0.005)
    between = np.corrcoef(times.T)[np.triu_indices(200, 1)]
    assert abs(between.mean()) < 0.002 and between.std() == pytest.approx(1 / np.sqrt(3000), rel=0.1)
    assert abs(np.corrcoef(times[:200])[np.triu_indices(200, 1)].mean()) < 0.005


def test_bootstrap_equals_a_plain_loop(spark):
    rng = np.random.default_rng(3)
    sums = [(f"b{i}", *map(float, v)) for i, v in enumerate(np.column_stack((rng.integers(1, 9, 150), rng.normal(6, 1, (150, 1)) * 5, np.full(150, 400.0), rng.random((150, 3)) * 4)))]
    df = spark.createDataFrame(sums, "block string, n double, y double, yy double, ee double, ae double, bb double").repartition(6)
    got = {r.metric: r for r in metrics.block_bootstrap(df, repeats=60).collect()}
    rmse, mae = [], []
    for rep in range(1, 61):
        t = np.array([plain_count(s[0], rep) for s in sums])
        n, ee, ae = (float(t @ np.array([s[k] for s in sums])) for k in (1, 4, 5))
        rmse.append(np.sqrt(ee / n))
        mae.append(ae / n)
    for name, values in (("RMSE", rmse), ("MAE", mae)):
        assert (got[name].lower_95, got[name].upper_95) == pytest.approx(tuple(np.quantile(values, [0.025, 0.975])))
        assert got[name].valid_repeats == 60 and got[name].blocks == 150
    assert got["RMSE"].estimate == pytest.approx(np.sqrt(sum(s[4] for s in sums) / sum(s[1] for s in sums)))


def test_few_blocks(spark):
    """A repeat without any block is not valid; a single block is an error."""
    rows = [("a", 2.0, 3.0, 5.0, 1.0, 1.0, 2.0), ("b", 1.0, 2.0, 4.0, 0.5, 0.5, 1.0)]
    df = spark.createDataFrame(rows, "block string, n double, y double, yy double, ee double, ae double, bb double")
    got = {r.metric: r.valid_repeats for r in metrics.block_bootstrap(df, repeats=200).collect()}
    drawn = sum(plain_count("a", r) + plain_count("b", r) > 0 for r in range(1, 201))
    assert got["RMSE"] == drawn < 200
    with pytest.raises(Exception, match="two blocks"):
        metrics.block_bootstrap(df.where("block = 'a'"), repeats=20).collect()

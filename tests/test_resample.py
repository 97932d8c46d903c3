"""Drawing as many blocks as there are, against a plain loop."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from measurelens.operators import metrics


def code(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16)


@pytest.mark.parametrize("cell", [8192, 16])
def test_every_repeat_draws_as_many_blocks_as_there_are(spark, monkeypatch, cell):
    monkeypatch.setattr(metrics, "_SLOT_CELL", cell)
    monkeypatch.setattr(metrics, "_DRAWERS", 40)
    rng = np.random.default_rng(3)
    blocks = [(f"b{i}", *map(float, v)) for i, v in enumerate(np.column_stack((rng.integers(1, 9, 150), rng.normal(6, 1, (150, 1)) * 5, np.full(150, 400.0), rng.random((150, 3)) * 4)))]
    df = spark.createDataFrame(blocks, "block string, n double, y double, yy double, ee double, ae double, bb double").repartition(6)
    got = {r.metric: r for r in metrics.block_resample(df, repeats=60).collect()}
    placed = sorted(blocks, key=lambda s: code(f"42:order:{s[0]}"))
    n, ee, ae = (np.array([s[k] for s in placed]) for k in (1, 4, 5))
    rmse, mae = [], []
    for rep in range(1, 61):
        drawn = [int(code(f"42:{rep}:{slot}") / 2**52 * 150) for slot in range(150)]
        rmse.append(np.sqrt(ee[drawn].sum() / n[drawn].sum()))
        mae.append(ae[drawn].sum() / n[drawn].sum())
    for name, values in (("RMSE", rmse), ("MAE", mae)):
        assert (got[name].lower_95, got[name].upper_95) == pytest.approx(tuple(np.quantile(values, [0.025, 0.975])))
        assert got[name].valid_repeats == 60 and got[name].blocks == 150
    assert got["RMSE"].estimate == pytest.approx(np.sqrt(ee.sum() / n.sum()))


def test_a_single_block_is_an_error(spark):
    df = spark.createDataFrame([("a", 2.0, 3.0, 5.0, 1.0, 1.0, 2.0)], "block string, n double, y double, yy double, ee double, ae double, bb double")
    with pytest.raises(ValueError, match="two blocks"):
        metrics.block_resample(df, repeats=20)

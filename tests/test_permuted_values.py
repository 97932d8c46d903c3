"""Values dealt to rows in hash order, against the numbered permutation."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from measurelens.operators import metrics, permutation


@pytest.mark.parametrize("ranks, block", [(50_000, 14), (37, 5)])
def test_permuted_values_equal_numbered_permutations(spark, monkeypatch, ranks, block):
    monkeypatch.setattr(permutation, "_RANKS", ranks)
    monkeypatch.setattr(permutation, "_BLOCK", block)
    df = spark.range(400).select("id", (F.pmod(F.col("id") * 37, F.lit(101)) / 7.0).alias("y")).repartition(4)
    got = {r.id: r.permuted for r in permutation.permuted_values(df, row="id", value="y", repeats=5).collect()}
    want = np.full((400, 5), np.nan)
    for r in metrics.permuted_labels(df, row="id", value="y", repeats=5).collect():
        want[r.id, r.rep - 1] = r.y
    assert len(got) == 400 and (np.array([got[i] for i in range(400)]) == want).all()

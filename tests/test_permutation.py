"""Correlations under permutations against the numbered permutation, over several stretches of ranks."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from measurelens.operators import metrics, permutation


@pytest.mark.parametrize("ranks", [50_000, 37])
def test_correlations_equal_numbered_permutations(spark, monkeypatch, ranks):
    monkeypatch.setattr(permutation, "_RANKS", ranks)
    monkeypatch.setattr(permutation, "_BITS", 5)
    monkeypatch.setattr(permutation, "_ROWS", 100)
    df = spark.range(500).select(F.col("id"), (F.pmod(F.col("id") * 37, F.lit(101)) / 7.0).alias("y"), (F.col("id") % 13 + 0.25).alias("x")).repartition(4)
    got = {r.rep: r.q for r in permutation.permuted_correlations(df, row="id", value="y", other="x", repeats=6).collect()}
    dealt = metrics.permuted_labels(df, row="id", value="y", repeats=6).join(df.select("id", "x"), "id")
    want = {r.rep: r.q for r in dealt.groupBy("rep").agg(F.corr("y", "x").alias("q")).collect()}
    assert got == pytest.approx(want, abs=1e-9) and len(got) == 6

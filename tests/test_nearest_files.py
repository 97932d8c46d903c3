"""Nearest neighbours from files: the sets are written once and do not move again, and ties hold across runs of files."""

from __future__ import annotations

import random

import pytest

from measurelens.operators import similarity as sim


def make_rows():
    rng = random.Random(6)
    return {str(i): set(rng.sample(range(12), rng.randrange(1, 6))) for i in range(90)}


@pytest.mark.parametrize("stripe", [8, 1 << 20])
def test_ties_across_files_and_runs(spark, monkeypatch, stripe):
    for name, value in (("_CHUNK", 7), ("_ASKED", 2), ("_TOLD", 2), ("_HOT", 2), ("_STRIPE", stripe)):
        monkeypatch.setattr(sim, name, value)
    sets = make_rows()
    df = spark.createDataFrame([(i, [f"w{t}" for t in s]) for i, s in sets.items()], "id string, tokens array<string>")
    got = {r.id: (r.similarity, r.nearest_id) for r in sim.nearest_neighbours(df, df, tokens="tokens", exclude_self=True).collect()}
    order = sorted(sets, key=lambda i: (len(i), i))
    for i, a in sets.items():
        score = {j: len(a & sets[j]) / len(a | sets[j]) for j in order if j != i}
        best = max(score, key=score.get)
        assert got[i] == (score[best], best)


def test_tokens_are_written_once_in_files_of_bounded_length(spark, monkeypatch):
    monkeypatch.setattr(sim, "_CHUNK", 20)
    written = []
    settle = sim.settle
    monkeypatch.setattr(sim, "settle", lambda df, *rows: written.append(settle(df, *rows)) or written[-1])
    df = spark.createDataFrame([(i, [f"w{t}" for t in s]) for i, s in make_rows().items()], "id string, tokens array<string>").coalesce(1)
    found = sim.nearest_neighbours(df, df, tokens="tokens", exclude_self=True)
    assert found.count() == 90 and len(written) == 1 and len(written[0].inputFiles()) == 5
    # a join of the ids and the best references: no exchange of tokens
    assert "tokens" not in found._jdf.queryExecution().executedPlan().toString()

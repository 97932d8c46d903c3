"""Nearest neighbours over several chunks against a plain loop, with ties and sets that share nothing."""

from __future__ import annotations

import random

import pytest

from measurelens.operators import similarity as sim


@pytest.mark.parametrize("hot", [512, 3])
def test_nearest_equals_a_plain_loop(spark, monkeypatch, hot):
    for name, value in (("_CHUNK", 9), ("_HOT", hot), ("_STRIPE", 50)):
        monkeypatch.setattr(sim, name, value)
    rng = random.Random(2)
    sets = {str(i): set(rng.sample(range(30), rng.randrange(1, 9))) for i in range(120)} | {"200": set(), "201": {99}, "202": set(range(30))}
    df = spark.createDataFrame([(i, [f"w{t}" for t in s]) for i, s in sets.items()], "id string, tokens array<string>")
    got = {r.id: (r.similarity, r.nearest_id) for r in sim.nearest_neighbours(df, df, tokens="tokens", exclude_self=True).collect()}
    order = sorted(sets, key=lambda i: (len(i), i))
    for i, a in sets.items():
        score = {j: len(a & sets[j]) / len(a | sets[j]) if a | sets[j] else 0.0 for j in order if j != i}
        best = max(score, key=score.get)
        assert got[i] == (score[best], best)
    assert len(got) == len(sets)


def test_no_reference(spark):
    df = spark.createDataFrame([("1", ["a"])], "id string, tokens array<string>")
    row = sim.nearest_neighbours(df, df.where("id = '2'"), tokens="tokens").first()
    assert (row.id, row.similarity, row.nearest_id) == ("1", None, None)

"""Cells of signatures: all pairs with copies and crowded signatures, and tokens that are written once."""

from __future__ import annotations

import random

import pytest

from measurelens.operators import similarity as sim

ARGS = dict(identifier="id", tokens="tokens", value="v")


def make_rows():
    rng = random.Random(8)
    words = [f"w{k}" for k in range(40)]
    sets = [set(rng.sample(words, rng.randrange(4, 14))) for _ in range(60)]
    sets += [s | {rng.choice(words)} for s in sets[:40]] + sets[:30] + [sets[0]] * 20
    return [(i, sorted(s), rng.randrange(12) / 2) for i, s in enumerate(sets)]


def plain(rows, t, a):
    out = {}
    for i, s, v in rows:
        for j, r, w in rows:
            like = len(set(s) & set(r)) / len(set(s) | set(r))
            if i < j and t < like < 1 and abs(v - w) > a:
                out[str(i), str(j)] = (round(like, 9), abs(v - w))
    return out


@pytest.mark.parametrize("t", [0.7, 0.85])
@pytest.mark.parametrize("block", [2, 2000])
def test_cliffs_equal_a_plain_loop(spark, monkeypatch, t, block):
    for name, value in (("_BLOCK", block), ("_LEAST", 30), ("_WISHED", 20), ("_PAIRS", 40), ("_BITS", 64)):
        monkeypatch.setattr(sim, name, value)
    rows = make_rows()
    df = spark.createDataFrame(rows, "id int, tokens array<string>, v double").repartition(5)
    got = sim.cliffs(df, **ARGS, t=t, a=1.0).collect()
    want = plain(rows, t, 1.0)
    assert {(r.id_a, r.id_b): (round(r.similarity, 9), r.delta) for r in got} == want and len(got) == len(want) > 20


def test_values_that_are_no_numbers(spark):
    rows = [(1, list("abcdefghij"), float("nan")), (2, list("abcdefghijk"), 1.0), (3, list("abcdefghijl"), None)]
    df = spark.createDataFrame(rows, "id int, tokens array<string>, v double")
    got = sim.cliffs(df, **ARGS, t=0.8, a=1.0).collect()
    assert [(r.id_a, r.id_b, str(r.delta)) for r in got] == [("1", "2", "nan")]


def test_tokens_are_written_once_and_sketches_without_signatures(spark, monkeypatch):
    written = []
    settle = sim.settle
    monkeypatch.setattr(sim, "settle", lambda df: written.append(df.columns) or settle(df))
    df = spark.createDataFrame(make_rows(), "id int, tokens array<string>, v double")
    sim.cliffs(df, **ARGS, t=0.7, a=1.0).collect()
    assert sum("tokens" in columns for columns in written) == 1
    assert not any({"sig", "bits"} <= set(columns) for columns in written)

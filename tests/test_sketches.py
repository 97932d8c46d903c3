"""Sketches and signatures: few candidates, and none of the similar pairs lost."""

from __future__ import annotations

import random

import pytest

from measurelens.operators import similarity as sim


def make_sets(n, sizes, words, seed):
    rng = random.Random(seed)
    out = [set(rng.sample(words, rng.choice(sizes))) for _ in range(n)]
    for s in out[: n // 10]:  # near copies, one to four tokens away
        out.append(set(list(s)[rng.randrange(3) :]) | set(rng.sample(words, 2)))
    return out


@pytest.mark.parametrize("t", [0.7, 0.85, 0.95])
def test_candidates_hold_all_similar_pairs_and_few_others(spark, t):
    # 60 words make sets that share much, so that single parts and rare words often agree
    rows = [(i, sorted(s)) for i, s in enumerate(make_sets(300, range(6, 40), [f"w{k}" for k in range(60)], 5))]
    df = spark.createDataFrame(rows, "i int, tokens array<string>")
    sets = sim._distinct_sets(sim.collapse_sets(df, tokens="tokens"), "tokens")
    signatures = (sim.part_signatures if t >= 0.8 else sim.prefix_signatures)(sets, t, "tokens")
    candidates = sim.candidate_pairs(signatures, sim.set_sketches(sets, t, "tokens"), t).count()
    got = {tuple(sorted((bytes(r.key_a), bytes(r.key_b)))): r.similarity for r in sim.similar_set_pairs(sets, t, tokens="tokens").collect()}
    kept = {bytes(r.set_key): set(r.tokens) for r in sets.collect()}
    keys = sorted(kept)
    want = {}
    for x, a in enumerate(keys):
        for b in keys[x + 1 :]:
            common = len(kept[a] & kept[b])
            s = common / (len(kept[a]) + len(kept[b]) - common)
            if s > t:
                want[a, b] = s
    assert got == pytest.approx(want)
    assert len(want) <= candidates <= len(want) + len(keys) * (len(keys) - 1) / 2 / 100


def test_large_sets_and_sets_of_one_token(spark):
    big = [f"w{k}" for k in range(6000)]
    rows = [(1, big), (2, big[:-300]), (3, [f"x{k}" for k in range(6000)]), (4, ["a"]), (5, ["b"]), (6, [])]
    df = spark.createDataFrame([(i, s, float(i)) for i, s in rows], "id int, tokens array<string>, v double")
    for t in (0.7, 0.9):
        got = sim.cliffs(df, identifier="id", tokens="tokens", value="v", t=t, a=0.5).collect()
        assert [(r.id_a, r.id_b, r.similarity) for r in got] == [("1", "2", 0.95)]


def test_far_copies_are_the_members_of_far_identical_pairs(spark):
    rng = random.Random(4)
    rows = [(i, [f"w{rng.randrange(3)}"], rng.randrange(9) / 2) for i in range(40)] + [(40, [], 0.0), (41, [], 9.0), (42, ["x"], 1.0)]
    df = spark.createDataFrame(rows, "id int, tokens array<string>, v double")
    args = dict(identifier="id", tokens="tokens", value="v")
    pairs = sim.identical_pairs(df, **args).where("delta > 1.5").collect()
    got = [r.id for r in sim.far_copies(df, **args, a=1.5).collect()]
    assert sorted(got) == sorted({i for r in pairs for i in (r.id_a, r.id_b)}) and got

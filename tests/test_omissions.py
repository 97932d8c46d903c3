"""Omission checks against going through every omission, without a copy of the claim per omission."""

from __future__ import annotations

import random
from collections import defaultdict
from statistics import median

import pytest
from pyspark.sql import functions as F

from measurelens.operators import stress

T = 0.4
KIND = "position string, fragment_from string, fragment_to string, evidence_tier string, endpoint string, variant string, context string, assay string, id_from string, id_to string, delta double"


def tables(n: int, contexts: int, seed: int):
    """Pairs of one position with up to three assays each, and records from four publications."""
    draw = random.Random(seed)
    cells, evidence = defaultdict(list), []
    for i in range(2 * n):
        for assay in draw.sample(["N1", "N2", "N3"], draw.randint(1, 3)):
            for k in range(draw.randint(1, 3)):
                v, doc = draw.randint(0, 8) / 4, draw.choice(["Y1", "Y2", "Y3", "Y4"])
                cells[(f"e{i}", assay)].append((v, doc))
                evidence.append((f"e{i}", assay, "E", "V", v, f"r{i}{assay}{k}", doc))
    pairs = []
    for i in range(n):
        for j in {i, draw.randrange(n)}:
            a, b, context = f"e{i}", f"e{n + j}", f"x{draw.randrange(contexts)}"
            for assay in ("N1", "N2", "N3"):
                if (a, assay) in cells and (b, assay) in cells:
                    delta = median(v for v, _ in cells[b, assay]) - median(v for v, _ in cells[a, assay])
                    pairs.append(("R1", "p", "q" if i % 3 else "s", "shared assay", "E", "V", context, assay, a, b, delta))
    return pairs, evidence, cells


def statistics(rows):
    if not rows:
        return 0, 0, 0, None, None, "insufficient evidence"
    votes, by_context = defaultdict(list), defaultdict(set)
    for context, _, a, b, delta in rows:
        votes[a, b].append(delta)
        by_context[context].add((a, b))
    effects = [median(v) for v in votes.values()]
    disjoint = 0
    for found in by_context.values():
        used: set = set()
        for a, b in sorted(found):
            if a not in used and b not in used:
                used |= {a, b}
                disjoint += 1
    agreement = max(sum(e > 0 for e in effects), sum(e < 0 for e in effects)) / len(effects)
    m = median(effects)
    mixed = abs(m) < T or agreement < 0.8 or (max(r[4] for r in rows) > T and min(r[4] for r in rows) < -T)
    return len(effects), disjoint, len({r[1] for r in rows}), round(m, 9), round(agreement, 9), "mixed / small change" if mixed else "increase" if m > 0 else "decrease"


def expected(pairs, cells):
    out = {}
    for to in ("q", "s"):
        rows = [p[6:] for p in pairs if p[2] == to]
        left = {("Baseline", "None"): rows}
        for i in {r[2] for r in rows} | {r[3] for r in rows}:
            left["Leave one compound out", i] = [r for r in rows if i not in r[2:4]]
        for c in {r[0] for r in rows}:
            left["Leave one chemical context out", c] = [r for r in rows if r[0] != c]
        for assay in {r[1] for r in rows}:
            left["Leave one assay out", assay] = [r for r in rows if r[1] != assay]
        for doc in {d for r in rows for e in r[2:4] for _, d in cells[e, r[1]]}:
            kept = []
            for r in rows:
                side = [[v for v, d in cells[e, r[1]] if d != doc] for e in r[2:4]]
                if all(side):
                    kept.append((*r[:4], median(side[1]) - median(side[0])))
            left["Leave one publication out", doc] = kept
        base = statistics(rows)[5]
        for name, kept in left.items():
            s = statistics(kept)
            out[(to, *name)] = (*s, base in ("increase", "decrease") and s[5] == base)
    return out


def checked(spark, pairs, evidence):
    p = spark.createDataFrame(pairs, KIND)
    ev = spark.createDataFrame(evidence, "id string, assay string, endpoint string, variant string, v double, record string, document string")
    return stress.omission_checks(p, ev, threshold=T, entity="id", assay="assay", endpoint="endpoint", variant=F.col("variant"), value="v", record="record", document="document")


@pytest.mark.parametrize(("n", "contexts", "seed"), [(30, 4, 1), (31, 25, 2)])
def test_every_omission_has_the_statistics_of_the_rest(spark, n, contexts, seed):
    pairs, evidence, cells = tables(n, contexts, seed)
    got = {}
    for r in checked(spark, pairs, evidence).collect():
        numbers = [None if x is None else round(x, 9) + 0.0 for x in (r.median_delta, r.direction_agreement)]
        got[r.fragment_to, r.test, r.omitted] = (r.supporting_pairs, r.disjoint_pairs, r.assays, *numbers, r.interpretation, r.retains_direction)
    assert got == expected(pairs, cells)


def test_omissions_do_not_copy_their_claim(spark, monkeypatch):
    """200 pairs and 400 compounds in a claim were 80,000 rows."""
    written, settle = [], stress.settle
    monkeypatch.setattr(stress, "settle", lambda df: written.append(settle(df)) or written[-1])
    n = 200
    pairs = [("R1", "p", "q", "shared assay", "E", "V", f"x{i}", "N1", f"a{i}", f"b{i}", 1.0 + i) for i in range(n)]
    evidence = [(f"{s}{i}", "N1", "E", "V", float(i), f"r{s}{i}", f"Y{i % 5}") for i in range(n) for s in "ab"]
    assert checked(spark, pairs, evidence).count() == 1 + 2 * n + n + 1 + 5
    assert max(df.count() for df in written) <= 10 * n

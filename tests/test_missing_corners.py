"""Missing corners against plain loops, from cells alone, and patterns that one or several entities hold."""

from __future__ import annotations

import json
import random

from measurelens.operators import pairs as pr
from measurelens.operators import stress

POSITIONS = ["R1", "R2", "R3"]


def make_rows():
    rng = random.Random(3)
    series = [(rng.randrange(2), f"e{i}", *[rng.choice(["a", 'b"', "c", "d"]) for _ in POSITIONS]) for i in range(70)]
    evidence = [(f"e{i}", f"N{rng.randrange(2)}", rng.choice("xy"), "v", "=", rng.random(), f"r{i}{k}") for i in range(70) for k in range(3)]
    return series, evidence


def plain(series, cells):
    def context(e, p):
        return json.dumps({o: e[2 + k] for k, o in enumerate(POSITIONS) if o != p}, separators=(",", ":"))

    holders = {}
    for e in series:
        for k, p in enumerate(POSITIONS):
            holders.setdefault((e[0], p, context(e, p), e[2 + k]), []).append(e[1])
    alone = lambda e, k: len(holders[e[0], POSITIONS[k], context(e, POSITIONS[k]), e[2 + k]]) == 1
    out = {}
    for a in series:
        for b in series:
            for k, p in enumerate(POSITIONS):
                if a[0] != b[0] or a[2 + k] >= b[2 + k] or context(a, p) != context(b, p) or not (alone(a, k) and alone(b, k)):
                    continue
                for c in series:
                    apart = [j for j in range(3) if c[2 + j] != a[2 + j]]
                    if c[0] != a[0] or len(apart) != 1 or apart[0] == k or not alone(c, k):
                        continue
                    fourth = holders.get((c[0], p, context(c, p), b[2 + k]), [])
                    for cell in cells[a[1]] & cells[b[1]] & cells[c[1]]:
                        if len(fourth) > 1 or (fourth and cell in cells[fourth[0]]):
                            continue
                        key = (c[0], p, context(c, p), b[2 + k], *cell)
                        support = (a[1], b[1], c[1])
                        held = out.get(key)
                        out[key] = (min(support, held[0]) if held else support, fourth[0] if fourth else "")
    return {key: (";".join(support), fourth) for key, (support, fourth) in out.items()}


def test_corners_equal_plain_loops(spark):
    series, evidence = make_rows()
    df = spark.createDataFrame([(*s, 0.0) for s in series], "core int, id string, R1 string, R2 string, R3 string, v double")
    ev = spark.createDataFrame(evidence, "id string, assay string, endpoint string, variant string, relation string, v double, record string")
    measured = pr.measured_cells(ev, entity="id", assay="assay", endpoint="endpoint", variant="variant", value="v", record="record", relation="relation")
    pairs = pr.shared_evidence(pr.position_pairs(df, core=["core"], positions=POSITIONS, entity="id", value="v"), measured)
    patterns = stress.pattern_members(df, core=["core"], positions=POSITIONS, entity="id")
    got = stress.missing_corners(pairs, patterns, measured, df, core=["core"], positions=POSITIONS, entity="id").collect()
    cells = {}
    for e, assay, endpoint, variant, *_ in evidence:
        cells.setdefault(e, set()).add((assay, endpoint, variant))
    want = plain(series, cells)
    assert {(r.core, r.position, r.context, r.proposed_fragment, r.assay, r.endpoint, r.variant): (r.supporting_ids, r.existing_id) for r in got} == want
    assert len(got) == len(want) > 20 and any(fourth for _, fourth in want.values())


def test_a_pattern_has_one_holder_or_several(spark):
    df = spark.createDataFrame([(1, "e1", "a"), (1, "e1", "a"), (1, "e2", "b"), (1, "e3", "b"), (1, None, "c")], "core int, id string, R1 string")
    got = stress.pattern_members(df.withColumn("R2", df.R1), core=["core"], positions=["R1", "R2"], entity="id").where("position = 'R1'").collect()
    assert {r.fragment: (r.holders, r.id) for r in got} == {"a": (1, "e1"), "b": (2, "e2"), "c": (0, None)}

"""Pairs in a context: calm and crowded contexts, and assays that travel with the members."""

from __future__ import annotations

import pytest

from measurelens.operators import pairs as pr


@pytest.mark.parametrize("block", [2000, 3])
def test_pairs_and_shared_assays_equal_a_plain_loop(spark, monkeypatch, block):
    monkeypatch.setattr(pr, "_BLOCK", block)
    members = [(c, f"m{i}", f"f{i % 3}", float(i)) for c, n in ((1, 8), (2, 2), (3, 1), (None, 3)) for i in range(n)]
    evidence = [(f"m{i}", a) for i in range(8) for a in (f"a{i // 2}", "a9" if i == 0 else f"b{i}", None)]
    df = spark.createDataFrame([*members, members[0]], "c int, id string, f string, v double")
    lists = pr.assay_lists(spark.createDataFrame(evidence, "id string, a string"), entity="id", assay="a")
    got = pr.matched_pairs(df, context="c", entity="id", fragment="f", value="v", assays=lists).collect()
    of = {i: {a for j, a in evidence if j == i and a} for i, _ in evidence}
    want = {(c, x, y): bool(of[x] & of[y]) for c, x, f, _ in members for d, y, g, _ in members if c is not None and c == d and x < y and f != g}
    assert {(r.context, r.id_a, r.id_b): r.shared for r in got} == want and len(got) == len(want)
    plans = pr.matched_pairs(df, context="c", entity="id", fragment="f", value="v")
    by_flag = {r.assay_context: r.supporting_pairs for r in pr.transformation_summary(plans, spark.createDataFrame(evidence, "id string, a string"), entity="id", assay="a").groupBy("assay_context").sum("supporting_pairs").toDF("assay_context", "supporting_pairs").collect()}
    assert by_flag == {"shared assay": sum(want.values()), "unmatched or unknown": len(want) - sum(want.values())}

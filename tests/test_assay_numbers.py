"""Assays go by small numbers, and crowded contexts are found before members are made."""

from __future__ import annotations

import pytest

from measurelens.operators import pairs as pr


def test_lists_hold_small_numbers_of_their_own(spark):
    evidence = [(f"m{i % 7}", f"a{i % 11}") for i in range(300)] + [("m1", None), ("m8", "a0")]
    got = pr.assay_lists(spark.createDataFrame(evidence, "id string, a string").repartition(4), entity="id", assay="a")
    assert dict(got.dtypes)["assays"] == "array<int>"
    lists = {r.id: set(r.assays) for r in got.collect()}
    want = {i: {a for j, a in evidence if j == i and a} for i, _ in evidence}
    assert {i: len(s) for i, s in lists.items()} == {i: len(s) for i, s in want.items()}
    assert all(bool(lists[i] & lists[j]) == bool(want[i] & want[j]) for i in want for j in want)
    assert pr.assay_lists(spark.createDataFrame([], "id string, a string"), entity="id", assay="a").count() == 0


@pytest.mark.parametrize("block", [2000, 2])
def test_copies_of_members_change_nothing(spark, monkeypatch, block):
    monkeypatch.setattr(pr, "_BLOCK", block)
    members = [(c, f"m{i}", f"f{i % 3}", float(i)) for c in (1, 2) for i in range(6)]
    args = dict(context="c", entity="id", fragment="f", value="v")
    count = lambda rows: sorted(map(tuple, pr.matched_pairs(spark.createDataFrame(rows, "c int, id string, f string, v double"), **args).collect()))
    assert count(members) == count(members * 3) != []

"""Greedy disjoint pairs by joins against the scan in order."""

from __future__ import annotations

import random

import pytest

from measurelens.operators import matching


def scan(rows):
    """{cell: number of pairs} by going through the sorted pairs of every cell."""
    out, used = {}, set()
    for cell, f, t in sorted({r for r in rows if None not in r[1:]}, key=lambda r: (str(r[0]), r[1], r[2])):
        out.setdefault(cell, 0)
        if (cell, f) not in used and (cell, t) not in used:
            used |= {(cell, f), (cell, t)}
            out[cell] += 1
    return out


def cells():
    rng = random.Random(7)
    name = lambda s, i: f"{s}{i:03d}"
    rows = [("sparse", name("a", rng.randint(0, 40)), name("b", rng.randint(0, 40))) for _ in range(90)]
    rows += [("dense", name("a", i), name("b", j)) for i in range(14) for j in range(17) if rng.random() < 0.9]
    rows += [("complete", name("a", i), name("b", j)) for i in range(20) for j in range(13)]
    # groups that share no id, each complete, beside one that is not
    rows += [("groups", name(f"a{g}", i), name(f"b{g}", j)) for g in range(4) for i in range(5 + g) for j in range(9 - g)]
    rows += [("groups", "x", "y"), ("groups", "x", "z"), ("groups", "w", "y")]
    # a path whose pairs free each other one after another
    rows += [("path", name("p", i), name("p", i + 1)) for i in range(40)]
    # ids on both sides
    rows += [("mixed", name("m", i), name("m", j)) for i in range(12) for j in range(i + 1, 12)]
    rows += [("star", "s", name("l", i)) for i in range(60)] + [(None, "a", "b"), (None, "a", "c"), ("tiny", "a", "b")]
    rows += [("null", None, "b"), ("null", "a", None), ("null", "a", "b")]
    return rows + rng.sample(rows, 100)


@pytest.mark.parametrize("few", [512, 20, 1])
def test_disjoint_pairs_equal_the_scan(spark, monkeypatch, few):
    """By folds alone, by both ways, and by rounds of joins alone."""
    monkeypatch.setattr(matching, "FEW", few)
    rows = cells()
    if few == 1:
        rows = [r for r in rows if r[0] != "path"]  # forty rounds take long
    df = spark.createDataFrame(rows, "cell string, f string, t string").repartition(5)
    got = {r.cell: r.taken for r in matching.disjoint_pairs(df, ["cell"], "f", "t").collect()}
    assert got == scan(rows)


def test_cells_of_several_columns(spark):
    """Nulls in different columns are different cells."""
    rows = [(None, "a", 1, 2), ("a", None, 1, 2), ("a", None, 1, 3), ("a", "a", 3, 2)]
    df = spark.createDataFrame(rows, "x string, y string, f long, t long")
    got = sorted(map(tuple, matching.disjoint_pairs(df, ["x", "y"], "f", "t").collect()), key=repr)
    assert got == sorted([(None, "a", 1), ("a", None, 1), ("a", "a", 1)], key=repr)
    assert matching.disjoint_pairs(df.where("false"), ["x", "y"], "f", "t").count() == 0


def test_complete_groups_need_no_rounds(spark, monkeypatch):
    """A crowded cell whose pairs are all there is counted, however many rounds a scan by minima would take."""
    monkeypatch.setattr(matching, "FEW", 10)
    monkeypatch.setattr(matching, "_round", lambda edges: pytest.fail("a round was needed"))
    rows = [("c", f"a{i:03d}", f"b{j:03d}") for i in range(60) for j in range(80)] + [("d", f"a{g}{i}", f"b{g}{j}") for g in range(5) for i in range(4) for j in range(g + 3)]
    df = spark.createDataFrame(rows, "cell string, f string, t string")
    assert {r.cell: r.taken for r in matching.disjoint_pairs(df, ["cell"], "f", "t").collect()} == {"c": 60, "d": 3 + 4 + 4 + 4 + 4}

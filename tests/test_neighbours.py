"""Nearest neighbours and their models against all distances."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from measurelens.operators import models, neighbours


def brute(queries, rows, k):
    """{query: [(distance, id)]}; ties go to the smaller id."""
    return {q: sorted((float(np.sqrt(((np.array(x) - np.array(y)) ** 2).sum())), i) for i, y, _ in rows)[:k] for q, x in queries}


def frames(spark, queries, rows):
    q = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in queries], "q long, x array<double>").repartition(3)
    r = spark.createDataFrame([(i, [float(v) for v in x], float(v)) for i, x, v in rows], "id long, x array<double>, v double").repartition(3)
    return q, r


def found_by(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["_q"], []).append((r.place, r.distance, r["_id"]))
    return {q: [(d, i) for _, d, i in sorted(v)] for q, v in out.items()}


def same(got, want):
    assert set(got) == set(want)
    for q in want:
        assert [i for _, i in got[q]] == [i for _, i in want[q]], q
        assert [d for d, _ in got[q]] == pytest.approx([d for d, _ in want[q]], abs=1e-9)


def clustered(n, seed, wide=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, wide)) * 20
    return centres[rng.integers(0, 12, n)] + rng.normal(size=(n, wide))


def test_nearest_rows_with_ties_and_a_hot_vector(spark, monkeypatch):
    """A third of the rows are one vector: its cell is divided into blocks, and ties go to the smaller id."""
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    x = clustered(600, 1).round(1)
    x[:200] = x[0]
    rows = [(i, v, i % 5) for i, v in enumerate(x)]
    asked = [(1000 + i, v) for i, v in enumerate(clustered(150, 2).round(1))] + [(2000, x[0]), (2001, x[300])]
    asked += [(3000 + i, x[0]) for i in range(130)]  # a crowd of equal queries
    q, r = frames(spark, asked, rows)
    got = neighbours.nearest(q, r, query="q", row="id", array="x", value="v", width=6, k=4)
    same(found_by(got), brute(asked, rows, 4))
    assert {i for d, i in found_by(got)[2000] if d == 0} == {0, 1, 2, 3}


def test_few_rows_and_no_rows(spark):
    rows = [(1, [0.0, 0.0], 5.0), (2, [3.0, 4.0], 7.0)]
    q, r = frames(spark, [(9, [0.0, 0.0]), (8, [3.0, 3.0])], rows)
    got = neighbours.nearest(q, r, query="q", row="id", array="x", value="v", width=2, k=4)
    same(found_by(got), {9: [(0.0, 1), (5.0, 2)], 8: [(1.0, 2), (np.sqrt(18), 1)]})
    assert neighbours.nearest(q, r.where("false"), query="q", row="id", array="x", value="v", width=2).count() == 0
    assert neighbours.nearest(q.where("false"), r, query="q", row="id", array="x", value="v", width=2).count() == 0
    bad = r.withColumn("x", F.when(F.col("id") == 1, F.col("x")))
    with pytest.raises(Exception, match="finite numbers"):
        neighbours.nearest(q, bad, query="q", row="id", array="x", value="v", width=2).collect()


def test_bounds_rule_out_cells():
    """On clustered rows most cells are never visited, and none that holds a neighbour is left out."""
    rng = np.random.default_rng(5)
    rows, asked = clustered(2000, 5), clustered(200, 6)
    cells = neighbours.Cells(rows[rng.permutation(2000)[:45]])
    home, away = cells.home(rows)
    for c in range(45):
        mine = away[home == c]
        cells.count[c], cells.low[c], cells.high[c] = len(mine), mine.min(initial=np.inf), mine.max(initial=0)
    distance = np.sqrt(neighbours.squares(asked, rows))
    bound = np.sort(distance, axis=1)[:, 3]
    seen = np.zeros((200, 45), bool)
    for step in range(3):
        q, c = cells.visits(asked, bound if step else np.full(200, np.inf), 4, step)
        assert not seen[q, c].any()  # no cell is visited twice
        seen[q, c] = True
    nearest = home[np.argsort(distance, axis=1)[:, :4]]
    assert seen[np.arange(200)[:, None], nearest].all()
    compared = (seen * cells.count[None, :]).sum() / 200
    assert compared < 400  # of 2,000 rows per query


def test_votes_and_averages(spark):
    rows = [("a", 1, 2.0, 0.0), ("a", 2, 1.0, 3.0), ("a", 3, 2.0, 4.0), ("a", 4, 1.0, 5.0), ("b", 1, 3.0, 1.0), ("b", 2, 6.0, 2.0), ("c", 1, 1.0, 0.0), ("c", 2, 5.0, 0.0), ("c", 3, 9.0, 1.0)]
    found = spark.createDataFrame(rows, "_q string, _id long, _v double, distance double")
    assert {r["_q"]: r.prediction for r in neighbours.vote(found).collect()} == {"a": 1.0, "b": 3.0, "c": 1.0}
    assert {r["_q"]: r.prediction for r in neighbours.average(found).collect()} == pytest.approx({"a": 2.0, "b": (3 / 1 + 6 / 2) / (1 + 0.5), "c": 3.0})
    assert {r["_q"]: r.prediction for r in neighbours.average(found, "uniform").collect()} == pytest.approx({"a": 1.5, "b": 4.5, "c": 5.0})


def test_neighbour_models_are_estimators(spark):
    x = clustered(120, 9, wide=3)
    label = np.arange(120) % 3
    rows = [(i, [float(v) for v in a], float(g)) for i, (a, g) in enumerate(zip(x, label))]
    df = spark.createDataFrame(rows, "id long, x array<double>, y double").withColumn("features", array_to_vector("x"))
    train, test = df.where("id % 4 <> 0"), df.where("id % 4 = 0")
    test = test.unionByName(test.where("id = 4"))  # repeated rows stay
    near = brute([(r[0], r[1]) for r in rows if r[0] % 4 == 0], [r for r in rows if r[0] % 4], 4)
    for name, registry in (("nearest_neighbors", models.CLASSIFIERS), ("nearest_neighbors", models.REGRESSORS)):
        model = registry[name](42).setLabelCol("y").setRowCol("id").fit(train)
        got = model.transform(test).select("id", "y", "prediction").collect()
        assert len(got) == 31
        for r in got:
            values = [label[i] for _, i in near[r.id]]
            if registry is models.CLASSIFIERS:
                assert r.prediction == min(set(values), key=lambda v: (-values.count(v), v))
            else:
                assert r.prediction == pytest.approx(np.average(values, weights=[1 / d for d, _ in near[r.id]]))
    with pytest.raises(ValueError, match="no rows"):
        models.CLASSIFIERS["nearest_neighbors"](1).setLabelCol("y").fit(train.where("false"))

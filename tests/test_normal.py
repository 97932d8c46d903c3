"""Fits from sums of products against explicit refits over rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from measurelens.operators import metrics, normal, splits
from measurelens.operators.common import settle


def ridge(x, y, penalty):
    mx, my = x.mean(0), y.mean()
    b = np.linalg.solve((x - mx).T @ (x - mx) + penalty * np.eye(x.shape[1]), (x - mx).T @ (y - my))
    return lambda z: my + (z - mx) @ b


def table(spark, x, y, *columns, names=""):
    rows = [(i, [float(v) for v in a], float(b), *[c[i] for c in columns]) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, f"id long, x array<double>, y double{names}").repartition(4)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(12)
    x = rng.normal(size=(60, 5)) + 1000  # a large offset must not cost digits
    return x, 6 + x[:, 1] + 0.4 * x[:, 2] + rng.normal(size=60) * 0.3


@pytest.mark.parametrize("penalty", [0.0, 10.0])
def test_leave_one_out_equals_n_refits(spark, data, penalty):
    x, y = data
    got = normal.leave_one_out(table(spark, x, y), array="x", target="y", width=5, penalty=penalty)
    assert got.columns == ["id", "x", "y", "loo_prediction", "leverage"]
    rows = sorted(got.collect())
    want = [ridge(np.delete(x, i, 0), np.delete(y, i), penalty)(x[i]) for i in range(60)]
    assert np.allclose([r.loo_prediction for r in rows], want, atol=1e-7)
    q2 = metrics.pooled_q2(got, "y", "loo_prediction").head().q2
    assert q2 == pytest.approx(1 - ((y - want) ** 2).sum() / ((y - y.mean()) ** 2).sum(), abs=1e-9)


def test_leave_one_out_where_a_row_is_alone(spark):
    """The only row with a feature has leverage one without a penalty, hence no prediction."""
    x = [[0.0], [0.0], [0.0], [1.0]]
    rows = {r.id: r for r in normal.leave_one_out(table(spark, x, [1, 2, 3, 9]), array="x", target="y", width=1, penalty=0.0).collect()}
    assert rows[3].loo_prediction is None and rows[3].leverage == pytest.approx(1)
    assert rows[0].loo_prediction == pytest.approx(2.5)
    with pytest.raises(ValueError, match="bypass"):
        normal.leave_one_out(table(spark, x, [1, 2, 3, 9]), array="x", target="y", width=1, split="scaffold")
    empty = normal.leave_one_out(table(spark, x, [1, 2, 3, 9]).where("false"), array="x", target="y", width=1)
    assert empty.count() == 0 and "leverage" in empty.columns


def test_permutations_equal_explicit_refits(spark, data):
    x, y = data
    fold = [i % 3 for i in range(60)]
    df = table(spark, x, y, fold, names=", fold int")
    observed, scrambled = normal.permutation_refits(df, row="id", array="x", target="y", fold="fold", width=5, penalty=1.0, repeats=25)
    dealt = metrics.permuted_labels(df.select("id", "y"), row="id", value="y", repeats=25).collect()
    fold = np.array(fold)

    def q2(t):
        error = sum(((t[fold == f] - ridge(x[fold != f], t[fold != f], 1.0)(x[fold == f])) ** 2).sum() for f in range(3))
        return 1 - error / ((t - t.mean()) ** 2).sum()

    assert observed == pytest.approx(q2(y), abs=1e-8)
    for rep in range(1, 26):
        t = np.array([r.y for r in sorted((r for r in dealt if r.rep == rep), key=lambda r: r.id)])
        assert sorted(t) == sorted(y)
        assert scrambled[rep - 1] == pytest.approx(q2(t), abs=1e-8)


def test_permutation_test_with_a_known_answer(spark, data):
    x, y = data
    fold = [i % 3 for i in range(60)]
    keep = dict(row="id", array="x", target="y", fold="fold", width=5, penalty=1.0, repeats=99)
    strong = normal.permutation_test(table(spark, x, y, fold, names=", fold int"), **keep).head()
    assert strong.p_value == pytest.approx(0.01) and strong.passed and strong.observed > 0.8 > strong.best_permuted
    noise = np.random.default_rng(1).normal(size=60)
    weak = normal.permutation_test(table(spark, x, noise, fold, names=", fold int"), **keep).head()
    assert weak.p_value > 0.05 and not weak.passed
    flat = normal.permutation_test(table(spark, x, np.ones(60), fold, names=", fold int"), **keep).head()
    assert np.isnan(flat.observed)


def explicit_nested(x, y, test, outer, inner, penalties, k, inner_k):
    """The same plan by refitting rows."""

    def choose(fit, cells):
        scores = [np.mean([np.sqrt(((y[c] - ridge(x[fit & ~c], y[fit & ~c], a)(x[c])) ** 2).mean()) for c in cells]) for a in penalties]
        return penalties[int(np.argmin(scores))], min(scores)

    def line(stage, fit, held, cells):
        a, error = choose(fit, cells)
        e = y[held] - ridge(x[fit], y[fit], a)(x[held])
        return stage, a, error, int(fit.sum()), int(held.sum()), np.sqrt((e**2).mean()), 1 - (e**2).sum() / ((y[held] - y[fit].mean()) ** 2).sum()

    out = []
    for f in range(k):
        fit = ~test & (outer != f)
        out.append(line(f"outer {f}", fit, ~test & (outer == f), [fit & (inner == g) for g in range(inner_k)]))
    return out + [line("held out", ~test, test, [~test & (outer == f) for f in range(k)])]


def nested_frame(spark, x, y, groups):
    df = table(spark, x, y, groups, ["s"] * len(y), names=", grp string, label string")
    return settle(splits.nested_plan(df, group="grp", label="label", test_fraction=0.2, k=3, inner_k=2))


def test_nested_selection_equals_explicit_refits(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 12))
    y = x[:, 0] + rng.normal(size=90)
    plan = nested_frame(spark, x, y, [f"g{i // 3}" for i in range(90)])
    rows = sorted(plan.select("id", "grp", "is_test", "outer_fold", "inner_fold").collect())
    seen = {}
    for r in rows:  # no group is divided at any level
        assert seen.setdefault(r.grp, r[2:]) == r[2:]
    cols = [np.array([-1 if r[c] is None else r[c] for r in rows]) for c in ("is_test", "outer_fold", "inner_fold")]
    penalties = [0.01, 1.0, 30.0, 1000.0]
    got = normal.nested_selection(plan, array="x", target="y", width=12, penalties=penalties, k=3, inner_k=2).collect()
    want = explicit_nested(x, y, cols[0].astype(bool), cols[1], cols[2], penalties, 3, 2)
    assert len(got) == len(want) == 4
    for g, w in zip(got, want):
        assert g.stage == w[0] and g.penalty == w[1] and (g.fit_rows, g.held_rows) == w[3:5]
        assert [g.inner_rmse, g.rmse, g.q2] == pytest.approx([w[2], w[5], w[6]], abs=1e-8)


def test_no_fold_is_in_its_own_statistics(spark):
    """Wild targets in one outer fold change its score, but neither the choice nor the fit made for it."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(90, 4))
    y = x[:, 0] + rng.normal(size=90)
    plan = nested_frame(spark, x, y, [f"g{i}" for i in range(90)])
    settings = dict(array="x", target="y", width=4, penalties=[0.1, 10.0, 1000.0], k=3, inner_k=2)
    before = {r.stage: r for r in normal.nested_selection(plan, **settings).collect()}
    for stage, hit in (("outer 1", F.col("outer_fold") == 1), ("held out", F.col("is_test"))):
        wild = plan.withColumn("y", F.when(hit, F.col("y") * 1e3 + 77).otherwise(F.col("y")))
        after = {r.stage: r for r in normal.nested_selection(wild, **settings).collect()}
        assert (after[stage].penalty, after[stage].fit_rows) == (before[stage].penalty, before[stage].fit_rows)
        assert after[stage].inner_rmse == pytest.approx(before[stage].inner_rmse)
        assert after[stage].rmse > 100 * before[stage].rmse
    others = {s for s in before if s != "held out"}
    assert all(after[s].rmse == pytest.approx(before[s].rmse) for s in others)


def test_refused_inputs(spark, data):
    x, y = data
    df = table(spark, x, y, [i % 3 for i in range(60)], names=", fold int")
    keep = dict(row="id", array="x", target="y", fold="fold", width=5, repeats=3)
    for bad in (df.withColumn("y", F.when(F.col("id") != 4, F.col("y"))), df.withColumn("x", F.when(F.col("id") != 4, F.col("x"))), df.withColumn("y", F.when(F.col("id") == 4, float("nan")).otherwise(F.col("y")))):
        with pytest.raises(Exception, match="finite numbers"):
            normal.permutation_test(bad, **keep)
    with pytest.raises(Exception, match="finite numbers"):
        normal.permutation_test(df, **{**keep, "width": 4})
    with pytest.raises(ValueError, match="bound"):
        normal.moments(df, array="x", responses="x", cell="fold", width=normal.MAX_WIDTH + 1)
    small = nested_frame(spark, x[:12], y[:12], [f"g{i}" for i in range(12)])
    with pytest.raises(ValueError, match="fewer than 15"):
        normal.nested_selection(small, array="x", target="y", width=5, penalties=[1.0], k=3, inner_k=2)

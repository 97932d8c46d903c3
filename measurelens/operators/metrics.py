"""Scores of classifiers and regressors from counts and running totals."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from measurelens.functions.scalar import THREE_FOLD, hash_long, hash_unit, similarity_bin
from measurelens.functions.stats import ratio
from measurelens.operators.common import settle, stack_rows
from measurelens.operators.ordered import average_ranks, prefix_sums, quantiles, usable


def confusion(df: DataFrame, truth: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """(truth, predicted, n) in long form."""
    return df.groupBy(*by, F.col(truth).cast("string").alias("actual"), F.col(predicted).cast("string").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, truth: str, predicted: str, labels: Sequence[str]) -> DataFrame:
    """Wide matrix with one column per label."""
    return confusion(df, truth, predicted).groupBy("actual").agg(
        *[F.coalesce(F.sum(F.when(F.col("predicted") == label, F.col("n"))), F.lit(0)).alias(f"predicted_{label}") for label in labels]
    )


def class_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Support, prevalence, precision, recall and F1 per class; zero divisions give 0."""
    cells = confusion(df, truth, predicted)
    sides = stack_rows(
        cells,
        [
            {"label": F.col("actual"), "support": F.col("n"), "called": F.lit(0).cast("long"), "hit": F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)},
            {"label": F.col("predicted"), "support": F.lit(0).cast("long"), "called": F.col("n"), "hit": F.lit(0).cast("long")},
        ],
    )
    one = sides.groupBy("label").agg(F.sum("support").alias("support"), F.sum("called").alias("called"), F.sum("hit").alias("hit"))
    total = cells.agg(F.sum("n").alias("total"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    precision, recall = zero(ratio(F.col("hit"), F.col("called"))), zero(ratio(F.col("hit"), F.col("support")))
    return one.join(F.broadcast(total)).select(
        "label",
        "support",
        ratio(F.col("support"), F.col("total")).alias("prevalence"),
        precision.alias("precision"),
        recall.alias("recall"),
        zero(ratio(2 * F.col("hit"), F.col("called") + F.col("support"))).alias("f1"),
    )


def accuracy_scores(df: DataFrame, truth: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, balanced accuracy and the multiclass correlation coefficient."""
    by = list(by)
    cells = confusion(df, truth, predicted, by)
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    sides = stack_rows(
        cells,
        [
            {**{b: F.col(b) for b in by}, "label": F.col("actual"), "t": F.col("n"), "p": F.lit(0).cast("long"), "h": hit},
            {**{b: F.col(b) for b in by}, "label": F.col("predicted"), "t": F.lit(0).cast("long"), "p": F.col("n"), "h": F.lit(0).cast("long")},
        ],
    )
    per = sides.groupBy(*by, "label").agg(F.sum("t").cast("double").alias("t"), F.sum("p").cast("double").alias("p"), F.sum("h").cast("double").alias("h"))
    sums = per.groupBy(*by).agg(
        F.sum("t").alias("s"), F.sum("h").alias("c"), F.sum(F.col("t") * F.col("p")).alias("tp"), F.sum(F.col("t") * F.col("t")).alias("tt"), F.sum(F.col("p") * F.col("p")).alias("pp"),
        F.avg(F.when(F.col("t") > 0, F.col("h") / F.col("t"))).alias("balanced_accuracy"),
    )
    s = F.col("s")
    spread = F.sqrt((s * s - F.col("pp")) * (s * s - F.col("tt")))
    return sums.select(*by, ratio(F.col("c"), s).alias("accuracy"), "balanced_accuracy", F.coalesce(ratio(F.col("c") * s - F.col("tp"), spread), F.lit(0.0)).alias("mcc"))


def ranking_cells(scores: DataFrame, *, label: str, positive: str, score: str) -> DataFrame:
    """Running counts by descending score per label: one row per distinct score."""
    pos = F.when(F.col(positive), 1).otherwise(0).cast("long")
    return prefix_sums(scores.withColumn("_s", -F.col(score)), "_s", {"pos": pos, "all": F.lit(1).cast("long")}, [label])


def ranking_scores(scores: DataFrame, *, label: str, positive: str, score: str) -> DataFrame:
    """Area under the ROC curve and average precision per label, ties handled.

    A label without both kinds of rows is not evaluable and gives nulls.
    """
    cells = ranking_cells(scores, label=label, positive=positive, score=score)
    pos, neg = F.col("pos"), F.col("all") - F.col("pos")
    seen_pos, seen_all = F.col("pos_before") + pos, F.col("all_before") + F.col("all")
    neg_after = (F.col("all_total") - F.col("pos_total")) - (F.col("all_before") - F.col("pos_before")) - neg
    sums = cells.groupBy(label).agg(
        F.sum(pos * neg_after + pos * neg / 2.0).alias("wins"),
        F.sum(ratio(pos, F.col("pos_total")) * ratio(seen_pos, seen_all)).alias("ap"),
        F.max("pos_total").alias("p"),
        (F.max("all_total") - F.max("pos_total")).alias("n"),
    )
    evaluable = (F.col("p") > 0) & (F.col("n") > 0)
    return sums.select(label, F.when(evaluable, ratio(F.col("wins"), F.col("p") * F.col("n"))).alias("roc_auc"), F.when(evaluable, F.col("ap")).alias("average_precision"))


def macro_ranking(per_label: DataFrame) -> DataFrame:
    return per_label.agg(F.avg("roc_auc").alias("roc_auc_ovr"), F.avg("average_precision").alias("pr_auc_ovr"), F.count("roc_auc").alias("auc_classes"))


def curve_points(scores: DataFrame, *, label: str, positive: str, score: str) -> DataFrame:
    """ROC and precision-recall points per label, one per distinct score."""
    cells = ranking_cells(scores, label=label, positive=positive, score=score)
    tp = F.col("pos_before") + F.col("pos")
    called = F.col("all_before") + F.col("all")
    return cells.select(
        label,
        (-F.col("v")).alias("threshold"),
        ratio(called - tp, F.col("all_total") - F.col("pos_total")).alias("false_positive_rate"),
        ratio(tp, F.col("pos_total")).alias("recall"),
        ratio(tp, called).alias("precision"),
    )


def regression_scores(df: DataFrame, truth: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """R², RMSE, MAE and Spearman correlation per group."""
    by = list(by)
    y, e = F.col(truth), F.col(truth) - F.col(prediction)
    n = F.count(F.lit(1))
    base = df.where(usable(F.col(truth)) & usable(F.col(prediction))).groupBy(*by).agg(
        n.alias("n"),
        F.when(n >= 2, 1 - ratio(F.sum(e * e), F.var_pop(y) * n)).alias("r2"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
    )
    rho = spearman(df, truth, prediction, by)
    return base.join(rho, by, "left") if by else base.join(F.broadcast(rho))


def spearman(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Correlation of average ranks; null when a side is constant."""
    by = list(by)
    rows = df.where(usable(F.col(a)) & usable(F.col(b))).select(*by, (F.col(a).cast("double") + 0.0).alias("_a"), (F.col(b).cast("double") + 0.0).alias("_b"))
    cells = rows.groupBy(*by, "_a", "_b").agg(F.count(F.lit(1)).cast("double").alias("c"))
    for side in ("_a", "_b"):
        ranks = average_ranks(rows, side, by).select(*by, F.col("v").alias(side), F.col("rank").alias(f"r{side}"))
        cells = cells.join(ranks, [*by, side])
    c, x, y = F.col("c"), F.col("r_a"), F.col("r_b")
    sums = cells.groupBy(*by).agg(F.sum(c).alias("n"), F.sum(c * x).alias("x"), F.sum(c * y).alias("y"), F.sum(c * x * x).alias("xx"), F.sum(c * y * y).alias("yy"), F.sum(c * x * y).alias("xy"))
    num = F.col("n") * F.col("xy") - F.col("x") * F.col("y")
    den = F.sqrt((F.col("n") * F.col("xx") - F.col("x") * F.col("x")) * (F.col("n") * F.col("yy") - F.col("y") * F.col("y")))
    return sums.select(*by, ratio(num, den).alias("spearman"))


def regression_summary(df: DataFrame, truth: str, prediction: str, baseline: str) -> DataFrame:
    """The report's list of regression measures, one per row."""
    e = F.col(truth) - F.col(prediction)
    err = df.withColumn("_abs", F.abs(e))
    one = regression_scores(df, truth, prediction)
    more = err.agg(
        F.avg((F.col("_abs") <= THREE_FOLD).cast("double")).alias("w3"), F.avg((F.col("_abs") <= 1).cast("double")).alias("w10"), F.avg(e).alias("bias"),
        F.sqrt(F.avg((F.col(truth) - F.col(baseline)) * (F.col(truth) - F.col(baseline)))).alias("base"),
    )
    mid = quantiles(err, [], "_abs", {"mid": 0.5})
    row = one.join(F.broadcast(more)).join(F.broadcast(mid))
    items = [
        ("Test R²", F.col("r2")),
        ("Test RMSE", F.col("rmse")),
        ("Test MAE", F.col("mae")),
        ("Test Spearman", F.col("spearman")),
        ("Median absolute error", F.col("mid")),
        ("Typical fold error", F.pow(F.lit(10.0), F.col("mid"))),
        ("Within 3-fold", F.col("w3")),
        ("Within 10-fold", F.col("w10")),
        ("Mean residual", F.col("bias")),
        ("Training-mean baseline RMSE", F.col("base")),
        ("RMSE gain versus baseline", F.col("base") - F.col("rmse")),
    ]
    return stack_rows(row, [{"metric": F.lit(name), "value": value} for name, value in items])


def novelty_table(df: DataFrame, similarity: str, absolute_error: str) -> DataFrame:
    e = F.col(absolute_error)
    rows = df.withColumn("nearest_similarity", similarity_bin(similarity)).where(F.col("nearest_similarity").isNotNull())
    return rows.groupBy("nearest_similarity").agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("mae"), F.avg((e <= THREE_FOLD).cast("double")).alias("within_3_fold"), F.avg((e <= 1).cast("double")).alias("within_10_fold")
    )


def subset_performance(df: DataFrame, flag: str, truth: str, prediction: str, actual: str, predicted: str) -> DataFrame:
    """Scores of flagged rows and of the others; both rows are always there."""
    scores = regression_scores(df, truth, prediction, [flag])
    hits = df.groupBy(flag).agg(F.avg((F.col(actual) == F.col(predicted)).cast("double")).alias("accuracy"))
    sides = df.sparkSession.range(2).select((F.col("id") == 1).alias(flag))
    return sides.join(scores.join(hits, flag), flag, "left").fillna(0, ["n"])


def pooled_q2(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    """1 - PRESS/SST; SST runs over valid rows about the mean of all truths."""
    mean = df.agg(F.avg(truth).alias("_mean"))
    ok = usable(F.col(prediction))
    e, d = F.col(truth) - F.col(prediction), F.col(truth) - F.col("_mean")
    rows = df.join(F.broadcast(mean)).where(ok)
    return rows.agg((1 - ratio(F.sum(e * e), F.sum(d * d))).alias("q2"))


def calibration(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    """Origin-regression diagnostics and their pass rule, from sums of products."""
    y, p = F.col(truth), F.col(prediction)
    s = df.agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(y * p).alias("yp"), F.sum(y * y).alias("yy"), F.sum(p * p).alias("pp"), F.corr(y, p).alias("r"),
        F.var_pop(y).alias("vy"), F.var_pop(p).alias("vp"),
    )
    fit = s.select("*", ratio(F.col("yp"), F.col("pp")).alias("k"), ratio(F.col("yp"), F.col("yy")).alias("kp"))
    press = lambda k, a, b: F.col(a) - 2 * F.col(k) * F.col("yp") + F.col(k) * F.col(k) * F.col(b)
    fit = fit.select(
        "*", (F.col("r") * F.col("r")).alias("r2"), (1 - ratio(press("k", "yy", "pp"), F.col("n") * F.col("vy"))).alias("r0"), (1 - ratio(press("kp", "pp", "yy"), F.col("n") * F.col("vp"))).alias("r0p")
    )
    r2 = F.col("r2")
    one = (ratio(r2 - F.col("r0"), r2) < 0.1) & F.col("k").between(0.85, 1.15)
    two = (ratio(r2 - F.col("r0p"), r2) < 0.1) & F.col("kp").between(0.85, 1.15)
    defined = (F.col("n") >= 3) & (F.col("vy") > 0) & (F.col("vp") > 0)
    keep = lambda c: F.when(defined, c)
    return fit.select(
        keep(r2).alias("pearson_r2"), keep(F.col("k")).alias("k"), keep(F.col("kp")).alias("k_prime"), keep(F.col("r0")).alias("r0_squared"), keep(F.col("r0p")).alias("r0_prime_squared"),
        F.coalesce(defined & (r2 > 0.6) & (one | two), F.lit(False)).alias("passes"),
    )


def empirical_band(errors: DataFrame, absolute_error: str, test: DataFrame, test_error: str, level: float = 0.9) -> DataFrame:
    """Half width: an observed quantile of held-out errors; coverage on the test rows."""
    width = quantiles(errors, [], absolute_error, {"half_width": level}, method="higher")
    return test.join(F.broadcast(width)).agg(F.max("half_width").alias("half_width"), F.avg((F.col(test_error) <= F.col("half_width")).cast("double")).alias("coverage"))


def fold_rollup(scores: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean and sample deviation over finite fold values."""
    aggs = []
    for m in metrics:
        clean = F.nanvl(F.col(m).cast("double"), F.lit(None).cast("double"))
        aggs += [F.avg(clean).alias(f"{m}_mean"), F.stddev_samp(clean).alias(f"{m}_sd")]
    return scores.groupBy(*by).agg(F.count(F.lit(1)).alias("folds"), *aggs)


def leak_inflation(scores: DataFrame, metric: str = "test_accuracy") -> DataFrame:
    """How much the leaky protocol flatters each algorithm."""
    pick = lambda p: F.max(F.when(F.col("protocol") == p, F.col(metric)))
    wide = scores.groupBy("algorithm").agg(pick("naive").alias("naive"), pick("leak_free").alias("leak_free"))
    return wide.where(F.col("naive").isNotNull() & F.col("leak_free").isNotNull()).withColumn("inflation", F.col("naive") - F.col("leak_free"))


def screen_metrics(df: DataFrame, *, active: str, score: str, row: str, top: float = 0.1) -> DataFrame:
    """Prevalence, ranking scores and precision in the best tenth (ties in row order).

    The tenth is found through running totals: whole score levels are taken
    until one is cut, and only that level is ordered by row.
    """
    pos = F.when(F.col(active), 1).otherwise(0).cast("long")
    scored = df.withColumn("_s", -F.col(score).cast("double") + 0.0)
    cells = prefix_sums(scored, "_s", {"pos": pos, "all": F.lit(1).cast("long")})
    size = F.greatest(F.lit(1), F.ceil(F.col("all_total") * top))
    cells = cells.withColumn("size", size)
    whole = cells.agg(
        F.max("all_total").alias("n"), F.max("pos_total").alias("n_active"), F.max("size").alias("top_n"),
        F.coalesce(F.sum(F.when(F.col("all_before") + F.col("all") <= F.col("size"), F.col("pos"))), F.lit(0)).alias("whole_hits"),
        F.max(F.when((F.col("all_before") < F.col("size")) & (F.col("all_before") + F.col("all") > F.col("size")), F.struct("v", "all_before"))).alias("cut"),
    )
    level = scored.join(F.broadcast(whole), F.col("_s") == F.col("cut.v"))
    ordered = prefix_sums(level, row, {"pos": F.when(F.col(active), 1).otherwise(0).cast("long"), "one": F.lit(1).cast("long"), "room": F.col("top_n") - F.col("cut.all_before")})
    partial = ordered.agg(F.coalesce(F.sum(F.when(F.col("one_before") < F.col("room"), F.col("pos"))), F.lit(0)).alias("cut_hits"))
    rank = ranking_scores(df.withColumn("_all", F.lit("all")), label="_all", positive=active, score=score).drop("_all")
    one = whole.join(F.broadcast(partial)).join(F.broadcast(rank))
    precision = ratio(F.col("whole_hits") + F.col("cut_hits"), F.col("top_n"))
    prevalence = ratio(F.col("n_active"), F.col("n"))
    return one.select("n", "n_active", prevalence.alias("prevalence"), "roc_auc", "average_precision", precision.alias("precision_at_top"), ratio(precision, prevalence).alias("enrichment_at_top"))


def block_sums(df: DataFrame, *, block: str, row: str, truth: str, prediction: str, baseline: str) -> DataFrame:
    """Sufficient statistics per resampling block; a row without a block is its own."""
    key = F.coalesce(F.nullif(F.trim(F.col(block).cast("string")), F.lit("")), F.concat(F.lit("__row_"), F.col(row).cast("string")))
    y, e, b = F.col(truth), F.col(truth) - F.col(prediction), F.col(truth) - F.col(baseline)
    return df.groupBy(key.alias("block")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(y).alias("y"), F.sum(y * y).alias("yy"), F.sum(e * e).alias("ee"), F.sum(F.abs(e)).alias("ae"), F.sum(b * b).alias("bb")
    )


def _measures(prefix: str = "") -> dict[str, Column]:
    c = lambda x: F.col(f"{prefix}{x}")
    sst = c("yy") - c("y") * c("y") / c("n")
    rmse = F.sqrt(c("ee") / c("n"))
    return {"R²": F.when(sst > 1e-12, 1 - c("ee") / sst), "RMSE": rmse, "MAE": c("ae") / c("n"), "RMSE gain versus baseline": F.sqrt(c("bb") / c("n")) - rmse}


# Steps of the multiplicative generator behind the block draws, modulo 2^31 - 1.
DRAW_PRIME = 2**31 - 1
DRAW_STEPS = (1664525, 1013904223, 48271, 69621, 16807)


def poisson_cuts(most: int = 12) -> list[float]:
    """P(X <= k) of a Poisson variable with mean one, for k = 0 .. most."""
    out, term, total = [], math.exp(-1.0), 0.0
    for k in range(most + 1):
        total += term
        out.append(total)
        term /= k + 1
    return out


def draw_counts(codes: np.ndarray, repeats: np.ndarray) -> np.ndarray:
    """How often each block (row) enters each repeat (column): Poisson counts with mean one.

    Whole-number steps that any engine can repeat turn a block's code and the
    number of the repeat into a draw in [0, 1).
    """
    jump, shift, one, two, three = DRAW_STEPS
    a, b = (codes % DRAW_PRIME)[:, None], (codes // DRAW_PRIME % DRAW_PRIME)[:, None]
    r = repeats[None, :]
    x = (a + r * jump + shift) % DRAW_PRIME
    x = ((x ^ (x >> 15)) * one + b) % DRAW_PRIME
    x = ((x ^ (x >> 13)) * two + a) % DRAW_PRIME
    x = ((x ^ (x >> 16)) * three + r) % DRAW_PRIME
    return np.searchsorted(poisson_cuts(), x / DRAW_PRIME, "right")


def block_bootstrap(blocks: DataFrame, *, repeats: int = 500, seed: int = 42) -> DataFrame:
    """Percentile intervals from resampling whole blocks.

    A block enters a repeat a number of times that depends on its own hash and the
    repeat alone (Poisson counts with mean one, the limit of drawing as many blocks
    with replacement).  So nothing is numbered or joined: a task adds up its blocks
    for all repeats at once and sends repeats x 6 sums.  A repeat that draws no block
    is not valid.  At least 20 repeats and 2 blocks are needed.  ``block_resample``
    draws exactly as many blocks as there are.
    """
    if repeats < 20:
        raise ValueError("a block bootstrap needs at least 20 repeats")
    sums = ["n", "y", "yy", "ee", "ae", "bb"]
    coded = blocks.select(hash_long(seed, "block", F.col("block")).alias("h"), *[F.col(s).cast("double").alias(s) for s in sums])
    names = ["rep", "blocks", *sums]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reps = np.arange(1, repeats + 1)
        total, n = np.zeros((repeats + 1, len(sums))), 0
        for batch in batches:
            for first in range(0, batch.num_rows, 4096):
                part = batch.slice(first, 4096)
                values = np.stack([part.column(i + 1).to_numpy(zero_copy_only=False) for i in range(len(sums))], axis=1)
                times = draw_counts(part.column(0).to_numpy(zero_copy_only=False), reps)
                total[0] += values.sum(0)  # repeat 0 is the sample itself
                total[1:] += times.T.astype(np.float64) @ values
                n += part.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(repeats + 1), pa.int32()), pa.array(np.full(repeats + 1, n)), *[pa.array(c) for c in total.T]], names)

    schema = ", ".join(["rep int", "blocks long", *[f"{s} double" for s in sums]])
    all_sums = coded.mapInArrow(run, schema).groupBy("rep").agg(F.sum("blocks").alias("blocks"), *[F.sum(s).alias(s) for s in sums])
    checked = F.when(F.col("blocks") >= 2, F.col("blocks")).otherwise(F.raise_error(F.lit("a block bootstrap needs at least two blocks")).cast("long"))
    all_sums = settle(all_sums.withColumn("blocks", checked)).where(F.col("n") > 0)
    return _intervals(all_sums)


def _intervals(all_sums: DataFrame) -> DataFrame:
    """Estimates from the sums of the sample (repeat 0) with their percentiles over the repeats."""
    long = stack_rows(all_sums.where("rep > 0"), [{"metric": F.lit(name), "value": value} for name, value in _measures().items()])
    spread = quantiles(long, ["metric"], "value", {"lower_95": 0.025, "upper_95": 0.975}).join(long.where(usable(F.col("value"))).groupBy("metric").agg(F.count("value").alias("valid_repeats")), "metric")
    point = stack_rows(all_sums.where("rep = 0"), [{"metric": F.lit(name), "estimate": value, "blocks": F.col("blocks")} for name, value in _measures().items()])
    return point.join(spread, "metric", "left")


# Slots whose sums one task holds, slots that draw in one task, and slots that draw at a time.
_SLOT_CELL, _DRAWERS, _DRAWN = 8192, 20_000, 4_096

# RFC 1321: the rotations of md5 by round, its constants and its start.
_MD5_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_MD5_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_MD5_START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]


def numbers_hashed(prefixes: Sequence[str], numbers: np.ndarray) -> np.ndarray:
    """The first 52 bits of the md5 of a prefix (row) and a whole number (column), as ``hash_long`` gives them.

    All numbers go through a step of md5 at once, which takes a fraction of the
    time of a call per number.  The text must fit one block of md5.
    """
    out = np.empty((len(prefixes), len(numbers)), np.int64)
    length = np.searchsorted(10 ** np.arange(1, 19), numbers, "right") + 1
    for d in np.unique(length).tolist():
        at = np.flatnonzero(length == d)
        digits = (numbers[at][:, None] // 10 ** np.arange(d - 1, -1, -1) % 10 + 48).astype(np.uint8)
        for row, prefix in zip(out, prefixes):
            head = prefix.encode()
            end = len(head) + d
            if end > 55:
                raise ValueError("the text does not fit one block of md5")
            text = np.zeros((len(at), 64), np.uint8)
            text[:, : len(head)] = np.frombuffer(head, np.uint8)
            text[:, len(head) : end] = digits
            text[:, end] = 128
            text[:, 56:58] = np.array([8 * end], "<u2").view(np.uint8)
            # words that are equal in all texts stay single numbers
            words = [text[:, 4 * j : 4 * j + 4].copy().view("<u4")[:, 0] if len(head) < 4 * j + 4 and 4 * j < end else text[0, 4 * j : 4 * j + 4].view("<u4")[0] for j in range(16)]
            row[at] = _md5_front(words, len(at))
    return out


def _md5_front(words: Sequence, n: int) -> np.ndarray:
    """The first 52 bits of the md5 of n texts of one block, given as 16 words."""
    a, b, c, e = (np.full(n, x) for x in _MD5_START)
    f, g = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, e, out=f)
            f &= b
            f ^= e
            j = i
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= e
            f ^= c
            j = (5 * i + 1) % 16
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= e
            j = (3 * i + 5) % 16
        else:
            np.invert(e, out=f)
            f |= b
            f ^= c
            j = 7 * i % 16
        if isinstance(words[j], np.ndarray):
            f += words[j]
            f += _MD5_SINES[i]
        else:
            f += np.uint32((int(words[j]) + int(_MD5_SINES[i])) & 0xFFFFFFFF)
        f += a
        turn = _MD5_TURNS[i // 16][i % 4]
        np.left_shift(f, np.uint32(turn), out=g)
        f >>= np.uint32(32 - turn)
        f |= g
        f += b
        a, e, c, b, f = e, c, b, f, a
    first, second = (a + _MD5_START[0]).byteswap(), (b + _MD5_START[1]).byteswap()
    return (first.astype(np.int64) << 20) | (second >> np.uint32(12))


def _joined(parts: Iterator[np.ndarray], least: int) -> Iterator[np.ndarray]:
    """The parts put together to at least so many numbers: their own number grows with the table, each one shrinks."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part)
        if n >= least:
            yield np.concatenate(held)
            held, n = [], 0
    if held:
        yield np.concatenate(held)


def block_resample(blocks: DataFrame, *, repeats: int = 500, seed: int = 42) -> DataFrame:
    """Percentile intervals from drawing as many blocks as there are, with replacement.

    Blocks are numbered in hash order through running totals, and every slot of
    every repeat draws a number by hash.  Tasks draw for a stretch of slots and
    send each draw in four bytes to the cell of slots it hits; there the draws are
    counted beside the sums of these slots.  At least 20 repeats and 2 blocks are
    needed.
    """
    from measurelens.operators.ordered import numbered

    if repeats < 20:
        raise ValueError("a block bootstrap needs at least 20 repeats")
    sums = ["n", "y", "yy", "ee", "ae", "bb"]
    placed = numbered(blocks, [], hash_unit(seed, "order", F.col("block")), tie=["block"])
    placed = settle(placed.select(F.col("position").alias("slot"), *[F.col(s).cast("double").alias(s) for s in sums]))
    slots, cell, wide = placed.count(), _SLOT_CELL, repeats + 1
    # numbers of 16 bits are sorted by counting
    narrow = np.uint16 if slots // cell < 1 << 16 else np.int64
    if slots < 2:
        raise ValueError("a block bootstrap needs at least two blocks")

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, _DRAWN):
                own = batch.column(0).slice(start, _DRAWN).to_numpy()
                unit = numbers_hashed([f"{seed}:{r}:" for r in range(1, wide)], own).astype(np.float64) / 2.0**52
                hit = np.floor(unit * slots).astype(np.int64)
                to, code = (hit // cell).ravel().astype(narrow), (hit % cell * wide + np.arange(1, wide)[:, None]).astype(np.uint32).ravel()
                order = np.argsort(to, kind="stable")
                to, code = to[order].astype(np.int64), code[order]
                cuts = np.flatnonzero(np.diff(to, prepend=-1))
                parts = [code[a:z].tobytes() for a, z in zip(cuts, [*cuts[1:], len(to)])]
                yield pa.RecordBatch.from_arrays([pa.array(to[cuts], pa.int64()), pa.array(parts, pa.binary())], ["cell", "draws"])

    def add(own: pa.Table, drawn: pa.Table) -> pa.Table:
        at = own.column("slot").to_numpy() % cell
        values = np.zeros((cell, len(sums)))
        values[at] = np.stack([own.column(s).to_numpy() for s in sums], axis=1)
        times = np.zeros(cell * wide, np.int64)
        for codes in _joined((np.frombuffer(part.as_buffer(), np.uint32) for part in drawn.column("draws")), len(times)):
            times += np.bincount(codes, minlength=len(times))
        times = times.reshape(cell, wide)
        times[at, 0] = 1  # repeat 0 is the sample itself
        total = times.T.astype(np.float64) @ values
        return pa.Table.from_arrays([pa.array(np.arange(wide), pa.int32()), *[pa.array(c) for c in total.T]], ["rep", *sums])

    spark = blocks.sparkSession
    drawers = spark.range(0, slots, 1, -(-slots // _DRAWERS))
    drawn = drawers.mapInArrow(draw, "cell long, draws binary").groupBy("cell")
    owned = placed.withColumn("cell", F.floor(F.col("slot") / cell)).groupBy("cell")
    partial = owned.cogroup(drawn).applyInArrow(add, ", ".join(["rep int", *[f"{s} double" for s in sums]]))
    all_sums = partial.groupBy("rep").agg(*[F.sum(s).alias(s) for s in sums])
    return _intervals(settle(all_sums.withColumn("blocks", F.lit(slots).cast("long"))))


def permutation_p(observed: DataFrame, scrambled: DataFrame, score: str) -> DataFrame:
    """(1 + number of permuted scores at least as good) / (1 + number of them)."""
    joined = scrambled.select(F.col(score).alias("_s")).join(F.broadcast(observed.select(F.col(score).alias("_o"))))
    return joined.agg(F.max("_o").alias("observed"), F.count("_s").alias("permutations"), ratio(1 + F.count_if(F.col("_s") >= F.col("_o")), 1 + F.count("_s")).alias("p_value"))


def permuted_labels(df: DataFrame, *, row: str, value: str, repeats: int, seed: int = 42) -> DataFrame:
    """Values dealt to rows in a new hash order for each repeat: (rep, row, value).

    Row ranks and value ranks are matched by number; both come from running totals.
    """
    from measurelens.operators.ordered import numbered

    reps = df.select(row, value).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    there = numbered(reps, ["rep"], hash_unit(seed, "row", F.col("rep"), F.col(row)), tie=[row]).select("rep", "position", row)
    here = numbered(reps, ["rep"], hash_unit(seed, "value", F.col("rep"), F.col(row)), tie=[row]).select("rep", "position", value)
    return there.join(here, ["rep", "position"]).select("rep", row, value)


def attribution(long: DataFrame, coefficients: DataFrame, *, entity: str, feature: str, block: str, value: str, parent: str, coefficient: str) -> DataFrame:
    """Share of each feature block in a linear prediction change against the parent."""
    joined = long.join(coefficients, feature)
    change = (F.col(value) - F.col(parent)) * F.col(coefficient)
    return joined.groupBy(entity, block).agg(F.sum(change).alias("contribution"))


def attribution_check(parts: DataFrame, predictions: DataFrame, *, entity: str, delta: str) -> DataFrame:
    """Withhold rows whose block contributions do not add up to the change."""
    total = parts.groupBy(entity).agg(F.sum("contribution").alias("_sum"))
    ok = F.abs(F.col("_sum") - F.col(delta)) <= 1e-7 + 1e-6 * F.abs(F.col(delta))
    return predictions.join(total, entity).select(entity, F.col("_sum").alias("reconstructed"), F.coalesce(ok, F.lit(False)).alias("reconstructs"))



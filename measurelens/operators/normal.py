"""Linear models from sums of products: cross-validation without refitting over rows.

One pass over the rows gives, for every cell of a partition (a fold, or an outer and
an inner fold), the sums from which ridge regression follows: counts, sums, products
of features, products with one or many responses.  They are additive, so

* a training part is the total minus the cells left out, and its fit solves one small
  system; no row is read again, and no row of a cell is in its own statistics;
* the squared error on the left-out cells follows from their sums as well;
* many responses (label permutations) share one factorisation per training part;
* leave-one-out residuals are residual / (1 - leverage), so n refits need one matrix.

Tasks send at most cells x (p + 1) x (p / 2 + responses + 1) numbers each, already
summed.  Matrices of ``MAX_WIDTH`` features at most are solved on the driver.  Values
are taken about the table's means, so that large offsets cost no digits.

The intercept is free, the penalty is that of the sum of squared coefficients.
Features and responses must be finite and of one width; anything else is an error.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from measurelens.operators.permutation import permuted_values

# Widest table whose p x p systems are solved on the driver (32 MB each).
MAX_WIDTH = 2048


def matrix(col: pa.Array, width: int) -> np.ndarray:
    """The rows of a list column as a matrix of finite numbers."""
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if col.null_count or len(flat) != len(col) * width or not np.isfinite(flat).all() or (np.diff(col.offsets.to_numpy()) != width).any():
        raise ValueError(f"features and responses need {width} finite numbers in every row")
    return flat.reshape(len(col), width)


def means(rows: DataFrame, widths: dict[str, int]) -> np.ndarray:
    """Means of every position of the named array columns, one after another, from one sum per task and position."""
    total_width = sum(widths.values())

    def run(batches):
        total, n = np.zeros(total_width), 0
        for batch in batches:
            x = np.concatenate([matrix(batch.column(i), w) for i, w in enumerate(widths.values())], axis=1)
            total, n = total + x.sum(0), n + len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total_width), pa.int32()), pa.array(total), pa.array(np.full(total_width, n))], ["i", "s", "n"])

    out = np.zeros(total_width)
    for r in rows.select(*widths).mapInArrow(run, "i int, s double, n long").groupBy("i").agg((F.sum("s") / F.sum("n")).alias("m")).collect():
        out[r.i] = r.m
    return out


@dataclass
class Sums:
    """Sums of a set of rows about fixed centres; sets add and subtract."""

    n: float
    x: np.ndarray  # p
    xx: np.ndarray  # p x p
    y: np.ndarray  # responses
    xy: np.ndarray  # p x responses
    yy: np.ndarray  # responses

    def __sub__(self, other: Sums) -> Sums:
        return Sums(*[a - b for a, b in zip(vars(self).values(), vars(other).values())])

    def __add__(self, other: Sums) -> Sums:
        return Sums(*[a + b for a, b in zip(vars(self).values(), vars(other).values())])

    def fit(self, penalty: float) -> tuple[np.ndarray, np.ndarray]:
        """(coefficients p x responses, intercepts) about the centres."""
        mx, my = self.x / self.n, self.y / self.n
        system = self.xx - self.n * np.outer(mx, mx)
        system[np.diag_indices_from(system)] += penalty
        right = self.xy - self.n * np.outer(mx, my)
        try:
            b = np.linalg.solve(system, right)
        except np.linalg.LinAlgError:
            b = np.linalg.lstsq(system, right, rcond=None)[0]
        return b, my - mx @ b

    def squared_error(self, b: np.ndarray, intercept: np.ndarray) -> np.ndarray:
        """Sum of squared errors of these rows per response, from the sums alone."""
        error = self.yy - 2 * (b * self.xy).sum(0) - 2 * intercept * self.y + (b * (self.xx @ b)).sum(0) + 2 * intercept * (self.x @ b) + self.n * intercept**2
        return np.maximum(error, 0.0)

    def spread(self) -> np.ndarray:
        """Sum of squares about the mean per response."""
        return self.yy - self.y**2 / self.n


@dataclass
class Moments:
    cells: dict[int, Sums]
    x_centre: np.ndarray
    y_centre: np.ndarray

    def over(self, keep) -> Sums:
        """The sums of the cells for which ``keep(cell)`` holds."""
        found = [s for c, s in sorted(self.cells.items()) if keep(c)]
        if not found:
            raise ValueError("a part of the plan has no rows")
        total = found[0]
        for s in found[1:]:
            total = total + s
        return total


def moments(rows: DataFrame, *, array: str, responses: str, cell: str, width: int, n_responses: int = 1) -> Moments:
    """Sums per cell.  ``array`` has the features, ``responses`` an array of responses, ``cell`` a whole number."""
    if width > MAX_WIDTH:
        raise ValueError(f"{width} features exceed the bound of {MAX_WIDTH}")
    p, q = width, n_responses
    xc, yc = np.split(means(rows, {array: p, responses: q}), [p])
    upper = np.triu_indices(p + 1)

    def run(batches):
        cells: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            x = np.concatenate((np.ones((batch.num_rows, 1)), matrix(batch.column(1), p) - xc), axis=1)
            y = matrix(batch.column(2), q) - yc
            if batch.column(0).null_count:
                raise ValueError("every row needs a cell")
            which = batch.column(0).to_numpy(zero_copy_only=False)
            for c in np.unique(which).tolist():
                a, b = x[which == c], y[which == c]
                new = [a.T @ a, a.T @ b, (b * b).sum(0)]
                cells[c] = [s + t for s, t in zip(cells[c], new)] if c in cells else new
        for c, (xx, xy, yy) in cells.items():
            i = np.concatenate((upper[0], np.repeat(np.arange(p + 1), q), np.full(q, p + 1)))
            j = np.concatenate((upper[1], p + 1 + np.tile(np.arange(q), p + 1), p + 1 + np.arange(q)))
            v = np.concatenate((xx[upper], xy.reshape(-1), yy))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), c), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(v)], ["cell", "i", "j", "v"])

    parts = rows.select(F.col(cell).cast("int"), array, responses).mapInArrow(run, "cell int, i int, j int, v double")
    table = parts.groupBy("cell", "i", "j").agg(F.sum("v").alias("v")).toArrow()
    which, i, j, v = (table.column(c).to_numpy() for c in ("cell", "i", "j", "v"))
    cells = {}
    for c in np.unique(which).tolist():
        m = np.zeros((p + 2, p + 1 + q))
        here = which == c
        m[i[here], j[here]] = v[here]
        xx = np.triu(m[: p + 1, : p + 1])
        xx = xx + np.triu(xx, 1).T
        cells[c] = Sums(xx[0, 0], xx[0, 1:], xx[1:, 1:], m[0, p + 1 :], m[1 : p + 1, p + 1 :], m[p + 1, p + 1 :])
    return Moments(cells, xc, yc)


# -- label permutation ------------------------------------------------------------


def cross_validated_q2(found: Moments, penalty: float) -> np.ndarray:
    """q² of every response: each cell is predicted by a fit to the others."""
    total = found.over(lambda c: True)
    error = sum(s.squared_error(*(total - s).fit(penalty)) for s in found.cells.values())
    spread = total.spread()
    return np.where(spread > 0, 1 - error / np.where(spread > 0, spread, 1.0), np.nan)


def permutation_refits(df: DataFrame, *, row: str, array: str, target: str, fold: str, width: int, penalty: float = 10.0, repeats: int = 100, seed: int = 42) -> tuple[float, list[float]]:
    """(observed q², q² of each label permutation), the whole cross-validation refitted every time.

    Every permutation deals the targets to the rows in a new hash order; a row then
    carries all its values side by side, so one pass serves all refits.
    """
    if repeats < 1:
        raise ValueError("need at least one permutation")
    dealt = permuted_values(df.select(row, fold, array, target), row=row, value=target, repeats=repeats, seed=seed)
    rows = dealt.select(F.col(fold).alias("_c"), F.col(array).cast("array<double>").alias("_x"), F.concat(F.array(F.col(target).cast("double")), "permuted").alias("_y"))
    q2 = cross_validated_q2(moments(rows, array="_x", responses="_y", cell="_c", width=width, n_responses=repeats + 1), penalty)
    return float(q2[0]), [float(x) for x in q2[1:]]


def permutation_test(df: DataFrame, *, alpha: float = 0.05, **settings) -> DataFrame:
    """One row: observed q², permutations, p = (1 + those at least as good) / (1 + all), and whether p <= alpha."""
    observed, scrambled = permutation_refits(df, **settings)
    p = (1 + sum(s >= observed for s in scrambled)) / (1 + len(scrambled))
    return df.sparkSession.createDataFrame([(observed, len(scrambled), max(scrambled), p, p <= alpha)], "observed double, permutations int, best_permuted double, p_value double, passed boolean")


# -- nested selection -------------------------------------------------------------


def _inner_choice(total: Sums, cells: Sequence[Sums], penalties: Sequence[float]) -> tuple[float, float]:
    """(penalty, mean error) of the least mean root squared error over cells left out in turn; ties go to the first."""
    scores = []
    for penalty in penalties:
        errors = [np.sqrt(s.squared_error(*(total - s).fit(penalty))[0] / s.n) for s in cells]
        scores.append((float(np.mean(errors)), penalty))
    best = min(range(len(scores)), key=lambda i: scores[i][0])
    return scores[best][1], scores[best][0]


PLAN = "stage string, penalty double, inner_rmse double, fit_rows long, held_rows long, rmse double, q2 double"


def nested_selection(plan: DataFrame, *, array: str, target: str, width: int, penalties: Sequence[float], k: int, inner_k: int, min_train: int = 15, min_test: int = 3, min_inner: int = 5) -> DataFrame:
    """Penalty and score per outer fold and for the held-out rows; the whole choice is made without the rows it is scored on.

    ``plan`` has ``is_test``, ``outer_fold`` and ``inner_fold`` per row.  For an outer
    fold, the penalty is chosen by the inner folds of the other rows, which are then
    fitted as a whole and score the fold.  The last stage chooses by the outer folds,
    fits all training rows and scores the held-out ones once.  q² is taken about the
    mean of the rows that were fitted.  Parts below the minimum sizes are an error.
    """
    if not penalties:
        raise ValueError("give at least one penalty")
    test = k * inner_k
    cell = F.when(F.col("is_test"), F.lit(test)).otherwise(F.col("outer_fold") * inner_k + F.col("inner_fold"))
    rows = plan.select(cell.alias("_c"), F.col(array).cast("array<double>").alias("_x"), F.array(F.col(target).cast("double")).alias("_y"))
    found = moments(rows, array="_x", responses="_y", cell="_c", width=width)
    train, held = found.over(lambda c: c != test), found.over(lambda c: c == test)
    for part, least, name in ((train, min_train, "training"), (held, min_test, "held-out")):
        if part.n < least:
            raise ValueError(f"the {name} part has {int(part.n)} rows, fewer than {least}")
    out, folds = [], [found.over(lambda c, f=f: c != test and c // inner_k == f) for f in range(k)]

    def score(stage, penalty, inner, fit, part):
        b, a = fit.fit(penalty)
        error = float(part.squared_error(b, a)[0])
        mean = fit.y[0] / fit.n
        spread = float(part.yy[0] - 2 * mean * part.y[0] + part.n * mean**2)
        return (stage, float(penalty), inner, int(fit.n), int(part.n), float(np.sqrt(error / part.n)), 1 - error / spread if spread > 0 else None)

    for f, fold in enumerate(folds):
        rest = train - fold
        if rest.n < min_inner:
            raise ValueError(f"outer fold {f} leaves {int(rest.n)} rows, fewer than {min_inner}")
        inner = [found.over(lambda c, f=f, g=g: c != test and c // inner_k != f and c % inner_k == g) for g in range(inner_k)]
        penalty, error = _inner_choice(rest, inner, penalties)
        out.append(score(f"outer {f}", penalty, error, rest, fold))
    penalty, error = _inner_choice(train, folds, penalties)
    out.append(score("held out", penalty, error, train, held))
    return plan.sparkSession.createDataFrame(out, PLAN)


# -- leave one out ----------------------------------------------------------------


def leave_one_out(df: DataFrame, *, array: str, target: str, width: int, penalty: float = 10.0, split: str = "random") -> DataFrame:
    """``df`` with ``loo_prediction`` and ``leverage``: every row as a fit to all others predicts it.

    The prediction is null where a row alone determines a coefficient (leverage one).
    Leaving single rows out is refused where it would cross group boundaries.
    """
    if split != "random":
        raise ValueError("leave-one-out must not bypass group, origin or time boundaries")
    x, y = F.col(array).cast("array<double>"), F.col(target).cast("double")
    rows = df.select(F.lit(0).alias("_c"), x.alias("_x"), F.array(y).alias("_y"))
    found = moments(rows, array="_x", responses="_y", cell="_c", width=width)
    if not found.cells:
        return df.withColumns({"loo_prediction": F.lit(None).cast("double"), "leverage": F.lit(None).cast("double")})
    total = found.over(lambda c: True)
    b, a = total.fit(penalty)
    mean = total.x / total.n
    system = total.xx - total.n * np.outer(mean, mean)
    system[np.diag_indices_from(system)] += penalty
    inverse = np.linalg.pinv(system, hermitian=True)
    box = df.sparkSession.sparkContext.broadcast((b[:, 0], float(a[0] + found.y_centre[0]), found.x_centre, mean, inverse, float(total.n)))
    schema = T.StructType([*df.schema, T.StructField("loo_prediction", T.DoubleType()), T.StructField("leverage", T.DoubleType())])
    names, place = schema.fieldNames(), len(df.columns)

    def run(batches):
        b, a, centre, mean, inverse, n = box.value
        for batch in batches:
            z = matrix(batch.column(place), width) - centre
            d = z - mean
            h = 1 / n + ((d @ inverse) * d).sum(1)
            y = batch.column(place + 1).to_numpy(zero_copy_only=False)
            with np.errstate(divide="ignore", invalid="ignore"):
                out = y - (y - a - z @ b) / (1 - h)
            lone = 1 - h < 1e-9
            yield pa.RecordBatch.from_arrays([*batch.columns[:place], pa.array(out, mask=lone), pa.array(h)], names)

    return df.select("*", x.alias("_loo_x"), y.alias("_loo_y")).mapInArrow(run, schema)

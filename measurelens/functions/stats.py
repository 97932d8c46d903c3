"""Closed-form statistics as column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b as double; null where b is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def wilson_lower(successes: Column, n: Column, confidence: float = 0.95) -> Column:
    """Lower end of the Wilson score interval."""
    z = NormalDist().inv_cdf(1 - (1 - confidence) / 2)
    n = n.cast("double")
    p = ratio(successes, n)
    centre = p + ratio(F.lit(z * z), 2 * n)
    margin = z * F.sqrt(ratio(p * (1 - p), n) + ratio(F.lit(z * z), 4 * n * n))
    return ratio(centre - margin, 1 + ratio(F.lit(z * z), n))


def sample_skew(skew: Column, n: Column) -> Column:
    """Bias-corrected skewness from Spark's population skewness; needs n >= 3."""
    n = n.cast("double")
    return F.when(n >= 3, F.coalesce(F.nanvl(skew, F.lit(0.0)), F.lit(0.0)) * ratio(F.sqrt(n * (n - 1)), n - 2))


def sample_kurtosis(kurt: Column, n: Column) -> Column:
    """Bias-corrected excess kurtosis from Spark's population one; needs n >= 4.

    A constant sample has excess kurtosis zero.
    """
    n = n.cast("double")
    corrected = ratio(n - 1, (n - 2) * (n - 3)) * ((n + 1) * kurt + 6)
    return F.when((n >= 4) & (kurt.isNull() | F.isnan(kurt)), F.lit(0.0)).when(n >= 4, corrected)


# Coefficients of a rational Chebyshev fit to the complementary
# error function (relative error below 1.2e-7 for every argument).
ERFC_FIT = (
    -1.26551223,
    1.00002368,
    0.37409196,
    0.09678418,
    -0.18628806,
    0.27886807,
    -1.13520398,
    1.48851587,
    -0.82215223,
    0.17087277,
)


def erfc_nonnegative(x: Column) -> Column:
    """erfc(x) for x >= 0, inside the JVM (Spark SQL has no erf)."""
    t = F.lit(1.0) / (1.0 + 0.5 * x)
    poly = F.lit(ERFC_FIT[-1])
    for coefficient in reversed(ERFC_FIT[:-1]):
        poly = poly * t + F.lit(coefficient)
    return t * F.exp(-x * x + poly)


def mann_whitney_p(n1: Column, n2: Column, rank_sum1: Column, tie_term: Column) -> Column:
    """Two-sided tie- and continuity-corrected normal p-value; null for a constant pool."""
    n1, n2 = n1.cast("double"), n2.cast("double")
    n = n1 + n2
    u1 = rank_sum1 - n1 * (n1 + 1) / 2
    u = F.greatest(u1, n1 * n2 - u1)
    variance = n1 * n2 / 12.0 * ((n + 1) - ratio(tie_term.cast("double"), n * (n - 1)))
    z = ratio(u - n1 * n2 / 2 - 0.5, F.sqrt(variance))
    # u is the larger statistic, so z below zero only arises from the correction.
    p = erfc_nonnegative(F.greatest(z, F.lit(0.0)) / math.sqrt(2.0))
    return F.when((n1 > 0) & (n2 > 0) & (variance > 0), F.least(p, F.lit(1.0)))


# From this size of the larger sample on, the exact counts equal their limit to six digits.
FINE = 1_000_000


def exact_mann_whitney() -> Callable[..., Column]:
    """Exact two-sided p for small samples without ties: one row per finished test."""

    @F.pandas_udf("double")
    def exact(u1: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
        known: dict[tuple[int, int], np.ndarray] = {}

        def counts(small: int, large: int) -> np.ndarray:
            # how many arrangements give each U: a product of Gaussian factors
            if (small, large) not in known:
                ways = np.zeros(small * large + 1)
                ways[0] = 1.0
                for k in range(1, small + 1):
                    ways[large + k :] -= ways[: len(ways) - large - k].copy()
                    # dividing by 1 - x^k sums every k-th entry
                    padded = np.append(ways, np.zeros(-len(ways) % k)).reshape(-1, k)
                    ways = padded.cumsum(axis=0).ravel()[: len(ways)]
                known[small, large] = ways
            return known[small, large]

        def p(u: float, a: int, b: int) -> float:
            small, large = min(a, b), max(a, b)
            high = int(round(max(u, a * b - u)))
            if large > FINE:
                # U / large is a sum of uniform draws up to an error of small / large
                x = small - (high - 0.5) / large * 1.0
                tail = sum((-1) ** j * math.comb(small, j) * max(x - j, 0.0) ** small for j in range(small + 1)) / math.factorial(small)
                return float(min(1.0, 2.0 * tail))
            ways = counts(small, large)
            return float(min(1.0, 2.0 * ways[high:].sum() / ways.sum()))

        return pd.Series([p(u, int(a), int(b)) for u, a, b in zip(u1, n1, n2)], dtype="float64")

    return exact


def mann_whitney(n1: Column, n2: Column, rank_sum1: Column, tie_term: Column) -> Column:
    """Exact for at most 8 values on one side and no ties, else the normal form."""
    u1 = rank_sum1 - n1.cast("double") * (n1.cast("double") + 1) / 2
    small = (F.least(n1, n2) <= 8) & (F.least(n1, n2) > 0) & (tie_term == 0)
    return F.when(
        small,
        exact_mann_whitney()(
            F.when(small, u1).otherwise(F.lit(1.0)),
            F.when(small, n1).otherwise(F.lit(1)),
            F.when(small, n2).otherwise(F.lit(1)),
        ),
    ).otherwise(mann_whitney_p(n1, n2, rank_sum1, tie_term))

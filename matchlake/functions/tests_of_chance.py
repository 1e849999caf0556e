"""Grouped significance tests as columns; the chi-square tail and run probabilities are small Python calls on grouped rows."""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType

from .winrate import as_col


def log_factorial(n: Column) -> Column:
    """ln(n!): exact to 20, Stirling series beyond."""
    x = n.cast("double")
    series = (x * F.log(x) - x + F.log(F.lit(2 * math.pi) * x) / 2 + 1 / (12 * x)
              - 1 / (360 * F.pow(x, 3)) + 1 / (1260 * F.pow(x, 5)))
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def fair_binomial_two_sided(k, n) -> Column:
    """min(1, 2 P(X <= min(k, n-k))) for X ~ Binomial(n, 1/2); NULL for an empty group.

    The tail is summed downwards from its largest term; the number of terms is bounded by a multiple of
    the standard deviation, past which they vanish in double precision.
    """
    k, n = as_col(k), as_col(n)
    low = F.least(k, n - k)
    top = F.exp(log_factorial(n) - log_factorial(low) - log_factorial(n - low) + n * F.lit(math.log(0.5)))
    terms = F.least(low, (F.ceil(F.sqrt(n.cast("double")) * 20) + 60).cast("bigint")).cast("int")
    steps = F.when(terms > 0, F.sequence(F.lit(1), terms)).otherwise(F.array().cast("array<int>"))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def add(acc, i):
        term = acc["term"] * (low - i + 1) / (n - low + i)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    tail = F.aggregate(steps, start, add, lambda acc: acc["total"])
    return F.when(n > 0, F.least(F.lit(1.0), 2 * top * tail))


def two_proportion_chi2(a, n, b, m) -> Column:
    """Squared z of a/n against b/m; NULL when a side is empty or an expected count is under five."""
    a, n, b, m = (as_col(c).cast("double") for c in (a, n, b, m))
    pooled = (a + b) / (n + m)
    smallest = F.least(n * pooled, n * (1 - pooled), m * pooled, m * (1 - pooled))
    z = (a / n - b / m) / F.sqrt(pooled * (1 - pooled) * (1 / n + 1 / m))
    return F.when((n > 0) & (m > 0) & (smallest >= 5), z * z)


def _tail(x: float, df: float) -> float:
    """P(chi-square with df >= x): finite sums for whole degrees of freedom."""
    if x is None or df is None or math.isnan(x) or math.isnan(df):
        return math.nan
    if x <= 0:
        return 1.0
    h, k = x / 2, int(df)
    odd = k % 2
    total = math.erfc(math.sqrt(h)) if odd else 0.0
    for i in range(k // 2):
        a = i + (0.5 if odd else 0.0)
        total += math.exp(a * math.log(h) - h - math.lgamma(a + 1))
    return min(1.0, total)


@F.pandas_udf(DoubleType())
def chi2_tail(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([_tail(a, b) for a, b in zip(x.astype(float), df.astype(float))]).astype("float64")


def _no_run(n: int, k: int) -> float:
    """q(n) with q(i) = 1 for i < k, q(k) = 1 - 2^-k and q(i) = q(i-1) - q(i-k-1) / 2^(k+1).

    x^n is reduced modulo x^(k+1) - x^k + 2^-(k+1) by repeated squaring, so any length takes O(k^2 log n).
    """
    if n < k:
        return 1.0
    h = 0.5 ** (k + 1)
    power = np.zeros(k + 1)
    power[0] = 1.0
    for bit in bin(n)[2:]:
        wide = np.convolve(power, power)
        if bit == "1":
            wide = np.append(0.0, wide)
        for d in range(len(wide) - 1, k, -1):
            wide[d - 1] += wide[d]
            wide[d - k - 1] -= h * wide[d]
        power = wide[:k + 1]
        power = np.pad(power, (0, k + 1 - len(power)))
    return min(1.0, max(0.0, float(power[:k].sum() + power[k] * (1 - 0.5 ** k))))


@F.pandas_udf(DoubleType())
def no_run_probability(length: pd.Series, streak: pd.Series) -> pd.Series:
    """P(no run of ``streak`` on a given side in ``length`` fair independent rows)."""
    return pd.Series([_no_run(int(n), int(k)) for n, k in zip(length, streak)]).astype("float64")


def p_to_score(p) -> Column:
    """50 from p = 0.10 up, 100 from p = 1e-4 down, linear in log10 p between."""
    p = as_col(p)
    share = (F.log10(p) + 1) / F.lit(-3.0)
    return (F.when(p.isNull(), F.lit(None)).when(p >= 0.10, F.lit(50.0)).when(p <= 1e-4, F.lit(100.0))
            .otherwise(F.round(50 + 50 * share, 1)))

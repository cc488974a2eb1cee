"""Tail probabilities as Arrow column functions for small aggregated tables, all from the regularised incomplete beta function."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function I_x(a, b), by its continued fraction (modified Lentz)."""
    if not 0.0 < x < 1.0:
        return float(x >= 1.0) if x == x else math.nan
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_share(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, value, c, d = 1e-300, 1.0, 1.0, 0.0
    for step in range(2000):
        m = step // 2
        if step == 0:
            term = 1.0
        elif step % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 / (1.0 + term * d or tiny)
        c = 1.0 + term / c or tiny
        value *= c * d
        if step and abs(c * d - 1.0) < 1e-15:
            break
    return front * (value - 1.0)


def t_tails(t: float, df: float) -> float:
    """P(|T| >= |t|) for Student's t."""
    if not (df > 0 and t == t):
        return math.nan
    return beta_share(df / 2.0, 0.5, df / (df + t * t)) if math.isfinite(t) else 0.0


def t_critical(df: float, level: float = 0.95) -> float:
    """The t that leaves 1 - level in both tails together, by bisection."""
    low, high = 0.0, 1.0
    while t_tails(high, df) > 1.0 - level:
        high *= 2.0
    for _ in range(80):
        mid = (low + high) / 2.0
        low, high = (mid, high) if t_tails(mid, df) > 1.0 - level else (low, mid)
    return (low + high) / 2.0


def upper_binomial(k: int, n: int, p: float) -> float:
    """P(X >= k) for n trials."""
    return 1.0 if k <= 0 else 0.0 if k > n else beta_share(k, n - k + 1, p)


def _log_mass(k: int, n: int, p: float) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)


def binomial_two_sided(k: int, n: int, p: float) -> float:
    """Mass of all outcomes no likelier than ``k``. The mass rises to one mode and falls, so the other side's edge is bisected."""
    if n == 0:
        return 1.0
    bar, mode = _log_mass(k, n, p) + 1e-7, min(n, int((n + 1) * p))
    low, high = (mode, n + 1) if k <= mode else (-1, mode)
    while high - low > 1:  # k below the mode: the first likely-enough outcome above it; else the last one below
        mid = (low + high) // 2
        small = _log_mass(mid, n, p) <= bar
        if k <= mode:
            low, high = (low, mid) if small else (mid, high)
        else:
            low, high = (mid, high) if small else (low, mid)
    if _log_mass(mode, n, p) <= bar:
        return 1.0
    below, above = (k, high) if k <= mode else (low, k)
    return min(1.0, 1.0 - upper_binomial(below + 1, n, p) + upper_binomial(above, n, p))


def tost_power(n: int, mean: float, sigma: float, bound: float, alpha: float = 0.05, points: int = 400) -> float:
    """Power of two one-sided t tests for |mean| < bound with ``n`` differences: the normal part is integrated over the law of the
    sample deviation."""
    if n < 2:
        return 0.0
    df, t = n - 1, t_critical(n - 1, 1.0 - 2.0 * alpha)
    mid, spread = 1.0, 8.0 / math.sqrt(2.0 * df)
    u = np.linspace(max(1e-9, mid - spread), mid + spread, points + 1)  # s / sigma
    density = np.exp(math.log(2.0) + (df / 2.0) * math.log(df / 2.0) - math.lgamma(df / 2.0) + (df - 1) * np.log(u) - df * u * u / 2.0)
    cdf = np.vectorize(lambda z: 0.5 * math.erfc(-z / math.sqrt(2.0)))
    scale = sigma / math.sqrt(n)
    inside = cdf((bound - mean) / scale - t * u) - cdf((-bound - mean) / scale + t * u)
    return float(np.trapezoid(np.maximum(inside, 0.0) * density, u))


def tost_sample_size(mean: float, sigma: float, bound: float, power: float = 0.8) -> int:
    """The smallest ``n`` whose power suffices: doubled until enough, then bisected. The bound must exceed the mean's size."""
    if abs(mean) >= bound:
        raise ValueError("no sample is large enough: the mean lies outside the bounds")
    high = 2
    while tost_power(high, mean, sigma, bound) < power:
        high *= 2
    low = high // 2
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (low, mid) if tost_power(mid, mean, sigma, bound) >= power else (mid, high)
    return high


def _column(function, *args: Column) -> Column:
    def run(*cols: pd.Series) -> pd.Series:
        return pd.Series([None if any(pd.isna(v) for v in row) else float(function(*row)) for row in zip(*cols)], dtype="float64")

    def of_two(a: pd.Series, b: pd.Series) -> pd.Series:
        return run(a, b)

    def of_three(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return run(a, b, c)

    return F.pandas_udf(of_two if len(args) == 2 else of_three, "double")(*args)


def t_p(t: Column, df: Column) -> Column:
    return _column(t_tails, t, df)


def t_quantile(df: Column, level: float = 0.95) -> Column:
    return _column(t_critical, df, F.lit(level))


def sign_p(k: Column, n: Column) -> Column:
    """P(X >= k) of ``n`` fair signs."""
    return _column(lambda a, b: upper_binomial(int(a), int(b), 0.5), k, n)


def binomial_p(k: Column, n: Column, p: Column) -> Column:
    return _column(lambda a, b, q: binomial_two_sided(int(a), int(b), q), k, n, p)


def tost_n(mean: Column, sigma: Column, bound: Column) -> Column:
    return _column(tost_sample_size, mean, sigma, bound)

"""Distribution functions Spark has no builtin for, as Arrow-batched helpers on reduced rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction (modified Lentz evaluation)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_cdf(1.0 - x, b, a)
    front = math.exp(
        a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    ) / a
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 10 + 20 * int(math.sqrt(a + b) + 10)):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            step = c * d
            total *= step
        if abs(step - 1.0) < 1e-15:
            break
    return front * total


def beta_quantile(p: float, a: float, b: float) -> float:
    lo, hi = 0.0, 1.0
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        if mid in (lo, hi):
            break
        lo, hi = (mid, hi) if beta_cdf(mid, a, b) < p else (lo, mid)
    return 0.5 * (lo + hi)


def binom_cdf(k: int, n: int, p: float) -> float:
    if k < 0:
        return 0.0
    return 1.0 if k >= n else beta_cdf(1.0 - p, n - k, k + 1.0)


def _log_pmf(k: int, n: int, p: float) -> float:
    return (
        math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
        + k * math.log(p) + (n - k) * math.log1p(-p)
    )


def binom_two_sided(k: int, n: int, p: float) -> float:
    """Exact two-sided test: total probability of outcomes no likelier than the observed one."""
    bar = _log_pmf(k, n, p) + 1e-7
    if k == p * n:
        return 1.0
    if k < p * n:  # the other tail starts at the first i >= mean with pmf(i) <= pmf(k)
        lo, hi = math.ceil(p * n), n + 1
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if _log_pmf(mid, n, p) <= bar else (mid + 1, hi)
        other = 1.0 - binom_cdf(lo - 1, n, p) if lo <= n else 0.0
        return min(1.0, binom_cdf(k, n, p) + other)
    lo, hi = -1, math.floor(p * n)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if _log_pmf(mid, n, p) <= bar else (lo, mid - 1)
    return min(1.0, binom_cdf(lo, n, p) + 1.0 - binom_cdf(k - 1, n, p))


def f_upper_tail(f: float, d1: float, d2: float) -> float:
    if not f > 0.0:
        return 1.0
    return beta_cdf(d2 / (d2 + d1 * f), d2 / 2.0, d1 / 2.0)


BINOMIAL = T.StructType(
    [T.StructField(c, T.DoubleType()) for c in ("ci_lower", "ci_upper", "p_value")]
)


def binomial_test(hits: Column, n: Column, p: float, confidence: float = 0.95) -> Column:
    """Exact coverage interval and two-sided p-value for one (hits, n) pair per reduced row."""
    tail = (1.0 - confidence) / 2.0

    def one(k: int, m: int) -> tuple[float, float, float]:
        lower = 0.0 if k == 0 else beta_quantile(tail, k, m - k + 1)
        upper = 1.0 if k == m else beta_quantile(1.0 - tail, k + 1, m - k)
        return lower, upper, binom_two_sided(k, m, p)

    @F.pandas_udf(BINOMIAL)
    def run(h: pd.Series, m: pd.Series) -> pd.DataFrame:
        pairs = pd.DataFrame({"h": h.to_numpy(), "m": m.to_numpy()})
        different = pairs.drop_duplicates()  # coverage tables repeat few pairs many times
        rows = [one(int(a), int(b)) if b else (None, None, None) for a, b in zip(different["h"], different["m"])]
        solved = pd.DataFrame(rows, columns=["ci_lower", "ci_upper", "p_value"], index=different.index)
        found = pairs.merge(pd.concat([different, solved], axis=1), on=["h", "m"], how="left")
        return found[["ci_lower", "ci_upper", "p_value"]]

    return run(hits.cast("bigint"), n.cast("bigint"))


@F.pandas_udf(T.DoubleType())
def normal_cdf(z: pd.Series) -> pd.Series:
    v = z.to_numpy(dtype="float64", na_value=np.nan)
    x = np.clip(v, -9.0, 9.0)  # beyond, the value is 0 or 1 to the last digit
    term = total = x
    for k in range(1, 400):  # the series in odd powers over odd factorials; all terms have the sign of x
        term = term * x * x / (2 * k + 1)
        total = total + term
        if not np.any(np.abs(term) > 1e-18 * np.abs(total)):
            break
    return pd.Series(np.clip(0.5 + total * np.exp(-x * x / 2) / math.sqrt(2 * math.pi), 0.0, 1.0), index=z.index)


def normal_sf_pair(mu: Column, sigma: Column, band: float) -> tuple[Column, Column]:
    """CDF at the lower and upper edge of a symmetric band around zero; missing where sigma is zero."""
    spread = F.nullif(sigma, F.lit(0.0))
    return (
        normal_cdf((F.lit(-band) - mu) / spread),
        normal_cdf((F.lit(band) - mu) / spread),
    )

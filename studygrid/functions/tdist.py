"""Student t tails and quantiles for rows that are already aggregated; Spark has no built-in for them."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_tail(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or tiny)
    f = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or tiny)
            c = (1 + num / c) or tiny
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f


def t_two_sided(t: float, df: float) -> float:
    return _beta_tail(df / 2, 0.5, df / (df + t * t)) if df > 0 and not math.isnan(t) else math.nan


def t_quantile(p: float, df: float) -> float:
    if not df > 0:
        return math.nan
    if p < 0.5:
        return -t_quantile(1 - p, df)
    lo, hi = 0.0, 1.0
    while 1 - t_two_sided(hi, df) / 2 < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - t_two_sided(mid, df) / 2 < p else (lo, mid)
    return (lo + hi) / 2


@F.pandas_udf(DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p."""
    return pd.Series([t_two_sided(a, b) if pd.notna(a) and pd.notna(b) else None for a, b in zip(t, df, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def t_ppf(p: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_quantile(a, b) if pd.notna(a) and pd.notna(b) and b > 0 else None for a, b in zip(p, df, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def normal_p_value(z: pd.Series) -> pd.Series:
    """Two-sided p of the standard normal."""
    return pd.Series([math.erfc(abs(x) / math.sqrt(2)) if pd.notna(x) else None for x in z], dtype="float64")

"""Tail probabilities for test statistics, applied to aggregated rows only."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Lentz evaluation of the continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-14:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    if not 0.0 < x < 1.0:
        return 0.0 if x <= 0.0 else 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while term > total * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1.0 - front * total)
    b = x + 1 - a
    c, d = 1e300, 1.0 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1.0 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def t_two_sided(t: float, df: float) -> float:
    if math.isinf(t):
        return 0.0
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def f_upper(f: float, d1: float, d2: float) -> float:
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def kolmogorov_tail(x: float) -> float:
    if x <= 0:
        return 1.0
    if x < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def _apply(fn, *series: pd.Series) -> pd.Series:
    out = [
        fn(*vals) if all(v is not None and not np.isnan(v) for v in vals) else None
        for vals in zip(*series, strict=True)
    ]
    return pd.Series(out, dtype="float64")


@F.pandas_udf(DoubleType())
def _p_t(t: pd.Series, df: pd.Series) -> pd.Series:
    return _apply(lambda a, b: t_two_sided(a, b) if b > 0 else float("nan"), t, df)


@F.pandas_udf(DoubleType())
def _p_f(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _apply(lambda a, b, c: f_upper(a, b, c) if b > 0 and c > 0 else float("nan"), f, d1, d2)


@F.pandas_udf(DoubleType())
def _p_chi2(x: pd.Series, k: pd.Series) -> pd.Series:
    return _apply(lambda a, b: gamma_upper(b / 2, a / 2) if b > 0 else float("nan"), x, k)


@F.pandas_udf(DoubleType())
def _cdf_norm(z: pd.Series) -> pd.Series:
    return _apply(normal_cdf, z)


@F.pandas_udf(DoubleType())
def _p_ks(x: pd.Series) -> pd.Series:
    return _apply(kolmogorov_tail, x)


def _d(c: Column) -> Column:
    return c.cast("double")


def p_t(t: Column, df: Column) -> Column:
    """Two-sided Student t."""
    return _p_t(_d(t), _d(df))


def p_f(f: Column, d1: Column, d2: Column) -> Column:
    return _p_f(_d(f), _d(d1), _d(d2))


def p_chi2(x: Column, k: Column) -> Column:
    return _p_chi2(_d(x), _d(k))


def p_normal(z: Column) -> Column:
    """Two-sided normal."""
    return F.lit(2.0) * _cdf_norm(-F.abs(_d(z)))


def cdf_normal(z: Column) -> Column:
    return _cdf_norm(_d(z))


def p_ks(d: Column, n1: Column, n2: Column) -> Column:
    en = F.sqrt(n1 * n2 / (n1 + n2))
    return _p_ks(_d(d * (en + 0.12 + 0.11 / en)))


def t_quantile(p: float, df: float) -> float:
    """Upper quantile with P(|T| <= q) = p, by bisection."""
    lo, hi = 0.0, 1e3
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - t_two_sided(mid, df) < p else (lo, mid)
    return (lo + hi) / 2


@F.pandas_udf(DoubleType())
def _q_t(p: pd.Series, df: pd.Series) -> pd.Series:
    return _apply(lambda a, b: t_quantile(a, b) if b > 0 else float("nan"), p, df)


def q_t(level: Column, df: Column) -> Column:
    return _q_t(_d(level), _d(df))

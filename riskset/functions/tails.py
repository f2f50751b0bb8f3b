"""Upper-tail probabilities, and the sums that large tied event times need.

Small helpers for result-sized tables: they are called on one value per fitted
term or per variable, on the driver or through ``tail_column``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Z_975 = 1.959963984540054
CHI2_1_95 = 3.841458820694124


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def _gamma_tail(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x)."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-17:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1.0 - total * scale)
    # continued fraction, modified Lentz
    b = x + 1 - a
    c = 1e300
    d = 1 / b
    h = d
    for i in range(1, 10000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        step = d * c
        h *= step
        if abs(step - 1) < 1e-16:
            break
    return scale * h


def chi2_tail(x: float | None, df: float) -> float | None:
    if x is None or math.isnan(x) or df <= 0:
        return None
    if df == 1:
        return math.erfc(math.sqrt(max(x, 0.0) / 2))
    return _gamma_tail(df / 2, x / 2)


def _beta_fraction(a: float, b: float, x: float) -> float:
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or 1e-300)
    h = d
    for m in range(1, 100000):
        num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1 / ((1 + num * d) or 1e-300)
        c = (1 + num / c) or 1e-300
        h *= d * c
        num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / ((1 + num * d) or 1e-300)
        c = (1 + num / c) or 1e-300
        step = d * c
        h *= step
        if abs(step - 1) < 1e-16:
            break
    return h


def beta_ratio(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def f_tail(x: float | None, df1: float, df2: float) -> float | None:
    if x is None or math.isnan(x) or df1 <= 0 or df2 <= 0:
        return None
    return beta_ratio(df2 / 2, df1 / 2, df2 / (df2 + df1 * x))


def t_two_sided(t: float, df: float) -> float:
    return beta_ratio(df / 2, 0.5, df / (df + t * t))


@F.pandas_udf(T.DoubleType())
def _chi2_column(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([chi2_tail(None if pd.isna(a) else a, b) for a, b in zip(x, df)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def _f_column(x: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    return pd.Series(
        [f_tail(None if pd.isna(a) else a, b, c) for a, b, c in zip(x, df1, df2)], dtype="float64"
    )


def chi2_tail_column(x: Column, df: Column) -> Column:
    """For result tables of one row per variable."""
    return _chi2_column(x.cast("double"), df.cast("double"))


def f_tail_column(x: Column, df1: Column, df2: Column) -> Column:
    """For result tables of one row per variable."""
    return _f_column(x.cast("double"), df1.cast("double"), df2.cast("double"))


# --- sums over the events of one tied time --------------------------------

DIRECT_TIES = 4096
_GL_NODES, _GL_WEIGHTS = np.polynomial.legendre.leggauss(40)


def _digamma(x: float) -> float:
    shift = 0.0
    while x < 12:
        shift -= 1 / x
        x += 1
    r = 1 / (x * x)
    tail = r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132))))
    return shift + math.log(x) - 0.5 / x - tail


def _trigamma(x: float) -> float:
    shift = 0.0
    while x < 12:
        shift += 1 / (x * x)
        x += 1
    r = 1 / (x * x)
    tail = 1 / x + r / 2 + r / x * (1 / 6 - r * (1 / 30 - r * (1 / 42 - r / 30)))
    return shift + tail


def tie_sums(s0: float, d0: float, d: float, efron: bool) -> tuple[float, float, float, float, float, float]:
    """(sum 1/v, sum f/v, sum 1/v^2, sum f/v^2, sum f^2/v^2, sum log v) over the d tied events,

    where v = s0 - f*d0 and f = l/d for l = 0..d-1 (Efron) or f = 0 (Breslow). Up
    to a few thousand ties the terms are added directly; beyond that, closed forms
    keep the cost independent of d.
    """
    if not efron:
        return d / s0, 0.0, d / s0**2, 0.0, 0.0, d * math.log(s0)
    if d <= DIRECT_TIES:
        f = np.arange(int(d)) / d
        v = s0 - f * d0
        i = 1 / v
        return i.sum(), (f * i).sum(), (i * i).sum(), (f * i * i).sum(), (f * f * i * i).sum(), np.log(v).sum()
    if d0 <= s0 / 2:
        # smooth summand: integral plus end corrections
        u = (_GL_NODES + 1) / 2
        q = d0

        def total(fn, slope):
            area = (_GL_WEIGHTS * fn(u)).sum() / 2
            return d * area - (fn(1.0) - fn(0.0)) / 2 + (slope(1.0) - slope(0.0)) / (12 * d)

        v = lambda x: s0 - x * q
        return (
            total(lambda x: 1 / v(x), lambda x: q / v(x) ** 2),
            total(lambda x: x / v(x), lambda x: s0 / v(x) ** 2),
            total(lambda x: 1 / v(x) ** 2, lambda x: 2 * q / v(x) ** 3),
            total(lambda x: x / v(x) ** 2, lambda x: (s0 + x * q) / v(x) ** 3),
            total(lambda x: x * x / v(x) ** 2, lambda x: 2 * x * s0 / v(x) ** 3),
            total(lambda x: np.log(v(x)), lambda x: -q / v(x)),
        )
    z = d * s0 / d0
    y = max(z - d, 0.0)
    h1 = _digamma(z + 1) - _digamma(y + 1)
    h2 = _trigamma(y + 1) - _trigamma(z + 1)
    return (
        d / d0 * h1,
        (z * h1 - d) / d0,
        (d / d0) ** 2 * h2,
        d / d0**2 * (z * h2 - h1),
        (z * z * h2 - 2 * z * h1 + d) / d0**2,
        d * math.log(d0 / d) + math.lgamma(z + 1) - math.lgamma(y + 1),
    )

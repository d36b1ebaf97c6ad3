"""Tail probabilities for the rank tests (textbook series / continued fractions).

Applied to one-row statistic frames through a pandas UDF, so they never run
per data row.  Formulas: regularised incomplete gamma (series for x < a+1,
Lentz continued fraction otherwise) and regularised incomplete beta
(continued fraction), as in standard numerical references.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EPS = 1e-15
_TINY = 1e-300


def _gamma_series(a: float, x: float) -> float:
    term = total = 1.0 / a
    ap = a
    for _ in range(100_000):
        ap += 1.0
        term *= x / ap
        total += term
        if abs(term) < abs(total) * _EPS:
            break
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def _gamma_cf(a: float, x: float) -> float:
    b = x + 1.0 - a
    c = 1.0 / _TINY
    d = 1.0 / b
    h = d
    for i in range(1, 100_000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = _TINY if abs(d) < _TINY else d
        c = b + an / c
        c = _TINY if abs(c) < _TINY else c
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < _EPS:
            break
    return math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


def gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma Q(a, x)."""
    if x <= 0:
        return 1.0
    if x < a + 1.0:
        return 1.0 - _gamma_series(a, x)
    return _gamma_cf(a, x)


def chi2_sf(x: float, dof: float) -> float:
    return gamma_q(dof / 2.0, x / 2.0)


def norm_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def _beta_cf(a: float, b: float, x: float) -> float:
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = _TINY if abs(d) < _TINY else d
    d = 1.0 / d
    h = d
    for m in range(1, 100_000):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = _TINY if abs(d) < _TINY else d
        c = 1.0 + aa / c
        c = _TINY if abs(c) < _TINY else c
        d = 1.0 / d
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = _TINY if abs(d) < _TINY else d
        c = 1.0 + aa / c
        c = _TINY if abs(c) < _TINY else c
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < _EPS:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_cf(a, b, x) / a
    return 1.0 - front * _beta_cf(b, a, 1.0 - x) / b


def t_sf_two_sided(t: float, dof: float) -> float:
    if math.isinf(t):
        return 0.0
    return beta_inc(dof / 2.0, 0.5, dof / (dof + t * t))


def _nan(v):
    return v is None or (isinstance(v, float) and math.isnan(v))


@F.pandas_udf(T.DoubleType())
def chi2_sf_udf(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([None if _nan(a) or _nan(b) else chi2_sf(float(a), float(b)) for a, b in zip(x, dof)],
                     dtype="float64")


@F.pandas_udf(T.DoubleType())
def norm_sf_udf(z: pd.Series) -> pd.Series:
    return pd.Series([None if _nan(a) else norm_sf(float(a)) for a in z], dtype="float64")


@F.pandas_udf(T.DoubleType())
def t_two_sided_udf(t: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([None if _nan(a) or _nan(b) else t_sf_two_sided(abs(float(a)), float(b))
                      for a, b in zip(t, dof)], dtype="float64")


def chi2_p(x, dof) -> Column:
    return chi2_sf_udf(x, dof)


def norm_p_two_sided(z) -> Column:
    return F.least(F.lit(1.0), 2.0 * norm_sf_udf(z))


def t_p_two_sided(t, dof) -> Column:
    return t_two_sided_udf(t, dof)


EXACT_PAIRS = 10_000_000     # n1 * n2 up to which the exact distribution of U is counted


def _u_counts(n: int, m: int) -> np.ndarray:
    """How many of the arrangements of ``n`` and ``m`` values give U = 0, 1, ...: coefficients of the Gaussian
    binomial, one factor (1 - q^(m+i)) / (1 - q^i) at a time, in whole numbers."""
    c = np.zeros(n * m + 1, object)
    c[0] = 1
    for i in range(1, n + 1):
        c[m + i:] = c[m + i:] - c[:-(m + i)] if m + i < len(c) else c[m + i:]
        for r in range(min(i, len(c))):
            c[r::i] = np.cumsum(c[r::i])
    return c


def mannwhitney_exact(n1: int, n2: int, u: float) -> float | None:
    """Two-sided p of U (the larger of the two) from its exact distribution."""
    n, m = sorted((int(n1), int(n2)))
    if n == 0 or n * m > EXACT_PAIRS:
        return None
    c = _u_counts(n, m)
    return float(min(1.0, 2 * Fraction(int(sum(c[int(u):])), int(sum(c)))))


@F.pandas_udf(T.DoubleType())
def mannwhitney_exact_udf(n1: pd.Series, n2: pd.Series, u: pd.Series) -> pd.Series:
    return pd.Series([mannwhitney_exact(a, b, x) for a, b, x in zip(n1, n2, u)], dtype="float64")

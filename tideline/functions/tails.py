"""Tail probabilities for the tiny coefficient tables (normal, chi-square, Student t); no SciPy needed."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def chi_square_upper(x: float, df: int) -> float:
    """Closed forms: even df end in an exponential sum, odd df in an error function plus a finite sum."""
    if x <= 0:
        return 1.0
    half = x / 2.0
    if df % 2 == 0:
        term = total = 1.0
        for i in range(1, df // 2):
            term *= half / i
            total += term
        return math.exp(-half) * total
    total = math.erfc(math.sqrt(half))
    term = math.exp(-half) * math.sqrt(half) / math.gamma(1.5)
    for i in range((df - 1) // 2):
        total += term
        term *= half / (i + 1.5)
    return total


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 400):
        for numerator in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + numerator * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + numerator / c
            c = c if abs(c) > tiny else tiny
            value *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return value


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0 or x >= 1.0:
        return float(x >= 1.0)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def student_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2.0, 0.5, df / (df + t * t))


def normal_p(z: Column) -> Column:
    @F.pandas_udf(DoubleType())
    def tail(batch: pd.Series) -> pd.Series:
        return batch.map(lambda v: None if pd.isna(v) else normal_two_sided(v))

    return tail(z)


def chi_square_p(x: Column, df: Column) -> Column:
    @F.pandas_udf(DoubleType())
    def tail(values: pd.Series, degrees: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(v) or k < 1 else chi_square_upper(v, int(k)) for v, k in zip(values, degrees)])

    return tail(x, df)


def student_p(t: Column, df: Column) -> Column:
    @F.pandas_udf(DoubleType())
    def tail(values: pd.Series, degrees: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(v) or k < 1 else student_two_sided(v, k) for v, k in zip(values, degrees)])

    return tail(t, df)

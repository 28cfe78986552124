"""Tail probabilities that Spark has no expression for, as Arrow UDFs over a few rows."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def regularized_beta(a: float, b: float, x: float) -> float:
    """I_x(a, b) by the continued fraction, evaluated on the side where it converges fast."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - regularized_beta(b, a, 1.0 - x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        + a * math.log(x) + b * math.log1p(-x)
    ) / a
    tiny = 1e-300
    c, d, result = 1.0, 1.0 - (a + b) * x / (a + 1.0), 1.0
    d = 1.0 / (d if abs(d) > tiny else tiny)
    result = d
    for m in range(1, 20_000):
        for numerator in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + numerator * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + numerator / c
            c = c if abs(c) > tiny else tiny
            result *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * result


def student_two_sided(t: float, df: float) -> float:
    return regularized_beta(df / 2.0, 0.5, df / (df + t * t))


def binomial_upper_tail(successes: int, trials: int) -> float:
    """P(X >= successes) for a fair coin; 1 when there were no trials."""
    if trials == 0 or successes <= 0:
        return 1.0
    return regularized_beta(successes, trials - successes + 1, 0.5)


@F.pandas_udf(DoubleType())
def _t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(
        [
            None if pd.isna(a) or pd.isna(b) or b <= 0 else student_two_sided(float(a), float(b))
            for a, b in zip(t, df)
        ],
        dtype="float64",
    )


@F.pandas_udf(DoubleType())
def _sign_p_value(successes: pd.Series, trials: pd.Series) -> pd.Series:
    return pd.Series(
        [binomial_upper_tail(int(s), int(n)) for s, n in zip(successes, trials)], dtype="float64"
    )


def t_p_value(t: Column, df: Column) -> Column:
    return _t_p_value(t, df)


def sign_p_value(successes: Column, trials: Column) -> Column:
    return _sign_p_value(successes, trials)

"""Two-sided Student-t p-value for one-row summaries."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def t_two_sided(t: float, dof: float) -> float:
    """I_x(dof/2, 1/2) at x = dof/(dof+t^2), by its continued fraction (modified Lentz)."""
    if t != t or dof != dof or dof <= 0:
        return math.nan
    a, b, x = dof / 2.0, 0.5, dof / (dof + t * t)
    if x in (0.0, 1.0):
        return x
    flip = x > (a + 1.0) / (a + b + 2.0)
    if flip:
        a, b, x = b, a, 1.0 - x
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        + a * math.log(x) + b * math.log1p(-x)
    ) / a
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 500):
        even = m * (b - m) * x / ((a + 2 * m - 1.0) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1.0))
        for coef in (even, odd):
            d = 1.0 + coef * d
            c = 1.0 + coef / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1.0) < 1e-16:
            break
    p = front * value
    return 1.0 - p if flip else p


@F.pandas_udf(DoubleType())
def _p_udf(t: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided(a, b) for a, b in zip(t, dof)], dtype="float64")


def t_pvalue(t: Column, dof: Column) -> Column:
    """Column form; applied to aggregated summary rows only."""
    p = _p_udf(t.cast("double"), dof.cast("double"))
    return F.when(t.isNotNull() & (dof > 0) & ~F.isnan(p), p)

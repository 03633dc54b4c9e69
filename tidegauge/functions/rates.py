"""Rates from confusion counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(num: Column, den: Column, on_empty: str = "zero") -> Column:
    """num/den as double; an empty denominator gives 0 or null."""
    value = F.when(den > 0, num.cast("double") / den.cast("double"))
    return F.coalesce(value, F.lit(0.0)) if on_empty == "zero" else value


def rate_columns(on_empty: str = "zero") -> dict[str, Column]:
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))
    return {
        "sens": ratio(tp, tp + fn, on_empty),
        "spec": ratio(tn, tn + fp, on_empty),
        "ppv": ratio(tp, tp + fp, on_empty),
        "npv": ratio(tn, tn + fn, on_empty),
    }


def net_benefit(tp: Column, fp: Column, n: Column, t: Column) -> Column:
    nn = n.cast("double")
    return tp / nn - fp / nn * (t / (F.lit(1.0) - t))


def score_bin(score: Column, per_efold: int = 4096) -> Column:
    """Monotone integer bin of a score.

    Equal-width on a log scale, so scores near 0 and near 1 are both resolved. A pure
    function of the value: needs no pre-pass, and two evaluations always agree. Scores in
    (0, 1) fall in at most 14 * per_efold bins.
    """
    s = score.cast("double")
    return F.floor(
        F.signum(s) * F.log1p(F.abs(s) * F.lit(float(1 << 20))) * F.lit(float(per_efold))
    ).cast("bigint")

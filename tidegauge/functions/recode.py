"""Recodes of coded survey answers, all as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegauge.functions.codes import (
    AGE_BANDS_A,
    AGE_BANDS_B,
    AGE_MIDPOINTS_17,
    AGE_MIDPOINTS_6,
    SKIP_CODES,
    VETERAN_CODES,
    VETERAN_NULL_CODES,
)

def numeric(c: Column) -> Column:
    """Cast to double; unparsable text and NaN become null."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x), x)


def skip_to_null(c: Column, codes: Sequence[int] = SKIP_CODES) -> Column:
    x = c.cast("double")
    return F.when(~x.isin(*[float(k) for k in codes]), x)


def binary(c: Column) -> Column:
    """1 -> 1, 2 or 0 -> 0, everything else null."""
    x = c.try_cast("double")
    return F.when(x == 1.0, F.lit(1.0)).when(x.isin(0.0, 2.0), F.lit(0.0))


def equals_flag(c: Column, code: int) -> Column:
    """1.0 where equal, 0.0 otherwise; a missing answer gives 0.0."""
    return F.when(c == F.lit(code), F.lit(1.0)).otherwise(F.lit(0.0))


def married_flag(c: Column) -> Column:
    return F.when(c.isin(*SKIP_CODES), F.lit(None).cast("double")).otherwise(equals_flag(c, 1))


def map_codes(c: Column, mapping: Mapping[int, float], codes: Sequence[int] = SKIP_CODES) -> Column:
    """Recode the mapped codes, null the skip codes, pass every other code through."""
    out = F.when(c.isin(*codes), F.lit(None).cast("double"))
    for code, value in mapping.items():
        out = out.when(c == F.lit(code), F.lit(float(value)))
    return out.otherwise(c.cast("double"))


def orientation_flag(c: Column) -> Column:
    return map_codes(c, {1: 0.0, 2: 1.0, 3: 1.0})


def member_flag(c: Column, members: Sequence[int], nulls: Sequence[int]) -> Column:
    """1.0 for members, null for the given null codes, 0.0 otherwise (missing included)."""
    return (
        F.when(c.isin(*nulls), F.lit(None).cast("double"))
        .when(c.isin(*members), F.lit(1.0))
        .otherwise(F.lit(0.0))
    )


def veteran_flag(c: Column) -> Column:
    return member_flag(c, VETERAN_CODES, VETERAN_NULL_CODES)


def _lookup(c: Column, table: Mapping[int, float]) -> Column:
    entries = [F.lit(v) for kv in table.items() for v in (float(kv[0]), float(kv[1]))]
    return F.try_element_at(F.create_map(*entries), c.cast("double"))


def age_midpoint(c: Column, wave_max: Column) -> Column:
    """Code to years; the coding is recognised by the largest code of the wave."""
    return F.when(wave_max <= 6, _lookup(c, AGE_MIDPOINTS_6)).otherwise(
        _lookup(c, AGE_MIDPOINTS_17)
    )


def age_band_a(c: Column) -> Column:
    lo, mid, hi = AGE_BANDS_A
    return (
        F.when(c.between(0, 2), lo).when((c > 2) & (c <= 5), mid).when((c > 5) & (c <= 100), hi)
    )


def age_band_b(c: Column) -> Column:
    lo, mid, hi = AGE_BANDS_B
    return F.when(c.isin(1, 2), lo).when(c.isin(3, 4), mid).when(c.isin(5, 6), hi)


def age_band_c(c: Column) -> Column:
    lo, mid, hi = AGE_BANDS_A
    return F.when(c <= 2, lo).when(c.between(3, 5), mid).when(c >= 6, hi)


def logit(p: Column, eps: float = 1e-12) -> Column:
    return F.log((p + F.lit(eps)) / (F.lit(1.0) - p + F.lit(eps)))


def flag_at(p: Column, threshold: Column | float) -> Column:
    """Inclusive threshold."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return (p >= t).cast("int")


def interaction(a: Column, b: Column) -> Column:
    return a * b

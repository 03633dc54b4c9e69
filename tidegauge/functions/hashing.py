"""Deterministic per-row randomness from md5, so that any engine can reproduce it.

A draw is a pure function of (seed, row id): a lost executor recomputes the same values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cumulative Poisson(1) probabilities, P(K <= k) = sum(1/i!)/e, k = 0..11.
POISSON1_CDF = (
    0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462,
    0.9963401531726563, 0.9994058151824183, 0.999916758850712, 0.9999897508033253,
    0.999998874797402, 0.9999998885745217, 0.9999999899522336, 0.9999999991683892,
)


def salted(salt: object, c: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{salt}:"), c.cast("string")))


def hex_slice(digest: Column, start: int | Column, length: int) -> Column:
    """Integer value of some hex digits of a digest (1-based start)."""
    piece = (
        F.substring(digest, start, length)
        if isinstance(start, int)
        else F.substr(digest, start, F.lit(length))
    )
    return F.conv(piece, 16, 10).cast("bigint")


def hash_int(salt: object, c: Column) -> Column:
    return hex_slice(salted(salt, c), 1, 7)


def poisson1(u: Column) -> Column:
    """Poisson(1) count of a uniform in [0, 1)."""
    out = F.when(u < F.lit(POISSON1_CDF[0]), 0)
    for k, edge in enumerate(POISSON1_CDF[1:], start=1):
        out = out.when(u < F.lit(edge), k)
    return out.otherwise(len(POISSON1_CDF))

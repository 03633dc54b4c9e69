"""Compression of coded rows to weighted cells.

Survey answers take few values, so a table of any length holds few distinct
(wave, features, outcome) vectors. One scan with map-side combine reduces the rows to cells
with a row count; fits and metrics then run on cells with that count as weight and give the
same numbers as on rows. Columns with many values simply compress less.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WEIGHT = "w"


def analytic(df: DataFrame, outcome: str = "y", employed_only: bool = True) -> DataFrame:
    """Population filter (switchable) and outcome filter."""
    out = df.filter(F.col("employment") == 1) if employed_only else df
    return out.filter(F.col(outcome).isin(0, 1))


def compress(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(WEIGHT))

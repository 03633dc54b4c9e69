"""Estimability rules shared by the studies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.codes import MIN_FEATURES, MIN_POSITIVES


def estimable(
    df: DataFrame, features: Sequence[str], label: str = "y", by: str = "wave",
    weight: str | None = None,
) -> DataFrame:
    """(by, n_pos, n_features, estimable): enough usable features and enough positives."""
    w = F.col(weight) if weight else F.lit(1)
    present = sum((F.count(f) > 0).cast("int") for f in features)
    return df.groupBy(by).agg(
        F.sum(F.when(F.col(label) == 1, w).otherwise(w * 0)).cast("bigint").alias("n_pos"),
        present.cast("bigint").alias("n_features"),
    ).withColumn(
        "estimable", (F.col("n_pos") >= MIN_POSITIVES) & (F.col("n_features") >= MIN_FEATURES)
    )

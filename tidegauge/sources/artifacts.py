"""Stored models and results that are reused instead of being computed again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def table_exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise
    return True


def stored_or_computed(
    spark: SparkSession, path: str, compute: Callable[[], DataFrame], force: bool = False
) -> DataFrame:
    """The stored table when it exists, else compute and store it."""
    if force or not table_exists(spark, path):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)

"""Wave files: header, scan, multi-wave load and landing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from tidegauge.operators import resolve
from tidegauge.operators.clean import clean_waves
from tidegauge.session import cut_lineage


def scan_wave(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """Delimited text with a header, every column as text. Later selects prune the parse."""
    return (
        spark.read.option("sep", sep).option("header", True).option("inferSchema", False).csv(path)
    )


def scan_waves(
    spark: SparkSession, paths: Mapping[int, str], sep: str = "\t"
) -> dict[int, DataFrame]:
    """One lazy frame per wave; waves whose file is absent are skipped."""
    frames = {}
    for wave, path in paths.items():
        try:
            frames[wave] = scan_wave(spark, path, sep)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    return frames


def wave_paths(folder: str, waves: Sequence[int], template: str = "wave_{wave}.tab") -> dict[int, str]:
    return {w: f"{folder}/{template.format(wave=w)}" for w in waves}


def resolve_frames(
    spark: SparkSession, frames: Mapping[int, DataFrame]
) -> dict[int, dict[str, str]]:
    """Physical column per wave and logical variable, from headers only."""
    columns = resolve.header_table(spark, {w: f.columns for w, f in frames.items()})
    aliases = resolve.alias_table(spark)
    resolved = cut_lineage(resolve.resolve(columns, aliases))
    return resolve.mapping_dict(resolve.mapping_table(columns, aliases, resolved))


def load_clean(
    spark: SparkSession, frames: Mapping[int, DataFrame], row_id: str = "row_id"
) -> DataFrame:
    """Resolve and clean all waves as one lazy table."""
    return clean_waves(frames, resolve_frames(spark, frames), row_id)


def land(clean: DataFrame, path: str) -> DataFrame:
    """Store the clean table once, partitioned by wave, and read it back.

    Every later study prunes to the waves and columns it needs instead of parsing text again.
    """
    clean.write.mode("overwrite").partitionBy("wave").parquet(path)
    return clean.sparkSession.read.parquet(path)

"""Incremental cleaning and windowed monitoring.

Sinks are written per batch id, so a batch that is repeated after a failure overwrites its
own output instead of adding to it. Windows are monitored by counts that add up: each batch writes
the counts of its own rows, and :func:`merged` sums them. No state is held between batches and
nothing is evicted, so rows may arrive in any order and as late as they like.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def file_stream(
    spark: SparkSession, folder: str, schema, pattern: str = "*", fmt: str = "parquet",
    max_files: int = 1000,
) -> DataFrame:
    """Arriving files; max_files bounds the size of a batch, every file is read in some batch.

    ``pattern`` names files of the folder, or folders of part files in it.
    """
    return (
        spark.readStream.format(fmt)
        .schema(schema)
        .option("maxFilesPerTrigger", max_files)
        .load(folder if pattern == "*" else f"{folder}/{pattern}")
    )


def _per_batch(path: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def append_clean(
    stream: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str, checkpoint: str
) -> StreamingQuery:
    """Clean arriving rows with the batch expressions and append them."""
    return (
        transform(stream)
        .writeStream.foreachBatch(_per_batch(path))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def prevalence_aggs(outcome: Column) -> dict[str, Column]:
    """Counts only: they merge exactly across batches."""
    return {"n": F.count("*"), "n_pos": F.count_if(outcome)}


def monitor_aggs(score: Column, outcome: Column, threshold: float) -> dict[str, Column]:
    """Confusion counts and squared error of a scored stream, as sums."""
    hit, y = score >= F.lit(threshold), outcome.cast("int")
    d = score - y
    return {
        "tp": F.count_if(hit & (y == 1)),
        "fp": F.count_if(hit & (y == 0)),
        "fn": F.count_if(~hit & (y == 1)),
        "tn": F.count_if(~hit & (y == 0)),
        "squared_error": F.sum(d * d),
    }


def write_counts(
    stream: DataFrame, ts: str, width: str, aggs: dict[str, Column], path: str, checkpoint: str, by: list[str] | None = None
) -> StreamingQuery:
    """Counts per event-time window (and ``by``) of each batch's rows; ``aggs`` must add up."""

    def write(batch: DataFrame, batch_id: int) -> None:
        counts = batch.groupBy(F.window(ts, width).start.alias("window_start"), *(by or [])).agg(*[c.alias(k) for k, c in aggs.items()])
        counts.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def merged(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Counts over all batches so far."""
    rows = spark.read.parquet(path)
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in rows.columns if c not in (*keys, "batch")])


def grid_count_aggs(score: Column, outcome: Column, grid) -> tuple[Column, dict[str, Column]]:
    """Cell of a threshold grid and class counts per cell: AUC and curves of a stream follow
    from these counts, since ranks themselves are not a streaming aggregate."""
    return grid.cell(score), {"pos": F.count_if(outcome), "neg": F.count_if(~outcome)}

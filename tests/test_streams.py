"""Streams over several files in any order, and tables stored as folders."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from tidegauge.session import new_folder
from tidegauge.sources import manifest
from tidegauge.streaming import incremental


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    return [(start + dt.timedelta(hours=rng.randrange(24 * 40)), rng.random() < 0.4, rng.random()) for _ in range(300)]


@pytest.mark.parametrize("layout", ["files", "folder"])
def test_replay_in_any_order_equals_batch(spark, rows, layout):
    base = new_folder(spark, "events").removeprefix("file:")
    folder = f"{base}/events.parquet" if layout == "folder" else base
    late_first = sorted(rows, reverse=True)
    frame = spark.createDataFrame(rows, "ts timestamp, outcome boolean, score double")
    for i in range(3):
        part = spark.createDataFrame(late_first[100 * i : 100 * i + 100], frame.schema).coalesce(1)
        part.write.mode("append").parquet(folder)
        for f in os.listdir(folder):
            if f.endswith(".parquet") and not f.startswith("seen"):
                os.rename(f"{folder}/{f}", f"{folder}/seen{i}.parquet")
                os.utime(f"{folder}/seen{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    pattern = "events.parque[t]" if layout == "folder" else "*"
    stream = incremental.file_stream(spark, base, frame.schema, pattern, max_files=1)
    out = new_folder(spark, "stream")
    aggs = incremental.monitor_aggs(F.col("score"), F.col("outcome"), 0.5)
    incremental.write_counts(stream, "ts", "1 day", aggs, f"{out}/rows", f"{out}/state").awaitTermination()
    assert spark.read.parquet(f"{out}/rows").select("batch").distinct().count() == 3
    got = incremental.merged(spark, f"{out}/rows", ["window_start"])
    want = frame.groupBy(F.window("ts", "1 day").start.alias("window_start")).agg(*[c.alias(k) for k, c in aggs.items()])
    columns = ["window_start", "tp", "fp", "fn", "tn", F.round("squared_error", 9)]
    assert sorted(got.select(*columns).collect()) == sorted(want.select(*columns).collect())


def test_checksums_of_folders(spark):
    base = new_folder(spark, "tables")
    spark.range(3000).repartition(2).write.parquet(f"{base}/a.parquet")
    spark.range(3000).coalesce(1).write.parquet(f"{base}/b.parquet")
    assert manifest.checksums(spark, base, "*.parquet").count() == 3

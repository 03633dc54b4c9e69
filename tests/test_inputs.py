"""The respondent table that the survey queries share."""

import os

from pyspark.sql import functions as F

from tidegauge.registry import inputs


def test_orders_are_dealt_by_rows_whatever_their_blocks(spark, tmp_path, monkeypatch):
    keyed = spark.range(3000).select(F.col("id").alias("o_orderkey"), F.expr("date'1995-06-01'").alias("o_orderdate"))
    keyed.repartition(3).write.parquet(str(tmp_path / "orders.parquet"))
    monkeypatch.setattr(inputs, "ROWS_PER_TASK", 100)
    table = inputs.Inputs(spark, str(tmp_path))
    assert table.raw.agg(F.count("*"), F.countDistinct("row_id")).first() == (3000, 3000)
    files = [f for f in os.listdir(f"{table.raw_folder}/wave=1995") if f.endswith(".parquet")]
    assert len(files) == 30

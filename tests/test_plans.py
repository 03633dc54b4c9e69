"""Registry contract and physical plans."""

import pytest
from pyspark.sql import functions as F

from tidegauge.functions.codes import BASIC5
from tidegauge.operators import ranking, sampling
from tidegauge.plans import rolling
from tidegauge.registry.all import QUERIES, SQL
from tidegauge.session import attach, cut_lineage, small_table


def plan(df):
    return df._jdf.queryExecution().toString()


def test_registry_is_consistent():
    assert set(SQL) <= set(QUERIES) and len(SQL) >= 120


def test_entry_has_a_stable_schema(spark, data):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["train_wave", "test_wave", "auc", "sensitivity", "specificity", "n_positive", "n_total"]
    assert df.count() > 0


@pytest.mark.parametrize("name", ["auc_by_wave", "roc_curve", "subgroup_audit", "reliability_curve", "stratified_folds", "scorecard_grid", "rolling_window_training"])
def test_no_cross_joins(spark, data, name):
    text = plan(QUERIES[name](spark, data.path))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scans_are_pruned_by_wave_and_column(spark, data):
    text = plan(data.clean.filter(F.col("wave") == 2000).select("y"))
    assert "PartitionFilters: [isnotnull(wave" in text
    schema = text[text.rindex("ReadSchema:"):].split("\n")[0]
    assert "suicide" in schema and "income" not in schema


def test_rank_windows_are_split_by_bin(spark, data):
    df = ranking.running_counts(ranking.score_counts(data.preds, "p_new", "y", ["wave"]), ["wave"])
    windows = [line for line in plan(df).split("\n") if "Window [" in line and "score" in line]
    assert windows and all("_bin" in line for line in windows)


def test_holdout_does_not_shuffle_rows(spark, data):
    out = sampling.holdout(data.analytic, "row_id", ["wave", "y"])
    assert "Exchange hashpartitioning" not in plan(out.select("row_id", "is_test"))


def test_window_rows_are_exploded_not_joined(spark, data):
    cells = data.analytic.groupBy("wave", *BASIC5, "y").agg(F.count("*").alias("w"))
    assert "Join" not in plan(rolling.training_windows(cells, [1998, 1999]))


def test_summary_size_is_checked(spark):
    table = small_table(spark.range(50).withColumn("v", F.col("id") * 2))
    joined = attach(spark.range(50), table, ["id"])
    assert "BroadcastHashJoin" in plan(joined)
    assert joined.filter("v = id * 2").count() == 50
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100")
        assert "Broadcast" not in plan(attach(spark.range(50), table, ["id"]))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_shared_folder_is_required_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from tidegauge.session import shared_dir

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="yarn", applicationId="a")
    with pytest.raises(ValueError):
        shared_dir(SimpleNamespace(conf={}, sparkContext=context))


def test_steps_are_kept_below_the_shared_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    df = cut_lineage(spark.range(5))
    assert df.count() == 5
    root = root or spark.sparkContext.getCheckpointDir()
    assert all(root.split(":")[-1] in f for f in df.inputFiles())
    assert "Range" not in plan(df)

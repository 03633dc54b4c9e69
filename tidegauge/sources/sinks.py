"""Result sinks and their sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.functions.rates import score_bin
from tidegauge.operators import ranking
from tidegauge.operators.resolve import require_columns
from tidegauge.session import attach

PREDICTION_COLUMNS = ("row_id", "y", "score")


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), fmt: str = "parquet") -> str:
    writer = df.write.mode("overwrite").format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.save(path)
    return path


def read_predictions(
    spark: SparkSession, path: str, required: Sequence[str] = PREDICTION_COLUMNS
) -> DataFrame:
    """Stored predictions; refuses a table without the required columns."""
    df = spark.read.parquet(path)
    require_columns(df, required)
    return df


def write_holdout_csv(df: DataFrame, path: str, label: str = "y", score: str = "score") -> str:
    """(y_true, p_hat) text table."""
    return write_table(
        df.select(F.col(label).alias("y_true"), F.col(score).alias("p_hat")), path, fmt="csv"
    )


GRID_METRICS = ("auc", "sensitivity", "specificity", "n_positive", "n_total")


def grid_to_json(grid: DataFrame) -> DataFrame:
    """One row with the nested document train -> test -> metrics (waves squared entries)."""
    cell = F.struct(*GRID_METRICS)
    rows = grid.groupBy("train_wave").agg(
        F.map_from_entries(
            F.sort_array(F.collect_list(F.struct(F.col("test_wave").cast("string"), cell)))
        ).alias("tests")
    )
    return rows.agg(
        F.to_json(
            F.struct(
                F.map_from_entries(
                    F.collect_list(F.struct(F.col("train_wave").cast("string"), F.col("tests")))
                ).alias("basic")
            )
        ).alias("value")
    )


GRID_SCHEMA = (
    "basic map<string, map<string, struct<auc: double, sensitivity: double, "
    "specificity: double, n_positive: bigint, n_total: bigint>>>"
)


def grid_from_json(documents: DataFrame, column: str = "value") -> DataFrame:
    """Inverse of :func:`grid_to_json`."""
    doc = documents.select(F.from_json(column, GRID_SCHEMA).alias("d"))
    trains = doc.select(F.explode("d.basic").alias("train", "tests"))
    cells = trains.select("train", F.explode("tests").alias("test", "m"))
    return cells.select(
        F.col("train").cast("int").alias("train_wave"),
        F.col("test").cast("int").alias("test_wave"),
        "m.*",
    )


def write_document(df: DataFrame, path: str) -> str:
    """A frame whose rows are JSON documents, as text lines."""
    df.select("value").write.mode("overwrite").text(path)
    return path


def read_document(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("wholetext", True).text(path)


def mapping_to_json(mapping: DataFrame) -> DataFrame:
    """wave -> logical -> physical as one document."""
    per_wave = mapping.groupBy("wave").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("logical", "physical")))).alias("m")
    )
    return per_wave.agg(
        F.to_json(
            F.map_from_entries(F.collect_list(F.struct(F.col("wave").cast("string"), F.col("m"))))
        ).alias("value")
    )


def metrics_to_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def indexed_points(curve: DataFrame, by: Sequence[str]) -> DataFrame:
    """Number curve points 0.. along the curve, with offsets per bin instead of one big sort."""
    by = list(by)
    keyed = curve.withColumn("_bin", score_bin(F.col("fpr")))
    order = [F.col("fpr"), F.col("tpr")]
    local = F.row_number().over(Window.partitionBy(*by, "_bin").orderBy(*order)) - 1
    before = (
        Window.partitionBy(*(by or [F.lit(0)]))
        .orderBy("_bin")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        keyed.groupBy(*by, "_bin")
        .agg(F.count("*").alias("_n"))
        .select(*by, "_bin", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    )
    return (
        attach(keyed.withColumn("_local", local), offsets, [*by, "_bin"], "inner")
        .withColumn("idx", F.col("_local") + F.col("_off"))
        .drop("_bin", "_local", "_off")
    )


def paired_curves(
    df: DataFrame, score: str, label: str, model: str, names: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """ROC curves of two models side by side; the shorter one is padded with nulls."""
    by = list(by)
    points = indexed_points(ranking.roc_curve(df, score, label, [*by, model]), [*by, model])
    sides = [
        points.filter(F.col(model) == n).select(
            *by, "idx", F.col("fpr").alias(f"fpr_{n}"), F.col("tpr").alias(f"tpr_{n}")
        )
        for n in names
    ]
    return sides[0].join(sides[1], [*by, "idx"], "full_outer")


POINTS_PER_DOCUMENT = 10_000


def curves_to_json(
    points: DataFrame, by: Sequence[str], per_document: int = POINTS_PER_DOCUMENT
) -> DataFrame:
    """(by, part, value): {"fpr": [...], "tpr": [...], "thr": [...]} in curve order, for plotting.

    The first threshold (+inf) is written as null. A longer curve continues in part 1, 2, ...,
    so no document, and no task, holds an unbounded curve.
    """
    part = F.floor(F.col("idx") / per_document).cast("int")
    indexed = indexed_points(points, by).withColumn("part", part)
    pts = F.sort_array(F.collect_list(F.struct("idx", "fpr", "tpr", "thr")))
    return indexed.groupBy(*by, "part").agg(pts.alias("_p")).select(
        *by,
        "part",
        F.to_json(
            F.struct(
                F.col("_p.fpr").alias("fpr"), F.col("_p.tpr").alias("tpr"), F.col("_p.thr").alias("thr")
            ),
            {"ignoreNullFields": "false"},
        ).alias("value"),
    )

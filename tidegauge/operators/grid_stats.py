"""Summaries of a train x test result grid.

A grid has at most waves squared rows, however many respondents are behind it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.operators.stats import describe, linear_fit, pooled_t


def _same():
    return F.col("train_wave") == F.col("test_wave")


def with_kind(grid: DataFrame) -> DataFrame:
    return grid.withColumn("kind", F.when(_same(), "same").otherwise("cross"))


def same_cross(grid: DataFrame) -> DataFrame:
    return describe(with_kind(grid), "auc", ["kind"])


def gap(grid: DataFrame) -> DataFrame:
    same = F.avg(F.when(_same(), F.col("auc")))
    cross = F.avg(F.when(~_same(), F.col("auc")))
    return grid.agg((same - cross).alias("gap"))


def summary_table(grid: DataFrame) -> DataFrame:
    """Mean, sd, min, max and range of both kinds, with the difference (none for range)."""
    stats = {
        "Mean": F.avg, "SD": F.stddev_samp, "Min": F.min, "Max": F.max,
        "Range": lambda c: F.max(c) - F.min(c),
    }
    a, b = F.when(_same(), F.col("auc")), F.when(~_same(), F.col("auc"))
    wide = grid.agg(
        F.array(
            *[
                F.struct(F.lit(k).alias("metric"), f(a).alias("same_year"), f(b).alias("cross_year"))
                for k, f in stats.items()
            ]
        ).alias("m")
    )
    return wide.select(F.explode("m").alias("e")).select(
        "e.metric",
        "e.same_year",
        "e.cross_year",
        F.when(F.col("e.metric") != "Range", F.col("e.same_year") - F.col("e.cross_year")).alias(
            "difference"
        ),
    )


def distances(grid: DataFrame) -> DataFrame:
    return grid.filter(~_same()).withColumn(
        "distance", F.abs(F.col("train_wave") - F.col("test_wave")).cast("int")
    )


def mean_by_distance(grid: DataFrame) -> DataFrame:
    return distances(grid).groupBy("distance").agg(
        F.avg("auc").alias("mean_auc"), F.count("*").alias("n")
    )


def distance_decay(grid: DataFrame, p_value: bool = True) -> DataFrame:
    return linear_fit(distances(grid), "distance", "auc", p_value=p_value)


def with_direction(grid: DataFrame, cut: int) -> DataFrame:
    """Tag cells that cross the era boundary."""
    forward = (F.col("train_wave") < cut) & (F.col("test_wave") >= cut)
    back = (F.col("train_wave") >= cut) & (F.col("test_wave") < cut)
    tagged = grid.withColumn(
        "direction", F.when(forward, "pre_to_post").when(back, "post_to_pre")
    )
    return tagged.filter(F.col("direction").isNotNull())


def era_transport(grid: DataFrame, cut: int) -> DataFrame:
    return describe(with_direction(grid, cut), "auc", ["direction"])


def era_test(grid: DataFrame, cut: int, p_value: bool = True) -> DataFrame:
    return pooled_t(
        with_direction(grid, cut), "auc", "direction", "pre_to_post", "post_to_pre", p_value
    )


def diagonal(grid: DataFrame) -> DataFrame:
    return grid.filter(_same())


def sample_characteristics(grid: DataFrame) -> DataFrame:
    return diagonal(grid).select(
        F.col("test_wave").alias("wave"),
        F.col("n_total").alias("n"),
        F.col("n_positive").alias("n_pos"),
        (F.lit(100.0) * F.col("n_positive") / F.col("n_total")).alias("prevalence_pct"),
        "sensitivity",
        "specificity",
        "auc",
    )


def prevalence_trend(grid: DataFrame, p_value: bool = True) -> DataFrame:
    """Regression of prevalence on wave and relative change of the last wave over the first."""
    chars = sample_characteristics(grid)
    first, last = F.min_by("prevalence_pct", "wave"), F.max_by("prevalence_pct", "wave")
    extra = [
        (F.lit(100.0) * (last - first) / first).alias("relative_change_pct"),
        F.sum("n").alias("total_n"),
        F.size(F.collect_set("wave")).cast("bigint").alias("n_waves"),
    ]
    return linear_fit(chars, "wave", "prevalence_pct", p_value=p_value, extra=extra)


def auc_pivot(grid: DataFrame, waves: Sequence[int]) -> DataFrame:
    """Train rows by test columns; naming the waves avoids a pass to find them."""
    return grid.groupBy("train_wave").pivot("test_wave", list(waves)).agg(F.first("auc"))


def strategy_table(results: DataFrame, digits: int = 3) -> DataFrame:
    """Single-wave and pooled AUC per test wave, rounded, with the difference of the rounded values."""
    single = F.round(F.max(F.when(F.col("strategy") == "single", F.col("auc"))), digits)
    rolling = F.round(F.max(F.when(F.col("strategy") == "rolling", F.col("auc"))), digits)
    return results.groupBy("test_wave").agg(
        single.alias("single_auc"), rolling.alias("rolling_auc"), (rolling - single).alias("improvement")
    )

"""Calibration curve, Brier score and reclassification indices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.rates import ratio
from tidegauge.operators.ranking import quantiles
from tidegauge.session import attach, small_table


def brier(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    d = F.col(score) - F.col(label)
    return df.groupBy(*by).agg(F.avg(d * d).alias("brier"), F.count("*").alias("n"))


def reliability(
    df: DataFrame, score: str, label: str, by: Sequence[str] = (), bins: int = 10
) -> DataFrame:
    """Equal-frequency bins by score quantiles; ties stay in one bin, empty bins vanish."""
    by = list(by)
    probs = [i / bins for i in range(1, bins)]
    edges = (
        quantiles(df, score, probs, by)
        .groupBy(*by)
        .agg(F.sort_array(F.collect_list("value")).alias("_edges"))
    )
    rows = attach(df, small_table(edges), by)
    b = F.size(F.filter("_edges", lambda e: e < F.col(score)))
    return (
        rows.groupBy(*by, b.alias("bin"))
        .agg(
            F.avg(score).alias("mean_score"),
            F.avg(label).alias("observed"),
            F.count("*").alias("n"),
        )
    )


def nri(df: DataFrame, new: str, old: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Continuous net reclassification improvement and its parts, in both sign conventions.

    nri_standard = [P(up|1) - P(down|1)] + [P(down|0) - P(up|0)]; nri_reference flips the
    second bracket.
    """
    y, up, down = F.col(label), F.col(new) > F.col(old), F.col(new) < F.col(old)

    def count(cond: Column) -> Column:
        return F.count_if(cond)

    n1, n0 = count(y == 1), count(y == 0)
    parts = df.groupBy(*by).agg(
        count(up & (y == 1)).alias("up_events"),
        count(down & (y == 1)).alias("down_events"),
        count(up & (y == 0)).alias("up_nonevents"),
        count(down & (y == 0)).alias("down_nonevents"),
        n1.alias("n_events"),
        n0.alias("n_nonevents"),
    )
    event = ratio(F.col("up_events") - F.col("down_events"), F.col("n_events"))
    nonevent = ratio(F.col("down_nonevents") - F.col("up_nonevents"), F.col("n_nonevents"))
    return parts.withColumn("nri_standard", event + nonevent).withColumn(
        "nri_reference", event - nonevent
    )


def idi(df: DataFrame, new: str, old: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Integrated discrimination improvement: difference of the two discrimination slopes."""
    y = F.col(label)

    def slope(p: str) -> Column:
        return F.avg(F.when(y == 1, F.col(p))) - F.avg(F.when(y == 0, F.col(p)))

    return df.groupBy(*by).agg((slope(new) - slope(old)).alias("idi"))

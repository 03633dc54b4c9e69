"""Descriptive profiles of coded tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def prevalence(df: DataFrame, label: str = "y", by: str = "wave") -> DataFrame:
    return df.groupBy(by).agg(
        F.count("*").alias("n"),
        F.sum(label).cast("bigint").alias("n_pos"),
        (F.lit(100.0) * F.sum(label) / F.count("*").cast("double")).alias("pct"),
    )


def raw_prevalence(df: DataFrame, code: str, by: str = "wave") -> DataFrame:
    """n1 / (n1 + n2) on raw answers; null unless both codes occur."""
    n1, n2 = F.count_if(F.col(code) == 1), F.count_if(F.col(code) == 2)
    return df.groupBy(by).agg(
        n1.alias("n_yes"),
        n2.alias("n_no"),
        F.when((n1 > 0) & (n2 > 0), n1.cast("double") / (n1 + n2).cast("double")).alias("prevalence"),
    )


def employment_share(df: DataFrame, column: str = "employment", by: str = "wave") -> DataFrame:
    n = F.count_if(F.col(column) == 1)
    return df.groupBy(by).agg(
        n.alias("n_employed"), (n.cast("double") / F.count("*").cast("double")).alias("share")
    )


def value_counts(
    df: DataFrame, columns: Sequence[str], order: str = "frequency", limit: int = 10
) -> DataFrame:
    """(feature, rank, value, n): first ``limit`` values per column, nulls counted.

    order: "frequency" (largest first, then value) or "value". One pass over the rows for
    all columns; the ranking sees distinct codes only.
    """
    from pyspark.sql import Window

    pairs = F.explode(
        F.array(
            *[
                F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"))
                for c in columns
            ]
        )
    ).alias("p")
    counts = df.select(pairs).groupBy("p.feature", "p.value").agg(F.count("*").alias("n"))
    first = [F.asc_nulls_last("value")] if order == "value" else [F.desc("n"), F.asc_nulls_last("value")]
    rank = F.row_number().over(Window.partitionBy("feature").orderBy(*first))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= limit)


def null_rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    wide = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    return wide.unpivot([], list(columns), "feature", "null_rate")


def funnel(
    df: DataFrame, sets: Mapping[str, Sequence[str]], outcome: str = "y", by: Sequence[str] = ()
) -> DataFrame:
    """(by, stage, n): rows left after each filter and complete cases per feature set, in one pass."""
    employed = F.coalesce(F.col("employment") == 1, F.lit(False))
    labelled = employed & F.col(outcome).isNotNull()
    counts = {
        "all": F.count("*"),
        "employed": F.count_if(employed),
        "with_outcome": F.count_if(labelled),
    }
    for name, features in sets.items():
        complete = labelled
        for f in features:
            complete = complete & F.col(f).isNotNull()
        counts[name] = F.count_if(complete)
    wide = df.groupBy(*by).agg(*[v.alias(k) for k, v in counts.items()])
    return wide.unpivot(list(by), list(counts), "stage", "n")

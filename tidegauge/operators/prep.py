"""Imputation, standardisation and class weights fitted on training rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, LongType

from tidegauge.operators.ranking import quantiles
from tidegauge.session import attach, small_table

LEVELS = 1_000_000  # counted levels of all groups and columns up to which medians are read per group


def class_weights(
    df: DataFrame, label: str = "y", by: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """n_neg, n_pos and n_neg / max(n_pos, 1) per group."""
    w = F.col(weight) if weight else F.lit(1)
    y = F.col(label)
    pos = F.sum(F.when(y == 1, w).otherwise(w * 0)).cast("bigint")
    neg = F.sum(F.when(y == 0, w).otherwise(w * 0)).cast("bigint")
    return df.groupBy(*by).agg(
        neg.alias("n_neg"),
        pos.alias("n_pos"),
        (neg.cast("double") / F.greatest(pos, F.lit(1)).cast("double")).alias("pos_weight"),
    )


def medians(
    df: DataFrame, features: Sequence[str], by: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """Exact weighted medians (wide) from the counts of each level.

    Coded columns have few levels: their counts are read once more, by group and feature. Where the
    counts are many, as for continuous columns, ranks come from the distributed quantiles.
    """
    by, kind = list(by), df.schema[weight].dataType if weight else LongType()
    keep = [*by, *([weight] if weight else [])]
    long = df.select(*keep, *[F.col(f).cast("double").alias(f) for f in features]).unpivot(keep, list(features), "feature", "value")
    n = F.sum(weight) if weight else F.count("*")
    counts = small_table(long.filter(F.col("value").isNotNull()).groupBy(*by, "feature", "value").agg(n.alias("_n")))
    if isinstance(kind, IntegralType) and counts.count() <= LEVELS:
        q = counts.filter("_n > 0").groupBy(*by, "feature").agg(F.percentile("value", F.lit(0.5), F.col("_n")).alias("value"))
    else:
        q = quantiles(counts, "value", [0.5], [*by, "feature"], "_n")
    return q.groupBy(*by).pivot("feature", list(features)).agg(F.first("value"))


def fit_prep(
    df: DataFrame, features: Sequence[str], by: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """Long table (by, feature, median, mean, sd) of the imputed training columns.

    sd is the population value, 1 for a constant column. Moments are taken about the
    median, so large values lose no digits.
    """
    by = list(by)
    med = small_table(medians(df, features, by, weight).select(
        *by, *[F.col(f).alias(f"{f}__med") for f in features]
    ))
    joined = attach(df, med, by)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    sums = [F.sum(w).alias("_n")]
    for f in features:
        d = F.coalesce(F.col(f) - F.col(f"{f}__med"), F.lit(0.0))
        sums += [
            F.sum(w * d).alias(f"{f}__s1"),
            F.sum(w * d * d).alias(f"{f}__s2"),
            F.first(f"{f}__med").alias(f"{f}__med"),
        ]
    wide = joined.groupBy(*by).agg(*sums)
    entry = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(f).alias("feature"),
                    F.col(f"{f}__med").alias("median"),
                    (F.col(f"{f}__s1") / F.col("_n")).alias("d1"),
                    (F.col(f"{f}__s2") / F.col("_n")).alias("d2"),
                )
                for f in features
            ]
        )
    ).alias("e")
    long = wide.select(*by, entry).select(*by, "e.*")
    var = F.col("d2") - F.col("d1") * F.col("d1")
    sd = F.sqrt(F.greatest(var, F.lit(0.0)))
    return long.select(
        *by,
        "feature",
        "median",
        (F.col("median") + F.col("d1")).alias("mean"),
        F.when(sd < 1e-12, F.lit(1.0)).otherwise(sd).alias("sd"),
    )


class Scaler:
    """Fitted medians, means and deviations as literals: applying it is a projection."""

    def __init__(self, params: dict[str, tuple[float, float, float]]):
        self.params = params

    @classmethod
    def fit(cls, df: DataFrame, features: Sequence[str], weight: str | None = None) -> Scaler:
        rows = fit_prep(df, features, (), weight).collect()  # one row per feature
        return cls({r["feature"]: (r["median"], r["mean"], r["sd"]) for r in rows})

    def column(self, feature: str, scale: bool = True) -> Column:
        median, mean, sd = self.params[feature]
        filled = F.coalesce(F.col(feature), F.lit(median))
        return (filled - F.lit(mean)) / F.lit(sd) if scale else filled

    def apply(self, df: DataFrame, scale: bool = True) -> DataFrame:
        """Fill and scale in place; columns the data lacks are filled from training medians."""
        absent = {f: F.lit(None).cast("double") for f in self.params if f not in df.columns}
        df = df.withColumns(absent) if absent else df
        return df.withColumns({f: self.column(f, scale) for f in self.params})


def availability(df: DataFrame, columns: Sequence[str], by: str = "wave") -> DataFrame:
    """Non-null counts of all columns in one pass, as (by, feature, n_present)."""
    wide = df.groupBy(by).agg(*[F.count(c).alias(c) for c in columns])
    return wide.unpivot([by], list(columns), "feature", "n_present")


def availability_report(df: DataFrame, columns: Sequence[str], by: str = "wave") -> DataFrame:
    long = availability(df, columns, by)
    missing = F.filter(
        F.collect_list(F.when(F.col("n_present") == 0, F.col("feature"))), lambda x: x.isNotNull()
    )
    return long.groupBy(by).agg(
        F.count_if(F.col("n_present") > 0).alias("n_available"),
        F.count("*").alias("n_template"),
        F.array_join(F.array_sort(missing), ",").alias("missing"),
    )


def usable_features(df: DataFrame, features: Sequence[str]) -> list[str]:
    """Features that are present and not entirely null; one aggregate."""
    have = [f for f in features if f in df.columns]
    if not have:
        return []
    row = df.agg(*[F.max(F.col(f).isNotNull()).alias(f) for f in have]).first()
    return [f for f in have if row[f]]

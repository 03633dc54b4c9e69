"""Metrics by subgroup."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions import recode as rc
from tidegauge.functions.codes import (
    AGE_BANDS_B,
    AUDIT_MIN_ROWS,
    AUDIT_THRESHOLD,
    SEX_LABELS,
    SUBGROUP_THRESHOLD,
)
from tidegauge.functions.rates import ratio, rate_columns
from tidegauge.operators.ranking import metrics_from_counts, quantiles
from tidegauge.session import attach, local_rows, small_table


def grouped_metrics(
    df: DataFrame, score: str, label: str, threshold: float, by: Sequence[str],
    on_empty: str = "null",
) -> DataFrame:
    """n, n_pos, AUC and rates per group, all from one reduction to (group, score) counts."""
    by = list(by)
    y = F.col(label)
    counts = (
        df.filter(y.isin(0, 1) & F.col(score).isNotNull())
        .groupBy(*by, F.col(score).alias("score"))
        .agg(F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"))
    )
    rates = rate_columns(on_empty)
    return metrics_from_counts(counts, F.lit(float(threshold)), by).select(
        *by,
        F.col("n_total").alias("n"),
        F.col("n_positive").alias("n_pos"),
        ratio(F.col("n_positive"), F.col("n_total"), "null").alias("prevalence"),
        "auc",
        rates["sens"].alias("sens"),
        rates["spec"].alias("spec"),
    )


def explode_groups(df: DataFrame, groups: Mapping[str, Column], keep: Sequence[str]) -> DataFrame:
    """One row per (row, group it belongs to). Groups may overlap."""
    tags = F.array(*[F.when(cond, F.lit(name)) for name, cond in groups.items()])
    return df.select(*keep, F.explode(F.filter(tags, lambda x: x.isNotNull())).alias("group"))


def sex_age_table(
    df: DataFrame, score: str, label: str = "y", threshold: float = SUBGROUP_THRESHOLD,
    band: Callable[[Column], Column] = rc.age_band_b,
) -> DataFrame:
    """Sex and age-band table; an empty age band stays as a row with n = 0."""
    groups = {
        SEX_LABELS[0]: F.col("male") == 0,
        SEX_LABELS[1]: F.col("male") == 1,
    } | {b: band(F.col("age")) == b for b in AGE_BANDS_B}
    metrics = grouped_metrics(
        explode_groups(df, groups, [score, label]), score, label, threshold, ["group"]
    )
    names = local_rows(
        df.sparkSession,
        [(i, g) for i, g in enumerate(groups)], "pos int, group string"
    )
    table = attach(names, metrics, ["group"]).filter(
        F.col("n").isNotNull() | ~F.col("group").isin(*SEX_LABELS)
    )
    return table.select(
        "pos",
        "group",
        F.coalesce("n", F.lit(0)).alias("n"),
        *[(F.col(k) * 100).alias(f"{k}_pct") for k in ("prevalence", "sens", "spec")],
        "auc",
    )


def audit_groups(low_income: Column, high_income: Column) -> dict[str, Column]:
    c = F.col
    return {
        "Female": c("male") == 0,
        "Male": c("male") == 1,
        "Veteran": c("veteran") == 1,
        "Civilians": c("veteran") == 0,
        "LGBTQ": c("lgbtq") == 1,
        "Non-LGBTQ": c("lgbtq") == 0,
        "Age18-25": c("age") <= 2,
        "Age26-49": c("age").between(3, 5),
        "Age50+": c("age") >= 6,
        "LowInc": c("income") <= low_income,
        "HighInc": c("income") >= high_income,
    }


def audit(
    df: DataFrame, score: str, label: str = "y", threshold: float = AUDIT_THRESHOLD,
    min_rows: int = AUDIT_MIN_ROWS, by: Sequence[str] = (),
) -> DataFrame:
    """Eleven overlapping subgroups; groups under min_rows are left out."""
    by = list(by)
    quartiles = quantiles(df, "income", [0.25, 0.75], by).groupBy(*by)
    cuts = small_table(quartiles.agg(F.array(*[F.max(F.when(F.col("prob") == p, F.col("value"))) for p in (0.25, 0.75)]).alias("_q")))
    rows = attach(df, cuts, by)
    groups = audit_groups(F.col("_q")[0], F.col("_q")[1])
    tagged = explode_groups(rows, groups, [*by, score, label])
    return (
        grouped_metrics(tagged, score, label, threshold, [*by, "group"], on_empty="zero")
        .filter(F.col("n") >= min_rows)
        .drop("prevalence")
    )

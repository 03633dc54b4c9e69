"""Confusion counts over a fixed threshold grid.

Each score is mapped to its grid cell by arithmetic, the cells are counted with map-side
combine, and the reverse running sum runs over grid cells only (at most 1001 per group).
Rows are never paired with thresholds.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.rates import net_benefit, rate_columns
from tidegauge.session import attach


@dataclass(frozen=True)
class Grid:
    """Thresholds lo + i * delta, i = 0 .. size - 1."""

    lo: float
    delta: float
    size: int

    @staticmethod
    def by_step(lo: float, hi: float, step: float) -> Grid:
        """Fixed form: delta is (lo + step) - lo, the end point counts when it is reached."""
        delta = (lo + step) - lo
        return Grid(lo, delta, max(0, math.ceil((hi + 1e-12 - lo) / step)))

    @staticmethod
    def by_count(lo: float, hi: float, size: int) -> Grid:
        return Grid(lo, (hi - lo) / (size - 1), size)

    def at(self, i: Column) -> Column:
        return F.lit(self.lo) + i.cast("double") * F.lit(self.delta)

    def cell(self, score: Column) -> Column:
        """Number of thresholds at or below the score (0 .. size), exact at the edges."""
        guess = F.floor((score - F.lit(self.lo)) / F.lit(self.delta))
        k = (
            F.when(self.at(guess + 1) <= score, guess + 2)
            .when(self.at(guess) <= score, guess + 1)
            .otherwise(guess)
        )
        return F.greatest(F.lit(0), F.least(F.lit(self.size), k)).cast("int")


SWEEP = Grid.by_step(0.0, 1.0, 0.05)
FINE = Grid.by_count(0.0, 1.0, 1001)
HIGH_SPEC = Grid.by_step(0.05, 0.90, 0.01)
DECISION = Grid.by_count(0.01, 0.99, 99)
TARGET_SCAN = Grid.by_count(0.01, 0.99, 10)


def confusion(
    df: DataFrame, score: str, label: str, threshold: float | str, by: Sequence[str] = (),
    weight: str | None = None,
) -> DataFrame:
    """tp, fp, fn, tn at one threshold (a number or a column name)."""
    w = F.col(weight) if weight else F.lit(1)
    t = F.col(threshold) if isinstance(threshold, str) else F.lit(float(threshold))
    hit, y = F.col(score) >= t, F.col(label)

    def total(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, w)), F.lit(0)).cast("bigint")

    return df.groupBy(*by).agg(
        total(hit & (y == 1)).alias("tp"),
        total(hit & (y == 0)).alias("fp"),
        total(~hit & (y == 1)).alias("fn"),
        total(~hit & (y == 0)).alias("tn"),
    )


def grid_confusion(
    df: DataFrame, score: str, label: str, grid: Grid, by: Sequence[str] = (),
    weight: str | None = None,
) -> DataFrame:
    """(by, i, thr, tp, fp, fn, tn) for every threshold of the grid."""
    by = list(by)
    w = F.col(weight) if weight else F.lit(1)
    y = F.col(label)
    cells = (
        df.filter(y.isin(0, 1) & F.col(score).isNotNull())
        .groupBy(*by, grid.cell(F.col(score)).alias("_k"))
        .agg(
            F.sum(F.when(y == 1, w).otherwise(0)).alias("_p"),
            F.sum(F.when(y == 0, w).otherwise(0)).alias("_n"),
        )
    )
    totals = cells.groupBy(*by).agg(F.sum("_p").alias("_tp"), F.sum("_n").alias("_tn"))
    spine = totals.select(*by, "_tp", "_tn", F.explode(F.sequence(F.lit(1), F.lit(grid.size))).alias("_k"))
    up = (
        Window.partitionBy(*(by or [F.lit(0)]))
        .orderBy(F.desc("_k"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    full = attach(spine, cells, [*by, "_k"])
    i = F.col("_k") - 1
    return (
        full.withColumn("tp", F.sum(F.coalesce("_p", F.lit(0))).over(up).cast("bigint"))
        .withColumn("fp", F.sum(F.coalesce("_n", F.lit(0))).over(up).cast("bigint"))
        .select(
            *by,
            i.alias("i"),
            grid.at(i).alias("thr"),
            "tp",
            "fp",
            (F.col("_tp") - F.col("tp")).cast("bigint").alias("fn"),
            (F.col("_tn") - F.col("fp")).cast("bigint").alias("tn"),
        )
    )


def sweep(df, score, label, grid: Grid = SWEEP, by: Sequence[str] = (), on_empty="zero") -> DataFrame:
    rates = rate_columns(on_empty)
    return grid_confusion(df, score, label, grid, by).select(
        *by, "thr", "tp", "fp", "fn", "tn", *[rates[k].alias(k) for k in ("sens", "spec")]
    )


def nearest_specificity(
    df: DataFrame, score: str, label: str, target: float, grid: Grid = FINE, by: Sequence[str] = (),
    default_thr: float | None = 0.5,
) -> DataFrame:
    """Threshold whose specificity is closest to the target; the lowest one on ties.

    A gap of 1 or more never wins; then the default threshold is reported with its own
    counts, or the group is dropped when there is no default. Tuned on the rows it reports on.
    """
    rates = rate_columns("zero")
    gap = F.abs(rates["spec"] - F.lit(float(target)))
    table = grid_confusion(df, score, label, grid, by).withColumn("_gap", gap)
    pick = table.filter(F.col("_gap") < 1.0)
    if default_thr is not None:
        pick = table.filter(
            (F.col("_gap") < 1.0) | (F.abs(F.col("thr") - F.lit(default_thr)) < grid.delta / 2)
        )
    row = F.struct("thr", "tp", "fp", "fn", "tn")
    best = pick.groupBy(*by).agg(F.min_by(row, F.struct("_gap", "thr")).alias("_b"))
    best = best.select(*by, "_b.*")
    return best.select(
        *by,
        F.col("thr").alias("threshold"),
        *[rates[k].alias(k) for k in ("sens", "spec", "ppv", "npv")],
        "tp",
        "fp",
        "fn",
        "tn",
        (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("n"),
        F.lit("test").alias("tuned_on"),
    )


def sensitivity_scan(df, score, label, target, band, by: Sequence[str] = ()) -> DataFrame:
    """Ten thresholds with a flag where sensitivity is within the band of the target."""
    rates = rate_columns("null")
    return grid_confusion(df, score, label, TARGET_SCAN, by).select(
        *by,
        "thr",
        rates["sens"].alias("sens"),
        rates["spec"].alias("spec"),
        F.coalesce(F.abs(rates["sens"] - F.lit(target)) < F.lit(band), F.lit(False)).alias("near_target"),
    )


def decision_curve(df, score, label, by: Sequence[str] = ()) -> DataFrame:
    table = grid_confusion(df, score, label, DECISION, by)
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return table.select(
        *by, "thr", net_benefit(F.col("tp"), F.col("fp"), n, F.col("thr")).alias("net_benefit")
    )

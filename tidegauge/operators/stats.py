"""Summary statistics: one-pass regressions, t tests and intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.student import t_pvalue


def describe(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    v = F.col(value)
    return df.groupBy(*by).agg(
        F.count(v).alias("n"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("sd"),
        F.stddev_pop(v).alias("sd_pop"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
    )


def linear_fit(
    df: DataFrame, x: str, y: str, by: Sequence[str] = (), p_value: bool = True,
    extra: Sequence[Column] = (),
) -> DataFrame:
    """Slope, intercept, r squared and standard error from one aggregate.

    ``extra`` aggregates are computed in the same pass.
    """
    cx, cy = F.col(x).cast("double"), F.col(y).cast("double")
    sums = df.groupBy(*by).agg(
        F.regr_slope(cy, cx).alias("slope"),
        F.regr_intercept(cy, cx).alias("intercept"),
        F.regr_r2(cy, cx).alias("r_squared"),
        F.regr_sxx(cy, cx).alias("_sxx"),
        F.regr_syy(cy, cx).alias("_syy"),
        F.regr_count(cy, cx).alias("n"),
        *extra,
    )
    rest = (F.lit(1.0) - F.col("r_squared")) * F.col("_syy")
    se = F.when(
        (F.col("n") > 2) & (F.col("_sxx") > 0),
        F.sqrt(rest / ((F.col("n") - 2) * F.col("_sxx"))),
    )
    out = sums.withColumn("se", se).drop("_sxx", "_syy")
    if p_value:
        t = F.when(F.col("se") > 0, F.col("slope") / F.col("se"))
        out = out.withColumn("p_value", t_pvalue(t, F.col("n") - 2))
    return out


def pooled_t(
    df: DataFrame, value: str, group: str, first: str, second: str, p_value: bool = True
) -> DataFrame:
    """Two-sample t with pooled variance, group ``first`` minus group ``second``."""
    a = F.when(F.col(group) == first, F.col(value))
    b = F.when(F.col(group) == second, F.col(value))
    s = df.agg(
        F.count(a).alias("n_first"), F.avg(a).alias("mean_first"), F.var_samp(a).alias("_va"),
        F.count(b).alias("n_second"), F.avg(b).alias("mean_second"), F.var_samp(b).alias("_vb"),
    )
    na, nb = F.col("n_first"), F.col("n_second")
    dof = na + nb - 2
    pooled = ((na - 1) * F.col("_va") + (nb - 1) * F.col("_vb")) / dof
    se = F.sqrt(pooled * (F.lit(1.0) / na + F.lit(1.0) / nb))
    out = s.select(
        "n_first", "mean_first", F.sqrt("_va").alias("sd_first"),
        "n_second", "mean_second", F.sqrt("_vb").alias("sd_second"),
        (F.col("mean_first") - F.col("mean_second")).alias("difference"),
        ((F.col("mean_first") - F.col("mean_second")) / se).alias("t"),
        dof.alias("dof"),
    )
    return out.withColumn("p_value", t_pvalue(F.col("t"), F.col("dof"))) if p_value else out


def paired_t(df: DataFrame, new: str, old: str, p_value: bool = True) -> DataFrame:
    d = F.col(new) - F.col(old)
    n = F.count(d)
    sd = F.stddev_samp(d)
    out = df.agg(
        F.avg(new).alias("mean_new"),
        F.avg(old).alias("mean_old"),
        F.avg(d).alias("mean_difference"),
        F.bool_and(d > 0).alias("all_positive"),
        n.alias("n"),
        F.when(sd > 0, F.avg(d) / (sd / F.sqrt(n.cast("double")))).alias("t"),
    )
    return out.withColumn("p_value", t_pvalue(F.col("t"), F.col("n") - 1)) if p_value else out


def percentile_interval(
    df: DataFrame, values: Sequence[str], by: Sequence[str] = (), level: float = 0.95
) -> DataFrame:
    """Mean and percentile interval of replicate statistics (one row per replicate)."""
    lo, hi = (1 - level) / 2, 1 - (1 - level) / 2
    long = df.unpivot(list(by), list(values), "metric", "value")
    q = F.percentile("value", F.array(F.lit(lo), F.lit(hi)))
    return (
        long.groupBy(*by, "metric")
        .agg(F.avg("value").alias("mean"), q.alias("_q"))
        .select(*by, "metric", "mean", F.col("_q")[0].alias("lo"), F.col("_q")[1].alias("hi"))
    )

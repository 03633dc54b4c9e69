"""Recode of resolved survey columns into one canonical table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions import recode as rc
from tidegauge.functions.codes import BINARY_COLUMNS, CATALOGUE, DESIGN_COLUMNS, NUMERIC_COLUMNS
from tidegauge.session import attach, small_table

LOGICAL = tuple(k for k in CATALOGUE if k != "survey_design")
CLEAN_COLUMNS = (
    "row_id", "wave", "employment", "y", "male", "married", "lgbtq", "veteran", "drug_use",
    "mental_health_tx", "criminal", "k6_score", "work_hours", "sick_days", "income",
    "education", "age", "overall_health", "health_insurance",
)


def select_logical(
    df: DataFrame, mapping: Mapping[str, str], wave: int, row_id: str = "row_id",
    design: Mapping[str, str] = DESIGN_COLUMNS,
) -> DataFrame:
    """Project one wave to the logical schema; absent variables become null doubles.

    Only the chosen physical columns are read.
    """
    have = set(df.columns)

    def pick(physical: str | None):
        if physical in have:
            return rc.numeric(F.col(physical))
        return F.lit(None).cast("double")

    ident = F.col(row_id) if row_id in have else F.lit(None)
    return df.select(
        ident.cast("bigint").alias("row_id"),
        F.lit(wave).cast("int").alias("wave"),
        *[pick(mapping.get(k)).alias(k) for k in LOGICAL],
        *[pick(v).alias(k) for k, v in design.items()],
    )


def recode(df: DataFrame) -> DataFrame:
    """Apply the recode rules to a logical table (any number of waves)."""
    c = F.col
    out = {k: rc.binary(c(k)) for k in BINARY_COLUMNS}
    out |= {k: rc.skip_to_null(c(k)) for k in NUMERIC_COLUMNS}
    kept = ("employment", "health_insurance")
    extra = [k for k in DESIGN_COLUMNS if k in df.columns]
    return df.select(
        "row_id",
        "wave",
        c("employment").cast("double").alias("employment"),
        out["suicide"].alias("y"),
        rc.equals_flag(c("sex"), 1).alias("male"),
        rc.married_flag(c("marital")).alias("married"),
        rc.orientation_flag(c("sexual_orientation")).alias("lgbtq"),
        rc.veteran_flag(c("military")).alias("veteran"),
        *[out[k].alias(k) for k in (*BINARY_COLUMNS[1:], *NUMERIC_COLUMNS)],
        c(kept[1]).cast("double").alias(kept[1]),
        *extra,
    )


def infer_employment(df: DataFrame) -> DataFrame:
    """Where a wave has no employment answer at all: employed when hours are positive."""
    known = small_table(df.groupBy("wave").agg(F.count("employment").alias("_known")))
    inferred = F.when(F.col("work_hours") > 0, F.lit(1.0))
    return (
        attach(df, known, ["wave"])
        .withColumn(
            "employment",
            F.when(F.coalesce("_known", F.lit(0)) == 0, inferred).otherwise(F.col("employment")),
        )
        .drop("_known")
    )


def clean_waves(
    frames: Mapping[int, DataFrame], mapping: Mapping[int, Mapping[str, str]], row_id: str = "row_id"
) -> DataFrame:
    """Select, recode and union all waves into one table with a wave column."""
    out = None
    for wave in sorted(frames):
        part = select_logical(frames[wave], mapping.get(wave, {}), wave, row_id)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no waves")
    table = recode(out)
    # a column that is absent stays null instead of turning into a zero flag
    for flag, source in (
        ("male", "sex"), ("married", "marital"), ("lgbtq", "sexual_orientation"),
        ("veteran", "military"),
    ):
        absent = [w for w in frames if source not in mapping.get(w, {})]
        if absent:
            table = table.withColumn(flag, F.when(~F.col("wave").isin(*absent), F.col(flag)))
    return infer_employment(table)


def rolling_age(df: DataFrame, by: str = "wave") -> DataFrame:
    """Age codes to midpoints in years; the coding is chosen by the wave's largest code."""
    top = small_table(df.groupBy(by).agg(F.max("age").alias("_top")))
    return (
        attach(df, top, [by]).withColumn("age", rc.age_midpoint(F.col("age"), F.col("_top"))).drop("_top")
    )


def complete_cases(df: DataFrame, columns) -> DataFrame:
    return df.na.drop(subset=list(columns))

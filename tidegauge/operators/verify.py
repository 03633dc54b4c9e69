"""Checks of result tables against expectations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tidegauge.session import local_rows

# Expected summary values and tolerances of the published nine-wave study.
EXPECTED = {
    "full_auc": (0.8721, 0.01),
    "same_year_mean": (0.750, 0.02),
    "cross_year_mean": (0.688, 0.02),
    "gap": (0.062, 0.02),
}
EXPECTED_TOTAL_N = 176957
EXPECTED_WAVES = tuple(range(2015, 2024))


def tolerance_checks(actual: DataFrame, expected: Mapping[str, tuple[float, float]]) -> DataFrame:
    """actual(metric, value) against {metric: (value, tolerance)}; an absent metric fails."""
    want = local_rows(
        actual.sparkSession,
        [(k, float(v), float(t)) for k, (v, t) in expected.items()],
        "metric string, expected double, tolerance double",
    )
    ok = F.abs(F.col("value") - F.col("expected")) <= F.col("tolerance")
    return want.join(actual.select("metric", "value"), "metric", "left").withColumn(
        "passed", F.coalesce(ok, F.lit(False))
    )


def exact_checks(grid: DataFrame, total_n: int, waves: Sequence[int]) -> DataFrame:
    """Total analytic N, wave set and grid completeness."""
    same = F.col("train_wave") == F.col("test_wave")
    facts = grid.agg(
        F.sum(F.when(same, F.col("n_total"))).cast("bigint").alias("n"),
        F.sort_array(F.collect_set("test_wave")).alias("w"),
        F.count("*").alias("cells"),
    )
    want = F.array(*[F.lit(w).cast("int") for w in sorted(waves)])
    checks = F.array(
        F.struct(F.lit("total_n").alias("check"), F.col("n").alias("found"),
                 (F.col("n") == total_n).alias("passed")),
        F.struct(F.lit("wave_set").alias("check"), F.size("w").cast("bigint").alias("found"),
                 (F.col("w") == want).alias("passed")),
        F.struct(F.lit("grid_cells").alias("check"), F.col("cells").alias("found"),
                 (F.col("cells") == len(waves) ** 2).alias("passed")),
    )
    return facts.select(F.explode(checks).alias("c")).select("c.*")


def missing_cells(grid: DataFrame, waves: Sequence[int]) -> DataFrame:
    """(train, test) pairs of the expected waves that the grid lacks."""
    pairs = local_rows(
        grid.sparkSession, [(a, b) for a in waves for b in waves], "train_wave int, test_wave int"
    )
    return pairs.join(grid, ["train_wave", "test_wave"], "left_anti")


def row_count_check(df: DataFrame, at_least: int) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), (F.count("*") >= at_least).alias("passed"))


def expected_counts(actual: DataFrame, expected: Mapping[int, int]) -> DataFrame:
    """actual(wave, n) against stored counts; reports, never raises."""
    want = local_rows(
        actual.sparkSession,
        [(int(k), int(v)) for k, v in expected.items()], "wave int, expected_n bigint"
    )
    return want.join(actual.select("wave", "n"), "wave", "full_outer").select(
        "wave", "expected_n", "n", F.coalesce(F.col("n") == F.col("expected_n"), F.lit(False)).alias("passed")
    )


def documented_vs_run(run: DataFrame, documented: DataFrame, keys: Sequence[str], tol: float = 0.003) -> DataFrame:
    """run(keys, auc) against documented(keys, auc)."""
    doc = documented.select(*keys, F.col("auc").alias("documented"))
    diff = F.col("auc") - F.col("documented")
    return run.join(doc, list(keys)).select(
        *keys, "auc", "documented", diff.alias("difference"), (F.abs(diff) < tol).alias("ok")
    )


def required_outputs(spark: SparkSession, present: Sequence[str], required: Sequence[str]) -> DataFrame:
    have = local_rows(spark, [(p, True) for p in present] or [("", True)], "name string, found boolean")
    want = local_rows(spark, [(r,) for r in required], "name string")
    return want.join(have, "name", "left").select(
        "name", F.coalesce("found", F.lit(False)).alias("found")
    )

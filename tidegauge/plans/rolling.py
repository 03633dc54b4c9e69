"""Pooled three-wave training against training on the last wave only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.codes import BASIC5
from tidegauge.operators import scorecard
from tidegauge.operators.boosting import fit_boosted
from tidegauge.operators.cells import WEIGHT
from tidegauge.operators.learners import fit_many
from tidegauge.operators.ranking import auc
from tidegauge.session import attach

SPAN = 3


def training_windows(cells: DataFrame, test_waves: Sequence[int], span: int = SPAN) -> DataFrame:
    """Send every training row to the test waves it serves: (strategy, test_wave, row).

    A row of wave w serves the tests w+1 .. w+span, so the window join is an explode of at
    most span + 1 entries and no row meets a test wave it does not serve.
    """
    allowed = F.array(*[F.lit(int(t)) for t in test_waves])
    served = F.array(
        *[
            F.struct(F.lit("rolling").alias("strategy"), (F.col("wave") + k).alias("test_wave"))
            for k in range(1, span + 1)
        ],
        F.struct(F.lit("single").alias("strategy"), (F.col("wave") + 1).alias("test_wave")),
    )
    return (
        cells.withColumn("_s", F.explode(served))
        .select("_s.*", *cells.columns)
        .filter(F.array_contains(allowed, F.col("test_wave")))
    )


def window_sizes(cells: DataFrame, test_waves: Sequence[int], span: int = SPAN) -> DataFrame:
    rows = training_windows(cells, test_waves, span)
    return rows.groupBy("strategy", "test_wave").agg(
        F.sum(WEIGHT).alias("n_train"),
        F.sum(F.when(F.col("y") == 1, F.col(WEIGHT)).otherwise(0)).alias("n_train_pos"),
    )


def scorecard_rolling(
    cells: DataFrame, test_waves: Sequence[int], features: Sequence[str] = BASIC5, span: int = SPAN
) -> DataFrame:
    """(strategy, test_wave, auc, sizes): every window fitted by one aggregation."""
    by = ["strategy", "test_wave"]
    model = scorecard.fit(training_windows(cells, test_waves, span), features, by=by, weight=WEIGHT)
    tests = (
        cells.withColumnRenamed("wave", "test_wave")
        .filter(F.col("test_wave").isin(*test_waves))
        .withColumn("strategy", F.explode(F.array(F.lit("rolling"), F.lit("single"))))
    )
    scored = scorecard.score(tests, model, features, by)
    result = auc(scored, "score", "y", by, WEIGHT).select(
        *by, "auc", F.col("n_total").alias("n_test"), F.col("n_positive").alias("n_test_pos")
    )
    return attach(result, window_sizes(cells, test_waves, span), by)


def boosted_rolling(cells: DataFrame, test_waves: Sequence[int], features: Sequence[str] = BASIC5, span: int = SPAN, rounds: int = 150) -> DataFrame:
    """The same comparison for boosted trees: every window of both strategies grown together."""
    by = ["strategy", "test_wave"]
    model = fit_boosted(training_windows(cells, test_waves, span), features, by, rounds=rounds)
    tests = (
        cells.withColumnRenamed("wave", "test_wave")
        .filter(F.col("test_wave").isin(*test_waves))
        .withColumn("strategy", F.explode(F.array(F.lit("rolling"), F.lit("single"))))
    )
    result = auc(model.score(tests), "score", "y", by, WEIGHT).select(
        *by, "auc", F.col("n_total").alias("n_test"), F.col("n_positive").alias("n_test_pos")
    )
    return attach(result, window_sizes(cells, test_waves, span), by)


def model_rolling(cells: DataFrame, test_waves: Sequence[int], fit, features=BASIC5, span: int = SPAN) -> DataFrame:
    """The same comparison for any learner (see plans.grid.model_grid)."""
    first = {(s, t): t - n for t in test_waves for s, n in (("rolling", span), ("single", 1))}
    models = fit_many(
        {
            (s, t): (lambda a=a, t=t: fit(cells.filter(F.col("wave").between(a, t - 1)), features))
            for (s, t), a in first.items()
        }
    )
    scored = None
    for (strategy, t), model in models.items():
        part = model.score(cells.filter(F.col("wave") == t)).select(
            F.lit(strategy).alias("strategy"), F.lit(t).alias("test_wave"), "y", WEIGHT, "score"
        )
        scored = part if scored is None else scored.unionByName(part)
    by = ["strategy", "test_wave"]
    result = auc(scored, "score", "y", by, WEIGHT).select(
        *by, "auc", F.col("n_total").alias("n_test"), F.col("n_positive").alias("n_test_pos")
    )
    return attach(result, window_sizes(cells, test_waves, span), by)


def paired(results: DataFrame) -> DataFrame:
    """One row per test wave with both AUCs."""
    return results.groupBy("test_wave").agg(
        F.max(F.when(F.col("strategy") == "rolling", F.col("auc"))).alias("rolling"),
        F.max(F.when(F.col("strategy") == "single", F.col("auc"))).alias("single"),
    )

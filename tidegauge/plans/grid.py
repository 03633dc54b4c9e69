"""Train-wave x test-wave grid.

One scan compresses the rows to cells; the fits, the thresholds and all train x test
evaluations then run on cells in one pass each, never one job per grid entry.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.codes import BASIC5
from tidegauge.functions.rates import rate_columns
from tidegauge.operators import scorecard
from tidegauge.operators.boosting import fit_boosted
from tidegauge.operators.cells import WEIGHT, analytic, compress
from tidegauge.operators.learners import fit_logistic_by, fit_many
from tidegauge.operators.ranking import best_f1_from_counts, metrics_from_counts
from tidegauge.plans.guards import estimable
from tidegauge.session import attach, cut_lineage, small_table

KEYS = ["train_wave", "test_wave"]


def evaluate_grid(counts: DataFrame, default_rates: str = "zero") -> DataFrame:
    """Grid metrics from (train_wave, test_wave, score, pos, neg).

    The threshold of a train wave is its max-F1 threshold on its own rows, so diagonal
    cells are in-sample.
    """
    own = counts.filter(F.col("train_wave") == F.col("test_wave")).drop("test_wave")
    best = best_f1_from_counts(own, ["train_wave"]).select("train_wave", "thr")
    marked = attach(counts, small_table(best), ["train_wave"])
    table = metrics_from_counts(marked, F.col("thr"), KEYS)
    rates = rate_columns(default_rates)
    return table.select(
        *KEYS,
        "auc",
        rates["sens"].alias("sensitivity"),
        rates["spec"].alias("specificity"),
        "n_positive",
        "n_total",
    )


def wave_cells(clean: DataFrame, features: Sequence[str], employed_only: bool = True) -> DataFrame:
    """Cells of the analytic rows, kept in the shared folder: the source is read once."""
    return cut_lineage(
        compress(analytic(clean, employed_only=employed_only), ["wave", *features, "y"])
    )


def estimable_waves(cells: DataFrame, features: Sequence[str]) -> list[int]:
    rows = estimable(cells, features, weight=WEIGHT).filter("estimable").select("wave").collect()
    return sorted(r["wave"] for r in rows)  # one row per wave


def _score_counts(scored: DataFrame) -> DataFrame:
    """(train, test, score) counts, kept in the shared folder: three steps read them."""
    y, w = F.col("y"), F.col(WEIGHT)
    counts = scored.groupBy(*KEYS, "score").agg(
        F.sum(F.when(y == 1, w).otherwise(0)).alias("pos"),
        F.sum(F.when(y == 0, w).otherwise(0)).alias("neg"),
    )
    return cut_lineage(counts)


def scorecard_grid(
    clean: DataFrame, features: Sequence[str] = BASIC5, employed_only: bool = True
) -> DataFrame:
    cells = wave_cells(clean, features, employed_only)
    waves = estimable_waves(cells, features)
    if not waves:
        raise ValueError("no wave can be fitted")
    model = scorecard.fit(cells, features, by=["wave"], weight=WEIGHT).withColumnRenamed(
        "wave", "train_wave"
    )
    scored = scorecard.score_all(
        cells.withColumnRenamed("wave", "test_wave"), model, features, "train_wave", waves
    )
    return evaluate_grid(_score_counts(scored))


def logistic_grid(
    clean: DataFrame, features: Sequence[str] = BASIC5, employed_only: bool = True
) -> DataFrame:
    """The grid for logistic regression: all waves fitted together, all pairs scored in one pass."""
    cells = wave_cells(clean, features, employed_only)
    waves = estimable_waves(cells, features)
    if not waves:
        raise ValueError("no wave can be fitted")
    model = fit_logistic_by(cells, features, "wave", waves)
    pairs = cells.withColumnRenamed("wave", "test_wave").withColumn("train_wave", F.explode(F.array(*map(F.lit, waves))))
    scored = pairs.withColumn("score", F.round(model.score(F.col("train_wave")), 9))
    return evaluate_grid(_score_counts(scored))


def boosted_grid(
    clean: DataFrame, features: Sequence[str] = BASIC5, employed_only: bool = True, rounds: int = 150
) -> DataFrame:
    """The grid for boosted trees: all waves grown together, all pairs scored in one pass."""
    cells = wave_cells(clean, features, employed_only)
    waves = estimable_waves(cells, features)
    if not waves:
        raise ValueError("no wave can be fitted")
    train = cells.filter(F.col("wave").isin(waves)).withColumnRenamed("wave", "train_wave")
    model = fit_boosted(train, features, ["train_wave"], rounds=rounds)
    kind = cells.schema["wave"].dataType
    pairs = cells.withColumnRenamed("wave", "test_wave").withColumn("train_wave", F.explode(F.array(*[F.lit(w).cast(kind) for w in waves])))
    return evaluate_grid(_score_counts(model.score(pairs)))


def model_grid(
    clean: DataFrame, fit: Callable[[DataFrame, Sequence[str]], object],
    features: Sequence[str] = BASIC5, employed_only: bool = True,
) -> DataFrame:
    """The same grid for any learner: ``fit(cells, features)`` returns an object with score(df).

    One fit per train wave; every fitted model scores the cells of all waves, and one
    aggregation evaluates the union.
    """
    cells = wave_cells(clean, features, employed_only)
    models = fit_many(
        {
            w: (lambda w=w: fit(cells.filter(F.col("wave") == w), features))
            for w in estimable_waves(cells, features)
        }
    )
    scored = None
    for wave, model in models.items():
        part = model.score(cells).select(
            F.lit(wave).alias("train_wave"), F.col("wave").alias("test_wave"), "y", WEIGHT, "score"
        )
        scored = part if scored is None else scored.unionByName(part)
    if scored is None:
        raise ValueError("no wave can be fitted")
    return evaluate_grid(_score_counts(scored))

"""Bootstrap intervals of score metrics.

Two forms with the same distribution. Row form: a Poisson(1) multiplicity per (row,
replicate), folded on the map side to (replicate, score) counts. Cell form: rows are first
reduced to (score, outcome) cells; the sum of n independent Poisson(1) counts is Poisson(n),
so one draw per (cell, replicate) replaces n draws.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.codes import NET_THRESHOLD
from tidegauge.functions.rates import rate_columns
from tidegauge.operators import nets, scorecard
from tidegauge.operators.boosting import fit_boosted
from tidegauge.operators.ranking import best_f1_from_counts, metrics_from_counts, score_counts
from tidegauge.operators.sampling import holdout, resample_weights
from tidegauge.session import attach, cut_lineage, small_table

METRICS = ("auc", "sens", "spec", "ppv", "npv")


def _metrics(counts: DataFrame, threshold: float) -> DataFrame:
    """Metrics per replicate from (replicate, score, pos, neg)."""
    table = metrics_from_counts(counts, F.lit(float(threshold)), ["replicate"])
    return table.select("replicate", "auc", *[c.alias(k) for k, c in rate_columns().items()])


def replicate_metrics(
    df: DataFrame, row_id: str, score: str, label: str, threshold: float, replicates: int,
    seed: int = 42,
) -> DataFrame:
    """Row form; any engine can reproduce the draws."""
    draws = resample_weights(df.select(row_id, score, label), row_id, replicates, seed)
    return _metrics(score_counts(draws, score, label, ["replicate"], "times"), threshold)


def replicate_metrics_by_cells(
    df: DataFrame, score: str, label: str, threshold: float, replicates: int, seed: int = 42
) -> DataFrame:
    """Cell form, for large tables: the work after one aggregation depends on cells only."""
    cells = score_counts(df, score, label).withColumn("_h", F.xxhash64("score"))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for h, s, pos, neg in zip(b["_h"], b["score"], b["pos"], b["neg"]):
                # the seed depends on the cell alone, so a retried task repeats its draws
                rng = np.random.default_rng([seed, h & 0xFFFFFFFFFFFFFFFF])
                yield pd.DataFrame(
                    {
                        "replicate": np.arange(replicates, dtype="int32"),
                        "score": np.full(replicates, s),
                        "pos": rng.poisson(pos, replicates),
                        "neg": rng.poisson(neg, replicates),
                    }
                )

    counts = cells.mapInPandas(draw, "replicate int, score double, pos bigint, neg bigint")
    return _metrics(counts.filter((F.col("pos") > 0) | (F.col("neg") > 0)), threshold)


def refit_scorecard(
    df: DataFrame, row_id: str, features: Sequence[str], label: str, replicates: int, seed: int = 42
) -> DataFrame:
    """(replicate, five metrics, n_positive, n_total): refit per replicate.

    All cards come from one aggregation and all evaluations from another. The threshold of a
    replicate is its max-F1 threshold on its own training rows.
    """
    parts = holdout(df, row_id, [label], seed)
    draws = resample_weights(parts, row_id, replicates, seed)
    cells = cut_lineage(draws.groupBy("replicate", "is_test", label, *features).agg(F.sum("times").alias("times")))
    model = scorecard.fit(cells.filter(~F.col("is_test")), features, label, ["replicate"], "times")
    return _evaluated(score_counts(scorecard.score(cells, model, features, ["replicate"]), "score", label, ["replicate", "is_test"], "times"))


def _evaluated(counts: DataFrame) -> DataFrame:
    """Test metrics per replicate from (replicate, is_test, score, pos, neg)."""
    scored = cut_lineage(counts)
    best = best_f1_from_counts(scored.filter(~F.col("is_test")).drop("is_test"), ["replicate"]).select("replicate", "thr")
    marked = attach(scored.filter("is_test").drop("is_test"), small_table(best), ["replicate"])
    table = metrics_from_counts(marked, F.col("thr"), ["replicate"])
    rates = [c.alias(k) for k, c in rate_columns().items()]
    return table.select("replicate", "auc", *rates, "n_positive", "n_total")


BLOCK = 25  # replicates that are drawn together


def cell_draws(
    df: DataFrame, row_id: str, features: Sequence[str], label: str, replicates: int, seed: int = 42
) -> DataFrame:
    """(replicate, is_test, label, features, times): resampled cells of a split table.

    Rows are split, then reduced to cells; a cell of n rows gets a Poisson(n) count in each
    replicate, which is the sum of its rows' Poisson(1) counts. Draws depend on the seed, the cell
    and the block of replicates alone, so a repeated task draws the same. Zeros are left out.
    """
    keys = ["is_test", label, *features]
    cells = small_table(holdout(df, row_id, [label], seed).groupBy(*keys).agg(F.count("*").alias("_n")))
    blocks = cells.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // BLOCK))))
    # floats of any kind hash alike on every machine; the block deals the work out
    named = blocks.withColumn("_h", F.xxhash64(*keys)).repartition("_block", "_h")
    schema = "replicate int, " + ", ".join(f"`{c}` {cells.schema[c].dataType.simpleString()}" for c in keys) + ", times bigint"

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, block, h = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("_n", "_block", "_h"))
            times = np.stack([np.random.default_rng([seed, int(x) & 0xFFFFFFFFFFFFFFFF, int(k)]).poisson(m, BLOCK) for m, k, x in zip(n, block, h)])
            replicate = block[:, None] * BLOCK + np.arange(BLOCK)
            cell, place = np.nonzero((times > 0) & (replicate < replicates))
            kept = b.select(keys).take(pa.array(cell))
            yield pa.RecordBatch.from_arrays(
                [pa.array(replicate[cell, place].astype(np.int32)), *kept.columns, pa.array(times[cell, place])], names=["replicate", *keys, "times"]
            )

    return cut_lineage(named.mapInArrow(draw, schema))


def refit_scorecard_by_cells(
    df: DataFrame, row_id: str, features: Sequence[str], label: str, replicates: int = 1000, seed: int = 42
) -> DataFrame:
    """The refit bootstrap from cells: after one aggregation nothing depends on the number of rows."""
    draws = cell_draws(df, row_id, features, label, replicates, seed)
    model = scorecard.fit(draws.filter(~F.col("is_test")), features, label, ["replicate"], "times")
    scored = scorecard.score(draws, model, features, ["replicate"])
    return _evaluated(score_counts(scored, "score", label, ["replicate", "is_test"], "times"))


def refit_boosted_by_cells(
    df: DataFrame, row_id: str, features: Sequence[str], label: str = "y", replicates: int = 1000, seed: int = 42, rounds: int = 150
) -> DataFrame:
    """The same for boosted trees: the models of all replicates grow together."""
    draws = cell_draws(df, row_id, features, label, replicates, seed)
    train = draws.filter(~F.col("is_test")).withColumn("y", F.col(label))
    model = fit_boosted(train, features, ["replicate"], "times", rounds)
    return _evaluated(score_counts(model.score(draws), "score", label, ["replicate", "is_test"], "times"))


def refit_nets_by_cells(
    df: DataFrame, row_id: str, features: Sequence[str], hidden: int = 5, replicates: int = 1000, seed: int = 42,
    rounds: int = nets.ROUNDS, threshold: float = NET_THRESHOLD,
) -> DataFrame:
    """The same for nets, at their fixed threshold: one job sums the gradients of all replicates."""
    draws = cell_draws(df, row_id, features, "y", replicates, seed)
    model = nets.fit_nets(draws.filter(~F.col("is_test")), {"net": nets.Shape(tuple(features), hidden)}, "replicate", "times", rounds, seed)
    scored = model.score(draws.filter("is_test"), "net")
    table = metrics_from_counts(score_counts(scored, "score", "y", ["replicate"], "times"), F.lit(threshold), ["replicate"])
    return table.select("replicate", "auc", *[c.alias(k) for k, c in rate_columns().items()], "n_positive", "n_total")

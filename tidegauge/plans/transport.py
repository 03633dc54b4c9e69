"""Prospective and leave-one-wave-out evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.codes import BASIC5
from tidegauge.operators import scorecard
from tidegauge.operators.boosting import fit_boosted
from tidegauge.operators.cells import WEIGHT
from tidegauge.operators.ranking import auc


def temporal_split(df: DataFrame, cut: int, wave: str = "wave") -> tuple[DataFrame, DataFrame]:
    return df.filter(F.col(wave) < cut), df.filter(F.col(wave) >= cut)


def leave_wave_out(df: DataFrame, held: int, wave: str = "wave") -> tuple[DataFrame, DataFrame]:
    return df.filter(F.col(wave) != held), df.filter(F.col(wave) == held)


def prospective(
    cells: DataFrame, cut: int, fit=None, features: Sequence[str] = BASIC5
) -> DataFrame:
    """Train on the waves before the cut, test on the others."""
    train, test = temporal_split(cells, cut)
    if fit is None:
        model = scorecard.fit(train, features, weight=WEIGHT)
        scored = scorecard.score(test, model, features)
    else:
        scored = fit(train, features).score(test)
    return auc(scored, "score", "y", weight=WEIGHT)


def leave_one_out_all(cells: DataFrame, waves: Sequence[int], features: Sequence[str] = BASIC5) -> DataFrame:
    """AUC of every wave under the card of all other waves.

    The cards come from one aggregation: counts of all waves minus the wave's own counts.
    """
    return auc(leave_one_out_scores(cells, waves, features), "score", "y", ["wave"], WEIGHT)


def leave_one_out_scores(cells: DataFrame, waves: Sequence[int], features: Sequence[str]) -> DataFrame:
    return scorecard.score(cells, scorecard.fit_excluding(cells, features, waves), features, ["wave"])


def boosted_leave_one_out(cells: DataFrame, waves: Sequence[int], features: Sequence[str] = BASIC5, rounds: int = 150) -> DataFrame:
    """Cells of every wave with the score of trees grown on all other waves, all waves together."""
    kind = cells.schema["wave"].dataType
    served = F.filter(F.array(*[F.lit(v).cast(kind) for v in waves]), lambda v: v != F.col("wave"))
    train = cells.filter(F.col("wave").isin(*waves)).withColumn("wave", F.explode(served))
    return fit_boosted(train, features, ["wave"], rounds=rounds).score(cells.filter(F.col("wave").isin(*waves)))

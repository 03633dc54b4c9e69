"""Weight-of-evidence scorecard: a risk score learned by one aggregation.

Each feature level scores log((n1 + 1/2)/(N1 + 1)) - log((n0 + 1/2)/(N0 + 1)); a level that
the training group never showed scores 0. One groupBy fits every training group at once,
and scoring against all of them is one equi-join per feature on the level.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.session import attach, small_table

SCORE_DIGITS = 9


def _woe() -> Column:
    return F.log((F.col("n1") + F.lit(0.5)) / (F.col("total1") + F.lit(1.0))) - F.log(
        (F.col("n0") + F.lit(0.5)) / (F.col("total0") + F.lit(1.0))
    )


def fit(
    df: DataFrame, features: Sequence[str], label: str = "y", by: Sequence[str] = (),
    weight: str | None = None,
) -> DataFrame:
    """(by, feature, level, n1, n0, woe); a missing answer is a level of its own (null)."""
    by = list(by)
    w = F.col(weight) if weight else F.lit(1)
    y = F.col(label)
    pairs = F.explode(
        F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("level")) for f in features])
    ).alias("p")
    levels = (
        df.select(*by, F.when(y == 1, w).otherwise(w * 0).alias("_p"),
                  F.when(y == 0, w).otherwise(w * 0).alias("_n"), pairs)
        .groupBy(*by, F.col("p.feature").alias("feature"), F.col("p.level").alias("level"))
        .agg(F.sum("_p").cast("bigint").alias("n1"), F.sum("_n").cast("bigint").alias("n0"))
    )
    totals = (
        levels.filter(F.col("feature") == features[0])
        .groupBy(*by)
        .agg(F.sum("n1").alias("total1"), F.sum("n0").alias("total0"))
    )
    return attach(levels, totals, by).select(
        *by,
        "feature",
        "level",
        "n1",
        "n0",
        _woe().alias("woe"),
    )


def score(
    df: DataFrame, model: DataFrame, features: Sequence[str], by: Sequence[str] = (),
    out: str = "score",
) -> DataFrame:
    """Add the score of the card of each row's group (one card when ``by`` is empty)."""
    by = list(by)
    model = small_table(model.select(*by, "feature", "level", "woe"))
    total = F.lit(0.0)
    for f in features:
        card = model.filter(F.col("feature") == f).select(
            *by, F.col("level").alias(f), F.col("woe").alias(f"_w_{f}")
        )
        df = attach(df, card, [*by, f])
        total = total + F.coalesce(F.col(f"_w_{f}"), F.lit(0.0))
    return df.withColumn(out, F.round(total, SCORE_DIGITS)).drop(*[f"_w_{f}" for f in features])


def score_all(
    df: DataFrame, model: DataFrame, features: Sequence[str], group: str, groups: Sequence[int],
) -> DataFrame:
    """Score every row with every group's card: one output row per (row, group).

    The cards are pivoted to one array of weights per level, so a row meets all cards
    through one lookup per feature.
    """
    groups = list(groups)
    arrays = (
        model.groupBy("feature", "level")
        .agg(F.map_from_entries(F.collect_list(F.struct(group, "woe"))).alias("m"))
        .select(
            "feature",
            "level",
            F.array(*[F.coalesce(F.try_element_at("m", F.lit(g)), F.lit(0.0)) for g in groups]).alias("a"),
        )
    )
    arrays = small_table(arrays)
    parts = []
    for f in features:
        card = arrays.filter(F.col("feature") == f).select(
            F.col("level").alias(f), F.col("a").alias(f"_a_{f}")
        )
        df = attach(df, card, [f])
        parts.append(f"_a_{f}")

    def at(i: int):
        total = F.lit(0.0)
        for p in parts:
            total = total + F.coalesce(F.col(p)[i], F.lit(0.0))
        return F.struct(F.lit(groups[i]).alias(group), F.round(total, SCORE_DIGITS).alias("score"))

    scored = df.withColumn("_s", F.explode(F.array(*[at(i) for i in range(len(groups))])))
    return scored.select(
        *[c for c in df.columns if c not in parts], F.col("_s")[group].alias(group), F.col("_s.score").alias("score")
    )


def fit_excluding(
    df: DataFrame, features: Sequence[str], waves: Sequence[int], label: str = "y",
    weight: str = "w", by: str = "wave",
) -> DataFrame:
    """One card per wave, fitted on all other waves, from a single pass over the rows."""
    own = fit(df, features, label, [by], weight)
    served = F.filter(F.array(*[F.lit(int(v)) for v in waves]), lambda v: v != F.col(by))
    shared = (
        own.withColumn("_to", F.explode(served))
        .groupBy(F.col("_to").alias(by), "feature", "level")
        .agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    )
    totals = (
        shared.filter(F.col("feature") == features[0])
        .groupBy(by)
        .agg(F.sum("n1").alias("total1"), F.sum("n0").alias("total0"))
    )
    return attach(shared, totals, [by]).withColumn("woe", _woe()).drop("total1", "total0")

"""Shapley attribution of any fitted score, on cells.

The worth of a set S of features for a cell is the mean score of the cell with the features outside
S taken from a background table. Each cell meets all 2^k sets and all background rows in one scan;
the sums per cell are combined inside the task that made them, so the shuffle carries k + 2 numbers
a cell. Nothing is sampled: the parts of a cell add up to its score minus the background's.

Cells are few bytes and much work, so they are dealt to tasks by their number and not by their size.
A model that can score all sets of a cell at once (``shapley_by_sets``) makes no row for a set.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.operators.cells import WEIGHT
from tidegauge.operators.prep import medians
from tidegauge.session import cut_lineage

Score = Callable[[DataFrame], DataFrame]
SetScores = Callable[[np.ndarray, np.ndarray], np.ndarray]
SCORES_PER_TASK = 1 << 20  # a cell has a score for every set and background row
SCORES_AT_ONCE = 1 << 20  # scores that a task holds at a time
MOST_FEATURES = 16  # 65,536 sets a cell


def set_weights(k: int) -> tuple[list[float], list[float]]:
    """By size of a set: its weight for a feature inside it, and for a feature outside it."""
    inside = [0.0] + [math.factorial(s - 1) * math.factorial(k - s) / math.factorial(k) for s in range(1, k + 1)]
    outside = [math.factorial(s) * math.factorial(k - s - 1) / math.factorial(k) for s in range(k)] + [0.0]
    return inside, outside


def background_medians(
    cells: DataFrame, features: Sequence[str], by: Sequence[str] = (), weight: str = WEIGHT
) -> list[tuple[float, list[float | None]]]:
    """(rows, medians) of each group: a background whose size is the number of groups."""
    by = list(by)
    rows = cells if by else cells.withColumn("_one", F.lit(0))
    by = by or ["_one"]
    middle = medians(rows, features, by, weight)
    sizes = rows.groupBy(*by).agg(F.sum(weight).alias("_n")).select(*[F.col(c).alias(f"_g_{c}") for c in by], "_n")
    both = [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in by]
    joined = sizes.join(middle, both, "left").orderBy(*[f"_g_{c}" for c in by])
    return [(float(r["_n"]), [r[f] for f in features]) for r in joined.collect()]  # one row per group


def _checked(features: list[str], background: Sequence[tuple[float, Sequence[float | None]]]) -> float:
    """Weight of the background."""
    if not 0 < len(features) <= MOST_FEATURES:
        raise ValueError(f"1 to {MOST_FEATURES} features are needed, not {len(features)}")
    total = float(sum(w for w, _ in background))
    if total <= 0:
        raise ValueError("the background has no weight")
    return total


def _dealt(cells: DataFrame, features: list[str], weight: str, background: int) -> DataFrame:
    """(features, _tg_w) of every distinct vector, dealt to tasks by the number of scores to come."""
    values = [F.col(f).cast("double").alias(f) for f in features]
    distinct = cut_lineage(cells.select(weight, *values).groupBy(*features).agg(F.sum(weight).alias("_tg_w")))
    tasks = -(-distinct.count() * background * (1 << len(features)) // SCORES_PER_TASK)
    return distinct.repartition(max(1, tasks), *features)


def shapley_by_sets(
    cells: DataFrame, features: Sequence[str], score: SetScores,
    background: Sequence[tuple[float, Sequence[float | None]]], weight: str = WEIGHT,
) -> DataFrame:
    """``shapley`` for a model whose ``score(values, other)`` gives cells x 2^k scores, those of the
    sets in order, features outside a set taken from the row ``other``; missing values are NaN."""
    features, k = list(features), len(features)
    total = _checked(features, background)
    distinct = _dealt(cells, features, weight, len(background))
    others = [(w / total, np.array([np.nan if v is None else v for v in values], float)) for w, values in background]
    inside, outside = map(np.array, set_weights(k))
    sets = np.arange(1 << k)
    has = (sets[:, None] >> np.arange(k)) & 1
    size = has.sum(1)[:, None]
    weights = np.where(has, inside[size], -outside[size])
    names, step = ["base", "score", *[f"phi_{f}" for f in features]], max(1, SCORES_AT_ONCE >> k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                own = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(k)], 1)
                worth = sum(share * score(own, other) for share, other in others)
                columns = [worth[:, 0], worth[:, -1], *(worth @ weights).T]
                yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(np.ascontiguousarray(c)) for c in columns]], names=[*features, weight, *names])

    held = distinct.select(*features, F.col("_tg_w").alias(weight))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema.fields) + "".join(f", `{n}` double" for n in names)
    return held.mapInArrow(run, schema)


def shapley(
    cells: DataFrame, features: Sequence[str], score: Score,
    background: Sequence[tuple[float, Sequence[float | None]]], weight: str = WEIGHT,
) -> DataFrame:
    """(features, weight, base, score, phi_<feature>) for every distinct vector of the features.

    ``score`` adds the column ``score`` to a frame and keeps its other columns. ``base`` is the mean
    score of the background, (weight, values) pairs; the phi of a row add up to score - base. Missing
    values, in cells or background, reach ``score`` as they are.
    """
    features, k = list(features), len(features)
    total = _checked(features, background)
    distinct = _dealt(cells, features, weight, len(background))
    rows = F.array(*[
        F.struct(F.lit(w / total).alias("share"), *[F.lit(v).cast("double").alias(f"v{j}") for j, v in enumerate(values)])
        for w, values in background
    ])
    sets = F.explode(F.sequence(F.lit(0), F.lit((1 << k) - 1)))
    held = {f"_own{j}": F.col(f) for j, f in enumerate(features)}
    wide = distinct.select("_tg_w", *[c.alias(n) for n, c in held.items()], sets.alias("_set")).withColumn("_row", F.explode(rows))

    def has(j: int):
        return F.col("_set").bitwiseAND(F.lit(1 << j)) != 0

    mixed = wide.select(
        "_tg_w", *held, "_set", F.col("_row.share").alias("_share"),
        *[F.when(has(j), F.col(f"_own{j}")).otherwise(F.col(f"_row.v{j}")).alias(f) for j, f in enumerate(features)],
    )
    inside, outside = (F.array(*[F.lit(x) for x in w]) for w in set_weights(k))
    size = F.bit_count("_set")
    worth = F.col("score") * F.col("_share")
    parts = [
        F.sum(worth * F.when(has(j), inside[size]).otherwise(-outside[size])).alias(f"phi_{f}") for j, f in enumerate(features)
    ]
    ends = [F.sum(F.when(F.col("_set") == s, worth).otherwise(0.0)).alias(n) for s, n in ((0, "base"), ((1 << k) - 1, "score"))]
    found = score(mixed).groupBy(*held, "_tg_w").agg(*ends, *parts)
    return found.select(*[F.col(n).alias(f) for n, f in zip(held, features)], F.col("_tg_w").alias(weight), "base", "score", *[f"phi_{f}" for f in features])


def shapley_summary(table: DataFrame, features: Sequence[str], weight: str = WEIGHT) -> DataFrame:
    """(feature, mean_abs, mean): over rows, how much a feature moves the score, and which way."""
    w = F.col(weight)
    sums = F.array(*[
        F.struct(
            F.lit(f).alias("feature"), (F.sum(w * F.abs(f"phi_{f}")) / F.sum(w)).alias("mean_abs"), (F.sum(w * F.col(f"phi_{f}")) / F.sum(w)).alias("mean")
        )
        for f in features
    ])
    return table.agg(sums.alias("_s")).select(F.explode("_s").alias("_e")).select("_e.*")

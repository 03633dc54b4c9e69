"""Exact rank statistics of scores without a single-task sort.

Rows are first reduced to one row per (group, score). Each score has a monotone bin, so a
running total over a group splits into a local window inside (group, bin) and a window over
the bin totals. A group of any size is spread over its bins; the per-group window only sees
bin totals, whose number is bounded by the bin function, not by the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.rates import ratio, score_bin
from tidegauge.session import attach


def score_counts(
    df: DataFrame, score: str, label: str, by: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """One row per (by, score) with pos and neg counts; the map side combines ties."""
    w = F.col(weight) if weight else F.lit(1)
    y = F.col(label)
    return (
        df.filter(y.isin(0, 1) & F.col(score).isNotNull())
        .groupBy(*by, F.col(score).alias("score"))
        .agg(
            F.sum(F.when(y == 1, w).otherwise(w * 0)).alias("pos"),
            F.sum(F.when(y == 0, w).otherwise(w * 0)).alias("neg"),
        )
    )


def auc_from_counts(
    counts: DataFrame, by: Sequence[str] = (), carry: Sequence[str] = ()
) -> DataFrame:
    """Tie-corrected AUC of (by, score, pos, neg); null when a class is missing.

    Columns in ``carry`` are summed per group on the way, which saves a join.
    """
    by = list(by)
    binned = counts.select(
        *by,
        "score",
        score_bin(F.col("score")).alias("_bin"),
        F.col("pos").cast("double").alias("pos"),
        F.col("neg").cast("double").alias("neg"),
        *carry,
    )
    lower = (
        Window.partitionBy(*by, "_bin")
        .orderBy("score")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    bins = (
        binned.withColumn("_below", F.coalesce(F.sum("neg").over(lower), F.lit(0.0)))
        .groupBy(*by, "_bin")
        .agg(
            F.sum(F.col("pos") * (F.col("_below") + F.col("neg") / 2)).alias("_u"),
            F.sum("pos").alias("_p"),
            F.sum("neg").alias("_n"),
            *[F.sum(c).alias(c) for c in carry],
        )
    )
    before = (
        Window.partitionBy(*(by or [F.lit(0)]))
        .orderBy("_bin")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    totals = bins.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0.0)))
    pairs = F.sum("_p") * F.sum("_n")
    return totals.groupBy(*by).agg(
        F.when(pairs > 0, F.sum(F.col("_u") + F.col("_p") * F.col("_before")) / pairs).alias("auc"),
        F.sum("_p").cast("bigint").alias("n_positive"),
        F.sum(F.col("_p") + F.col("_n")).cast("bigint").alias("n_total"),
        *[F.sum(c).alias(c) for c in carry],
    )


def metrics_from_counts(
    counts: DataFrame, threshold: Column, by: Sequence[str] = ()
) -> DataFrame:
    """AUC and confusion counts at a threshold, from (by, score, pos, neg), in one pass."""
    hit = F.col("score") >= threshold
    zero = F.lit(0).cast("bigint")
    marked = counts.select(
        *by, "score", "pos", "neg",
        F.when(hit, F.col("pos")).otherwise(zero).alias("tp"),
        F.when(hit, F.col("neg")).otherwise(zero).alias("fp"),
    )
    area = auc_from_counts(marked, by, ["tp", "fp"])
    return area.withColumns(
        {
            "fn": F.col("n_positive") - F.col("tp"),
            "tn": F.col("n_total") - F.col("n_positive") - F.col("fp"),
        }
    )


def auc(
    df: DataFrame, score: str, label: str, by: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    return auc_from_counts(score_counts(df, score, label, by, weight), by)


def running_counts(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Add counts at or above each score, and the counts of the next lower score.

    Columns: by, score, pos, neg, tp, fp (running from the top), next_pos, next_neg,
    total_pos, total_neg.
    """
    by = list(by)
    binned = counts.withColumn("_bin", score_bin(F.col("score")))
    bins = binned.groupBy(*by, "_bin").agg(
        F.sum("pos").alias("_bp"),
        F.sum("neg").alias("_bn"),
        F.max_by(F.struct("pos", "neg"), F.col("score")).alias("_top"),
    )
    group = Window.partitionBy(*(by or [F.lit(0)]))
    down = group.orderBy(F.desc("_bin"))
    above = down.rowsBetween(Window.unboundedPreceding, -1)
    offsets = bins.select(
        *by,
        "_bin",
        F.coalesce(F.sum("_bp").over(above), F.lit(0)).alias("_op"),
        F.coalesce(F.sum("_bn").over(above), F.lit(0)).alias("_on"),
        F.lead("_top").over(down).alias("_next_top"),
        F.sum("_bp").over(group).alias("total_pos"),
        F.sum("_bn").over(group).alias("total_neg"),
    )
    inside = Window.partitionBy(*by, "_bin").orderBy(F.desc("score"))
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = binned.select(
        *by,
        "_bin",
        "score",
        "pos",
        "neg",
        F.sum("pos").over(upto).alias("_lp"),
        F.sum("neg").over(upto).alias("_ln"),
        F.lead(F.struct("pos", "neg")).over(inside).alias("_next_in"),
    )
    nxt = F.coalesce("_next_in", "_next_top")
    return attach(local, offsets, [*by, "_bin"], "inner").select(
        *by,
        "score",
        "pos",
        "neg",
        (F.col("_lp") + F.col("_op")).alias("tp"),
        (F.col("_ln") + F.col("_on")).alias("fp"),
        nxt["pos"].alias("next_pos"),
        nxt["neg"].alias("next_neg"),
        "total_pos",
        "total_neg",
    )


def roc_curve(
    df: DataFrame,
    score: str,
    label: str,
    by: Sequence[str] = (),
    weight: str | None = None,
    drop_intermediate: bool = True,
) -> DataFrame:
    """ROC points by falling threshold, with the (0, 0) start whose threshold is null (+inf).

    A point is dropped when the step into it equals the step out of it in both counts; the
    first and the last point always stay.
    """
    by = list(by)
    run = running_counts(score_counts(df, score, label, by, weight), by)
    if drop_intermediate:
        first = (F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))
        bend = (F.col("pos") != F.col("next_pos")) | (F.col("neg") != F.col("next_neg"))
        run = run.filter(F.col("next_pos").isNull() | bend | first)
    point = F.struct(
        ratio(F.col("fp"), F.col("total_neg"), "null").alias("fpr"),
        ratio(F.col("tp"), F.col("total_pos"), "null").alias("tpr"),
        F.col("score").alias("thr"),
    )
    start = F.struct(
        F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), F.lit(None).cast("double").alias("thr")
    )
    # The start point rides along with the last point of each group: no second pass.
    pair = F.when(F.col("next_pos").isNull(), F.array(point, start)).otherwise(F.array(point))
    points = run.select(*by, F.explode(pair).alias("p"))
    return points.select(*by, "p.fpr", "p.tpr", "p.thr")


def curve_area(
    df: DataFrame, score: str, label: str, by: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """Trapezoid area under the ROC curve; every strip comes from one row of running counts."""
    run = running_counts(score_counts(df, score, label, by, weight), by)
    strip = F.col("neg") * (F.col("tp") - F.col("pos") / 2.0)
    total = F.max("total_pos").cast("double") * F.max("total_neg")
    return run.groupBy(*by).agg(F.when(total > 0, F.sum(strip) / total).alias("area"))


def pr_curve(
    df: DataFrame, score: str, label: str, by: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """Precision and recall at every distinct score."""
    run = running_counts(score_counts(df, score, label, by, weight), by)
    return run.select(
        *by,
        F.col("score").alias("thr"),
        ratio(F.col("tp"), F.col("tp") + F.col("fp"), "null").alias("precision"),
        ratio(F.col("tp"), F.col("total_pos"), "null").alias("recall"),
    )


def best_f1_from_counts(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Threshold with the largest F1; among equals the lowest."""
    run = running_counts(counts, by)
    f1 = F.coalesce(
        (2 * F.col("tp")).cast("double")
        / (F.col("tp") + F.col("fp") + F.col("total_pos")).cast("double"),
        F.lit(0.0),
    )
    return (
        run.withColumn("f1", f1)
        .groupBy(*by)
        .agg(
            F.max_by("score", F.struct(F.col("f1"), (-F.col("score")).alias("s"))).alias("thr"),
            F.max("f1").alias("f1"),
        )
    )


def best_f1(
    df: DataFrame, score: str, label: str, by: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    return best_f1_from_counts(score_counts(df, score, label, by, weight), by)


def quantiles(
    df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (),
    weight: str | None = None,
) -> DataFrame:
    """Exact linear-interpolation quantiles of a column with any number of distinct values.

    Returns (by, prob, value). The rank search runs on the running counts, so no task holds
    a group's values. For columns with few codes ``percentile`` is the cheaper choice.
    """
    by = list(by)
    w = F.col(weight) if weight else F.lit(1)
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).cast("double").alias("score"))
        .agg(F.sum(w).alias("pos"))
        .withColumn("neg", F.lit(0).cast("bigint"))
    )
    run = running_counts(counts, by)
    # tp counts values >= score; ranks are 0-based from the bottom.
    n = F.col("total_pos")
    upper = n - F.col("tp") + F.col("pos")
    lower = n - F.col("tp")
    probe = F.array(
        *[
            F.struct(
                F.lit(float(q)).alias("prob"),
                F.floor((n - 1) * F.lit(float(q))).alias("lo"),
                F.ceil((n - 1) * F.lit(float(q))).alias("hi"),
                ((n - 1) * F.lit(float(q)) - F.floor((n - 1) * F.lit(float(q)))).alias("frac"),
            )
            for q in probs
        ]
    )

    def holds(rank: Column) -> Column:
        return (rank >= F.col("_from")) & (rank < F.col("_to"))

    hits = (
        run.withColumn("_from", lower)
        .withColumn("_to", upper)
        .select(
            *by,
            "score",
            "_from",
            "_to",
            F.explode(F.filter(probe, lambda p: holds(p["lo"]) | holds(p["hi"]))).alias("p"),
        )
    )
    return (
        hits.groupBy(*by, F.col("p.prob").alias("prob"))
        .agg(
            F.max(F.when(holds(F.col("p.lo")), F.col("score"))).alias("_lo"),
            F.max(F.when(holds(F.col("p.hi")), F.col("score"))).alias("_hi"),
            F.max("p.frac").alias("_f"),
        )
        .select(
            *by, "prob", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_f")).alias("value")
        )
    )

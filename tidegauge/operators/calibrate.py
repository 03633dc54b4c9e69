"""Calibration: cross-fitted sigmoid calibration, statistics and recalibration."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions.recode import logit
from tidegauge.operators.boosting import GroupedTrees, fit_boosted
from tidegauge.operators.cells import WEIGHT
from tidegauge.operators.learners import Fitted, assemble, fit_many
from tidegauge.operators.ranking import auc, auc_from_counts, score_counts
from tidegauge.session import attach, cut_lineage, local_rows


def _sigmoid_fit(df: DataFrame, weight: str) -> tuple[float, float]:
    """Sigmoid on a score with smoothed targets.

    A positive counts as (N1 + 1)/(N1 + 2) of a case, a negative as 1/(N0 + 2); each row is
    entered once per class with that share of its weight.
    """
    w = F.col(weight).cast("double")
    r = df.agg(
        F.sum(F.when(F.col("y") == 1, w)).alias("p"), F.sum(F.when(F.col("y") == 0, w)).alias("n")
    ).first()
    n1, n0 = float(r["p"] or 0), float(r["n"] or 0)
    target = F.when(F.col("y") == 1, F.lit((n1 + 1) / (n1 + 2))).otherwise(F.lit(1 / (n0 + 2)))
    sides = F.explode(
        F.array(
            F.struct(F.lit(1.0).alias("label"), (w * target).alias("_w")),
            F.struct(F.lit(0.0).alias("label"), (w * (1 - target)).alias("_w")),
        )
    )
    rows = assemble(df.select("score", sides.alias("s")).select("score", "s.*"), ["score"])
    m = LogisticRegression(weightCol="_w", maxIter=100, tol=1e-9).fit(rows.select("features", "label", "_w"))
    return float(m.intercept), float(m.coefficients[0])


CURVES = "part int, a double, b double"


@dataclass
class Calibrated:
    """Mean of the calibrated fold models."""

    parts: list[tuple[Fitted, float, float]]

    def score(self, df: DataFrame, out: str = "score") -> DataFrame:
        keep = df.columns
        total = F.lit(0.0)
        for i, (fitted, a, b) in enumerate(self.parts):
            df = fitted.score(df, f"_p{i}")
            total = total + _sigmoid(F.lit(a) + F.lit(b) * F.col(f"_p{i}"))
        return df.withColumn(out, total / len(self.parts)).select(*keep, out)

    def save(self, path: str) -> str:
        for i, (fitted, _, _) in enumerate(self.parts):
            fitted.save(f"{path}/part{i}")
        curves = [(i, a, b) for i, (_, a, b) in enumerate(self.parts)]
        local_rows(SparkSession.active(), curves, CURVES).write.mode("overwrite").parquet(f"{path}/curves")
        return path

    @classmethod
    def load(cls, path: str) -> Calibrated:
        curves = sorted(SparkSession.active().read.schema(CURVES).parquet(f"{path}/curves").collect())  # one row per part
        return cls([(Fitted.load(f"{path}/part{r['part']}"), r["a"], r["b"]) for r in curves])

    def fold_auc(self, cells: DataFrame, fold: str = "fold", weight: str = WEIGHT) -> DataFrame:
        """(fold, auc) of each fold's model on the fold it did not see."""
        scored = None
        for i, (fitted, _, _) in enumerate(self.parts):
            part = fitted.score(cells.filter(F.col(fold) == i)).select(F.lit(i).alias(fold), "y", weight, "score")
            scored = part if scored is None else scored.unionByName(part)
        return auc(scored, "score", "y", [fold], weight).select(fold, "auc")


def _sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def fit_calibrated(
    cells: DataFrame, features: Sequence[str], fit: Callable[[DataFrame, Sequence[str]], Fitted],
    fold: str = "fold", k: int = 5, weight: str = WEIGHT,
) -> Calibrated:
    """k models, each fitted without one fold and calibrated on that fold."""

    def part(i: int) -> tuple[Fitted, float, float]:
        model = fit(cells.filter(F.col(fold) != i), features)
        held = model.score(cells.filter(F.col(fold) == i)).groupBy("score", "y").agg(
            F.sum(weight).alias(weight)
        )
        return model, *_sigmoid_fit(cut_lineage(held), weight)

    parts = fit_many({i: (lambda i=i: part(i)) for i in range(k)})
    return Calibrated([parts[i] for i in range(k)])


def sigmoid_by(counts: DataFrame, by: Sequence[str], rounds: int = 60, tol: float = 1e-10) -> dict[tuple, tuple[float, float]]:
    """(intercept, slope) of the sigmoid on a score with smoothed targets, for every group of ``by``.

    ``counts`` has (by, score, pos, neg). Newton steps for all groups at once, one aggregation a
    step; a step that raises a group's loss is halved. Groups of one class get slope 0.
    """
    by, counts = list(by), cut_lineage(counts)
    kinds = ", ".join(f"`{c}` {counts.schema[c].dataType.simpleString()}" for c in by)
    sums = counts.groupBy(*by).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).collect()  # one row per group
    sizes = {tuple(r[c] for c in by): (float(r["p"]), float(r["n"])) for r in sums}
    now = {g: (math.log((p + 1) / (n + 1)), 0.0) for g, (p, n) in sizes.items()}
    last: dict[tuple, tuple[float, float]] = {}
    losses: dict[tuple, float] = {}
    eta = F.col("_a") + F.col("_b") * F.col("score")
    q, n = _sigmoid(eta), F.col("pos") + F.col("neg")
    hits = F.col("pos") * F.col("_t1") + F.col("neg") * F.col("_t0")
    r, h = hits - n * q, n * q * (1 - q)
    loss = n * (F.greatest(eta, F.lit(0.0)) + F.log1p(F.exp(-F.abs(eta)))) - hits * eta
    parts = {"l": loss, "g0": r, "g1": r * F.col("score"), "h00": h, "h01": h * F.col("score"), "h11": h * F.col("score") * F.col("score")}
    for _ in range(rounds):
        rows = [(*g, *now[g], (p + 1) / (p + 2), 1 / (m + 2)) for g, (p, m) in sizes.items()]
        table = local_rows(counts.sparkSession, rows, kinds + ", _a double, _b double, _t1 double, _t0 double")
        moved = 0.0
        for s in attach(counts, table, by, "inner").groupBy(*by).agg(*[F.sum(c).alias(k) for k, c in parts.items()]).collect():
            g = tuple(s[c] for c in by)
            if g in losses and s["l"] > losses[g] * (1 + 1e-13) + 1e-13:
                now[g] = tuple((x + y) / 2 for x, y in zip(last[g], now[g]))
                moved = max(moved, *(abs(x - y) for x, y in zip(last[g], now[g])))
                continue
            info = np.array([[s["h00"], s["h01"]], [s["h01"], s["h11"]]])
            step = np.linalg.lstsq(info, np.array([s["g0"], s["g1"]]), rcond=1e-12)[0]
            last[g], losses[g] = now[g], s["l"]
            now[g] = (now[g][0] + float(step[0]), now[g][1] + float(step[1]))
            moved = max(moved, float(np.abs(step).max()))
        if moved < tol:
            break
    return now


@dataclass
class GroupedCalibrated:
    """For each group of ``by`` the mean of k boosted models, each calibrated on the fold it did not see."""

    model: GroupedTrees
    by: list[str]
    curves: dict[tuple, tuple[float, float]]  # (group..., part)
    k: int

    def score(self, df: DataFrame, out: str = "score") -> DataFrame:
        keep = [c for c in df.columns if c != out]
        kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in self.by)
        curves = [f"_{x}{i}" for i in range(self.k) for x in "ab"]
        groups = sorted({g[:-1] for g in self.curves})
        rows = [(*g, *(v for i in range(self.k) for v in self.curves[*g, i])) for g in groups]
        df = attach(df, local_rows(df.sparkSession, rows, kinds + "".join(f", {c} double" for c in curves)), self.by, "inner")
        total = F.lit(0.0)
        for i in range(self.k):
            df = self.model.score(df.withColumn("_part", F.lit(i)), f"_p{i}").drop("_part")
            total = total + _sigmoid(F.col(f"_a{i}") + F.col(f"_b{i}") * F.col(f"_p{i}"))
        return df.select(*keep, (total / self.k).alias(out))

    def held_out(self, cells: DataFrame, fold: str = "fold") -> DataFrame:
        """Cells with the uncalibrated score of the model that did not see them."""
        return self.model.score(cells.withColumn("_part", F.col(fold)))

    def fold_auc(self, cells: DataFrame, fold: str = "fold", weight: str = WEIGHT) -> DataFrame:
        """(by, fold, auc) of each fold under the model that did not see it."""
        return auc(self.held_out(cells, fold), "score", "y", [*self.by, fold], weight).select(*self.by, fold, "auc")


def fit_calibrated_by(
    cells: DataFrame, features: Sequence[str], by: Sequence[str], fold: str = "fold", k: int = 5, weight: str = WEIGHT, rounds: int = 150
) -> GroupedCalibrated:
    """Boosted trees of all groups and folds in one fit, then all sigmoids in one.

    ``cells`` has (by, fold, features, y, weight); each cell serves the k - 1 parts of other folds.
    """
    by = list(by)
    served = F.explode(F.filter(F.array(*map(F.lit, range(k))), lambda i: i != F.col(fold)))
    model = fit_boosted(cells.withColumn("_part", served), features, [*by, "_part"], weight, rounds)
    found = GroupedCalibrated(model, by, {}, k)
    held = found.held_out(cells, fold).withColumnRenamed(fold, "_fold")
    found.curves = sigmoid_by(score_counts(held, "score", "y", [*by, "_fold"], weight), [*by, "_fold"])
    return found


def cross_validated_auc(
    cells: DataFrame, features: Sequence[str], fit: Callable[[DataFrame, Sequence[str]], Fitted],
    fold: str = "fold", k: int = 5, weight: str = WEIGHT,
) -> DataFrame:
    """(fold, auc); imputation and scaling are fitted inside each training part."""
    jobs = {i: (lambda i=i: fit(cells.filter(F.col(fold) != i), features)) for i in range(k)}
    scored = None
    for i, model in sorted(fit_many(jobs).items()):
        part = model.score(cells.filter(F.col(fold) == i)).select(F.lit(i).alias(fold), "y", weight, "score")
        scored = part if scored is None else scored.unionByName(part)
    return auc(scored, "score", "y", [fold], weight).select(fold, "auc")


def intercept_slope(
    df: DataFrame, score: str, label: str, scale: str = "logit", ridge: float = 0.0,
    weight: str | None = None,
) -> tuple[float, float]:
    """Logistic regression of the outcome on one score column.

    scale "logit" regresses on logit(score) without penalty; "probability" regresses on the
    score itself, where ``ridge`` is the squared-coefficient penalty 1/(2C) sum form of the
    usual solvers (C = 1 / ridge).
    """
    return intercept_slope_of_counts(score_counts(df, score, label, weight=weight), scale, ridge)


def intercept_slope_of_counts(
    counts: DataFrame, scale: str = "logit", ridge: float = 0.0
) -> tuple[float, float]:
    """The same from (score, pos, neg)."""
    x = logit(F.col("score")) if scale == "logit" else F.col("score")
    if ridge == 0.0:
        # one row per score with its observed share: a start near the solution for IRLS
        n = (F.col("pos") + F.col("neg")).cast("double")
        rows = counts.select(x.alias("x"), (F.col("pos") / n).alias("label"), n.alias("_w"))
        m = GeneralizedLinearRegression(
            family="binomial", link="logit", weightCol="_w", maxIter=25, tol=1e-10
        ).fit(assemble(rows, ["x"]).select("features", "label", "_w"))
    else:
        sides = F.explode(
            F.array(
                F.struct(F.lit(1.0).alias("label"), F.col("pos").cast("double").alias("_w")),
                F.struct(F.lit(0.0).alias("label"), F.col("neg").cast("double").alias("_w")),
            )
        ).alias("s")
        rows = counts.select(x.alias("x"), sides).select("x", "s.*").filter("_w > 0")
        rows = assemble(rows, ["x"]).select("features", "label", "_w")
        total = rows.agg(F.sum("_w")).first()[0]
        m = LogisticRegression(
            weightCol="_w", regParam=ridge / total, standardization=False, maxIter=200, tol=1e-10
        ).fit(rows)
    return float(m.intercept), float(m.coefficients[0])


def recalibrate(df: DataFrame, score: str, label: str, out: str = "recalibrated") -> DataFrame:
    """Add sigmoid(a + b logit(score)) with a, b fitted on the frame; the order is kept."""
    a, b = intercept_slope(df, score, label)
    return df.withColumn(out, _sigmoid(F.lit(a) + F.lit(b) * logit(F.col(score)))).withColumns(
        {"_a": F.lit(a), "_b": F.lit(b)}
    )


def recalibration_summary(df: DataFrame, score: str, label: str, name: str) -> DataFrame:
    """(model, intercept, slope, brier before/after, auc before/after)."""
    rows = cut_lineage(score_counts(df, score, label))
    a, b = intercept_slope_of_counts(rows)
    after = _sigmoid(F.lit(a) + F.lit(b) * logit(F.col("score")))
    n = F.sum(F.col("pos") + F.col("neg"))

    def brier(p: Column) -> Column:
        return F.sum(F.col("pos") * (p - 1) * (p - 1) + F.col("neg") * p * p) / n

    briers = rows.agg(brier(F.col("score")).alias("brier_before"), brier(after).alias("brier_after")).first()
    before = auc_from_counts(rows).first()["auc"]
    moved = rows.groupBy(after.alias("score")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    row = (name, a, b, briers["brier_before"], briers["brier_after"], before, auc_from_counts(moved).first()["auc"])
    return local_rows(
        df.sparkSession, [row],
        "model string, intercept double, slope double, brier_before double, brier_after double, "
        "auc_before double, auc_after double",
    )

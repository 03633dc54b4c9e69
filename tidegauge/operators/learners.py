"""Spark ML learners on weighted cells.

A fit takes a frame, the feature names and a row-count column. Imputation and scaling are
fitted on the same frame and travel with the model, so ``score`` works on any frame, also one
that lacks a feature.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators.cells import WEIGHT
from tidegauge.operators.prep import Scaler, fit_prep
from tidegauge.session import local_rows

SEED = 42
PREPARED = "place int, feature string, median double, mean double, sd double"


@dataclass
class Fitted:
    """Scaler, assembler and classifier."""

    features: list[str]
    scaler: Scaler
    model: object

    def design(self, df: DataFrame) -> DataFrame:
        absent = {f: F.lit(None).cast("double") for f in self.features if f not in df.columns}
        df = df.withColumns(absent) if absent else df
        df = df.withColumns({f"_x_{f}": self.scaler.column(f) for f in self.features})
        return assemble(df, [f"_x_{f}" for f in self.features])

    def score(self, df: DataFrame, out: str = "score") -> DataFrame:
        keep = [c for c in df.columns if c != out]
        scored = self.model.transform(self.design(df))
        return scored.select(*keep, vector_to_array("probability")[1].alias(out))

    def save(self, path: str) -> str:
        """Classifier, feature order and preparation: all that scoring in a new session needs."""
        PipelineModel([self.model]).write().overwrite().save(f"{path}/model")
        rows = [(i, f, *self.scaler.params[f]) for i, f in enumerate(self.features)]
        local_rows(SparkSession.active(), rows, PREPARED).write.mode("overwrite").parquet(f"{path}/features")
        return path

    @classmethod
    def load(cls, path: str) -> Fitted:
        rows = sorted(SparkSession.active().read.schema(PREPARED).parquet(f"{path}/features").collect())  # one row per feature
        scaler = Scaler({r["feature"]: (r["median"], r["mean"], r["sd"]) for r in rows})
        return cls([r["feature"] for r in rows], scaler, PipelineModel.load(f"{path}/model").stages[0])


def assemble(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=out).transform(df)


def _prepare(df: DataFrame, features: Sequence[str], weight: str | None):
    features = list(features)
    fitted = Fitted(features, Scaler.fit(df, features, weight), None)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return fitted, fitted.design(df).withColumn("label", F.col("y").cast("double")).withColumn("_w", w)


def _class_ratio(df: DataFrame, weight: str | None) -> float:
    """n_neg / n_pos of the training rows only."""
    w = F.col(weight) if weight else F.lit(1)
    r = df.agg(F.sum(F.when(F.col("y") == 1, w)).alias("p"), F.sum(F.when(F.col("y") == 0, w)).alias("n")).first()
    return float(r["n"] or 0) / max(float(r["p"] or 0), 1.0)


def fit_trees(
    df: DataFrame, features: Sequence[str], weight: str | None = WEIGHT, rounds: int = 150,
    depth: int = 3, seed: int = SEED, step: float = 0.3,
) -> Fitted:
    """Boosted trees with positives weighted by the class ratio."""
    fitted, train = _prepare(df, features, weight)
    ratio = _class_ratio(df, weight)
    train = train.withColumn("_w", F.when(F.col("y") == 1, F.col("_w") * ratio).otherwise(F.col("_w")))
    fitted.model = GBTClassifier(
        labelCol="label", featuresCol="features", weightCol="_w", maxDepth=depth, maxIter=rounds,
        stepSize=step, seed=seed, maxBins=64,
    ).fit(train.select("features", "label", "_w"))
    return fitted


def fit_logistic(
    df: DataFrame, features: Sequence[str], weight: str | None = WEIGHT, reg: float = 0.0,
    mix: float = 0.0, rounds: int = 100,
) -> Fitted:
    fitted, train = _prepare(df, features, weight)
    fitted.model = LogisticRegression(
        labelCol="label", featuresCol="features", weightCol="_w", regParam=reg, elasticNetParam=mix,
        maxIter=rounds, tol=1e-9, standardization=False,
    ).fit(train.select("features", "label", "_w"))
    return fitted


@dataclass
class GroupedLogistic:
    """One logistic regression for each value of a grouping column.

    ``params`` has for each group the preparation of its features and its coefficients,
    intercept first. Both are literals, so scoring any number of groups is one projection.
    """

    features: list[str]
    params: dict[object, tuple[dict[str, tuple[float, float, float]], list[float]]]

    def score(self, group: Column) -> Column:
        """Probability under the model of the group that the column names."""

        def of_group(value) -> Column:
            entries = [x for g, p in self.params.items() for x in (F.lit(g), F.lit(float(value(*p))))]
            return F.create_map(*entries)[group]

        eta = of_group(lambda prep, beta: beta[0])
        for j, f in enumerate(self.features, 1):
            filled = F.coalesce(F.col(f), of_group(lambda prep, beta, f=f: prep[f][0]))
            z = (filled - of_group(lambda prep, beta, f=f: prep[f][1])) / of_group(lambda prep, beta, f=f: prep[f][2])
            eta = eta + of_group(lambda prep, beta, j=j: beta[j]) * z
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-eta))


def fit_logistic_by(
    df: DataFrame, features: Sequence[str], by: str, groups: Sequence, weight: str = WEIGHT, rounds: int = 25, tol: float = 1e-10
) -> GroupedLogistic:
    """Newton steps for all groups at once: one aggregation over ``df`` per step.

    A step sums each group's gradient and information, (k + 1)(k + 4) / 2 numbers for k
    features, which are solved on the driver. Separable groups stop at ``rounds``.
    """
    features, k = list(features), len(features) + 1
    rows = df.filter(F.col(by).isin(list(groups)))
    preps: dict[object, dict] = {g: {} for g in groups}
    for r in fit_prep(rows, features, [by], weight).collect():  # one row per group and feature
        preps[r[by]][r["feature"]] = (r["median"], r["mean"], r["sd"])
    model = GroupedLogistic(features, {g: (preps[g], [0.0] * k) for g in groups})
    w, y = F.col(weight).cast("double"), F.col("y").cast("double")
    for _ in range(rounds):
        q = model.score(F.col(by))
        z = [F.lit(1.0), *[F.col(f"_z{j}") for j in range(1, k)]]
        scaled = {}
        for j, f in enumerate(features, 1):
            maps = [F.create_map(*[x for g in groups for x in (F.lit(g), F.lit(float(preps[g][f][i])))])[F.col(by)] for i in range(3)]
            scaled[f"_z{j}"] = (F.coalesce(F.col(f), maps[0]) - maps[1]) / maps[2]
        staged = rows.withColumns(scaled).withColumn("_q", q)
        r, h = w * (y - F.col("_q")), w * F.col("_q") * (1 - F.col("_q"))
        sums = [F.sum(r * z[a]).alias(f"g{a}") for a in range(k)]
        sums += [F.sum(h * z[a] * z[b]).alias(f"h{a}_{b}") for a in range(k) for b in range(a, k)]
        moved = 0.0
        for s in staged.groupBy(by).agg(*sums).collect():  # one row per group
            grad = np.array([s[f"g{a}"] for a in range(k)])
            info = np.array([[s[f"h{min(a, b)}_{max(a, b)}"] for b in range(k)] for a in range(k)])
            step = np.linalg.lstsq(info, grad, rcond=None)[0]
            prep, beta = model.params[s[by]]
            model.params[s[by]] = (prep, [b + d for b, d in zip(beta, step.tolist())])
            moved = max(moved, float(np.abs(step).max()))
        if moved < tol:
            break
    return model


def coefficients(fitted: Fitted) -> list[tuple[str, float]]:
    """(term, coefficient) of a logistic fit, intercept first."""
    m = fitted.model
    return [("intercept", float(m.intercept)), *zip(fitted.features, map(float, m.coefficients))]


def wald_table(
    df: DataFrame, features: Sequence[str], weight: str | None = WEIGHT
) -> list[tuple[str, float, float, float]]:
    """(term, coefficient, standard error, z) by iteratively reweighted least squares."""
    fitted = Fitted(list(features), Scaler.fit(df, features, weight), None)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    # one row per feature vector with its observed share: a start near the solution
    shares = df.filter(F.col("y").isin(0, 1)).groupBy(*features).agg(
        (F.sum(w * F.col("y")) / F.sum(w)).alias("label"), F.sum(w).alias("_w")
    )
    m = GeneralizedLinearRegression(
        family="binomial", link="logit", labelCol="label", featuresCol="features", weightCol="_w",
        maxIter=25, tol=1e-10,
    ).fit(fitted.design(shares).select("features", "label", "_w"))
    beta = [*map(float, m.coefficients), float(m.intercept)]
    se = list(m.summary.coefficientStandardErrors)
    names = [*fitted.features, "intercept"]
    return [(n, b, s, b / s) for n, b, s in zip(names, beta, se)]


def gain_table(fitted: Fitted, limit: int = 12) -> list[tuple[str, float]]:
    """Features by gain, largest first."""
    gains = list(zip(fitted.features, map(float, fitted.model.featureImportances.toArray())))
    return sorted(gains, key=lambda g: (-g[1], g[0]))[:limit]


def fit_many(jobs: dict[object, Callable[[], object]], threads: int = 8) -> dict[object, object]:
    """Independent fits submitted from a few driver threads; Spark interleaves their stages."""
    with ThreadPoolExecutor(max_workers=threads) as pool:
        futures = {k: pool.submit(f) for k, f in jobs.items()}
        return {k: f.result() for k, f in futures.items()}

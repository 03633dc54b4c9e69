"""Elastic-net logistic regression: all folds and a path of penalties on weighted cells.

A fit minimises mean log loss + penalty * (mix * |b|_1 + (1 - mix) / 2 * |b|_2^2) over coefficients
of columns that are filled and scaled by its own training rows; the intercept is free. The fits of
all folds and of the whole table go down the path together, each penalty starting where the one
before ended. One aggregation over the cells gives gradient, information and loss of every fit; the
quadratic problem is then solved by coordinate descent on the driver, on matrices of the terms' size.
A fit is done when its optimality conditions hold within ``tol``, as measured on the cells.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.operators.cells import WEIGHT
from tidegauge.operators.prep import fit_prep
from tidegauge.operators.ranking import auc
from tidegauge.session import attach, cut_lineage, local_rows

STRENGTHS = tuple(10.0 ** (-4 + 8 * i / 9) for i in range(10))  # inverse penalties, times rows
WHOLE = -1  # the fit that leaves no fold out


@dataclass
class PathFit:
    """One fit on its way down the path."""

    filled: np.ndarray  # medians, means and deviations of the training rows
    mean: np.ndarray
    sd: np.ndarray
    beta: np.ndarray  # intercept first
    before: np.ndarray | None = None
    value: float = np.inf
    done: bool = False
    gap: float = np.inf
    path: list[np.ndarray] = field(default_factory=list)
    gaps: list[float] = field(default_factory=list)

    def move(self, n: float, loss: float, grad: np.ndarray, info: np.ndarray, l1: float, l2: float, tol: float) -> None:
        """Take a step from the sums at ``beta``, half of the last one where that did not help."""
        grad, info, slope = grad / n, info / n, self.beta[1:]
        value = loss / n + l1 * np.abs(slope).sum() + l2 / 2 * (slope**2).sum()
        self.gap = violation(grad, self.beta, l1, l2)
        if self.gap <= tol:
            self.done = True
        elif self.before is not None and value > self.value + 1e-12:
            self.beta = (self.beta + self.before) / 2
        else:
            self.before, self.value = self.beta, value
            self.beta = descend(grad, info, self.beta, l1, l2)

    def settle(self) -> None:
        """Keep the end of this penalty and start the next one there."""
        self.path.append(self.beta.copy())
        self.gaps.append(self.gap)
        self.before, self.value, self.done = None, np.inf, False


def violation(grad: np.ndarray, beta: np.ndarray, l1: float, l2: float) -> float:
    """Largest departure from the optimality conditions; ``grad`` is that of the mean loss."""
    b, g = beta[1:], grad[1:] + l2 * beta[1:]
    off = np.where(b != 0, np.abs(g + l1 * np.sign(b)), np.maximum(np.abs(g) - l1, 0.0))
    return float(max(abs(grad[0]), off.max(initial=0.0)))


def descend(grad: np.ndarray, info: np.ndarray, beta: np.ndarray, l1: float, l2: float, sweeps: int = 10_000) -> np.ndarray:
    """Minimum of the quadratic model at ``beta`` plus penalties, by cyclic coordinate descent."""
    out, slope = beta.copy(), grad.copy()  # slope: gradient of the quadratic part at ``out``
    for _ in range(sweeps):
        largest = 0.0
        for j in range(len(out)):
            a = info[j, j]
            if a <= 1e-14:
                continue
            pull = a * out[j] - slope[j]
            new = pull / a if j == 0 else np.sign(pull) * max(abs(pull) - l1, 0.0) / (a + l2)
            if new != out[j]:
                slope += info[:, j] * (new - out[j])
                largest = max(largest, abs(new - out[j]) * np.sqrt(a))
                out[j] = new
        if largest < 1e-12:
            break
    return out


@dataclass
class ElasticPath:
    """Fits of a path: coefficients at the chosen penalty, and AUC by fold and penalty."""

    features: list[str]
    strengths: list[float]
    rows: float
    fits: dict[int, PathFit]
    scores: DataFrame  # fold, step, auc
    chosen: int

    @property
    def coefficients(self) -> list[tuple[str, float]]:
        """(term, coefficient of the scaled column) of the whole table at the chosen penalty."""
        return list(zip(["intercept", *self.features], map(float, self.fits[WHOLE].path[self.chosen])))

    def penalty(self, step: int) -> float:
        """Penalty of a step for the whole table; a fold's is that of the same strength on its rows."""
        return 1 / (self.strengths[step] * self.rows)


def elastic_net_path(
    cells: DataFrame, features: Sequence[str], fold: str = "fold", mix: float = 0.5,
    strengths: Sequence[float] = STRENGTHS, weight: str = WEIGHT, rounds: int = 100, tol: float = 1e-7,
) -> ElasticPath | None:
    """Fit the path for every fold left out and for all rows; None without both outcomes.

    A strength C stands for the penalty 1 / (C * training rows), as where C multiplies the summed
    loss. The strength with the highest mean AUC on the folds left out is chosen, the smallest of
    equals; a fold without both outcomes has no AUC and does not count.
    """
    features, strengths = list(features), sorted(strengths)
    values = [F.col(f).cast("double").alias(f) for f in features]
    rows = cells.filter(F.col("y").isin(0, 1) & (F.col(weight) > 0) & F.col(fold).isNotNull())
    rows = cut_lineage(
        rows.select(F.col(fold).cast("int").alias("fold"), F.col("y").cast("double").alias("y"), F.col(weight).cast("double").alias(weight), *values)
        .groupBy("fold", "y", *features).agg(F.sum(weight).alias(weight))
    )
    counts = {(r["fold"], r["y"]): r["n"] for r in rows.groupBy("fold", "y").agg(F.sum(weight).alias("n")).collect()}  # two rows a fold
    held = {WHOLE, *[f for f, _ in counts]}
    sizes = {g: [sum(n for (f, y), n in counts.items() if f != g and y == v) for v in (0.0, 1.0)] for g in held}
    if not min(sizes[WHOLE]):
        return None
    held = sorted(g for g in held if min(sizes[g]))
    fits = _fits(rows, features, held, sizes, weight)
    for c in strengths:
        for _ in range(rounds):
            open_fits = {g: f for g, f in fits.items() if not f.done}
            if not open_fits:
                break
            for g, (loss, grad, info) in _sums(rows, features, open_fits, weight).items():
                n = sum(sizes[g])
                open_fits[g].move(n, loss, grad, info, mix / (c * n), (1 - mix) / (c * n), tol)
        for f in fits.values():
            f.settle()
    scores = cut_lineage(_fold_auc(rows, features, {g: f for g, f in fits.items() if g != WHOLE}, len(strengths), weight))
    means = {r["step"]: r["m"] for r in scores.groupBy("step").agg(F.avg("auc").alias("m")).collect() if r["m"] is not None}  # one row per strength
    chosen = max(sorted(means), key=lambda i: round(means[i], 12)) if means else 0
    return ElasticPath(features, strengths, sum(sizes[WHOLE]), fits, scores, chosen)


def _fits(rows: DataFrame, features: list[str], held: list[int], sizes: dict, weight: str) -> dict[int, PathFit]:
    """Fits at their intercepts, with medians and moments of the rows that each is trained on."""
    groups = local_rows(rows.sparkSession, [(g,) for g in held], "_fit int")
    training = rows.join(groups, F.col("fold") != F.col("_fit"))  # a cell serves as many fits as there are folds
    found = fit_prep(training, features, ["_fit"], weight).collect()  # one row per fit and feature
    at = {(r["_fit"], r["feature"]): (r["median"], r["mean"], r["sd"]) for r in found}
    out = {}
    for g in held:
        prep = np.array([at.get((g, f), (0.0, 0.0, 1.0)) for f in features], float).reshape(-1, 3)
        start = np.zeros(len(features) + 1)
        start[0] = np.log(sizes[g][1] / sizes[g][0])
        out[g] = PathFit(prep[:, 0], prep[:, 1], prep[:, 2], start)
    return out


def _design(b: pa.RecordBatch, features: list[str], fit: PathFit) -> np.ndarray:
    """One and the scaled columns of a batch under the preparation of a fit."""
    columns = [b.column(b.schema.get_field_index(f)).to_numpy(zero_copy_only=False) for f in features]
    x = np.stack(columns, 1) if columns else np.zeros((b.num_rows, 0))
    x = np.where(np.isnan(x), fit.filled, x)
    return np.column_stack([np.ones(len(x)), (x - fit.mean) / fit.sd])


def _sums(rows: DataFrame, features: list[str], fits: dict[int, PathFit], weight: str) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Loss, gradient and information of each fit over its training cells, one job."""
    k = len(features) + 1
    upper, width = np.triu_indices(k), 1 + k + k * (k + 1) // 2
    order = sorted(fits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(order), width))
        for b in batches:
            fold, y, w = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("fold", "y", weight))
            for i, g in enumerate(order):
                z, n = _design(b, features, fits[g]), np.where(fold != g, w, 0.0)
                eta = z @ fits[g].beta
                p = 1 / (1 + np.exp(-eta))
                sums[i, 0] += n @ (np.logaddexp(0, eta) - y * eta)
                sums[i, 1 : k + 1] += z.T @ (n * (p - y))
                sums[i, k + 1 :] += (z.T @ (z * (n * p * (1 - p))[:, None]))[upper]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(sums.size)), pa.array(sums.ravel())], names=["at", "v"])

    found = rows.mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()  # one row per sum
    flat = np.zeros((len(order), width))
    flat.ravel()[found["at"].to_numpy()] = found["v"].to_numpy()
    out = {}
    for i, g in enumerate(order):
        info = np.zeros((k, k))
        info[upper] = flat[i, k + 1 :]
        out[g] = float(flat[i, 0]), flat[i, 1 : k + 1], info + np.triu(info, 1).T
    return out


def _fold_auc(rows: DataFrame, features: list[str], fits: dict[int, PathFit], steps: int, weight: str) -> DataFrame:
    """(fold, step, auc): every cell under the fits that left its fold out, at all strengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fold, y, w = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("fold", "y", weight))
            for g, fit in fits.items():
                at = np.flatnonzero(fold == g)
                if len(at):
                    eta = _design(b, features, fit)[at] @ np.array(fit.path).T
                    columns = [np.full(at.size * steps, g, np.int32), np.tile(np.arange(steps, dtype=np.int32), at.size), np.repeat(y[at], steps),
                               np.repeat(w[at], steps), np.round(eta.ravel(), 12)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["fold", "step", "y", weight, "score"])

    scored = rows.mapInArrow(run, f"fold int, step int, y double, `{weight}` double, score double")
    found = auc(scored, "score", "y", ["fold", "step"], weight).select("fold", "step", "auc")
    both = rows.groupBy("fold").agg(F.countDistinct("y").alias("_kinds")).filter("_kinds = 2").select("fold")
    return attach(found, both, ["fold"], "inner")

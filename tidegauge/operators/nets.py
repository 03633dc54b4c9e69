"""Nets with one tanh layer on weighted cells, any number of nets in one fit.

A fit takes cells with a count and fits every net for every value of a grouping column (waves,
replicates). The nets take quasi-Newton steps together: one job sums loss and gradient of all
unfinished nets over the cells, a few dozen numbers each; steps and memory of the search stay on
the driver. No row is repeated: a count multiplies its cell's terms. Every job reads all cells, so
they are scaled once, dealt to tasks by their number, and held as blocks of plain arrays.

Imputation and scaling are fitted per group on the training cells and travel with the nets. The
loss is the mean log loss plus ``ALPHA`` / (2 n) times the squared weights without intercepts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.operators.cells import WEIGHT
from tidegauge.operators.prep import fit_prep
from tidegauge.session import cut_lineage

SEED = 42
ROUNDS = 500
ALPHA = 1e-4
GRADIENT = 1e-4  # a net is done when no derivative of its loss is larger
DECREASE = 2.2e-9  # or when a step lowers the loss by less than this share
MEMORY = 10
CELLS_PER_TASK = 50_000


@dataclass(frozen=True)
class Shape:
    """Features and number of hidden units; parameters lie in one vector: input weights, hidden
    intercepts, output weights, output intercept."""

    features: tuple[str, ...]
    hidden: int

    @property
    def size(self) -> int:
        return (len(self.features) + 2) * self.hidden + 1

    def start(self, seed: int) -> np.ndarray:
        """Uniform draws within sqrt(6 / (inputs + outputs)) of each layer."""
        rng, k, h = np.random.RandomState(seed), len(self.features), self.hidden
        first, second = np.sqrt(6 / (k + h)), np.sqrt(6 / (h + 1))
        return np.concatenate([rng.uniform(-first, first, k * h + h), rng.uniform(-second, second, h + 1)])

    def unpack(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        k, h = len(self.features), self.hidden
        return x[: k * h].reshape(k, h), x[k * h : k * h + h], x[k * h + h : -1], float(x[-1])

    def penalised(self) -> np.ndarray:
        """1 for weights, 0 for intercepts."""
        k, h = len(self.features), self.hidden
        return np.concatenate([np.ones(k * h), np.zeros(h), np.ones(h), [0.0]])


def predict(shape: Shape, x: np.ndarray, z: np.ndarray) -> np.ndarray:
    w, b, v, c = shape.unpack(x)
    return 1 / (1 + np.exp(-(np.tanh(z @ w + b) @ v + c)))


def loss_sums(shape: Shape, x: np.ndarray, z: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Summed log loss, then its gradient, over scaled rows ``z`` with labels and counts."""
    w, b, v, c = shape.unpack(x)
    t = np.tanh(z @ w + b)
    eta = t @ v + c
    loss = n @ (np.logaddexp(0, eta) - y * eta)
    d = n * (1 / (1 + np.exp(-eta)) - y)
    back = d[:, None] * v * (1 - t * t)
    return np.concatenate([[loss], (z.T @ back).ravel(), back.sum(0), d @ t, [d.sum()]])


class Search:
    """L-BFGS that is told the value and gradient at ``point`` until ``done``."""

    def __init__(self, start: np.ndarray, rounds: int):
        self.x = self.point = start
        self.f = self.g = None
        self.rounds, self.taken, self.done = rounds, 0, rounds < 1
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []

    def tell(self, f: float, g: np.ndarray) -> None:
        if self.f is not None:
            slope = float(self.g @ self.way)
            if not f <= self.f + 1e-4 * self.t * slope:
                return self._shorter(f, slope)
            s, r = self.point - self.x, g - self.g
            if s @ r > 1e-10 * (r @ r):
                self.pairs = [*self.pairs, (s, r)][-MEMORY:]
            self.taken += 1
            small = self.f - f <= DECREASE * max(abs(self.f), abs(f), 1.0)
            self.done = small or self.taken >= self.rounds
        self.x, self.f, self.g = self.point, f, g
        self.done = self.done or np.abs(g).max() <= GRADIENT
        if not self.done:
            self._aim()

    def _aim(self) -> None:
        q, left = -self.g, []
        for s, r in reversed(self.pairs):
            left.append(s @ q / (s @ r))
            q = q - left[-1] * r
        if self.pairs:
            s, r = self.pairs[-1]
            q = q * (s @ r / (r @ r))
        for (s, r), a in zip(self.pairs, reversed(left)):
            q = q + (a - r @ q / (s @ r)) * s
        if q @ self.g >= 0:  # no descent: forget the curvature
            self.pairs, q = [], -self.g
        self.way, self.tries = q, 0
        self.t = 1.0 if self.pairs else min(1.0, 1 / float(np.abs(q).sum()))
        self.point = self.x + self.t * q

    def _shorter(self, f: float, slope: float) -> None:
        self.tries += 1
        if self.tries > 20:
            if not self.pairs:
                self.done = True
                return
            self.pairs = []
            return self._aim()
        bend = f - self.f - self.t * slope
        best = -slope * self.t / (2 * bend) if np.isfinite(bend) and bend > 0 else 0.1
        self.t *= min(max(best, 0.1), 0.5)
        self.point = self.x + self.t * self.way


@dataclass
class Net:
    """One fitted net; scoring is a projection. Features that a frame lacks take the median."""

    shape: Shape
    prep: dict[str, tuple[float, float, float]]
    params: np.ndarray
    loss: float
    rounds: int

    @property
    def features(self) -> list[str]:
        return list(self.shape.features)

    def score(self, df: DataFrame, out: str = "score") -> DataFrame:
        w, b, v, c = self.shape.unpack(self.params)
        scaled = {}
        for f in self.features:
            median, mean, sd = self.prep[f]
            value: Column = F.col(f).cast("double") if f in df.columns else F.lit(None).cast("double")
            scaled[f"_z_{f}"] = (F.coalesce(value, F.lit(median)) - F.lit(mean)) / F.lit(sd)
        hidden = {
            f"_h_{j}": F.tanh(sum((F.lit(float(w[i, j])) * F.col(f"_z_{f}") for i, f in enumerate(self.features)), F.lit(float(b[j]))))
            for j in range(self.shape.hidden)
        }
        eta = sum((F.lit(float(v[j])) * F.col(h) for j, h in enumerate(hidden)), F.lit(c))
        keep = [x for x in df.columns if x != out]
        return df.withColumns(scaled).withColumns(hidden).select(*keep, (1 / (1 + F.exp(-eta))).alias(out))


@dataclass
class GroupedNets:
    """(group, name) -> net; the group is None in a fit without a grouping column."""

    by: str | None
    nets: dict[tuple[object, str], Net]

    def score(self, df: DataFrame, name: str, out: str = "score") -> DataFrame:
        """Each row under the net of its own group; rows of groups without a net get null."""
        if self.by is None:
            return self.nets[None, name].score(df, out)
        mine = {g: net for (g, n), net in self.nets.items() if n == name}
        features, by = list(next(iter(mine.values())).shape.features), self.by
        keep = [c for c in df.columns if c != out]
        wide = df.select(*keep, *[F.col(f).cast("double").alias(f"_z_{f}") for f in features])
        schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + f", `{out}` double"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                z = _columns(b, [f"_z_{f}" for f in features])
                group = np.array(b.column(b.schema.get_field_index(by)).to_pylist(), dtype=object)
                score = np.full(b.num_rows, np.nan)
                for g in set(group):
                    if g in mine:
                        at = group == g
                        score[at] = predict(mine[g].shape, mine[g].params, _scaled(z[at], mine[g].prep, features))
                yield pa.RecordBatch.from_arrays([*b.select(keep).columns, pa.array(score, mask=np.isnan(score))], names=[*keep, out])

        return wide.mapInArrow(run, schema)


def _columns(b: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    """Doubles with NaN for null, one column a name."""
    return np.stack([b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(float) for c in names], 1)


def _scaled(x: np.ndarray, prep: dict[str, tuple[float, float, float]], features: Sequence[str]) -> np.ndarray:
    median, mean, sd = (np.array([prep[f][i] for f in features]) for i in range(3))
    return (np.where(np.isnan(x), median, x) - mean) / sd


def fit_nets(
    cells: DataFrame, shapes: dict[str, Shape], by: str | None = None, weight: str = WEIGHT,
    rounds: int = ROUNDS, seed: int = SEED,
) -> GroupedNets:
    """All nets for all groups of ``cells`` (label ``y``; rows with another label than 0 or 1 and
    counts below 1 are left out). A feature without any value in a group is 0 there. A group
    without rows has no net."""
    features = list(dict.fromkeys(f for s in shapes.values() for f in s.features))
    rows = cells.filter(F.col("y").isin(0, 1) & (F.col(weight) > 0))
    group = F.col(by) if by else F.lit(0)
    rows = cut_lineage(rows.select(
        group.alias("_g"), F.col("y").cast("double").alias("_y"), F.col(weight).cast("double").alias("_n"),
        F.col(weight).alias("_w"), *[F.col(f).cast("double").alias(f) for f in features],
    ))
    preps: dict[object, dict] = {}
    for r in fit_prep(rows, features, ["_g"], "_w").collect():  # one row per group and feature
        known = (0.0, 0.0, 1.0) if r["median"] is None else (r["median"], r["mean"], r["sd"])
        preps.setdefault(r["_g"], {})[r["feature"]] = known
    totals = {r["_g"]: r["n"] for r in rows.groupBy("_g").agg(F.sum("_n").alias("n")).collect()}  # one row per group
    jobs = [(g, name) for g in preps for name in shapes]
    searches = {j: Search(shapes[j[1]].start(seed), rounds) for j in jobs}
    data = _blocks(rows.drop("_w"), features, preps)
    while any(not s.done for s in searches.values()):
        points = {j: s.point for j, s in searches.items() if not s.done}
        for j, sums in _sums(data, features, shapes, list(preps), points).items():
            shape, n, x = shapes[j[1]], totals[j[0]], points[j]
            pull = ALPHA * shape.penalised() * x
            searches[j].tell((sums[0] + pull @ x / 2) / n, (sums[1:] + pull) / n)
    data.unpersist()
    nets = {
        (g if by else None, name): Net(shapes[name], {f: preps[g][f] for f in shapes[name].features}, s.x, float(s.f or 0.0), s.taken)
        for (g, name), s in searches.items()
    }
    return GroupedNets(by, nets)


def _blocks(rows: DataFrame, features: list[str], preps: dict) -> DataFrame:
    """(group number, block): scaled features, labels and counts of the cells of one group, a line each."""
    number = {g: i for i, g in enumerate(preps)}
    tasks = max(1, -(-rows.count() // CELLS_PER_TASK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            group = np.array(b.column(b.schema.get_field_index("_g")).to_pylist(), dtype=object)
            x, rest = _columns(b, features) if features else np.zeros((b.num_rows, 0)), _columns(b, ["_y", "_n"])
            found = sorted(number[g] for g in set(group))
            blocks = []
            for g, i in number.items():
                if i in found:
                    at = group == g
                    blocks.append(np.concatenate([_scaled(x[at], preps[g], features), rest[at]], 1).T.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(blocks, pa.binary())], names=["group", "block"])

    spread = rows.repartition(tasks, *rows.columns).sortWithinPartitions("_g", "_y", *features)
    return spread.mapInArrow(run, "group int, block binary").persist(StorageLevel.MEMORY_AND_DISK)


def _sums(data: DataFrame, features: list[str], shapes: dict[str, Shape], groups: list, points: dict) -> dict[tuple, np.ndarray]:
    """Loss and gradient sums of every net at its point: one job, added up before the shuffle."""
    order = list(points)
    of_group: dict[int, list[int]] = {}
    for i, (g, _) in enumerate(order):
        of_group.setdefault(groups.index(g), []).append(i)
    places = {name: [features.index(f) for f in s.features] for name, s in shapes.items()}
    lines = len(features) + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for g, block in zip(b.column(0).to_pylist(), b.column(1)):
                if g not in of_group:
                    continue
                cells = np.frombuffer(block.as_buffer()).reshape(lines, -1)
                for i in of_group[g]:
                    name = order[i][1]
                    got = loss_sums(shapes[name], points[order[i]], cells[places[name]].T, cells[-2], cells[-1])
                    sums[i] = sums[i] + got if i in sums else got
        if sums:
            net = np.concatenate([np.full(len(s), i, np.int32) for i, s in sums.items()])
            place = np.concatenate([np.arange(len(s), dtype=np.int32) for s in sums.values()])
            yield pa.RecordBatch.from_arrays([pa.array(net), pa.array(place), pa.array(np.concatenate(list(sums.values())))], names=["net", "place", "v"])

    parts = data.mapInArrow(run, "net int, place int, v double")
    out = {j: np.zeros(shapes[j[1]].size + 1) for j in order}
    found = parts.groupBy("net", "place").agg(F.sum("v").alias("v")).toArrow()  # one row per parameter
    for net, place, v in zip(*(found[c].to_pylist() for c in ("net", "place", "v"))):
        out[order[net]][place] = v
    return out


def fit_one(cells: DataFrame, features: Sequence[str], hidden: int, weight: str = WEIGHT, rounds: int = ROUNDS, seed: int = SEED) -> Net:
    return fit_nets(cells, {"net": Shape(tuple(features), hidden)}, None, weight, rounds, seed).nets[None, "net"]

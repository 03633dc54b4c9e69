"""Boosted trees for many groups at once, on weighted cells.

A group is a wave, a training window, a set of folds or a bootstrap replicate: every model of a
study. All groups grow the same tree of the same round together. Jobs sum first and second
derivatives into histograms, combined inside each task, so that what is shuffled and what reaches
the driver has the size of the histograms and does not grow with rows; the driver picks the splits.

The path to a node of the last level and its split name at most ``depth`` features. Where the joint
histograms of all sets of that many features are small (``JOINT`` entries for all groups), one job
over the cells therefore makes a whole round; otherwise one job makes each level, summed by
(group, node, feature, bin). Both forms find the same trees.

Features are binned once, at the values midway between neighbouring levels or, beyond ``BINS``
levels, at weighted quantiles. Missing values take the bin of the group's training median. The margin
of every cell is kept with it, written every ``KEEP`` rounds, so that a task replays few trees and a
lost executor costs no more than that. Every job reads all cells, so they are held as blocks of plain
arrays: a task takes a block as it is and makes no column of it anew.

Splits maximise the usual second-order gain with leaf penalty ``ridge``; children below
``MIN_HESSIAN`` are not made; ties go to the first feature and the lowest cut.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from itertools import combinations
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators.cells import WEIGHT
from tidegauge.operators.prep import medians as group_medians
from tidegauge.operators.ranking import quantiles
from tidegauge.session import attach, cut_lineage, local_rows, small_table

BINS = 255
KEEP = 25  # rounds between two writes of the margins
CELLS_PER_TASK = 50_000
JOINT = 250_000  # entries of joint histograms that one job may sum
MIN_HESSIAN = 1.0
SLACK = 1e-9  # gains this close, relative to the best, are ties

Sums = tuple[np.ndarray, np.ndarray]


#: What a worker remembers of the state it met last: {(partition, block): (round, margins)}.
_MET: dict[str, dict[tuple[int, int], tuple[int, np.ndarray]]] = {}


@dataclass
class Forest:
    """Trees of every group as full binary trees: ``feature`` (-1: no split) and last bin of the left child by inner node, values by leaf."""

    depth: int
    feature: list[np.ndarray] = field(default_factory=list)  # per round: groups x (2^depth - 1)
    cut: list[np.ndarray] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)  # groups x 2^depth
    gain: list[np.ndarray] = field(default_factory=list)  # of the splits, 0 without one

    def margin(self, group: np.ndarray, bins: np.ndarray, start: int, before: np.ndarray | float) -> np.ndarray:
        """``before`` plus the leaf values of the rounds from ``start`` on; ``bins`` is cells x features."""
        out, row = np.zeros(len(group)) + before, np.arange(len(group))
        for feature, cut, value in zip(self.feature[start:], self.cut[start:], self.value[start:]):
            node = descend(group, bins, row, feature, cut, self.depth)
            out += value[group, node - (2**self.depth - 1)]
        return out


def descend(group: np.ndarray, bins: np.ndarray, row: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """Node of every cell after ``levels`` levels; children of node n are 2n + 1 and 2n + 2."""
    node = np.zeros(len(group), np.int64)
    for _ in range(levels):
        f = feature[group, node]
        right = (f >= 0) & (bins[row, f] > cut[group, node])
        node = 2 * node + 1 + right
    return node


def best_splits(grad: np.ndarray, hess: np.ndarray, ridge: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, Sums, Sums]:
    """(feature or -1, last left bin, gain, sums left, sums right) for histograms [..., feature, bin]."""
    total_g, total_h = grad[..., 0, :].sum(-1), hess[..., 0, :].sum(-1)
    left_g, left_h = np.cumsum(grad, -1), np.cumsum(hess, -1)
    right_g, right_h = total_g[..., None, None] - left_g, total_h[..., None, None] - left_h
    gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - (total_g**2 / (total_h + ridge))[..., None, None]
    gain = np.where((left_h >= MIN_HESSIAN) & (right_h >= MIN_HESSIAN), gain, 0.0)
    flat = gain.reshape(*gain.shape[:-2], -1)
    best = flat.max(-1)
    at = np.argmax(flat >= (best * (1 - SLACK))[..., None], -1)
    split = best > 1e-10
    feature, cut = np.where(split, at // grad.shape[-1], -1), np.where(split, at % grad.shape[-1], 0)

    def side(sums: np.ndarray, whole: np.ndarray | float) -> np.ndarray:
        picked = np.take_along_axis(sums.reshape(*sums.shape[:-2], -1), at[..., None], -1)[..., 0]
        return np.where(split, picked, whole)

    left = side(left_g, total_g), side(left_h, total_h)
    right = side(right_g, 0.0), side(right_h, 0.0)
    return feature, cut, np.where(split, best, 0.0), left, right


@dataclass
class GroupedTrees:
    """One boosted-tree model for each value of the grouping columns."""

    features: list[str]
    by: list[str]
    groups: list[tuple]
    cuts: list[np.ndarray]
    medians: np.ndarray  # groups x features
    forest: Forest
    start: float = 0.0

    def table(self, spark: SparkSession, kinds: str) -> DataFrame:
        return local_rows(spark, [(*g, i) for i, g in enumerate(self.groups)], kinds + ", _gid int")

    def numbered(self, df: DataFrame) -> DataFrame:
        """Rows of known groups with the group's number."""
        kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in self.by)
        return attach(df, self.table(df.sparkSession, kinds), self.by, "inner")

    def score(self, df: DataFrame, out: str = "score") -> DataFrame:
        """Probability under the model of the row's group; absent features count as missing."""
        absent = {f: F.lit(None).cast("double") for f in self.features if f not in df.columns}
        rows = self.numbered(df.drop(out).withColumns(absent) if absent else df.drop(out))
        rows = rows.withColumns({f"_x{i}": F.col(f).cast("double") for i, f in enumerate(self.features)}).drop(*absent)
        keep = [c for c in df.columns if c != out]
        k, forest, start, bins_of = len(self.features), self.forest, self.start, self.bins
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != out) + f", `{out}` double"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                group, values = _matrix(b, k)
                margin = forest.margin(group, bins_of(group, values), 0, start)
                columns = [b.column(b.schema.get_field_index(c)) for c in keep]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(1 / (1 + np.exp(-margin)))], names=[*keep, out])

        return rows.select(*keep, "_gid", *[f"_x{i}" for i in range(k)]).mapInArrow(run, schema)

    def bins(self, group: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Bin numbers of cells x features; missing values take the group's median."""
        filled = np.where(np.isnan(values), self.medians[group], values)
        return np.stack([np.searchsorted(c, filled[:, i], "left") for i, c in enumerate(self.cuts)], 1) if len(self.cuts) else filled.astype(int)

    def gains(self) -> list[tuple]:
        """(group..., feature, mean gain of its splits, number of splits)."""
        out = []
        for i, g in enumerate(self.groups):
            used = np.concatenate([f[i] for f in self.forest.feature] or [np.zeros(0, int)])
            gain = np.concatenate([x[i] for x in self.forest.gain] or [np.zeros(0)])
            for j, f in enumerate(self.features):
                n = int((used == j).sum())
                out.append((*g, f, float(gain[used == j].sum() / max(n, 1)), n))
        return out


def _path(feature: np.ndarray, cut: np.ndarray, leaf: int, depth: int) -> dict[int, tuple[int, float]] | None:
    """{feature: (first bin, last bin)} of the cells of a leaf; None when none can reach it."""
    node, asked = 0, {}
    for level in range(depth):
        right, f = leaf >> (depth - 1 - level) & 1, int(feature[node])
        if f < 0 and right:
            return None
        if f >= 0:
            low, high = asked.get(f, (0, math.inf))
            asked[f] = (max(low, int(cut[node]) + 1), high) if right else (low, min(high, int(cut[node])))
        node = 2 * node + 1 + right
    return asked


@dataclass
class OneGroup:
    """A grouped fit of one group, used like any single model."""

    model: GroupedTrees

    @property
    def features(self) -> list[str]:
        return self.model.features

    def score(self, df: DataFrame, out: str = "score") -> DataFrame:
        keep = [c for c in df.columns if c != out]
        return self.model.score(df.withColumn("_one", F.lit(0)), out).select(*keep, out)

    def set_scores(self, values: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Probabilities of cells x all sets of features, those outside a set taken from ``other``.

        A leaf asks at most ``depth`` features. Its value is a product over them, each the cell's answer
        inside the set and the other row's outside, so it is a sum over the few sets of its own features;
        one matrix product carries these to all sets.
        """
        model, forest, k = self.model, self.model.forest, len(self.model.features)
        own = model.bins(np.zeros(len(values), int), np.asarray(values, float))
        base = model.bins(np.zeros(1, int), np.asarray(other, float)[None, :])[0]
        parts: dict[int, np.ndarray] = {0: np.full(len(own), model.start)}
        for feature, cut, value in zip(forest.feature, forest.cut, forest.value):
            for leaf, v in enumerate(value[0].tolist()):
                asked = _path(feature[0], cut[0], leaf, forest.depth)
                if asked is None or v == 0.0:
                    continue
                terms: dict[int, np.ndarray | float] = {0: v}
                for f, (low, high) in asked.items():
                    there = float(low <= base[f] <= high)
                    gain = ((own[:, f] >= low) & (own[:, f] <= high)) - there
                    added = {mask | 1 << f: t * gain for mask, t in terms.items()}
                    terms = {**terms, **added} if there else added
                for mask, t in terms.items():
                    parts[mask] = parts[mask] + t if mask in parts else np.zeros(len(own)) + t
        masks = np.array(list(parts))
        inside = (np.arange(1 << k) & masks[:, None]) == masks[:, None]
        return 1 / (1 + np.exp(-(np.stack(list(parts.values()), 1) @ inside.astype(float))))

    def gain_table(self, limit: int = 12) -> list[tuple[str, float]]:
        """Features that are used by mean gain, largest first."""
        gains = [(f, gain) for _, f, gain, n in self.model.gains() if n]
        return sorted(gains, key=lambda g: (-g[1], g[0]))[:limit]


def _matrix(b: pa.RecordBatch, k: int, prefix: str = "_x") -> tuple[np.ndarray, np.ndarray]:
    def column(name: str) -> np.ndarray:
        return b.column(b.schema.get_field_index(name)).to_numpy(zero_copy_only=False)

    return column("_gid").astype(np.int64), np.stack([column(f"{prefix}{i}") for i in range(k)], 1)


def bin_cuts(cells: DataFrame, features: Sequence[str], weight: str) -> list[np.ndarray]:
    """Ascending cuts of each feature over all groups: a value above cut i lies in bin i + 1 or later."""
    long = cells.select(weight, *[F.col(f).cast("double").alias(f) for f in features]).unpivot([weight], list(features), "feature", "value")
    levels = small_table(long.filter("value is not null and not isnan(value)").groupBy("feature", "value").agg(F.sum(weight).alias(weight)))
    sizes = {r["feature"]: r["n"] for r in levels.groupBy("feature").agg(F.count("*").alias("n")).collect()}  # one row per feature
    few = [f for f in features if sizes.get(f, 0) <= BINS]
    held: dict[str, set[float]] = {f: set() for f in features}
    for r in levels.filter(F.col("feature").isin(few)).select("feature", "value").collect():  # BINS values a feature at most
        held[r["feature"]].add(r["value"])
    many = [f for f in features if f not in few]
    if many:
        shares = [i / BINS for i in range(1, BINS)]
        for r in quantiles(levels.filter(F.col("feature").isin(many)), "value", shares, ["feature"], weight).collect():
            held[r["feature"]].add(r["value"])
    out = []
    for f in features:
        v = np.array(sorted(held[f]))
        out.append((v[1:] + v[:-1]) / 2 if f in few else v)
    return out


def _preparation(rows: DataFrame, features: list[str], by: list[str], weight: str) -> tuple[list[tuple], np.ndarray, np.ndarray]:
    """Groups in order, their medians, and the weight of a positive row (negatives over positives)."""
    w = F.col(weight).cast("double")
    sums = rows.groupBy(*by).agg(F.sum(F.when(F.col("y") == 1, w).otherwise(0.0)).alias("_p"), F.sum(F.when(F.col("y") == 0, w).otherwise(0.0)).alias("_n"))
    ratios = {tuple(r[c] for c in by): r["_n"] / max(r["_p"], 1.0) for r in sums.collect()}  # one row per group
    groups = sorted(ratios, key=lambda g: tuple((v is None, v) for v in g))
    place = {g: i for i, g in enumerate(groups)}
    medians = np.zeros((len(groups), len(features)))
    for r in group_medians(rows, features, by, weight).collect():  # one row per group
        medians[place[tuple(r[c] for c in by)]] = [0.0 if r[f] is None else r[f] for f in features]
    return groups, medians, np.array([ratios[g] for g in groups])


def fit_boosted(
    cells: DataFrame, features: Sequence[str], by: Sequence[str], weight: str = WEIGHT, rounds: int = 150,
    depth: int = 3, step: float = 0.3, ridge: float = 1.0, balanced: bool = True,
) -> GroupedTrees:
    """Fit one model for every value of ``by`` on cells (by, features, y, weight).

    A row that serves several models comes once for each. ``balanced`` weights positives by the
    class ratio of their group.
    """
    features, by, k = list(features), list(by), len(features)
    rows = cells.filter(F.col("y").isin(0, 1) & (F.col(weight) > 0)).select(*by, *features, "y", weight)
    groups, medians, ratios = _preparation(rows, features, by, weight)
    model = GroupedTrees(features, by, groups, bin_cuts(rows, features, weight), medians, Forest(depth))
    if not groups:
        return model
    name, tasks, state = _binned(model, rows, weight, ratios if balanced else np.ones(len(groups)))
    widths = [len(c) + 1 for c in model.cuts]
    shape, sets = (len(groups), k, max(widths)), list(combinations(range(k), min(depth, k)))
    joint = len(groups) * sum(math.prod(widths[f] for f in s) for s in sets) <= JOINT
    forest, kept = model.forest, 0
    for r in range(rounds):
        feature = np.full((len(groups), 2**depth - 1), -1)
        cut, gain = np.zeros_like(feature), np.zeros(feature.shape)
        if joint:
            tables = _joint_histograms(state, name, tasks, forest, kept, sets, widths, len(groups))
            low, high = np.zeros((len(groups), 1, k), int), np.tile(np.array(widths) - 1, (len(groups), 1, 1))
        for level in range(depth):
            first, n = 2**level - 1, 2**level
            if joint:
                grad, hess = _from_joint(tables, sets, low, high, shape)
            else:
                grad, hess = _histograms(state, name, tasks, forest, kept, feature, cut, level, shape)
            here = slice(first, first + n)
            found, at, gain[:, here], left, right = best_splits(grad, hess, ridge)
            feature[:, here], cut[:, here] = found, at
            if joint:
                low, high = _halved(low, high, found, at)
        leaves = [np.stack(pair, -1).reshape(len(groups), -1) for pair in zip(left, right)]
        forest.feature.append(feature)
        forest.cut.append(cut)
        forest.gain.append(gain)
        forest.value.append(-step * leaves[0] / (leaves[1] + ridge))
        if (r + 1) % KEEP == 0 and r + 1 < rounds:
            (name, tasks, state), kept = _advanced(state, forest, kept, k), r + 1
    state.unpersist()
    return model


def _binned(model: GroupedTrees, rows: DataFrame, weight: str, ratios: np.ndarray) -> tuple[str, int, DataFrame]:
    """(_gid, _b0.., y, _w, _m): binned cells with balanced weights and their margin."""
    k, start, bins_of = len(model.features), model.start, model.bins
    schema = "_gid int, " + "".join(f"_b{i} short, " for i in range(k)) + "y double, _w double, _m double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            group, values = _matrix(b, k)
            bins = bins_of(group, values).astype(np.int16)
            y, w = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("y", "_w"))
            arrays = [group.astype(np.int32), *bins.T, y, w * np.where(y == 1, ratios[group], 1.0), np.full(len(y), start)]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(a)) for a in arrays], names=names)

    names = ["_gid", *[f"_b{i}" for i in range(k)], "y", "_w", "_m"]
    values = [F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(model.features)]
    plain = model.numbered(rows).select("_gid", *values, F.col("y").cast("double").alias("y"), F.col(weight).cast("double").alias("_w"))
    return _held(plain.mapInArrow(run, schema).groupBy(*names[:-2], "_m").agg(F.sum("_w").alias("_w")).select(*names))


def _held(df: DataFrame) -> tuple[str, int, DataFrame]:
    """(name, tasks, blocks): written to the shared folder, in tasks of a fixed number of cells, and cached as blocks on top of that."""
    kept = cut_lineage(df)
    tasks = max(1, -(-kept.count() // CELLS_PER_TASK))
    bins = [c for c in kept.columns if c.startswith("_b")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [np.stack([b.column(b.schema.get_field_index(c)).to_numpy() for c in names]) for names in (["_gid"], bins, ["y", "_w", "_m"]) if names]
            blocks = [parts[0], parts[1] if bins else np.zeros((0, b.num_rows), np.int16), parts[-1]]
            yield pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in blocks], names=["group", "bins", "rest"])

    spread = kept.repartition(tasks, "_gid", *bins).sortWithinPartitions(*kept.columns)
    return uuid4().hex, tasks, spread.mapInArrow(run, "group binary, bins binary, rest binary").persist(StorageLevel.MEMORY_AND_DISK)


def _cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """(group, bins, y, weight, margin) of every block."""
    for b in batches:
        for row in zip(*(b.column(i) for i in range(3))):
            group, bins, rest = (np.frombuffer(v.as_buffer(), t) for v, t in zip(row, (np.int32, np.int16, np.float64)))
            n = len(group)
            if n:
                yield group.astype(np.int64), bins.reshape(-1, n).T, *rest.reshape(3, n)


def _advanced(state: DataFrame, forest: Forest, kept: int, k: int) -> tuple[str, int, DataFrame]:
    """The cells with the trees since round ``kept`` added to their margins."""
    names = ["_gid", *[f"_b{i}" for i in range(k)], "y", "_w", "_m"]
    schema = "_gid int, " + "".join(f"_b{i} short, " for i in range(k)) + "y double, _w double, _m double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, bins, y, w, margin in _cells_of(batches):
            arrays = [group.astype(np.int32), *bins.T, y, w, forest.margin(group, bins, kept, margin)]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=names)

    moved = _held(state.mapInArrow(run, schema))
    state.unpersist()
    return moved


def _margins(
    state: str, number: int, group: np.ndarray, bins: np.ndarray, margin: np.ndarray, recent: Forest, kept: int, rounds: int
) -> np.ndarray:
    """Margins of one block after ``rounds`` rounds. A worker that met the block adds the trees since then;
    any other one adds all trees since the state was written and gets the same numbers."""
    if state not in _MET:
        _MET.clear()
        _MET[state] = {}
    at = (TaskContext.get().partitionId(), number)
    done, found = _MET[state].get(at, (kept, margin))
    if done < rounds:
        found = recent.margin(group, bins, done - kept, found)
        _MET[state][at] = (rounds, found)
    return found


def _derivatives(state: str, number: int, cells: tuple[np.ndarray, ...], recent: Forest, kept: int, rounds: int) -> tuple[np.ndarray, ...]:
    """(group, bins, first derivative, second derivative) of the cells of a block."""
    group, bins, y, w, margin = cells
    p = 1 / (1 + np.exp(-_margins(state, number, group, bins, margin, recent, kept, rounds)))
    return group, bins, w * (p - y), w * p * (1 - p)


def _summed(
    state: DataFrame, name: str, tasks: int, forest: Forest, kept: int, size: int,
    places: Callable[[np.ndarray, np.ndarray], Iterator[np.ndarray]],
) -> np.ndarray:
    """Both derivatives (2 x size) summed at the places that ``places(group, bins)`` gives, one job."""
    rounds, name = len(forest.feature), f"{name}:{kept}"
    recent = Forest(forest.depth, forest.feature[kept:], forest.cut[kept:], forest.value[kept:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, size))
        for number, cells in enumerate(_cells_of(batches)):
            group, bins, g, h = _derivatives(name, number, cells, recent, kept, rounds)
            for at in places(group, bins):  # cells are in order of their groups: a block meets a small part of the table
                low = int(at.min())
                for side, values in zip(sums, (g, h)):
                    found = np.bincount(at - low, values)
                    side[low : low + len(found)] += found
        held = np.flatnonzero(sums[1])
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(sums[0, held]), pa.array(sums[1, held])], names=["at", "g", "h"])

    whole = state.mapInArrow(run, "at long, g double, h double")
    if tasks > 1:
        whole = whole.groupBy("at").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    found, out = whole.toArrow(), np.zeros((2, size))  # one row per entry of a histogram
    out[0, found["at"].to_numpy()], out[1, found["at"].to_numpy()] = found["g"].to_numpy(), found["h"].to_numpy()
    return out


def _histograms(
    state: DataFrame, name: str, tasks: int, forest: Forest, kept: int, feature: np.ndarray, cut: np.ndarray, level: int,
    shape: tuple[int, int, int],
) -> np.ndarray:
    """Derivatives by (group, node of the level, feature, bin)."""
    groups, k, width = shape
    n, first = 2**level, 2**level - 1

    def places(group: np.ndarray, bins: np.ndarray) -> Iterator[np.ndarray]:
        node = descend(group, bins, np.arange(len(group)), feature, cut, level) - first
        for j in range(k):
            yield ((group * n + node) * k + j) * width + bins[:, j]

    return _summed(state, name, tasks, forest, kept, groups * n * k * width, places).reshape(2, groups, n, k, width)


def _joint_histograms(
    state: DataFrame, name: str, tasks: int, forest: Forest, kept: int, sets: list[tuple[int, ...]], widths: list[int], groups: int
) -> list[np.ndarray]:
    """Derivatives by group and the bins of each set of features: arrays groups x 2 x widths."""
    sizes = [groups * math.prod(widths[f] for f in s) for s in sets]
    starts = np.concatenate(([0], np.cumsum(sizes)))

    def places(group: np.ndarray, bins: np.ndarray) -> Iterator[np.ndarray]:
        for s, start in zip(sets, starts.tolist()):
            at = group
            for f in s:
                at = at * widths[f] + bins[:, f]
            yield at + start

    sums = _summed(state, name, tasks, forest, kept, int(starts[-1]), places)
    parts = [sums[:, a:b].reshape(2, groups, *[widths[f] for f in s]) for s, a, b in zip(sets, starts, starts[1:])]
    return [np.moveaxis(p, 0, 1) for p in parts]


def _from_joint(tables: list[np.ndarray], sets: list[tuple[int, ...]], low: np.ndarray, high: np.ndarray, shape: tuple[int, int, int]) -> np.ndarray:
    """Derivatives by (group, node, feature, bin) inside the bounds of the nodes."""
    groups, k, width = shape
    out = np.zeros((2, groups, low.shape[1], k, width))
    whole = high[0, 0] if low.shape[1] == 1 else np.array([max(t.shape[2 + s.index(f)] for t, s in zip(tables, sets) if f in s) - 1 for f in range(k)])
    for g in range(groups):
        for node in range(low.shape[1]):
            lo, hi = low[g, node], high[g, node]
            if (lo > hi).any():
                continue
            bound = set(np.flatnonzero((lo > 0) | (hi < whole)).tolist())
            for j in range(k):
                at = next(i for i, s in enumerate(sets) if bound | {j} <= set(s))
                block = tables[at][(g, slice(None), *[slice(lo[f], hi[f] + 1) for f in sets[at]])]
                out[:, g, node, j, lo[j] : hi[j] + 1] = block.sum(tuple(1 + i for i, f in enumerate(sets[at]) if f != j))
    return out


def _halved(low: np.ndarray, high: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the children, left and right in turn; the right child of an unsplit node is empty."""
    groups, n, k = low.shape
    low, high = np.repeat(low, 2, 1), np.repeat(high, 2, 1)
    g, node = np.indices((groups, n))
    f = np.maximum(feature, 0)
    split = feature >= 0
    high[g, 2 * node, f] = np.where(split, np.minimum(cut, high[g, 2 * node, f]), high[g, 2 * node, f])
    low[g, 2 * node + 1, f] = np.where(split, cut + 1, high[g, 2 * node + 1, f] + 1)
    return low, high


def fit_one(cells: DataFrame, features: Sequence[str], weight: str = WEIGHT, rounds: int = 150) -> OneGroup:
    """One model of all cells."""
    return OneGroup(fit_boosted(cells.withColumn("_one", F.lit(0)), features, ["_one"], weight, rounds))

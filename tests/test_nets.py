"""Nets fitted together on cells against plain numpy on rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import bootstrap, nets
from tidegauge.operators.cells import compress
from tidegauge.session import cut_lineage

FEATURES = ["a", "b", "c"]


def sample(n=900, seed=3):
    rng, out = np.random.default_rng(seed), []
    for i in range(n):
        a, b = float(rng.integers(0, 5)), None if rng.random() < 0.1 else float(rng.integers(0, 3))
        c = float(rng.integers(0, 2))
        p = 1 / (1 + np.exp(1.5 - 0.9 * (a > 2) * (1 + c) + 0.5 * (b or 0)))
        out.append((i, 2001 + i % 2, a, b, c, float(rng.random() < p)))
    return out


@pytest.fixture(scope="module")
def rows(spark):
    return cut_lineage(spark.createDataFrame(sample(), "row_id long, wave int, a double, b double, c double, y double"))


def scaled(part, features):
    at = {"a": 2, "b": 3, "c": 4}
    x = np.array([[np.nan if r[at[f]] is None else r[at[f]] for f in features] for r in part])
    x = np.where(np.isnan(x), np.nanmedian(x, axis=0), x)
    return (x - x.mean(0)) / x.std(0), np.array([r[5] for r in part])


def plain_loss(shape, x, z, y):
    k, h = len(shape.features), shape.hidden
    w, b, v, c = x[: k * h].reshape(k, h), x[k * h : k * h + h], x[k * h + h : -1], x[-1]
    p = 1 / (1 + np.exp(-(np.tanh(z @ w + b) @ v + c)))
    return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)) + 1e-4 * ((w**2).sum() + (v**2).sum()) / 2 / len(y)


def slopes(shape, x, z, y, h=1e-6):
    eye = np.eye(len(x)) * h
    return np.array([(plain_loss(shape, x + e, z, y) - plain_loss(shape, x - e, z, y)) / (2 * h) for e in eye])


def test_loss_sums_equal_finite_differences():
    shape, rng = nets.Shape(("a", "b"), 3), np.random.default_rng(1)
    z, y, n = rng.normal(size=(40, 2)), rng.integers(0, 2, 40).astype(float), rng.integers(1, 5, 40).astype(float)
    x = shape.start(7)
    got, eye = nets.loss_sums(shape, x, z, y, n), np.eye(shape.size) * 1e-6
    assert shape.size == len(x) == 2 * 3 + 3 + 3 + 1
    up, down = ([nets.loss_sums(shape, x + s * e, z, y, n)[0] for e in eye] for s in (1, -1))
    assert got[1:] == pytest.approx((np.array(up) - np.array(down)) / 2e-6, abs=1e-4)


def test_fits_end_at_minima_of_the_row_loss(rows):
    shapes = {"small": nets.Shape(("a", "b"), 2), "large": nets.Shape(tuple(FEATURES), 4)}
    model = nets.fit_nets(compress(rows, ["wave", *FEATURES, "y"]), shapes, "wave")
    assert set(model.nets) == {(w, s) for w in (2001, 2002) for s in shapes}
    for (wave, name), net in model.nets.items():
        z, y = scaled([r for r in sample() if r[1] == wave], shapes[name].features)
        assert net.loss == pytest.approx(plain_loss(net.shape, net.params, z, y), abs=1e-9)
        start = plain_loss(net.shape, net.shape.start(nets.SEED), z, y)
        assert net.loss < start and (np.abs(slopes(net.shape, net.params, z, y)).max() < 2e-3 or net.rounds == nets.ROUNDS)


def test_cells_equal_rows_and_groups_equal_single_fits(rows):
    cells = compress(rows, ["wave", *FEATURES, "y"])
    both = nets.fit_nets(cells, {"n": nets.Shape(tuple(FEATURES), 3)}, "wave", rounds=60)
    for wave in (2001, 2002):
        one = nets.fit_one(rows.filter(F.col("wave") == wave).withColumn("w", F.lit(1)), FEATURES, 3, rounds=60)
        grouped = both.nets[wave, "n"]
        assert grouped.loss == pytest.approx(one.loss, abs=1e-6)
        scored = both.score(grouped.score(rows.filter(F.col("wave") == wave), "p"), "n", "q")
        assert scored.agg(F.max(F.abs(F.col("p") - F.col("q")))).first()[0] < 1e-12
        z, _ = scaled([r for r in sample() if r[1] == wave], FEATURES)
        want = nets.predict(grouped.shape, grouped.params, z)
        got = [r["p"] for r in scored.orderBy("row_id").collect()]
        assert got == pytest.approx(want, abs=1e-9)


def test_rows_without_a_net_and_columns_without_values(spark, rows):
    cells = compress(rows, ["wave", *FEATURES, "y"]).withColumn("a", F.when(F.col("wave") == 2001, F.col("a")))
    model = nets.fit_nets(cells.unionByName(cells.limit(3).withColumn("y", F.lit(None).cast("double"))), {"n": nets.Shape(("a", "c"), 2)}, "wave", rounds=5)
    new = spark.createDataFrame([(2001, 1.0, None), (2002, None, 1.0), (2010, 1.0, 1.0), (None, 1.0, 1.0)], "wave int, a double, c double")
    got = {r["wave"]: r["score"] for r in model.score(new, "n").collect()}
    assert 0 < got[2001] < 1 and 0 < got[2002] < 1 and got[2010] is None and got[None] is None
    assert nets.fit_nets(cells.limit(0), {"n": nets.Shape(("a",), 2)}, "wave").nets == {}


def test_search_minimises_a_curved_valley():
    search = nets.Search(np.array([-1.2, 1.0]), 500)
    while not search.done:
        a, b = search.point
        search.tell((1 - a) ** 2 + 100 * (b - a * a) ** 2, np.array([-2 * (1 - a) - 400 * a * (b - a * a), 200 * (b - a * a)]))
    assert search.x == pytest.approx([1, 1], abs=1e-3)


def test_refits_of_every_replicate(rows):
    got = {r["replicate"]: r for r in bootstrap.refit_nets_by_cells(rows, "row_id", FEATURES, 2, 3, rounds=15).collect()}
    draws = bootstrap.cell_draws(rows, "row_id", FEATURES, "y", 3)
    assert sorted(got) == [0, 1, 2]
    for rep in (0, 2):
        mine = cut_lineage(draws.filter(F.col("replicate") == rep))
        net = nets.fit_one(mine.filter("not is_test"), FEATURES, 2, "times", 15)
        test = [(r["score"], r["y"], r["times"]) for r in net.score(mine.filter("is_test")).collect()]
        s, y, w = (np.array(c, float) for c in zip(*test))
        d = s[y == 1][:, None] - s[y == 0][None]
        want = (w[y == 1][:, None] * w[y == 0][None] * ((d > 1e-9) + 0.5 * (abs(d) <= 1e-9))).sum() / (w[y == 1].sum() * w[y == 0].sum())
        assert got[rep]["auc"] == pytest.approx(want, abs=1e-6)
        flagged = s >= 0.10
        assert got[rep]["sens"] == pytest.approx(w[(y == 1) & flagged].sum() / w[y == 1].sum(), abs=1e-9)


def test_cells_are_dealt_by_number_and_sums_do_not_depend_on_it(rows, monkeypatch):
    cells = compress(rows, ["wave", *FEATURES, "y"])
    shapes = {"net": nets.Shape(tuple(FEATURES), 2)}
    one = nets.fit_nets(cells, shapes, "wave", rounds=3)
    monkeypatch.setattr(nets, "CELLS_PER_TASK", 10)
    plain = cells.select(F.col("wave").alias("_g"), F.col("y").alias("_y"), F.col("w").cast("double").alias("_n"), *FEATURES)
    preps = {g: net.prep for (g, _), net in one.nets.items()}
    assert nets._blocks(plain, FEATURES, preps).rdd.getNumPartitions() == -(-cells.count() // 10)
    many = nets.fit_nets(cells, shapes, "wave", rounds=3)
    for key, net in one.nets.items():
        assert np.allclose(net.params, many.nets[key].params, atol=1e-9)

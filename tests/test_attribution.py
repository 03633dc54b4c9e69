"""Shapley attribution against the sum over all orders of features."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import attribution, boosting, nets
from tidegauge.session import local_rows

FEATS = ["a", "b", "c"]


def by_orders(f, x, background):
    """Mean gain of each feature over all orders in which features take the cell's values."""
    phi, total = np.zeros(len(x)), sum(w for w, _ in background)
    for w, row in background:
        for order in itertools.permutations(range(len(x))):
            now = list(row)
            for j in order:
                before = f(now)
                now[j] = x[j]
                phi[j] += w / total * (f(now) - before) / math.factorial(len(x))
    return phi


@pytest.fixture(scope="module")
def cells(spark):
    rng = np.random.default_rng(4)
    rows = []
    for a, b, c in itertools.product(range(4), range(2), range(3)):
        p = 1 / (1 + np.exp(1 - 0.6 * a * (b + 0.2) + 0.3 * c))
        n1 = int(rng.binomial(60, p))
        rows += [(2001 + a % 2, float(a), float(b), float(c) if c else None, 1.0, n1), (2001 + a % 2, float(a), float(b), float(c) if c else None, 0.0, 60 - n1)]
    return local_rows(spark, rows, "wave int, a double, b double, c double, y double, w bigint").filter("w > 0").cache()


def test_equals_all_orders(cells):
    def f(v):
        a, b, c = (0.5 if x is None else x for x in v)
        return a * b + max(b, c) - 0.1 * a * b * c

    def score(df):
        a, b, c = (F.coalesce(F.col(x), F.lit(0.5)) for x in FEATS)
        return df.withColumn("score", a * b + F.greatest(b, c) - 0.1 * a * b * c)

    background = attribution.background_medians(cells, FEATS, ["wave"])
    assert len(background) == 2 and sum(w for w, _ in background) == cells.agg(F.sum("w")).first()[0]
    background.append((7.0, [None, 1.0, 2.0]))
    got = attribution.shapley(cells, FEATS, score, background).collect()
    assert len(got) == 24 and sum(r.w for r in got) == cells.agg(F.sum("w")).first()[0]
    base = sum(w * f(v) for w, v in background) / sum(w for w, _ in background)
    for r in got:
        x = [r.a, r.b, r.c]
        want = by_orders(f, x, background)
        assert np.allclose([r.phi_a, r.phi_b, r.phi_c], want, atol=1e-12)
        assert r.base == pytest.approx(base) and r.score == pytest.approx(f(x))


@pytest.mark.parametrize("kind", ["trees", "net"])
def test_parts_of_fitted_models_add_up(cells, kind):
    fit = boosting.fit_one(cells, FEATS, rounds=20) if kind == "trees" else nets.fit_one(cells, FEATS, 2, rounds=30)
    got = attribution.shapley(cells, FEATS, fit.score, attribution.background_medians(cells, FEATS)).collect()
    own = {(r.a, r.b, r.c): r.score for r in fit.score(cells).collect()}
    assert len(got) == len(own)
    for r in got:
        assert r.score == pytest.approx(own[r.a, r.b, r.c], abs=1e-12)
        assert r.phi_a + r.phi_b + r.phi_c == pytest.approx(r.score - r.base, abs=1e-12)


def test_summary_and_bounds(cells):
    def score(df):
        return df.withColumn("score", 2 * F.col("a") + F.col("b"))

    table = attribution.shapley(cells, FEATS, score, [(1.0, [1.0, 0.0, None])])
    got = {r.feature: r for r in attribution.shapley_summary(table, FEATS).collect()}
    rows = cells.select("a", "b", "w").collect()
    n = sum(r.w for r in rows)
    assert got["a"].mean_abs == pytest.approx(sum(r.w * abs(2 * (r.a - 1)) for r in rows) / n)
    assert got["a"].mean == pytest.approx(sum(r.w * 2 * (r.a - 1) for r in rows) / n)
    assert got["b"].mean == pytest.approx(sum(r.w * r.b for r in rows) / n) and got["c"].mean_abs < 1e-12
    assert attribution.shapley(cells.limit(0), FEATS, score, [(1.0, [1.0, 0.0, None])]).count() == 0
    with pytest.raises(ValueError):
        attribution.shapley(cells, FEATS, score, [])
    with pytest.raises(ValueError):
        attribution.shapley(cells, [f"f{i}" for i in range(17)], score, [(1.0, [None] * 17)])


def test_trees_by_sets_equal_a_row_for_every_set(cells, monkeypatch):
    rows = cells.withColumn("d", F.pmod(F.col("a") * 5 + F.col("b") * 3, F.lit(4)))
    feats = [*FEATS, "d"]
    fit = boosting.fit_one(rows, feats, rounds=12)
    background = [*attribution.background_medians(rows, feats, ["wave"]), (7.0, [None, 1.0, 2.0, None])]
    monkeypatch.setattr(attribution, "SCORES_PER_TASK", 64)
    monkeypatch.setattr(attribution, "SCORES_AT_ONCE", 64)
    table = attribution.shapley_by_sets(rows, feats, fit.set_scores, background)
    assert table.rdd.getNumPartitions() > 1  # few bytes, much work
    got = {tuple(r)[: len(feats)]: tuple(r)[len(feats) :] for r in table.collect()}
    want = {tuple(r)[: len(feats)]: tuple(r)[len(feats) :] for r in attribution.shapley(rows, feats, fit.score, background).collect()}
    assert got.keys() == want.keys()
    assert all(np.allclose(got[v], want[v], atol=1e-12) for v in want)
    assert attribution.shapley_by_sets(rows.limit(0), feats, fit.set_scores, background).count() == 0


def test_permutation_importance_draws_by_join(spark):
    """Draws meet their steps by a join; filtering an array of steps for each row and feature took twice the time."""
    import hashlib

    from tidegauge.operators import inference

    rows = [(i, int(i * 7 % 10 < 3), None if i % 11 == 0 else i % 3, i * i % 5) for i in range(64)]
    frame = spark.createDataFrame(rows, "row_id long, y int, p int, q int")
    seen = []

    def score(cells):
        seen.append(cells)
        return cells.selectExpr("*", "coalesce(p, 1) + q / 10D as score")

    got = inference.permutation_importance(frame, ["p", "q"], score)
    assert {r.feature for r in got.collect()} == {"p", "q", "none"}
    want = {}
    for k, f in ((2, "p"), (3, "q")):
        levels = sorted((r[k] for r in rows), key=lambda v: (v is not None, v))
        for r in rows:
            u = int(hashlib.md5(f"42:{f}:{r[0]}".encode()).hexdigest()[:8], 16) / 2**32
            new = [*r]
            new[k] = levels[int(u * len(levels))]
            key = (f, *new[1:])
            want[key] = want.get(key, 0) + 1
    for r in rows:
        want[("none", *r[1:])] = want.get(("none", *r[1:]), 0) + 1
    weight = next(c for c in seen[0].columns if c not in ("feature", "y", "p", "q"))
    assert {(c.feature, c.y, c.p, c.q): c[weight] for c in seen[0].collect()} == want
    assert "lambda" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()

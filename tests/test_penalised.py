"""Elastic-net paths against proximal gradient descent in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import penalised
from tidegauge.operators.cells import compress
from tidegauge.session import local_rows

FEATS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    n = 900
    x = np.column_stack([rng.integers(0, 5, n), rng.integers(0, 2, n), rng.integers(0, 4, n)]).astype(float)
    y = (rng.random(n) < 1 / (1 + np.exp(1.5 - 0.7 * x[:, 0] + 0.8 * x[:, 1]))).astype(float)
    x[rng.random(n) < 0.05, 2] = np.nan
    return x, y, np.arange(n) % 5


@pytest.fixture(scope="module")
def cells(spark, data):
    x, y, fold = data
    rows = [(int(f), *[None if np.isnan(v) else float(v) for v in r], float(t)) for f, r, t in zip(fold, x, y)]
    return compress(local_rows(spark, rows, "fold int, a double, b double, c double, y double"), ["fold", *FEATS, "y"]).cache()


def prepared(x):
    x = np.where(np.isnan(x), np.nanmedian(x, 0), x)
    return x.mean(0), x.std(0), np.nanmedian(x, 0)


def proximal(x, y, strength, mix, steps=20_000):
    """Slow but plain: gradient steps and soft thresholds from zero."""
    n, beta = len(y), np.zeros(x.shape[1] + 1)
    z = np.column_stack([np.ones(n), x])
    rate, l1, l2 = 4 * n / np.linalg.norm(z, 2) ** 2, mix / (strength * n), (1 - mix) / (strength * n)
    rate = 1 / (1 / rate + l2)
    for _ in range(steps):
        g = z.T @ (1 / (1 + np.exp(-z @ beta)) - y) / n
        g[1:] += l2 * beta[1:]
        beta = beta - rate * g
        beta[1:] = np.sign(beta[1:]) * np.maximum(np.abs(beta[1:]) - rate * l1, 0)
    return beta


def area(s, y):
    p, n = s[y == 1], s[y == 0]
    return ((p[:, None] > n).mean() + (p[:, None] == n).mean() / 2)


def test_path_equals_proximal_gradient(cells, data):
    x, y, fold = data
    strengths = [1e-3, 0.03, 1.0]
    got = penalised.elastic_net_path(cells, FEATS, strengths=strengths)
    scores = {(r.fold, r.step): r.auc for r in got.scores.collect()}
    assert sorted(got.fits) == [-1, 0, 1, 2, 3, 4] and len(scores) == 15
    for g in got.fits:
        train = fold != g
        filled = np.where(np.isnan(x), np.nanmedian(x[train], 0), x)
        z = (filled - filled[train].mean(0)) / filled[train].std(0)
        for step, c in enumerate(strengths):
            want = proximal(z[train], y[train], c, 0.5)
            assert np.allclose(got.fits[g].path[step], want, atol=1e-5)
            if g >= 0:
                assert scores[g, step] == pytest.approx(area(np.round(z[~train] @ want[1:], 4), y[~train]), abs=2e-3)
    assert all(gap <= 1e-7 for f in got.fits.values() for gap in f.gaps)
    assert (got.fits[-1].path[0][1:] == 0).any()  # the strongest penalty drops features
    means = [np.mean([scores[g, s] for g in range(5)]) for s in range(3)]
    assert means[got.chosen] == pytest.approx(max(means)) and got.coefficients[0][0] == "intercept"
    assert got.penalty(2) == pytest.approx(1 / len(y))


def test_optimality_conditions_on_rows(cells, data):
    x, y, _ = data
    got = penalised.elastic_net_path(cells, FEATS)
    assert len(got.fits[-1].path) == 10
    filled = np.where(np.isnan(x), np.nanmedian(x, 0), x)
    z = np.column_stack([np.ones(len(y)), (filled - filled.mean(0)) / filled.std(0)])
    for c, beta in zip(got.strengths, got.fits[-1].path):
        grad = z.T @ (1 / (1 + np.exp(-z @ beta)) - y) / len(y)
        l1 = l2 = 0.5 / (c * len(y))
        g = grad[1:] + l2 * beta[1:]
        assert abs(grad[0]) < 1e-6
        for b, d in zip(beta[1:], g):
            assert abs(d + l1 * np.sign(b)) < 1e-6 if b else abs(d) <= l1 + 1e-6


def test_odd_tables(cells):
    assert penalised.elastic_net_path(cells.limit(0), FEATS) is None
    assert penalised.elastic_net_path(cells.filter("y = 1"), FEATS) is None
    one = cells.withColumn("c", F.lit(2.0)).withColumn("fold", F.when(F.col("y") == 1, 0).otherwise(F.col("fold")))
    got = penalised.elastic_net_path(one, FEATS, strengths=[0.1])  # fold 0 holds all positives, a column is constant
    assert 0 not in got.fits and got.fits[-1].path[0][3] == 0
    assert got.scores.count() == 0 and got.chosen == 0

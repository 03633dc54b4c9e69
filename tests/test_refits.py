"""Refit bootstrap from cells: draws, and every replicate against a plain refit."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import boosting, bootstrap
from tidegauge.session import cut_lineage

FEATURES = ["a", "b"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(9)
    out = []
    for i in range(1500):
        a, b = float(rng.integers(0, 3)), None if rng.random() < 0.1 else float(rng.integers(0, 4))
        out.append((i, a, b, float(rng.random() < 1 / (1 + np.exp(1.2 - 0.6 * a - 0.2 * (b or 0))))))
    return cut_lineage(spark.createDataFrame(out, "row_id long, a double, b double, y double"))


def plain_auc(score, y, w):
    p, n = y == 1, y == 0
    d = score[p][:, None] - score[n][None]
    return float((w[p][:, None] * w[n][None] * ((d > 1e-12) + 0.5 * (abs(d) <= 1e-12))).sum() / (w[p].sum() * w[n].sum()))


def test_draws_are_poisson_and_repeatable(rows):
    draws = bootstrap.cell_draws(rows, "row_id", FEATURES, "y", 130)
    again = bootstrap.cell_draws(rows, "row_id", FEATURES, "y", 130)
    assert draws.exceptAll(again).count() == 0 and draws.count() == again.count()
    totals = np.array([r["t"] for r in draws.groupBy("replicate").agg(F.sum("times").alias("t")).collect()])
    assert len(totals) == 130 and abs(totals.mean() - 1500) < 4 * np.sqrt(1500 / 130) and 0.6 < totals.var() / 1500 < 1.6
    assert draws.filter("times <= 0").count() == 0 and draws.agg(F.max("replicate")).first()[0] == 129


def test_every_replicate_equals_a_plain_refit(rows):
    draws = bootstrap.cell_draws(rows, "row_id", FEATURES, "y", 6).collect()
    got = {r["replicate"]: r for r in bootstrap.refit_scorecard_by_cells(rows, "row_id", FEATURES, "y", 6).collect()}
    assert sorted(got) == list(range(6))
    for rep, found in got.items():
        mine = [r for r in draws if r["replicate"] == rep]
        train, test = ([r for r in mine if r["is_test"] == side] for side in (False, True))

        def card(rows_):
            n1 = sum(r["times"] for r in rows_ if r["y"] == 1)
            n0 = sum(r["times"] for r in rows_ if r["y"] == 0)
            out = {}
            for f in FEATURES:
                for level in {r[f] for r in rows_}:
                    m1 = sum(r["times"] for r in rows_ if r[f] == level and r["y"] == 1)
                    m0 = sum(r["times"] for r in rows_ if r[f] == level and r["y"] == 0)
                    out[f, level] = np.log((m1 + 0.5) / (n1 + 1)) - np.log((m0 + 0.5) / (n0 + 1))
            return out

        woe = card(train)
        score = np.array([sum(woe.get((f, r[f]), 0.0) for f in FEATURES) for r in test])
        y, w = np.array([r["y"] for r in test]), np.array([r["times"] for r in test], float)
        assert found["auc"] == pytest.approx(plain_auc(score, y, w), abs=1e-6)
        assert found["n_total"] == w.sum() and found["n_positive"] == w[y == 1].sum()


def test_trees_of_every_replicate(rows):
    draws = bootstrap.cell_draws(rows, "row_id", FEATURES, "y", 4)
    got = {r["replicate"]: r["auc"] for r in bootstrap.refit_boosted_by_cells(rows, "row_id", FEATURES, "y", 4, rounds=3).collect()}
    for rep in (0, 3):
        mine = cut_lineage(draws.filter(F.col("replicate") == rep))
        one = boosting.fit_one(mine.filter("not is_test"), FEATURES, "times", 3)
        test = one.score(mine.filter("is_test")).collect()
        want = plain_auc(*(np.array([r[c] for r in test], float) for c in ("score", "y", "times")))
        assert got[rep] == pytest.approx(want, abs=1e-9)


def test_cells_and_rows_agree(rows):
    by_rows = bootstrap.refit_scorecard(rows, "row_id", FEATURES, "y", 60).agg(F.avg("auc"), F.stddev("auc")).first()
    by_cells = bootstrap.refit_scorecard_by_cells(rows, "row_id", FEATURES, "y", 200).agg(F.avg("auc"), F.stddev("auc")).first()
    assert abs(by_rows[0] - by_cells[0]) < 4 * by_rows[1] / np.sqrt(60) and 0.5 < by_rows[1] / by_cells[1] < 2

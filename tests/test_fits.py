"""Fits against brute force on small fixtures."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import calibrate, inference, learners, nets, sampling, scorecard
from tidegauge.operators.cells import compress
from tidegauge.operators.ranking import auc
from tidegauge.plans import grid as grid_plan
from tidegauge.plans import transport
from tidegauge.session import local_rows

FEATS = ["a", "b"]
THREE = ["a", "b", "c"]


def make(n=1200, seed=0):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 5, n).astype(float), rng.integers(0, 2, n).astype(float)
    p = 1 / (1 + np.exp(-(-1.5 + 0.5 * a - 0.7 * b)))
    y = (rng.random(n) < p).astype(float)
    return a, b, y, rng


@pytest.fixture(scope="module")
def table(spark):
    a, b, y, rng = make()
    wave = rng.integers(2001, 2004, len(a))
    rows = [(i, int(w), float(u), float(v), float(t)) for i, (w, u, v, t) in enumerate(zip(wave, a, b, y))]
    return local_rows(spark, rows, "row_id bigint, wave int, a double, b double, y double").withColumn(
        "employment", F.lit(1.0)
    ).withColumn("c", (F.col("row_id") % 3).cast("double")).cache()


def newton(x, y, w=None, steps=50, ridge=None):
    w = np.ones(len(y)) if w is None else w
    ridge = np.zeros(x.shape[1]) if ridge is None else ridge
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ beta))
        h = (x * (w * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        beta = beta + np.linalg.solve(h, x.T @ (w * (y - p)) - ridge * beta)
    return beta, h


def columns(df, names):
    pdf = df.orderBy("row_id").toPandas()
    return [pdf[c].to_numpy() for c in names]


def test_wald_table_matches_newton(table):
    a, b, y = columns(table, ["a", "b", "y"])
    x = np.column_stack([(a - a.mean()) / a.std(), (b - b.mean()) / b.std(), np.ones(len(a))])
    beta, h = newton(x, y)
    se = np.sqrt(np.diag(np.linalg.inv(h)))
    got = {t: (c, s) for t, c, s, _ in learners.wald_table(compress(table, ["a", "b", "y"]), FEATS)}
    for name, c, s in zip(["a", "b", "intercept"], beta, se):
        assert got[name] == pytest.approx((c, s), rel=1e-6)


def test_logistic_on_cells_equals_rows(table):
    cells = learners.coefficients(learners.fit_logistic(compress(table, ["a", "b", "y"]), FEATS))
    rows = learners.coefficients(learners.fit_logistic(table, FEATS, weight=None))
    assert [c for _, c in cells] == pytest.approx([c for _, c in rows], abs=1e-6)


def test_design_variance_matches_direct_sum(spark):
    a, b, y, rng = make(600, 4)
    h, c, w = rng.integers(0, 4, 600), rng.integers(0, 3, 600), rng.uniform(1, 3, 600)
    df = local_rows(
        spark,
        [(float(p), float(q), float(t), int(s), int(k), float(v)) for p, q, t, s, k, v in zip(a, b, y, h, c, w)],
        "a double, b double, y double, s int, c int, w double",
    )
    got = {r.term: r for r in inference.design_logistic(df, FEATS, "y", "s", "c", "w").collect()}
    x = np.column_stack([np.ones(600), a, b])
    beta, info = newton(x, y, w)
    u = x * (w * (y - 1 / (1 + np.exp(-x @ beta))))[:, None]
    meat = np.zeros((3, 3))
    for s in range(4):
        sums = np.array([u[(h == s) & (c == k)].sum(axis=0) for k in range(3)])
        d = sums - sums.mean(axis=0)
        meat += 3 / 2 * d.T @ d
    inv = np.linalg.inv(info)
    se = np.sqrt(np.diag(inv @ meat @ inv))
    for name, bb, ss in zip(["intercept", "a", "b"], beta, se):
        assert got[name].coefficient == pytest.approx(bb, rel=1e-5)
        assert got[name].se == pytest.approx(ss, rel=1e-5)


def test_random_intercept_is_the_penalised_mode(table):
    a, b, y, wave = columns(table, ["a", "b", "y", "wave"])
    groups = sorted(set(wave))
    z = lambda v: (v - v.mean()) / v.std()
    x = np.column_stack([np.ones(len(a)), z(a), z(b), *[(wave == g).astype(float) for g in groups]])
    ridge = np.array([0, 1 / 100, 1 / 100, *[1 / 0.25] * len(groups)])
    beta, _ = newton(x, y, ridge=ridge)
    got = {r.term: r.coefficient for r in inference.random_intercept(compress(table, ["wave", "a", "b", "y"]), FEATS, sigma=0.5).collect()}
    want = dict(zip(["intercept", "a", "b", *[f"wave_{g}" for g in groups]], beta))
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-7), k
    assert inference.random_intercept(compress(table.limit(50), ["wave", "a", "b", "y"]), FEATS) is None


def test_group_spread_solves_its_equation(spark):
    rng = np.random.default_rng(12)
    n, true = 6000, 0.8
    group, a = rng.integers(0, 12, n), rng.integers(0, 4, n).astype(float)
    shift = rng.normal(0, true, 12)
    y = (rng.random(n) < 1 / (1 + np.exp(1 - 0.4 * a - shift[group]))).astype(float)
    df = local_rows(spark, [(int(g), float(x), float(t)) for g, x, t in zip(group, a, y)], "wave int, a double, y double")
    got = {r.term: r for r in inference.random_intercept(compress(df, ["wave", "a", "y"]), ["a"]).collect()}
    sigma = got["sigma"].coefficient
    # dense fit on rows at this sigma
    x = np.column_stack([np.ones(n), (a - a.mean()) / a.std(), *[(group == g).astype(float) for g in range(12)]])
    ridge = np.array([0, 1 / 100, *[sigma**-2] * 12])
    beta, _ = newton(x, y, ridge=ridge)
    p = 1 / (1 + np.exp(-x @ beta))
    cov = np.linalg.inv((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge))
    names = ["intercept", "a", *[f"wave_{g}" for g in range(12)]]
    for i, name in enumerate(names):
        assert got[name].coefficient == pytest.approx(beta[i], abs=1e-6), name
        assert got[name].se == pytest.approx(np.sqrt(cov[i, i]), rel=1e-5), name
        assert got[name].hi - got[name].lo == pytest.approx(2 * 1.959964 * np.sqrt(cov[i, i]), rel=1e-5)
    assert sigma**2 == pytest.approx(np.mean(beta[2:] ** 2 + np.diag(cov)[2:]), rel=1e-6)
    assert got["sigma"].lo < true < got["sigma"].hi

    def marginal(s):  # Laplace's log likelihood without constants
        r = np.array([0, 1 / 100, *[s**-2] * 12])
        b, _ = newton(x, y, ridge=r)
        q = 1 / (1 + np.exp(-x @ b))
        h = (x * (q * (1 - q))[:, None]).T @ x + np.diag(r)
        return (y * np.log(q) + (1 - y) * np.log(1 - q)).sum() - r @ b**2 / 2 - 12 * np.log(s) - np.linalg.slogdet(h)[1] / 2

    assert marginal(sigma) > max(marginal(sigma * 0.8), marginal(sigma * 1.25))


def test_groups_that_do_not_differ(spark):
    df = local_rows(spark, [(g, float(i % 4 == 0), float(i % 3)) for g in range(3) for i in range(600)], "wave int, y double, a double")
    got = {r.term: r for r in inference.random_intercept(compress(df, ["wave", "a", "y"]), ["a"]).collect()}
    assert got["sigma"].coefficient < 0.1 and all(abs(got[f"wave_{g}"].coefficient) < 1e-6 for g in range(3))


def test_dominance_adds_up_and_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3))
    y = x @ [1.0, 0.5, 0.0] + rng.normal(size=400)
    df = local_rows(spark, [(*map(float, r), float(t), 1) for r, t in zip(x, y)], "p double, q double, r double, y double, w bigint")
    names = ["p", "q", "r"]
    subsets = inference.subset_r2(inference.moments(df, [*names, "y"]), "y", names)

    def r2(idx):
        if not idx:
            return 0.0
        m = np.column_stack([np.ones(400), x[:, list(idx)]])
        res = y - m @ np.linalg.lstsq(m, y, rcond=None)[0]
        return 1 - res @ res / ((y - y.mean()) @ (y - y.mean()))

    for r in subsets.collect():
        assert r.r2 == pytest.approx(r2([i for i in range(3) if r.mask >> i & 1]), abs=1e-10)
    got = {r.term: r.incremental_r2 for r in inference.dominance(subsets, names).collect()}
    for i, n in enumerate(names):
        others = [j for j in range(3) if j != i]
        want = np.mean([
            np.mean([r2([*s, i]) - r2(s) for s in itertools.combinations(others, k)]) for k in range(3)
        ])
        assert got[n] == pytest.approx(want, abs=1e-10)
    assert sum(got.values()) == pytest.approx(r2([0, 1, 2]), abs=1e-10)


def test_recalibration_keeps_auc_and_lowers_brier(table):
    rows = table.withColumn("score", F.lit(0.02) + F.col("a") / 20)
    r = calibrate.recalibration_summary(rows, "score", "y", "m").first()
    assert r.auc_before == pytest.approx(r.auc_after) and r.brier_after < r.brier_before


def test_probability_scale_matches_ridge_newton(table):
    a, b, y = columns(table, ["a", "b", "y"])
    rows = table.withColumn("score", F.col("a") / 10)
    x = np.column_stack([np.ones(len(a)), a / 10])
    beta, _ = newton(x, y, ridge=np.array([0.0, 1.0]))
    got = calibrate.intercept_slope(rows, "score", "y", scale="probability", ridge=1.0)
    assert got == pytest.approx(tuple(beta), rel=1e-5)


def test_trees_do_not_change_under_monotone_recodes(table):
    cells = compress(table, ["a", "b", "y"])
    moved = cells.withColumn("a", F.col("a") * F.col("a") * 3 + 10)
    one = auc(learners.fit_trees(cells, FEATS, rounds=5).score(cells), "score", "y", weight="w").first().auc
    two = auc(learners.fit_trees(moved, FEATS, rounds=5).score(moved), "score", "y", weight="w").first().auc
    assert one == pytest.approx(two, abs=1e-9) and one > 0.6


def test_calibrated_trees_are_calibrated(table):
    rows = sampling.folds(table, "row_id", ["y"])
    cells = compress(rows, ["fold", "a", "b", "y"])
    model = calibrate.fit_calibrated(cells, FEATS, lambda c, f: learners.fit_trees(c, f, rounds=5))
    r = model.score(cells).agg(
        (F.sum(F.col("score") * F.col("w")) / F.sum("w")).alias("p"), (F.sum(F.col("y") * F.col("w")) / F.sum("w")).alias("y")
    ).first()
    assert r.p == pytest.approx(r.y, abs=0.02)


def test_net_learns_and_scores_frames_without_a_feature(table):
    net = nets.fit_one(compress(table, [*FEATS, "y"]), FEATS, 3, rounds=60)
    assert auc(net.score(table), "score", "y").first().auc > 0.65
    assert net.score(table.drop("b")).filter("score is null").count() == 0


def test_gain_table_is_sorted_and_limited(table):
    fitted = learners.fit_trees(compress(table, ["a", "b", "y"]), FEATS, rounds=3)
    gains = learners.gain_table(fitted, limit=1)
    assert gains[0][0] == "a" and len(gains) == 1


def test_scorecard_unseen_level_scores_zero_and_grid_sizes(spark, table):
    model = scorecard.fit(table.filter("a < 4"), ["a"])
    row = scorecard.score(table.filter("a = 4"), model, ["a"]).select("score").distinct().collect()
    assert [r.score for r in row] == [0.0]
    grid = grid_plan.scorecard_grid(table, THREE).collect()
    sizes = {}
    for r in grid:
        sizes.setdefault(r.test_wave, set()).add((r.n_total, r.n_positive))
    assert len(grid) == 9 and all(len(v) == 1 for v in sizes.values())  # depends on the test wave only


def test_excluding_cards_equal_separate_fits(table):
    cells = compress(table, ["wave", "a", "b", "y"])
    shared = scorecard.fit_excluding(cells, FEATS, [2001, 2002, 2003]).filter("wave = 2002")
    train, _ = transport.leave_wave_out(cells, 2002)
    own = scorecard.fit(train, FEATS, weight="w")
    got = {(r.feature, r.level): r.woe for r in shared.collect()}
    assert got == pytest.approx({(r.feature, r.level): r.woe for r in own.collect()})


def test_too_few_positives_drop_a_wave(table):
    few = table.filter("wave <> 2003 or y = 0")
    waves = {r.train_wave for r in grid_plan.scorecard_grid(few, THREE).collect()}
    assert waves == {2001, 2002}
    with pytest.raises(ValueError):
        grid_plan.scorecard_grid(table, FEATS)  # fewer than three features

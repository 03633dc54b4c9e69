"""Boosted trees of many groups against a row-by-row boosting written out plainly."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import boosting
from tidegauge.session import cut_lineage

FEATURES = ["a", "b", "c", "d"]


def make_rows(seed=3, groups=(1, 2), n=160):
    rng, rows = np.random.default_rng(seed), []
    for g in groups:
        for _ in range(n):
            x = [None if rng.random() < 0.06 else float(v) for v in rng.integers(0, (2, 4, 7, 3))]
            p = 1 / (1 + np.exp(1.5 - 0.7 * (x[1] or 0) + g * 0.3 * (x[2] or 0) * ((x[0] or 0) - 0.5)))
            rows.append((g, *x, float(rng.random() < p), int(rng.integers(1, 5))))
    return rows


def plain_boosting(x, y, w, rounds, depth=3, step=0.3, ridge=1.0):
    """Scores of all rows after ``rounds`` trees; x is filled. Cuts lie midway between levels."""
    w = w * np.where(y == 1, w[y == 0].sum() / w[y == 1].sum(), 1.0)
    margin = np.zeros(len(y))

    def grow(rows, left, g, h, out):
        def score(r):
            return g[r].sum() ** 2 / (h[r].sum() + ridge)

        best = (1e-10, None)
        if left:
            for j in range(x.shape[1]):
                for cut in sorted(set(x[:, j]))[:-1]:
                    a, b = rows[x[rows, j] <= cut], rows[x[rows, j] > cut]
                    if min(h[a].sum(), h[b].sum()) >= 1.0:
                        gain = score(a) + score(b) - score(rows)
                        if gain > best[0] * (1 + 1e-9):
                            best = (gain, (a, b))
        if best[1] is None:
            out[rows] = -step * g[rows].sum() / (h[rows].sum() + ridge)
        else:
            for part in best[1]:
                grow(part, left - 1, g, h, out)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        out = np.zeros(len(y))
        grow(np.arange(len(y)), depth, w * (p - y), w * p * (1 - p), out)
        margin = margin + out
    return 1 / (1 + np.exp(-margin))


@pytest.fixture(scope="module")
def cells(spark):
    schema = "g int, " + ", ".join(f"{f} double" for f in FEATURES) + ", y double, w long"
    return cut_lineage(spark.createDataFrame(make_rows(), schema).withColumn("n", F.monotonically_increasing_id()))


def expected(cells, rounds):
    got = {}
    for g in (1, 2):
        rows = [r for r in cells.collect() if r["g"] == g]
        x = np.array([[np.nan if r[f] is None else r[f] for f in FEATURES] for r in rows])
        w = np.array([r["w"] for r in rows])
        for j in range(x.shape[1]):
            held = ~np.isnan(x[:, j])
            x[~held, j] = np.median(np.repeat(x[held, j], w[held]))
        score = plain_boosting(x, np.array([r["y"] for r in rows]), w.astype(float), rounds)
        got |= {r["n"]: s for r, s in zip(rows, score)}
    return got


@pytest.mark.parametrize("joint, tasks, keep", [(10**9, 10**6, 25), (0, 10**6, 25), (10**9, 60, 4), (0, 60, 4)])
def test_all_forms_equal_plain_boosting(cells, monkeypatch, joint, tasks, keep):
    monkeypatch.setattr(boosting, "JOINT", joint)
    monkeypatch.setattr(boosting, "CELLS_PER_TASK", tasks)
    monkeypatch.setattr(boosting, "KEEP", keep)
    model = boosting.fit_boosted(cells, FEATURES, ["g"], rounds=12)
    want = expected(cells, 12)
    got = {r["n"]: r["score"] for r in model.score(cells).collect()}
    assert got.keys() == want.keys() and max(abs(got[n] - want[n]) for n in want) < 1e-9


def test_groups_do_not_mix(cells):
    both = boosting.fit_boosted(cells, FEATURES, ["g"], rounds=6)
    one = boosting.fit_boosted(cells.filter("g = 2"), FEATURES, ["g"], rounds=6)
    a = {r["n"]: r["score"] for r in both.score(cells.filter("g = 2")).collect()}
    b = {r["n"]: r["score"] for r in one.score(cells).collect()}
    assert a.keys() == b.keys() and max(abs(a[n] - b[n]) for n in a) < 1e-9


def test_many_levels_constant_and_empty_features(spark):
    rng = np.random.default_rng(1)
    rows = [(1, float(v), 3.0, None, float(rng.random() < 1 / (1 + np.exp(-v))), 1) for v in rng.normal(size=900)]
    df = cut_lineage(spark.createDataFrame(rows, "g int, a double, b double, c double, y double, w long"))
    model = boosting.fit_boosted(df, ["a", "b", "c"], ["g"], rounds=10)
    assert 200 < len(model.cuts[0]) <= boosting.BINS and len(model.cuts[1]) == len(model.cuts[2]) == 0
    scored = model.score(df)
    assert scored.stat.corr("a", "score") > 0.7
    assert model.score(df.drop("a")).agg(F.countDistinct("score")).first()[0] == 1
    none = boosting.fit_boosted(df.filter("g = 5"), ["a", "b"], ["g"], rounds=2)
    assert none.score(df).count() == 0
    one_class = boosting.fit_boosted(df.filter("y = 1"), ["a"], ["g"], rounds=3)
    assert one_class.score(df).filter("score is null or isnan(score)").count() == 0


def plain_sigmoid(s, y, w):
    """Smoothed sigmoid of one group by damped Newton steps on rows."""
    n1, n0 = w[y == 1].sum(), w[y == 0].sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, beta = np.stack([np.ones(len(s)), s], 1), np.zeros(2)
    for _ in range(200):
        q = 1 / (1 + np.exp(-x @ beta))
        beta = beta + 0.7 * np.linalg.solve(x.T @ (x * (w * q * (1 - q))[:, None]), x.T @ (w * (target - q)))
    return beta


def test_calibrated_parts_equal_plain_ones(spark, cells):
    from tidegauge.operators import calibrate

    k = 3
    folded = cut_lineage(cells.withColumn("fold", (F.col("n") % k).cast("int")))
    model = calibrate.fit_calibrated_by(folded, FEATURES, ["g"], k=k, rounds=4)
    rows = folded.collect()
    want = {r["n"]: 0.0 for r in rows}
    aucs = {}
    for g in (1, 2):
        mine = [r for r in rows if r["g"] == g]
        for part in range(k):
            train = [r for r in mine if r["fold"] != part]
            x, med = np.array([[np.nan if r[f] is None else r[f] for f in FEATURES] for r in mine]), []
            for f in FEATURES:
                med.append(np.median(np.concatenate([[r[f]] * r["w"] for r in train if r[f] is not None])))
            x = np.where(np.isnan(x), med, x)
            seen = np.array([r["fold"] != part for r in mine])
            y, w = np.array([r["y"] for r in mine]), np.array([r["w"] for r in mine], float)
            one = boosting.fit_one(spark.createDataFrame([tuple(map(float, v)) + (float(a), int(b)) for v, a, b in zip(x[seen], y[seen], w[seen])], ", ".join(f"{f} double" for f in FEATURES) + ", y double, w long"), FEATURES, "w", 4)
            bins = one.model.bins(np.zeros(len(x), int), x)
            score = 1 / (1 + np.exp(-one.model.forest.margin(np.zeros(len(x), int), bins, 0, 0.0)))
            a, b = plain_sigmoid(score[~seen], y[~seen], w[~seen])
            assert np.allclose(model.curves[g, part], (a, b), atol=1e-5)
            for r, s in zip(mine, score):
                want[r["n"]] += 1 / (1 + np.exp(-(a + b * s))) / k
            order = [(s, t, v) for s, t, v in zip(score[~seen], y[~seen], w[~seen])]
            wins = sum(v1 * v0 * ((s1 > s0) + 0.5 * (s1 == s0)) for s1, t1, v1 in order if t1 for s0, t0, v0 in order if not t0)
            aucs[g, part] = wins / (w[~seen & (y == 1)].sum() * w[~seen & (y == 0)].sum())
    got = {r["n"]: r["score"] for r in model.score(folded).collect()}
    assert max(abs(got[n] - want[n]) for n in want) < 1e-5
    assert {(r["g"], r["fold"]): pytest.approx(r["auc"]) for r in model.fold_auc(folded).collect()} == aucs


def test_sigmoids_of_separable_and_one_class_groups(spark):
    from tidegauge.operators import calibrate

    rows = [("apart", s / 10, 0 if s < 5 else 4, 5 if s < 5 else 0) for s in range(10)]
    rows += [("none", 0.5, 0, 9), ("none", 0.6, 0, 2)] + [("flat", 0.3, 4, 6)]
    curves = calibrate.sigmoid_by(spark.createDataFrame(rows, "m string, score double, pos long, neg long"), ["m"])
    assert all(np.isfinite(v).all() for v in curves.values()) and curves[("apart",)][1] > 1
    s, y, w = (np.array(v, float) for v in zip(*[(s, t, n) for m, s, p, q in rows if m == "apart" for t, n in ((1, p), (0, q)) if n]))
    assert np.allclose(curves[("apart",)], plain_sigmoid(s, y, w), atol=1e-5)


def test_all_waves_within_wave_and_gains(spark, data):
    from tidegauge.functions.codes import BASIC5
    from tidegauge.plans import grid, rolling, single_wave, transport

    cells = grid.wave_cells(data.clean, BASIC5)
    waves = grid.estimable_waves(cells, BASIC5)
    held = single_wave.within_waves(data.clean, BASIC5, rounds=2).collect()
    assert held and {r["wave"] for r in held} <= set(waves) and all(0 <= r["auc"] <= 1 and r["cv_sd"] >= 0 for r in held)
    table = grid.boosted_grid(data.clean, rounds=2).collect()
    assert {(r["train_wave"], r["test_wave"]) for r in table} >= {(a, b) for a in waves for b in waves}
    others = cells.filter(F.col("wave").isin(waves) & (F.col("wave") != waves[0]))
    scored = transport.boosted_leave_one_out(cells, waves, rounds=2).filter(F.col("wave") == waves[0])
    both = boosting.fit_one(others, BASIC5, rounds=2).score(scored, "one")
    assert both.count() > 0 and both.filter("abs(score - one) > 1e-9").count() == 0
    assert {r["strategy"] for r in rolling.boosted_rolling(cells, [1998, 1999], rounds=2).collect()} == {"rolling", "single"}
    gains = boosting.fit_one(cells, BASIC5, rounds=3).gain_table()
    assert gains and all(a[1] >= b[1] > 0 for a, b in zip(gains, gains[1:]))

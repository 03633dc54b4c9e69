import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidegauge.operators import ranking, reclass, subgroups, thresholds
from tidegauge.session import local_rows

SCHEMA = "g int, score double, y int"


def brute_auc(pairs):
    pos = [s for s, y in pairs if y == 1]
    neg = [s for s, y in pairs if y == 0]
    if not pos or not neg:
        return None
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def frame(spark, pairs):
    return local_rows(spark, [(1, float(s), int(y)) for s, y in pairs], SCHEMA)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.floats(-5, 5).map(lambda v: round(v, 2)), st.integers(0, 1)), min_size=1, max_size=40))
def test_auc_matches_pair_counting(spark, pairs):
    got = ranking.auc(frame(spark, pairs), "score", "y").first()["auc"]
    want = brute_auc(pairs)
    assert got == want if want is None else math.isclose(got, want, abs_tol=1e-12)


def test_auc_properties(spark):
    rng = np.random.default_rng(0)
    pairs = [(round(float(s), 2), int(y)) for s, y in zip(rng.random(300), rng.integers(0, 2, 300))]
    df = frame(spark, pairs)
    a = ranking.auc(df, "score", "y").first()["auc"]
    flipped = ranking.auc(df.withColumn("score", -F.col("score")), "score", "y").first()["auc"]
    cubed = ranking.auc(df.withColumn("score", F.col("score") ** 3 * 1e6), "score", "y").first()["auc"]
    assert flipped == pytest.approx(1 - a) and cubed == pytest.approx(a)
    assert ranking.curve_area(df, "score", "y").first()["area"] == pytest.approx(a)
    same = df.withColumn("score", F.lit(0.4))
    assert ranking.auc(same, "score", "y").first()["auc"] == 0.5
    assert ranking.auc(df.filter("y = 1"), "score", "y", ["g"]).first()["auc"] is None


def test_one_hot_score_holding_a_third_of_the_rows(spark):
    pairs = [(0.5, i % 2) for i in range(100)] + [(i / 1000, i % 3 == 0) for i in range(200)]
    assert ranking.auc(frame(spark, pairs), "score", "y").first()["auc"] == pytest.approx(brute_auc(pairs))


def test_roc_thinning_keeps_ends_and_bends(spark):
    pairs = [(0.9, 1), (0.8, 1), (0.7, 1), (0.6, 0), (0.5, 1), (0.4, 0), (0.3, 0), (0.2, 0)]
    got = sorted((r.fpr, r.tpr, r.thr) for r in ranking.roc_curve(frame(spark, pairs), "score", "y").collect() if r.thr)
    # the middle of three equal steps goes, the first and the last point stay
    assert [t for _, _, t in got] == [0.9, 0.7, 0.6, 0.5, 0.2]
    every = ranking.roc_curve(frame(spark, pairs), "score", "y", drop_intermediate=False)
    assert every.count() == 9 and every.filter("thr is null and fpr = 0 and tpr = 0").count() == 1


def test_best_f1_takes_the_lowest_of_equal_thresholds(spark):
    pairs = [(0.9, 1), (0.8, 0), (0.7, 1), (0.6, 0), (0.5, 0)]
    # F1 at 0.9: 2/3; at 0.7: 4/5
    row = ranking.best_f1(frame(spark, pairs), "score", "y").first()
    assert row.thr == 0.7 and row.f1 == pytest.approx(0.8)
    tie = [(0.9, 1), (0.8, 0), (0.8, 0), (0.8, 1)]
    assert ranking.best_f1(frame(spark, tie), "score", "y").first().thr == 0.8


@pytest.mark.parametrize("grid", [thresholds.SWEEP, thresholds.FINE, thresholds.HIGH_SPEC, thresholds.DECISION])
def test_grid_cells_are_exact_at_the_edges(spark, grid):
    marks = [grid.lo + i * grid.delta for i in range(grid.size)]
    values = [x for m in marks for x in (m, np.nextafter(m, -1), np.nextafter(m, 2))] + [-1.0, 2.0]
    df = local_rows(spark, [(float(v),) for v in values], "score double")
    for r in df.select("score", grid.cell(F.col("score")).alias("k")).collect():
        assert r.k == sum(m <= r.score for m in marks)


def test_grid_confusion_against_direct_counts(spark):
    rng = np.random.default_rng(1)
    s, y = np.round(rng.random(500), 2), rng.integers(0, 2, 500)
    df = frame(spark, list(zip(s, y)))
    for r in thresholds.grid_confusion(df, "score", "y", thresholds.SWEEP).collect():
        hit = s >= r.thr
        assert (r.tp, r.fp, r.fn, r.tn) == (
            int((hit & (y == 1)).sum()), int((hit & (y == 0)).sum()),
            int((~hit & (y == 1)).sum()), int((~hit & (y == 0)).sum()),
        )


def test_high_specificity_point_from_published_counts(spark):
    import golden

    g = golden.HIGH_SPEC
    pairs = [(0.175, 1)] * g["tp"] + [(0.175, 0)] * g["fp"] + [(0.165, 1)] * g["fn"] + [(0.165, 0)] * g["tn"]
    row = thresholds.nearest_specificity(
        frame(spark, pairs), "score", "y", 0.93, thresholds.HIGH_SPEC, default_thr=None
    ).first()
    assert row.threshold == 0.17000000000000004 and row.n == 3738
    for k, v in g.items():
        assert row[k] == pytest.approx(v, rel=1e-12)


def test_quantiles_match_linear_interpolation(spark):
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 1000):
        x = np.round(rng.normal(size=n), 3)
        got = {r.prob: r.value for r in ranking.quantiles(frame(spark, [(v, 0) for v in x]), "score", [0.0, 0.1, 0.5, 0.975, 1.0]).collect()}
        for q, v in got.items():
            assert v == pytest.approx(np.quantile(x, q), abs=1e-12)


def test_reliability_keeps_ties_together(spark):
    pairs = [(0.2, 0)] * 50 + [(0.2, 1)] * 10 + [(0.9, 1)] * 5
    rows = reclass.reliability(frame(spark, pairs), "score", "y").collect()
    assert sorted(r.n for r in rows) == [5, 60]


def test_nri_sign_conventions(spark):
    df = local_rows(spark, [(0.9, 0.1, 1), (0.2, 0.3, 0), (0.6, 0.5, 0), (0.1, 0.4, 0)], "a double, b double, y int")
    r = reclass.nri(df, "a", "b", "y").first()
    assert r.nri_standard == pytest.approx(1 + 1 / 3) and r.nri_reference == pytest.approx(1 - 1 / 3)


def test_empty_band_and_one_class_group(spark):
    rows = [(1.0, 1.0, 0.3, 1), (1.0, 2.0, 0.1, 1), (0.0, 3.0, 0.5, 0), (0.0, 4.0, 0.1, 1)]
    df = local_rows(spark, rows, "male double, age double, score double, y int")
    got = {r.group: r for r in subgroups.sex_age_table(df, "score").collect()}
    assert got["50+"].n == 0 and got["50+"].auc is None and got["50+"].sens_pct is None
    assert got["Male"].auc is None and got["Male"].spec_pct is None and got["Male"].sens_pct == 50.0
    assert len(got) == 5


def test_threshold_is_inclusive(spark):
    r = thresholds.confusion(frame(spark, [(0.3, 1), (0.3, 0), (0.29, 1)]), "score", "y", 0.3).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (1, 1, 1, 0)

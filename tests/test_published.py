"""Summaries of the published nine-wave grid."""

import golden
import pytest
from pyspark.sql import functions as F

from tidegauge.functions.student import t_two_sided
from tidegauge.operators import grid_stats, stats, verify
from tidegauge.plans import rolling
from tidegauge.session import local_rows
from tidegauge.sources import sinks


@pytest.fixture(scope="module")
def grid(spark):
    rows = [
        (a, b, golden.AUC[i][j], 0.4, 0.9, golden.N_POSITIVE[b], golden.N_TOTAL[b])
        for i, a in enumerate(golden.WAVES)
        for j, b in enumerate(golden.WAVES)
    ]
    return local_rows(
        spark, rows,
        "train_wave int, test_wave int, auc double, sensitivity double, specificity double, "
        "n_positive bigint, n_total bigint",
    ).cache()


def close(row, want):
    for k, v in want.items():
        assert row[k] == pytest.approx(v, rel=1e-9), k


def test_same_and_cross(grid):
    got = {r.kind: r for r in grid_stats.same_cross(grid).collect()}
    for kind, want in (("same", golden.SAME), ("cross", golden.CROSS)):
        assert (got[kind].mean, got[kind].sd, got[kind].min, got[kind].max) == pytest.approx(want, rel=1e-9)
    assert grid_stats.gap(grid).first()[0] == pytest.approx(golden.GAP, rel=1e-9)
    table = {r.metric: r for r in grid_stats.summary_table(grid).collect()}
    assert table["SD"].difference == pytest.approx(-0.005028420561422619, rel=1e-9)
    assert table["Range"].difference is None and table["Range"].cross_year == pytest.approx(0.0683156204705655)


def test_distance_decay(grid):
    close(grid_stats.distance_decay(grid).first(), golden.DECAY)
    means = {r.distance: r.mean_auc for r in grid_stats.mean_by_distance(grid).collect()}
    assert [means[d] for d in range(1, 9)] == pytest.approx(golden.MEAN_AT_DISTANCE, rel=1e-9)


def test_era_transport(grid):
    close(grid_stats.era_test(grid, 2020).first(), golden.ERA)


def test_prevalence_trend(grid):
    close(grid_stats.prevalence_trend(grid).first(), golden.TREND)


def test_rolling_summary(spark, grid):
    rows = [("rolling", t, v[0]) for t, v in golden.ROLLING.items()]
    single = [("single", t, golden.AUC[t - 2016][t - 2015]) for t in golden.ROLLING]
    results = local_rows(spark, rows + single, "strategy string, test_wave int, auc double")
    r = stats.paired_t(rolling.paired(results), "rolling", "single").first()
    close(r, golden.PAIRED)
    assert r.all_positive
    table = {x.test_wave: x for x in grid_stats.strategy_table(results).collect()}
    assert (table[2022].single_auc, table[2022].rolling_auc) == (0.709, 0.731)
    cells = local_rows(
        spark,
        [x for w in golden.WAVES for x in ((w, 1.0, golden.N_POSITIVE[w]), (w, 0.0, golden.N_TOTAL[w] - golden.N_POSITIVE[w]))],
        "wave int, y double, w bigint",
    )
    for s in rolling.window_sizes(cells, list(golden.ROLLING)).filter("strategy = 'rolling'").collect():
        assert (s.n_train, s.n_train_pos) == golden.ROLLING[s.test_wave][1:]


def test_verification(spark, grid):
    actual = local_rows(
        spark,
        [("full_auc", 0.8721268238243411), ("same_year_mean", golden.SAME[0]), ("cross_year_mean", golden.CROSS[0]), ("gap", golden.GAP)],
        "metric string, value double",
    )
    assert all(r.passed for r in verify.tolerance_checks(actual, verify.EXPECTED).collect())
    checks = verify.exact_checks(grid, verify.EXPECTED_TOTAL_N, verify.EXPECTED_WAVES).collect()
    assert len(checks) == 3 and all(r.passed for r in checks)
    short = grid.filter(~((F.col("train_wave") == 2016) & (F.col("test_wave") == 2020)))
    assert [(r.train_wave, r.test_wave) for r in verify.missing_cells(short, golden.WAVES).collect()] == [(2016, 2020)]
    n = grid_stats.sample_characteristics(grid).select("wave", "n")
    assert all(r.passed for r in verify.expected_counts(n, golden.N_TOTAL).collect())


def test_grid_document_roundtrip(grid):
    back = sinks.grid_from_json(sinks.grid_to_json(grid))
    assert back.exceptAll(grid.select(*back.columns)).count() == 0 and back.count() == 81


def test_pivot(grid):
    table = {r.train_wave: r for r in grid_stats.auc_pivot(grid, golden.WAVES).collect()}
    assert table[2017]["2021"] == golden.AUC[2][6] and len(table) == 9


def test_student_p_values():
    assert t_two_sided(3.150103159936264, 38) == pytest.approx(0.0031760258756064162, rel=1e-12)
    assert t_two_sided(0.0, 5) == pytest.approx(1.0)
    assert t_two_sided(12.706204736432095, 1) == pytest.approx(0.05, rel=1e-9)

import numpy as np
from pyspark.sql import functions as F

from tidegauge.functions import recode as rc
from tidegauge.operators import clean, prep, resolve
from tidegauge.session import local_rows


def column(spark, values, kind, expr):
    df = local_rows(spark, [(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("c")).alias("x")).collect()]


def test_binary_keeps_zero_and_drops_other_codes(spark):
    got = column(spark, ["1", "2", "0", "94", "7", "x", "", None, "NaN"], "string", rc.binary)
    assert got == [1.0, 0.0, 0.0, None, None, None, None, None, None]


def test_skip_codes_remove_genuine_values_too(spark):
    got = column(spark, [84, 85, 89, 94, 97, 98, 99, 40, None], "int", rc.skip_to_null)
    assert got == [84.0, None, None, None, None, None, None, 40.0, None]


def test_veteran_null_set_differs_from_skip_set(spark):
    got = column(spark, [1, 2, 3, 85, 89, 94, 97, 98, 99, None], "int", rc.veteran_flag)
    assert got == [0.0, 1.0, 1.0, None, 0.0, None, None, None, 0.0, 0.0]


def test_missing_sex_and_marital_give_zero(spark):
    assert column(spark, [1, 2, None], "int", lambda c: rc.equals_flag(c, 1)) == [1.0, 0.0, 0.0]
    assert column(spark, [1, 2, 99, None], "int", rc.married_flag) == [1.0, 0.0, None, 0.0]


def test_orientation_passes_unknown_codes_through(spark):
    assert column(spark, [1, 2, 3, 4, 94, None], "int", rc.orientation_flag) == [0.0, 1.0, 1.0, 4.0, None, None]


def test_age_bands_disagree_on_code_five(spark):
    assert column(spark, [5.0], "double", rc.age_band_a) == ["26‑49"]
    assert column(spark, [5.0], "double", rc.age_band_b) == ["50+"]
    assert column(spark, [5.0], "double", rc.age_band_c) == ["26‑49"]
    assert column(spark, [0.0, 6.0, 101.0], "double", rc.age_band_a) == ["18‑25", "50+", None]


def test_midpoints_follow_the_coding_of_the_wave(spark):
    df = local_rows(
        spark, [(1, 3.0), (1, 6.0), (2, 3.0), (2, 17.0), (2, None)], "wave int, age double"
    )
    got = {(r.wave, r.age) for r in clean.rolling_age(df).collect()}
    assert got == {(1, 30.0), (1, 72.5), (2, 14.0), (2, 62.0), (2, None)}


def test_absent_columns_stay_null_and_employment_is_inferred(spark):
    df = local_rows(spark, [(1, "40"), (2, "0"), (3, "98"), (4, None)], "row_id bigint, WRKDHRSWK2 string")
    got = clean.clean_waves({2020: df}, {2020: {"work_hours": "WRKDHRSWK2"}}).orderBy("row_id").collect()
    assert [r.employment for r in got] == [1.0, None, None, None]
    assert all(r.male is None and r.veteran is None and r.y is None for r in got)


def test_family_match_is_by_file_order_and_ignores_case(spark):
    cols = resolve.header_table(spark, {1: ["x", "wrkhrsus2", "WRKDHRSWK2", "AWRKHRS"]})
    hit = {r.logical: r.physical for r in resolve.by_family(cols).collect()}
    assert hit == {"work_hours": "wrkhrsus2"}
    alias = {r.logical: r.physical for r in resolve.by_alias(cols, resolve.alias_table(spark)).collect()}
    assert alias == {"work_hours": "WRKDHRSWK2"}


def test_canonical_tie_goes_to_the_later_wave(spark):
    rows = [(1, "income", "A"), (2, "income", "B"), (3, "age", "C"), (1, "k6_score", "K")]
    got = {r.logical: r.physical for r in resolve.canonical_choice(local_rows(spark, rows, "wave int, logical string, physical string")).collect()}
    assert got == {"income": "B", "age": "C"}


def test_required_columns_fail_fast(spark):
    import pytest

    with pytest.raises(ValueError, match="score"):
        resolve.require_columns(spark.range(1), ["id", "score"])


def test_exact_median_and_constant_feature(spark):
    df = local_rows(spark, [(1.0, 5.0), (2.0, 5.0), (3.0, 5.0), (10.0, None)], "a double, b double")
    got = {r.feature: r for r in prep.fit_prep(df, ["a", "b"]).collect()}
    assert got["a"].median == 2.5
    assert got["b"].sd == 1.0 and got["b"].mean == 5.0


def test_weighted_prep_equals_repeated_rows(spark):
    rows = [(1.0, 3), (4.0, 1), (None, 2), (9.0, 5)]
    cells = local_rows(spark, rows, "a double, w bigint")
    flat = local_rows(spark, [(a,) for a, n in rows for _ in range(n)], "a double")
    x, y = prep.fit_prep(cells, ["a"], weight="w").first(), prep.fit_prep(flat, ["a"]).first()
    assert (x.median, round(x.mean, 12), round(x.sd, 12)) == (y.median, round(y.mean, 12), round(y.sd, 12))


def test_all_null_feature_is_gated(spark):
    df = local_rows(spark, [(1.0, None), (None, None)], "a double, b double")
    assert prep.usable_features(df, ["a", "b", "c"]) == ["a"]


def test_medians_equal_brute_force_in_both_forms(spark, monkeypatch):
    rows = [(1, 1.5, 3), (1, 4.0, 1), (1, None, 2), (2, 9.0, 5), (2, -1.0, 5), (3, 2.0, 2), (3, 8.0, 1), (3, 4.0, 1)]
    df = local_rows(spark, rows, "g int, a double, w bigint")
    want = {g: float(np.median([a for h, a, w in rows for _ in range(w) if h == g and a is not None])) for g in (1, 2, 3)}
    for weight in ("w", "cast(w as double)"):
        assert {r.g: r.a for r in prep.medians(df.withColumn("w", F.expr(weight)), ["a"], ["g"], "w").collect()} == want
    monkeypatch.setattr(prep, "LEVELS", 0)
    assert {r.g: r.a for r in prep.medians(df, ["a"], ["g"], "w").collect()} == want
    alone = prep.medians(df, ["a"]).first()["a"]
    assert alone == float(np.median([a for _, a, _ in rows if a is not None]))

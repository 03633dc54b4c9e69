import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import bootstrap, sampling
from tidegauge.session import local_rows


def rows(n):
    return [(i, 1 if i % 17 == 0 else 0) for i in range(n)]


def test_holdout_equals_hash_order(spark):
    data = rows(5000) + [(999999, 5)]
    df = local_rows(spark, data, "id bigint, y int")
    got = {r.id for r in sampling.holdout(df, "id", ["y"]).filter("is_test").collect()}
    want = set()
    for y in (0, 1, 5):
        ids = sorted((hashlib.md5(f"42:{i}".encode()).hexdigest(), i) for i, v in data if v == y)
        want |= {i for _, i in ids[: math.ceil(0.3 * len(ids))]}
    assert got == want and 999999 in got  # a single-row stratum goes to the test part


def test_holdout_does_not_depend_on_partitions(spark):
    df = local_rows(spark, rows(2000), "id bigint, y int")
    a = sampling.holdout(df.repartition(7), "id", ["y"]).filter("is_test").select("id")
    b = sampling.holdout(df.coalesce(1), "id", ["y"]).filter("is_test").select("id")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_published_split_sizes(spark):
    data = [(i, 1 if i < 686 else 0) for i in range(12458)]
    out = sampling.holdout(local_rows(spark, data, "id bigint, y int"), "id", ["y"]).filter("is_test")
    r = out.agg(F.count("*").alias("n"), F.sum("y").alias("p")).first()
    assert r.p == 206 and abs(r.n - 3738) <= 1  # quotas are rounded up per class


def test_folds_are_balanced_per_stratum(spark):
    out = sampling.folds(local_rows(spark, rows(3001), "id bigint, y int"), "id", ["y"])
    for y in (0, 1):
        sizes = [r["count"] for r in out.filter(F.col("y") == y).groupBy("fold").count().collect()]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_poisson_weights_have_unit_mean_and_variance(spark):
    df = local_rows(spark, rows(4000), "id bigint, y int")
    r = sampling.resample_weights(df, "id", 10).agg(
        F.sum("times").alias("s"), F.sum(F.col("times") * F.col("times")).alias("q"), F.max("replicate").alias("m")
    ).first()
    n = 4000 * 10
    assert r.s / n == pytest.approx(1, abs=0.02) and r.q / n - (r.s / n) ** 2 == pytest.approx(1, abs=0.04)
    assert r.m == 9


def test_cell_draws_agree_with_row_draws(spark):
    rng = np.random.default_rng(3)
    data = [(i, round(float(s), 2), int(rng.random() < s)) for i, s in enumerate(rng.random(3000))]
    df = local_rows(spark, data, "id bigint, score double, y int")
    a = bootstrap.replicate_metrics(df, "id", "score", "y", 0.5, 60).agg(F.avg("auc"), F.stddev("auc")).first()
    b = bootstrap.replicate_metrics_by_cells(df, "score", "y", 0.5, 60).agg(F.avg("auc"), F.stddev("auc")).first()
    assert a[0] == pytest.approx(b[0], abs=0.004) and a[1] == pytest.approx(b[1], rel=0.5)
    again = bootstrap.replicate_metrics_by_cells(df.repartition(5), "score", "y", 0.5, 60).agg(F.avg("auc")).first()
    assert again[0] == pytest.approx(b[0], abs=1e-12)

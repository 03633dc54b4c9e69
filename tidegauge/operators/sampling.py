"""Seeded splits, folds and resampling weights that are pure functions of (seed, row id)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.hashing import hex_slice, poisson1, salted
from tidegauge.session import attach, small_table

LEVEL = 3  # hex digits of the hash that one level of buckets uses: 4096 buckets
ROWS_PER_BUCKET = 10_000


def _edge(counts: DataFrame, strata: list[str], bucket: str, quota: Column) -> DataFrame:
    """(strata, bucket, _rank): the bucket in which the quota ends, and its rank in there."""
    before = Window.partitionBy(*strata).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return (
        counts.withColumn("_rank", quota - F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .filter((F.col("_rank") >= 1) & (F.col("_rank") <= F.col("_n")))
        .select(*strata, bucket, "_rank")
    )


def holdout(
    df: DataFrame, row_id: str, strata: Sequence[str], seed: int = 42, tenths: int = 3
) -> DataFrame:
    """Add boolean ``is_test``: the first ceil(tenths/10 * n) rows of each stratum in hash order.

    Exact, yet no stratum is sorted: a histogram of 4096 hash buckets locates the bucket in which
    the quota ends, a second one divides that bucket, only one of its 4096 parts is ranked, and
    the last accepted key becomes the cut-off. Membership is then a comparison per row against
    one cut-off per stratum.
    """
    strata = list(strata)
    keyed = df.select(*strata, row_id).withColumn("_key", salted(seed, F.col(row_id)))
    keyed = keyed.withColumns({"_b1": hex_slice(F.col("_key"), 1, LEVEL), "_b2": hex_slice(F.col("_key"), 1 + LEVEL, LEVEL)})
    whole = Window.partitionBy(*strata)
    quota = F.ceil(F.sum("_n").over(whole).cast("double") * tenths / 10)
    first = small_table(_edge(keyed.groupBy(*strata, "_b1").agg(F.count("*").alias("_n")), strata, "_b1", quota))
    edge = attach(keyed, first, [*strata, "_b1"], "inner").groupBy(*strata, "_b1", "_b2").agg(
        F.count("*").alias("_n"), F.max("_rank").alias("_quota")
    )
    second = small_table(_edge(edge, [*strata, "_b1"], "_b2", F.col("_quota")))
    order = Window.partitionBy(*strata).orderBy("_key", row_id)
    cuts = (
        attach(keyed, second, [*strata, "_b1", "_b2"], "inner")
        .withColumn("_r", F.row_number().over(order))
        .filter(F.col("_r") == F.col("_rank"))
        .select(*strata, F.col("_key").alias("_cut_key"), F.col(row_id).alias("_cut_id"))
    )
    cuts = small_table(cuts)
    out = attach(df.withColumn("_key", salted(seed, F.col(row_id))), cuts, strata)
    inside = (F.col("_key") < F.col("_cut_key")) | (
        (F.col("_key") == F.col("_cut_key")) & (F.col(row_id) <= F.col("_cut_id"))
    )
    return out.withColumn("is_test", F.coalesce(inside, F.lit(False))).drop(
        "_key", "_cut_key", "_cut_id"
    )


def stratum_rank(df: DataFrame, row_id: str, strata: Sequence[str], seed: int = 42) -> DataFrame:
    """Add ``rank`` (1-based, hash order) inside each stratum, one task per hash bucket.

    Hash digits are taken until a bucket holds about ``ROWS_PER_BUCKET`` rows of the table, so
    buckets stay small whatever its size and however few strata there are.
    """
    strata = list(strata)
    digits = LEVEL
    rows = df.count()
    while rows > ROWS_PER_BUCKET * 16**digits and digits < 7:
        digits += 1
    bucket = hex_slice(salted(seed, F.col(row_id)), 1, digits)
    per_bucket = df.select(*strata, bucket.alias("_bucket")).groupBy(*strata, "_bucket").agg(F.count("*").alias("_n"))
    before = (
        Window.partitionBy(*strata)
        .orderBy("_bucket")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = per_bucket.select(
        *strata, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    local = Window.partitionBy(*strata, "_bucket").orderBy("_key", row_id)
    keyed = df.withColumns({"_key": salted(seed, F.col(row_id)), "_bucket": bucket})
    ranked = keyed.withColumn("_local", F.row_number().over(local))
    return (
        attach(ranked, small_table(offsets), [*strata, "_bucket"], "inner")
        .withColumn("rank", F.col("_before") + F.col("_local"))
        .drop("_key", "_bucket", "_local", "_before")
    )


def folds(
    df: DataFrame, row_id: str, strata: Sequence[str], k: int = 5, seed: int = 42
) -> DataFrame:
    """Add ``fold`` 0..k-1: stratified and shuffled; fold sizes per stratum differ by at most 1."""
    return stratum_rank(df, row_id, strata, seed).withColumn(
        "fold", ((F.col("rank") - 1) % k).cast("int")
    ).drop("rank")


def resample_weights(
    df: DataFrame, row_id: str, replicates: int, seed: int = 42
) -> DataFrame:
    """One row per (row, replicate) with a Poisson(1) multiplicity ``times``; zeros are left out.

    Multiplicities replace copied rows. Rows grow by the number of replicates, so aggregate
    straight after: the map side folds them into the groups of the metric. One md5 serves
    four replicates, 8 hex digits each.
    """
    block = F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // 4)))
    digest = F.md5(
        F.concat(F.lit(f"{seed}:"), F.col("_block").cast("string"), F.lit(":"), F.col(row_id).cast("string"))
    )
    draws = F.explode(
        F.array(
            *[
                F.struct(
                    (F.col("_block") * 4 + i).alias("replicate"),
                    (hex_slice(F.col("_digest"), 8 * i + 1, 8).cast("double") / F.lit(4294967296.0)).alias("u"),
                )
                for i in range(4)
            ]
        )
    )
    out = (
        df.withColumn("_block", block)
        .withColumn("_digest", digest)
        .withColumn("_d", draws)
        .withColumn("replicate", F.col("_d.replicate"))
        .withColumn("times", poisson1(F.col("_d.u")))
        .drop("_block", "_digest", "_d")
    )
    return out.filter((F.col("replicate") < replicates) & (F.col("times") > 0))

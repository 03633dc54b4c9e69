"""Weighted rendezvous sharding by stable record keys, with DataFrame functions only.

Every record scores each shard with -weight / ln(u), u a uniform draw from the hash of (key, shard
number), and goes to the highest score. A shard's score depends on no other shard, so one more
shard takes rows only into itself, and shards get rows in proportion to their weights.

Slots: rows are numbered inside (shard, input part), and each part starts after the rows that
earlier parts gave to the shard. No shard is sorted in one task, a key that holds a third of all
rows is numbered in parallel, and only the counts per (shard, part) meet.

Defined results: a null key is a key like any other; null text has size 1 and the checksum of
the empty text; repeated rows get slots of their own; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import text_of
from tidegauge.session import cut_lineage

SHARDS = 16


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Number of the shard (0 ..) that a key goes to; weights are positive."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    scores = []
    for shard, weight in enumerate(weights):
        bits = F.shiftrightunsigned(F.xxhash64(key.cast("string"), F.lit(f"shard-{shard}")), 12)
        draw = (bits.cast("double") + F.lit(0.5)) / F.lit(float(2**52))
        scores.append(F.struct((F.lit(-float(weight)) / F.ln(draw)).alias("score"), F.lit(shard).alias("shard")))
    return scores[0]["shard"] if len(scores) == 1 else F.greatest(*scores)["shard"]


def slotted(df: DataFrame, shard: str, part: str, row: str) -> DataFrame:
    """Add ``slot``: gapless from 0 in each shard, in the order of (part, row)."""
    inside = Window.partitionBy(shard, part)
    before = Window.partitionBy(shard).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        df.groupBy(shard, part)
        .agg(F.count("*").alias("_n"))
        .select(shard, part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    ranked = df.withColumn("_rank", F.row_number().over(inside.orderBy(row)))
    return (
        ranked.join(starts, [shard, part])
        .withColumn("slot", (F.col("_start") + F.col("_rank") - 1).cast("long"))
        .drop("_start", "_rank")
    )


def shards(docs: DataFrame, weights: Sequence[float] = (1.0,) * SHARDS, grown_weight: float = 1.0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document."""
    size = F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)) + 1
    rows = cut_lineage(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            size.cast("long").alias("size"),
            F.crc32(text_of()).alias("text_crc32"),
            rendezvous(F.col("doc_id"), weights).alias("shard"),
            rendezvous(F.col("doc_id"), (*weights, grown_weight)).alias("grown_shard"),
            F.monotonically_increasing_id().alias("_row"),
        )
    )
    parted = rows.withColumn("_part", F.shiftright("_row", 33))
    return slotted(parted, "shard", "_part", "_row").select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )

"""Rendezvous shards: proportions, movement and slots."""

import zlib
from collections import Counter

from pyspark.sql import functions as F

from fixtures import CLASHING, COLUMNS, corpus, frame, odd_rows
from tidegauge.llm import sharding as s


def gapless(rows):
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    return all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_shards(spark):
    rows = corpus()
    got = s.shards(frame(spark, rows)).collect()
    assert len(got) == len(rows) and gapless(got)
    texts = {r[0]: (r[1] or "").encode() for r in rows}
    for r in got:
        assert (r.size, r.text_crc32, r.law) == (len(texts[r.doc_id]) + 1, zlib.crc32(texts[r.doc_id]), "key")
        assert 0 <= r.shard < 16 and r.grown_shard in (r.shard, 16)
    again = {r.doc_id: (r.shard, r.grown_shard) for r in s.shards(frame(spark, rows[::3], parts=2)).collect()}
    assert again.items() <= {r.doc_id: (r.shard, r.grown_shard) for r in got}.items()


def test_weights_and_growth(spark):
    ids = spark.range(40_000).select(F.col("id").alias("doc_id"))
    weights = (1.0, 2.0, 1.0)
    placed = ids.select(s.rendezvous(F.col("doc_id"), weights).alias("a"), s.rendezvous(F.col("doc_id"), (*weights, 4.0)).alias("b"))
    pairs = Counter((r.a, r.b) for r in placed.collect())
    counts = Counter()
    for (a, _), n in pairs.items():
        counts[a] += n
    assert abs(counts[1] / 40_000 - 0.5) < 0.02 and abs(counts[0] / 40_000 - 0.25) < 0.02
    assert all(b in (a, 3) for a, b in pairs)
    moved = sum(n for (a, b), n in pairs.items() if b == 3)
    assert abs(moved / 40_000 - 0.5) < 0.02


def test_hot_key_and_odd_rows(spark):
    docs = frame(spark, [(7, "t", None, None, None)] * 300 + [(None, None, None, None, None)] * 20, parts=6)
    got = s.shards(docs).collect()
    assert gapless(got) and len({r.shard for r in got if r.doc_id == 7}) == 1
    assert gapless(s.shards(frame(spark, odd_rows(), CLASHING, 2)).collect())
    assert s.shards(spark.createDataFrame([], COLUMNS)).count() == 0


def test_native(spark):
    plan = s.shards(frame(spark, corpus()))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan

"""Exact deduplication and its cuckoo index against brute force."""

import hashlib
import os
import re

from pyspark.sql import functions as F

from fixtures import CLASHING, COLUMNS, corpus, frame, odd_rows
from tidegauge.llm import exact_dedup as x


def bare(text):
    return re.sub("[\x20\x09-\x0d]", "", text or "")


def test_filter_resizes_finds_and_deletes():
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(20_000)]
    shard = x.CuckooShard(2)
    for i, k in enumerate(keys):
        assert shard.find(k) is None
        shard.insert(k, [1, i, i, 1])
    assert shard.buckets * x.SLOTS >= len(keys) and all(shard.find(k)[1] == i for i, k in enumerate(keys))
    false_hits = sum(shard.may_hold(os.urandom(32)) for _ in range(20_000))
    assert false_hits < 100
    for k in keys[::2]:
        assert shard.delete(k) and not shard.delete(k)
    assert all(shard.find(k) is None for k in keys[::2]) and all(shard.find(k) for k in keys[1::2])
    assert sum(map(bool, shard.slots)) == shard.size == 10_000
    again = x.CuckooShard.load(shard.dump(3))
    assert again.slots == shard.slots and again.content == shard.content and again.size == shard.size


def test_false_hit_is_verified():
    shard = x.CuckooShard(2)
    a, b = bytes(32), bytes(31) + b"\1"  # same bucket and fingerprint, other key
    shard.insert(a, [1, 1, 1, 1])
    assert shard.may_hold(b) and shard.find(b) is None
    shard.insert(b, [1, 2, 2, 1])
    assert shard.delete(a) and shard.find(b) and shard.find(a) is None


def test_equals_brute_force(spark):
    rows = corpus()
    got = {r.doc_id: r for r in x.duplicates(frame(spark, rows)).collect()}
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(bare(t), []).append((-len(t or ""), i))
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        mine = groups[bare(t)]
        keep = min(mine)[1]
        r = got[i]
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(mine), keep == i)
        assert r.text_sha256 == hashlib.sha256(bare(t).encode()).hexdigest()


def test_index_grows_and_forgets(spark):
    first, second = corpus(1), [(1000 + r[0], *r[1:]) for r in corpus(1)]
    rows = x.keyed(frame(spark, first))
    index = x.CuckooIndex(spark, 3)
    index.insert(rows)
    before = {bytes(r.key): r for r in index.entries().collect()}
    assert set(before) == {hashlib.sha256(bare(t).encode()).digest() for _, t, *_ in first}
    index.insert(x.keyed(frame(spark, second)))
    after = {bytes(r.key): r for r in index.entries().collect()}
    assert all(after[k].group_size == 2 * r.group_size and after[k].keep_id == r.keep_id for k, r in before.items())
    gone = list(before)[:7]
    index.delete(spark.createDataFrame([(k,) for k in [*gone, b"\0" * 32, None]], "key binary"))
    assert {bytes(r.key) for r in index.entries().collect()} == set(before) - set(gone)
    missing = index.lookup(rows).filter("keep_row is null").select("key").distinct().collect()
    assert {bytes(r.key) for r in missing} == set(gone)


def test_large_ids_and_nulls(spark):
    rows = [(2**62 + 1, "a"), (2**62, "a "), (None, "a"), (None, "b"), (None, "b")]
    got = x.duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.keep_id for r in got.filter("kept and keep_id is not null").collect()) == [2**62]
    assert got.filter("kept").count() == 2


def test_stage_keeps_columns_and_one_row_each(spark):
    docs = frame(spark, odd_rows(), CLASHING, 2)
    out = x.deduplicate(docs)
    assert out.schema == docs.schema
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [
        (1, "same text here now"), (3, "other text stands here"), (3, "third text stands there"), (4, "")
    ]


def test_empty(spark):
    docs = spark.createDataFrame([], COLUMNS)
    assert x.duplicates(docs).count() == 0 and x.deduplicate(docs).columns == docs.columns
    assert x.deduplicate(docs).filter(F.lit(True)).count() == 0

"""Near-deduplication and connected groups against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from fixtures import CLASHING, COLUMNS, corpus, frame, odd_rows
from tidegauge.llm import near_dedup as n
from tidegauge.llm.components import components, link


def union(pairs, nodes):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in nodes}


def sets(rows, k):
    out = {}
    for i, t, *_ in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for c in "\t\n\x0b\f\r":
            low = low.replace(c, " ")
        w = [x for x in low.split(" ") if x]
        out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    return out


def brute(rows, k, num, den):
    s = sets(rows, k)
    ids = sorted(i for i in s if s[i])
    pairs = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if den * len(s[a] & s[b]) >= num * len(s[a] | s[b])]
    return s, union(pairs, s)


@pytest.mark.parametrize("k,num,seed", [(3, 85, 3), (5, 80, 4)])
def test_equals_brute_force(spark, k, num, seed):
    rows = corpus(seed)
    s, want = brute(rows, k, num, 100)
    got = n.near_duplicates(frame(spark, rows), n.Similarity(words=k, num=num)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(s[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_miss_probability_and_bounds():
    like = n.Similarity(words=3, num=85)
    assert (1 - 0.85**like.rows) ** like.bands <= like.miss
    steps = like.least_matches()
    assert steps[-1][0] == like.size and all(0 < m < size * 0.85 for size, m in steps)


def test_chain_of_links_is_one_group(spark):
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    rows = [(i, " ".join(words[8 * i : 8 * i + 200]), None, None, None) for i in range(20)]
    _, want = brute(rows, 3, 85, 100)
    assert len(set(want.values())) == 1
    got = n.near_duplicates(frame(spark, rows), n.Similarity(words=3, num=85))
    assert [r.component_id for r in got.select("component_id").distinct().collect()] == [0]


def test_components_of_random_graphs(spark):
    rng = random.Random(1)
    for nodes, edges in ((50, 20), (200, 150), (300, 320)):
        pairs = [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(edges)]
        pairs += [(i, i + 1) for i in range(nodes, nodes + 40)]
        pairs = [(a, b) for a, b in pairs if a != b]
        want = union(pairs, {x for p in pairs for x in p})
        got = components(spark.createDataFrame(pairs, "a long, b long"))
        assert {r.node: r.group for r in got.collect()} == want


def test_link_looks_beyond_the_first_member(spark):
    """0 is in every bucket and like nobody; the rest are alike in two groups."""
    members = [(b, x) for b in range(3) for x in range(21)]
    asked = []

    def verify(pairs):
        asked.append(pairs.count())
        return pairs.filter("a > 0 and a % 2 = b % 2")

    got = link(spark.createDataFrame(members, "bucket long, node long"), verify)
    groups = {r.node: r.group for r in got.collect()}
    assert groups == {x: 2 - x % 2 for x in range(1, 21)}
    assert link(spark.createDataFrame([(1, 2)], "bucket long, node long"), verify) is None


def test_one_comparison_for_each_alike_member(spark):
    members = spark.range(500).select(F.lit(7).cast("long").alias("bucket"), F.col("id").alias("node"))
    asked = []

    def verify(pairs):
        asked.append(pairs.count())
        return pairs

    assert link(members, verify).select("group").distinct().count() == 1
    assert sum(asked) == 499


def test_stage_keeps_columns(spark):
    docs = frame(spark, odd_rows(), CLASHING, 2)
    out = n.deduplicate(docs)
    assert out.schema == docs.schema
    assert sorted(r.text for r in out.filter("text <> ''").collect()) == ["other text stands here", "same text here now", "third text stands there"]
    assert out.filter("coalesce(text, '') = ''").count() == 3


def test_empty(spark):
    docs = spark.createDataFrame([], COLUMNS)
    assert n.near_duplicates(docs).count() == 0 and n.deduplicate(docs).count() == 0
    blank = spark.createDataFrame([(1, None, None, None, None), (2, " ", None, None, None)], COLUMNS)
    got = n.near_duplicates(blank).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_tasks_hold_few_rows_at_a_time(spark):
    from tidegauge.llm.common import map_rows

    held = map_rows(spark.range(0, 6000, 1, 1), lambda batches: ({"n": [len(b["id"])]} for b in batches), "n long", 10_000)
    assert max(r.n for r in held.collect()) <= 1024 and sum(r.n for r in held.collect()) == 6000


def test_a_loosely_linked_bucket_is_not_compared_pair_by_pair(spark):
    """Members of one bucket of which every pair is linked with a chance of 1 in 10, and nothing with the first."""
    size, compared = 400, []
    linked = lambda p: p.filter("a > 0 and pmod(xxhash64(a, b), 10) = 0")

    def verify(pairs):
        compared.append(pairs.count())
        return linked(pairs)

    members = spark.range(size).crossJoin(spark.range(6).withColumnRenamed("id", "bucket")).select("bucket", F.col("id").alias("node"))
    got = {r.node: r.group for r in link(members, verify).collect()}
    left, right = spark.range(size).withColumnRenamed("id", "a"), spark.range(size).withColumnRenamed("id", "b")
    want = union([tuple(r) for r in linked(left.join(right, F.col("a") < F.col("b"))).collect()], range(size))
    assert {x: got.get(x, x) for x in want} == want
    assert sum(compared) < size * size / 5

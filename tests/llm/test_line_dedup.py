"""Fuzzy line deduplication against brute force on all pairs."""

import random
import re

import xxhash

from fixtures import CLASHING, COLUMNS, corpus, frame, near, odd_rows, sentence
from test_near_dedup import union
from tidegauge.llm import line_dedup as d


def normal(line):
    return " ".join(w for w in re.split("[ \t\x0b\f\r]+", line.lower()) if w)


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def simhash(line):
    counts = [0] * 64
    words = line.split(" ")
    words = [w for w in words if len(w) >= 4] or words
    hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    lead = min(hashes, key=signed)
    for h in hashes:
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(words) or 2 * counts[b] == len(words) and lead >> b & 1)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def rows_with_near_lines():
    rng = random.Random(11)
    base = [sentence(rng, rng.randint(4, 40)) for _ in range(25)]
    lines = base + [near(rng, b, c) for b in base for c in (1, 1, 2)] + base[:6] + ["  " + base[0].upper() + " ", "", "  ", "-", "-"]
    rng.shuffle(lines)
    return [(i, "\n".join(lines[i::9]), None, None, None) for i in range(9)] + [(9, None, None, None, None), (10, "", None, None, None)]


def test_equals_brute_force(spark):
    rows = rows_with_near_lines()
    got = d.duplicate_lines(frame(spark, rows, parts=1)).collect()
    want = {(i, k): normal(line) for i, t, *_ in rows for k, line in enumerate((t or "").split("\n")) if normal(line)}
    assert {(r.doc_id, r.line_no) for r in got} == set(want) and len(got) == len(want)
    texts = sorted(set(want.values()))
    hashes = {t: simhash(t) for t in texts}
    pairs = [
        (a, b)
        for x, a in enumerate(texts)
        for b in texts[x + 1 :]
        if bin(hashes[a] ^ hashes[b]).count("1") <= 3 and distance(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9)
    ]
    assert pairs
    root, groups = union(pairs, texts), {}
    for r in got:
        groups.setdefault(root[want[r.doc_id, r.line_no]], []).append(r)
    assert len(groups) == len({r.group_id for r in got})
    for members in groups.values():
        assert len({r.group_id for r in members}) == 1 and sum(r.kept for r in members) == 1
        assert {r.group_size for r in members} == {len(members)}


def test_edit_distance(spark):
    rng = random.Random(8)
    pairs = []
    for _ in range(60):
        a = sentence(rng, rng.randint(1, 12))
        b = rng.choice([near(rng, a, 2), a + " end", "start " + a, a[3:] or "x", sentence(rng, 5), " ".join(a.split(" ")[::2])])
        pairs.append((a, b))
    got = spark.createDataFrame(pairs, "a string, b string").withColumn("d", d.edit_distance("a", "b")).collect()
    assert all(r.d == distance(r.a, r.b) for r in got)


def test_clean_and_odd_tables(spark):
    rows = corpus()
    docs = frame(spark, rows)
    out = d.clean(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    left = [normal(line) for r in out.collect() for line in (r.text or "").split("\n") if normal(line)]
    assert len(left) == len(set(left)) and set(left) <= {normal(x) for _, t, *_ in rows for x in (t or "").split("\n")}
    odd = frame(spark, odd_rows(), CLASHING, 2)
    assert d.clean(odd).schema == odd.schema
    assert d.duplicate_lines(odd).filter("kept").count() == 3
    assert d.duplicate_lines(spark.createDataFrame([], COLUMNS)).count() == 0


def test_blocks_leave_two_equal():
    assert sum(w for _, w in d.blocks()) == 64 and len(d.blocks()) == d.RADIUS + 2


def test_native(spark):
    plan = d.simhashes(d.line_rows(frame(spark, corpus())))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_buckets_of_equal_blocks(spark):
    rng = random.Random(3)
    marks = [rng.getrandbits(64) for _ in range(40)]
    marks += [m ^ sum(1 << b for b in rng.sample(range(64), 3)) for m in marks]
    rows = [(k, signed(m)) for k, m in enumerate(marks)]
    found = spark.createDataFrame(rows, "node long, mark long").select("node", d.buckets(d.F.col("mark")).alias("bucket")).collect()
    held = {}
    for r in found:
        held.setdefault(r.node, set()).add(r.bucket)
    assert {len(h) for h in held.values()} == {20}
    assert all(held[k] & held[k + 40] for k in range(40))
    # 32 bits are equal in a bucket; with 26 bits 2 million lines of chance share some 400,000 buckets
    assert min(sum(w for _, w in some) for some in d.combinations(d.blocks(d.RADIUS, d.EQUAL), d.EQUAL)) >= 30


def test_edit_distance_up_to_a_bound(spark):
    rng = random.Random(9)
    pairs = []
    for k in range(60):
        a = sentence(rng, rng.randint(1, 90))
        pairs.append((a, rng.choice([near(rng, a, 3), a + " end", sentence(rng, 60), " ".join(a.split(" ")[::2])]), [3, 16, 17, 100, 256, 300][k % 6]))
    got = spark.createDataFrame(pairs, "a string, b string, most int").withColumn("d", d.edit_distance("a", "b", d.F.col("most"))).collect()
    assert all(r.d == (distance(r.a, r.b) if distance(r.a, r.b) <= r.most else -1) for r in got)
    assert {r.d >= 0 for r in got} == {True, False}


def test_sieve_keeps_all_wanted(spark):
    rows = spark.range(-5000, 5000).select(d.F.when(d.F.col("id") != 0, d.F.col("id")).alias("key"), "id")
    wanted = spark.createDataFrame([(k,) for k in range(-300, 300, 3)] + [(None,)], "w long")
    got = [r.key for r in d.sieve(rows, "key", wanted).collect()]
    assert {*range(-300, 0, 3), *range(3, 300, 3), None} <= set(got) and len(got) == len(set(got)) < 2000
    assert d.sieve(rows, "key", wanted.filter("false")).count() == 0


def test_within_a_bound(spark):
    """Words settle most pairs; the answer is that of the edit distance by letters."""
    rng = random.Random(10)
    pairs = [("a b c", "a b c", 0), ("a b", "a", 1), ("a b", "a", 2), ("\U0001d11e \u00e9 x", "x \u00e9 \U0001d11e", 3), ("ab cd", "abcd", 1)]
    for k in range(150):
        a = sentence(rng, rng.randint(1, 60))
        b = rng.choice([near(rng, a, 2), near(rng, "start " + a, 2), a[3:] or "x", " ".join(a.split(" ")[::2]), near(rng, a, 9), a.replace("e ", "e")])
        pairs.append((a, b, max(0, distance(a, b) + rng.choice([-9, -1, 0, 1, 9, 40]))))
    got = spark.createDataFrame(pairs, "a string, b string, most int").withColumn("near", d.within("a", "b", "most")).collect()
    assert [r.near for r in got] == [distance(a, b) <= most for a, b, most in pairs]
    assert {r.near for r in got} == {True, False}


def test_generated_code_is_compiled(spark, monkeypatch, capsys):
    """The JVM leaves methods above 8,000 bytes uncompiled: SimHashes and buckets then took some ten times as long."""
    monkeypatch.setattr(d, "cut_lineage", lambda df: df)
    marks = d.simhashes(d.line_rows(frame(spark, corpus()))).groupBy("node").agg(d.F.min("simhash").alias("mark"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        marks.select(d.buckets(d.F.col("mark")).alias("bucket")).groupBy("bucket").count().explain(mode="codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000


def test_white_space_of_lines(spark):
    lines = ["A\tb", "a  B ", " a b", "\r", "\t \x0b\f", "a\x0bb\r", "\u00a0", "a"]
    got = d.line_rows(frame(spark, [(1, "\n".join(lines), None, None, None)], parts=1)).collect()
    assert {r.line_no: (r.line, r.words) for r in got} == {k: (normal(x), normal(x).split(" ")) for k, x in enumerate(lines) if normal(x)}
    assert all(r.node == signed(xxhash.xxh64_intdigest(r.line.encode(), 42)) for r in got)

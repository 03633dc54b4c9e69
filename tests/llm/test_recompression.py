"""Runs, grammar extensions and their query against brute force."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from fixtures import CLASHING, COLUMNS, corpus, frame, odd_rows
from tidegauge.llm import recompression as rc


def brute(w):
    """Runs by comparing all words a period apart."""
    n, best = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(6, 4 * q):
                best.setdefault((s, i + q - s), q)
    return sorted((s, length, q) for (s, length), q in best.items())


def planted_sequence(rng):
    n, k = rng.choice([0, 1, 5, 6, 7, 20, 60, 200, 500]), rng.choice([1, 2, 3, 5, 50])
    w = [rng.randint(1, k) for _ in range(n)]
    for _ in range(rng.randint(0, 4) if n >= 8 else 0):
        a, p = rng.randrange(n), rng.randint(1, max(1, n // 5))
        for i in range(a + p, min(n, a + p * rng.randint(3, 9) + rng.randint(0, p))):
            w[i] = w[i - p]
    return w


def listed(found):
    return list(zip(*(x.tolist() for x in found)))


def test_runs_equal_brute_force():
    rng, total = random.Random(5), 0
    for _ in range(80):
        some = [planted_sequence(rng) for _ in range(rng.randint(1, 12))]
        for s, found in zip(some, rc.runs([np.array(s, np.int32) for s in some])):
            assert listed(found) == brute(s)
            total += len(found[0])
    assert total > 300


def test_words_with_many_repetitions():
    a, b = [1], [1, 2]
    while len(b) < 1500:
        a, b = b, b + a
    thue = [1 + bin(i).count("1") % 2 for i in range(1024)]
    cube = [1, 2, 1, 3] * 40 + [1] * 77 + [2, 1] * 30
    for w in (b, thue, cube, [7] * 2000, list(range(1, 500))):
        assert listed(rc.runs([np.array(w, np.int32)])[0]) == brute(w)


def test_extensions_equal_brute_force():
    rng = random.Random(8)
    for _ in range(40):
        docs = [w for w in (planted_sequence(rng) for _ in range(4)) if w] or [[1]]
        words = np.array([0, *(x for d in docs for x in [*d, 0])], np.int32)
        g, n = rc.recompress(words), len(words)
        at = 1
        for d in docs:
            pairs = [tuple(sorted(rng.sample(range(at, at + len(d)), 2))) for _ in range(30)] if len(d) > 1 else []
            at += len(d) + 1
            if not pairs:
                continue
            i, j = (np.array(x) for x in zip(*pairs))
            after = rc.extension(g, g.forward, i, j)
            ahead = rc.extension(g, g.backward, n - 1 - i, n - 1 - j)
            for x, y, f, b in zip(i, j, after, ahead):
                want = next(k for k in range(n) if words[x + k] != words[y + k] or words[y + k] == 0)
                back = next(k for k in range(n) if words[x - k] != words[y - k] or words[x - k] == 0)
                assert (f, b) == (want, back)


def test_grammar_is_small_and_its_levels_expand():
    w = np.array([0, *([3, 1, 4, 1, 5] * 3000), 0], np.int32)
    g = rc.recompress(w)
    assert len(g.forward.symbols[-1]) <= rc.TOP + 2
    assert sum(len(set(s.tolist())) for s in g.forward.symbols) < 400
    for level, counts in enumerate(g.counts):
        assert counts.sum() == len(g.forward.symbols[level]) and len(counts) == len(g.forward.symbols[level + 1])
    assert sum(map(len, g.forward.symbols)) < 8 * len(w)


def test_blocks_of_candidates_change_nothing(monkeypatch):
    w = [np.array([1, 2] * 200 + [3] * 300, np.int32)]
    whole = listed(rc.runs(w)[0])
    monkeypatch.setattr(rc, "BLOCK", 7)
    assert listed(rc.runs(w)[0]) == whole == brute(w[0].tolist())


def want_row(doc_id, text, plant=True):
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if x]
    if plant and doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    found = brute(w)
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if found else (None,) * 3
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    rest = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(rest.encode()).hexdigest())


@pytest.fixture(scope="module")
def rows():
    return [r for r in corpus() if len((r[1] or "").split()) < 2000] + [(900 + i, "a b " * i + "c", None, None, 0) for i in range(30)]


def test_report_equals_brute_force(spark, rows):
    got = sorted(map(tuple, rc.run_report(frame(spark, rows), plant=True).collect()))
    assert got == sorted(want_row(r[0], r[1]) for r in rows)
    assert sum(r[1] > 0 for r in got) > 30


def test_long_texts_and_odd_tables(spark):
    long = [(1, "word " * 30_000, None, None, 0), (2, "x" * 150_000, None, None, 0), (3, " ".join(str(i % 997) for i in range(20_000)), None, None, 0)]
    got = {r[0]: r[1:5] for r in rc.run_report(frame(spark, long)).collect()}
    assert got == {1: (1, 0, 30_000, 1), 2: (0, None, None, None), 3: (1, 0, 20_000, 997)}
    odd = odd_rows()
    assert sorted(map(tuple, rc.run_report(frame(spark, odd, CLASHING), plant=True).collect()), key=str) == sorted((want_row(r[0], r[1]) for r in odd), key=str)
    assert rc.run_report(spark.createDataFrame([], COLUMNS)).count() == 0


def test_collapsed_texts_and_spans(spark, rows):
    table = frame(spark, rows)
    for r in rc.collapse(table).collect():
        text = dict((x[0], x[1]) for x in rows)[r["doc_id"]]
        assert hashlib.sha256(r["text"].encode()).hexdigest() == want_row(r["doc_id"], text, False)[-1]
    spans = sorted((r["doc_id"], r["start"], r["length"], r["period"]) for r in rc.run_spans(table).collect())
    assert spans == sorted((r[0], *x) for r in rows for x in brute((r[1] or "").encode().split()))

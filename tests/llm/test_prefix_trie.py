"""Conversation trie against a brute-force trie."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tidegauge.llm import prefix_trie

COLUMNS = "conv_id long, turn long, role string, text string"


def sequences(rows):
    held = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            held[c].append(((turn is not None, turn or 0), role or "", text or ""))
    return {c: [x[1:] for x in sorted(t, key=lambda x: x[0])] for c, t in held.items()}


def rebuilt(held):
    out = {}
    for c, own in held.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c // 100 * 100 if c >= 0 else -(-c // 100 * 100)  # the remainder has the sign of c, as in SQL
        out[c] = held.get(base, [])[:h] + own[h:]
    return out


def brute(convs):
    nodes = defaultdict(set)
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            nodes[tuple(seq[:d])].add(c)
    out = []
    for path, members in nodes.items():
        under = [p for p in nodes if p[: len(path)] == path]
        ends = ",".join(map(str, sorted(c for c in members if len(convs[c]) == len(path))))
        out.append((
            min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members),
            sum(len(p) == len(path) + 1 for p in under), sum(not any(o[:-1] == p for o in nodes if o) for p in under),
            sum((len(nodes[p]) - 1) * len(p[-1][1]) for p in under if p), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def found(spark, rows, rebuild, schema=COLUMNS):
    table = spark.createDataFrame(rows, schema).repartition(4)
    return sorted((tuple(r) for r in prefix_trie.conversation_trie(table, rebuild).collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for c in [*range(0, 12), *range(96, 112), 250, 251, 300, -3, -100, 5_000_000_000, 2**60 + 7]:
        for turn in range(rng.randint(0, 7)):
            out.append((c, turn if turn or rng.random() < 0.8 else None, rng.choice(["user", "bot", None]), rng.choice(["a", "bb", "é😀x", "", None])))
    return out + [(777, 0, "user", "same")] + [(c, 0, "user", "same") for c in range(801, 840)]


def test_trie_equals_brute_force(spark, rows):
    held = sequences(rows)
    assert found(spark, rows, False) == brute(held)
    assert found(spark, rows, True) == brute(rebuilt(held))


def test_turnless_conversations_end_at_the_root(spark):
    rows = [(c, 0, "user", "only") for c in range(101, 160)]
    convs = rebuilt(sequences(rows))
    assert any(not s for s in convs.values())
    assert found(spark, rows, True) == brute(convs)


def test_blocks_of_long_conversations(spark, monkeypatch):
    rng = random.Random(1)
    long = [(1, t, "u", "x") for t in range(60)] + [(2, t, "u", "x") for t in range(45)] + [(3, t, "u", rng.choice("xy")) for t in range(50)]
    monkeypatch.setattr(prefix_trie, "BLOCK", 2)
    monkeypatch.setattr(prefix_trie, "CHUNK", 1)
    assert found(spark, long, False) == brute(sequences(long))


def test_ties_nulls_repeats_and_clashing_names(spark):
    rows = [(1, 0, "u", "b"), (1, 0, "u", "a"), (2, 0, "u", "a"), (2, 0, "u", "b"), (3, 1, "u", "z"), (3, None, None, None), (3, None, None, None), (None, 0, "u", "lost"), (4, 0, "u", "t" * 100_000)]
    got = found(spark, rows, False)
    assert (1, 2, 1, 2, 0, 1, 1, hashlib.sha256(b"1,2").hexdigest()) in got  # equal turns: one order whatever the rows' order
    assert (3, 3, 3, 1, 0, 1, 0, hashlib.sha256(b"3").hexdigest()) in got
    assert max(r[3] for r in got) == 4
    wide = [(*r, 1, "n", 2, "d") for r in rows]
    assert found(spark, wide, False, COLUMNS + ", pos int, depth string, k1 long, chars string") == got
    assert prefix_trie.conversation_trie(spark.createDataFrame([], COLUMNS), True).count() == 0

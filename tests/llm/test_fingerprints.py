"""Merkle fingerprints and the meeting of neighbours by id."""

import hashlib
import random

import pytest

from fixtures import CLASHING, COLUMNS, corpus, frame, odd_rows, text
from tidegauge.llm import merkle as m


def test_equal_roots_for_equal_texts_only():
    texts = {t or "" for _, t, *_ in corpus()}
    marks = {t: m.fingerprint(t) for t in texts}
    assert len({f[:32] for f in marks.values()}) == len(texts)
    for t in texts:
        assert "".join(p for q in m.PARAGRAPH.findall(t) for p in (m.WORD if len(q) < m.SHORT else m.PHRASE).findall(q)) == t
        assert all(c not in marks[t][33:].replace("/", "").replace(".", "") for c in "/.")


def test_changes_locate_an_edit():
    rng = random.Random(9)
    a = text(rng, 400)
    paragraphs = a.split("\n")
    b = "\n".join([*paragraphs[:5], paragraphs[5] + " added words here", *paragraphs[6:]])
    found = m.changes(m.fingerprint(b), m.fingerprint(a))
    flat = [p for s in m.fingerprint(b)[33:].split("/") for p in s.split(".")]
    assert len(found) == 1 and m.changes(m.fingerprint(a), m.fingerprint(a)) == []
    section, paragraph = found[0]
    before = sum(len(s.split(".")) for s in m.fingerprint(b)[33:].split("/")[:section])
    assert before + paragraph == 5 and len(flat) == len(paragraphs)
    assert 0.9 < m.likeness(m.fingerprint(a), m.fingerprint(b)) < 1


@pytest.mark.parametrize("parts", [1, 7])
def test_edited_equals_brute_force(spark, parts):
    rows = [(r[0] * 7 - 50, *r[1:]) for r in corpus()]
    got = {r.doc_id: r for r in m.edited(frame(spark, rows, parts=parts)).collect()}
    ordered = sorted((i, t or "") for i, t, *_ in rows)
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][1]
        half = len(t) // 2
        changed = t[: len(t) - half] + following[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (m.fingerprint(t), m.fingerprint(changed))
        assert r.near_edited == m.likeness(r.fingerprint, r.edited_fingerprint)
        assert r.near_next == m.likeness(r.fingerprint, m.fingerprint(following))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1


def test_edited_half_stays_alike():
    rng = random.Random(4)
    for n in (12, 40, 200, 3000):
        a, b = text(rng, n), text(rng, n)
        half = len(a) // 2
        near = m.likeness(m.fingerprint(a), m.fingerprint(a[: len(a) - half] + b[:half]))
        assert 0.25 < near < 0.8 and m.likeness(m.fingerprint(a), m.fingerprint(b)) < near


def test_leaves_do_not_depend_on_the_length_of_the_paragraph():
    rng = random.Random(12)
    for n in (20, 28, 40, 200, 2000):
        a = " ".join(text(rng, n).split())
        for b in ("inserted " + a, a + " appended"):
            words = len(a.split())
            assert m.likeness(m.fingerprint(a), m.fingerprint(b)) >= 2 * (words - 1) / (2 * words + 1)
    for size in range(140, 181):
        a = " ".join(text(rng, 60).split())
        below, above = a[:150], a[:150] + "x" * (size - 150) if size > 150 else a[:size]
        assert m.likeness(m.fingerprint(below), m.fingerprint(above)) > 0.8


def test_odd_and_empty_tables(spark):
    docs = frame(spark, odd_rows(), CLASHING, 2)
    assert m.edited(docs).count() == m.fingerprints(docs).count() == docs.count()
    assert m.edited(spark.createDataFrame([], COLUMNS)).count() == 0
    one = m.edited(spark.createDataFrame([(5, "only one text", None, None, None)], COLUMNS)).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    nothing = m.edited(spark.createDataFrame([(None, "a", None, None, None), (None, None, None, None, None)], COLUMNS)).collect()
    assert sorted(r.n_chars for r in nothing) == [0, 1]


def test_edited_text_takes_the_branches_of_its_sources(spark, monkeypatch):
    from collections import Counter

    rng = random.Random(6)
    a, b = text(rng, 400), text(rng, 300)
    known, seen = {}, []
    branch = m.branch
    monkeypatch.setattr(m, "branch", lambda p: seen.append(p) or branch(p))
    own, other = m.fingerprint(a, known), m.fingerprint(b, known)
    half = len(a) // 2
    changed = a[: len(a) - half] + b[:half]
    seen.clear()
    mark = m.fingerprint(changed, known)
    assert len(seen) <= 2 < len(m.PARAGRAPH.findall(changed)) and mark == m.fingerprint(changed)
    left, right = (Counter(x[33:].replace("/", "").replace(".", "")[i : i + 4] for i in range(0, len(x[33:].replace("/", "").replace(".", "")), 4)) for x in (own, other))
    assert m.likeness(own, other) == 2 * (left & right).total() / (left.total() + right.total())

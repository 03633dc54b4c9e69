"""Language profiles: held-out accuracy and the algebra of the vectors."""

import os

import numpy as np
import pytest

from fixtures import CLASHING, COLUMNS, corpus, frame, odd_rows
from tidegauge.llm import language_id as x
from tidegauge.llm.common import table

DATA = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no data folder")
    docs = table(spark, DATA, "documents")
    out = x.held_out()
    profiles = x.fit(docs.filter(~out).select("text", "lang"))
    found = x.predict(docs, profiles, ["doc_id", "lang"]).withColumn("held_out", out).filter("held_out").collect()
    assert len(found) > 200 and sum(r.lang == r.lang_pred for r in found) / len(found) > 0.97
    assert all(0 <= r.score <= 1 for r in found)


def test_bundle_is_the_sum_of_bound_ngrams():
    e = x.Encoder(64, 3, 7)
    want = np.zeros(64)
    signs = [0, ord("a"), ord("b"), 0, ord("é"), 0]
    for i in range(len(signs) - 2):
        want += np.prod([np.roll(e.letter(c).astype(int), k) for k, c in enumerate(signs[i : i + 3])], axis=0)
    assert (e.bundle(["Ab -- é!", "123", None])[0] == want).all()
    assert not e.bundle(["123", None])[0].any()


def test_small_tables_keep_results():
    texts = [r[1] for r in corpus()]
    a, b = x.Encoder(128, 3, 7), x.Encoder(128, 3, 7)
    b.KEEP = 50
    one = np.vstack([b.bundle([t]) for t in texts])
    assert np.allclose(a.bundle(texts), one)


def test_unknown_and_nothing_learned(spark):
    rows = [(1, "abc abd", "xx", None, None), (2, "xyz xyw", "yy", None, None), (3, "123 ...", "xx", None, None), (4, None, "xx", None, None), (5, "abd abc", None, None, None)]
    docs = spark.createDataFrame(rows, COLUMNS)
    got = {r.doc_id: (r.lang_pred, r.score) for r in x.predict(docs, x.fit(docs)).collect()}
    assert got[1][0] == got[5][0] == "xx" and got[2][0] == "yy"
    assert got[3] == got[4] == (x.UNKNOWN, 0.0)
    blank = x.fit(docs.filter("doc_id > 9"))
    assert {r.lang_pred for r in x.predict(docs, blank).collect()} == {x.UNKNOWN}


def test_odd_and_empty_tables(spark):
    docs = frame(spark, odd_rows(), CLASHING, 2)
    profiles = x.fit(docs)
    assert x.predict(docs, profiles, ["doc_id", "key", "node"]).count() == docs.count()
    none = spark.createDataFrame([], COLUMNS)
    assert x.predict(none, x.fit(none)).count() == 0


def test_floors_are_learned_from_whole_texts(spark):
    rng = np.random.default_rng(4)

    def words(signs, n):
        return " ".join("".join(rng.choice(list(signs), 5)) for _ in range(n))

    heads = [words("abcde", 260) for _ in range(12)]
    alike = spark.createDataFrame([(i, h + " " + words("abcde", 300), "xx", None, None) for i, h in enumerate(heads)], COLUMNS)
    mixed = spark.createDataFrame([(i, h + " " + words("vwxyz", 300), "xx", None, None) for i, h in enumerate(heads)], COLUMNS)
    profiles = x.fit(alike, 1024)
    one, other = x.floors(alike, profiles), x.floors(mixed, profiles)
    assert set(one) == set(other) == {("xx", size) for size in range(x.SMALLEST, x.LARGEST + 1)}
    assert all(other[k] < 0.8 * one[k] for k in one)


def test_piece_scores_against_bundles(monkeypatch):
    e, rng = x.Encoder(4096, 3, 7), np.random.default_rng(5)
    texts = ["".join(rng.choice(list("abcdefgh "), n)) for n in (40, 700, 2600)] + ["", "12"]
    profiles = x.Profiles(["xx", "yy"], e.bundle(texts[:2]), 4096, 3, 7)
    codes = [e.codes(t) for t in texts]
    got = x.piece_scores(e, profiles, x.Likeness(50), codes)
    assert set(got) == {(k, s) for k, c in enumerate(codes) for s in range(5, 10) if len(c) >> s}
    for (k, size), score in got.items():
        cuts = [i << size for i in range(1, len(codes[k]) >> size)]
        pieces = [sum(e.bind(g).astype(float) for g in part.tolist()) for part in np.split(codes[k], cuts)]
        want = np.mean([max(0, (profiles.matrix @ v).max() / np.linalg.norm(v)) for v in pieces])
        assert abs(score - want) < 0.05 * want
    monkeypatch.setattr(x, "SEGMENT", 512)
    cut = x.piece_scores(e, profiles, x.Likeness(50), codes)
    assert set(cut) == set(got) and all(abs(cut[k] - got[k]) < 1e-6 for k in got)

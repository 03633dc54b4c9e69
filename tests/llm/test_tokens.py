"""Token counts, packing and BPE against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fixtures import CLASHING, COLUMNS, corpus, frame, odd_rows
from tidegauge.llm import bpe, packing, token_counts

ODD = [
    "a  b   c \n\n d", " lead", "trail ", "  ", "\t", "x y   z", "it's 'tis don't I'LL WE'VE 's", "<|endoftext|>", "a <|endoftext|>b<|startoftext|> C",
    "é é ﬁ ΑΣ Σ σς İ ǅ", "日本語 テキスト 123 ４５", "a\x1cb \x1f c\x85d", "\u0000 ﻿", "!!! ... ?!'s", "1234 56 7", "🙂🙂 \U0001f9d1‍\U0001f33e", "᠎​ x",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    made = {}
    for name in (token_counts.BYTE_BPE, bpe.WORD_BPE):
        made[name] = Tokenizer.from_file(token_counts.tokenizer_path(name))
    return made


def ids_of(library, name, text):
    return library[name].encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_library(library):
    encoder = token_counts.TextEncoder(token_counts.BYTE_BPE)
    assert encoder.fast is not None and token_counts.TextEncoder(bpe.WORD_BPE).fast is None
    for t in ODD + [r[1] or "" for r in corpus()]:
        assert encoder(t) == ids_of(library, token_counts.BYTE_BPE, t), t


def test_ids_of_real_texts_equal_the_library(library):
    import os

    import pyarrow.parquet as pq

    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no data folder")
    encoder = token_counts.TextEncoder(token_counts.BYTE_BPE)
    for t in pq.read_table(path, columns=["text"])["text"].to_pylist()[::3]:
        assert encoder(t) == ids_of(library, token_counts.BYTE_BPE, t)


def test_words_equal_the_library(library):
    own = bpe.WordBpe()
    for t in ODD + [r[1] or "" for r in corpus()]:
        want = ids_of(library, bpe.WORD_BPE, t)
        n, ids, decoded = own.round_trip(t)
        assert (n, ids) == (len(want), " ".join(map(str, want))), t
        assert decoded == library[bpe.WORD_BPE].decode(want, skip_special_tokens=False) == own.decode(want), t


@settings(max_examples=400, deadline=None)
@given(st.text(st.characters(codec="utf-8", exclude_categories=["Cs", "Cn", "Co"]), max_size=40) | st.text("aB 's\n\t<|>.é1", max_size=60))
def test_any_text(library, t):
    assert token_counts.worker_encoder(token_counts.BYTE_BPE)(t) == ids_of(library, token_counts.BYTE_BPE, t)
    want = ids_of(library, bpe.WORD_BPE, t)
    assert bpe.worker_bpe(bpe.WORD_BPE).encode(t) == (len(want), " ".join(map(str, want)))


def test_long_runs_are_seen():
    run = token_counts.RUN
    assert token_counts.has_long_run("a " + "x" * run) and token_counts.has_long_run("a" + " \n" * (run // 2) + "b")
    assert not token_counts.has_long_run("ab  \n" * 1000) and not token_counts.has_long_run("")


def test_stale_heap_entries():
    own = bpe.WordBpe()
    for word in ("aaaaaaaaaaaaaa", "ababababab", "thethethethe", "mississippi" * 20):
        ids = own.merge(word)
        assert "".join(own.strings[i] for i in ids) == word + "</w>"


def test_digests_equal_encoded(spark, library):
    docs = frame(spark, corpus())
    want = {r.doc_id: (r.ids, r.decoded) for r in bpe.encoded(docs).collect()}
    for r in bpe.digests(docs).collect():
        ids, decoded = want[r.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_counts_and_cache(spark, library):
    rows = corpus()
    docs, cache = frame(spark, rows), token_counts.CountCache(spark)
    version = token_counts.tokenizer_digest(token_counts.BYTE_BPE)
    texts = {r[0]: r[1] for r in rows}
    for _ in range(2):
        got = token_counts.count_tokens(docs, cache=cache).collect()
        assert len(got) == len(rows)
        for r in got:
            t = texts[r.doc_id] or ""
            assert (r.n_bytes, r.n_tokens) == (len(t.encode()), len(ids_of(library, token_counts.BYTE_BPE, t)))
        assert cache.read(version).count() == len({t or "" for t in texts.values()})
    cache.append(spark.createDataFrame([(hashlib.sha256(b"told").digest(), version, 77)], token_counts.CACHE))
    got = token_counts.count_tokens(spark.createDataFrame([(1, "told")], "doc_id long, text string"), cache=cache)
    assert got.first().n_tokens == 77  # a hit is read, not encoded
    other = token_counts.count_tokens(spark.createDataFrame([(1, "told")], "doc_id long, text string"), bpe.WORD_BPE, cache)
    assert other.first().n_tokens == 1  # another tokenizer version is a miss


def test_patterns_hold_every_piece_once():
    rng = random.Random(2)
    for _ in range(40):
        size = rng.choice([8, 64, 2048])
        histogram = {rng.randint(1, size): rng.choice([1, 2, 7, 1000, 10**7]) for _ in range(rng.randint(1, 60))}
        found = packing.patterns(histogram, size)
        seen = {}
        for pattern, count in found:
            assert count > 0 and sum(n * t for n, t in pattern) <= size
            for n, t in pattern:
                seen[n] = seen.get(n, 0) + t * count
        assert seen == histogram and len(found) <= 4 * size
        ends = {}
        for length, first, end, times, _, _ in packing.slots(found):
            assert first == ends.get(length, 0) and (end - first) % times == 0
            ends[length] = end
        assert ends == histogram


def check_packing(rows, got, library, size):
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == {r[0] for r in rows}
    for i, t, *_ in rows:
        ids = np.array([*ids_of(library, token_counts.BYTE_BPE, t), 1], "<u4")
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            at += p.length
            assert p.ids_crc32 == zlib.crc32(ids[p.start : at].tobytes())
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= size
    assert sorted(by_sequence) == list(range(len(by_sequence)))


def test_packing(spark, library):
    rows = corpus()
    check_packing(rows, packing.packed(frame(spark, rows)).collect(), library, 2048)
    check_packing(rows, packing.packed(frame(spark, rows), size=100).collect(), library, 100)


def test_sequences_hold_the_ids(spark, library):
    rows = corpus(n=20)
    out = packing.sequences(frame(spark, rows), size=256).collect()
    want = sorted(i for r in rows for i in [*ids_of(library, token_counts.BYTE_BPE, r[1]), 1])
    assert sorted(i for r in out for i in r.ids[: r.n_tokens]) == want
    assert all(len(r.ids) == 256 and not any(r.ids[r.n_tokens :]) for r in out)


def test_odd_and_empty_tables(spark):
    docs, none = frame(spark, odd_rows(), CLASHING, 2), spark.createDataFrame([], COLUMNS)
    assert packing.packed(docs).agg(F.sum("length")).first()[0] == packing.packed(docs).select("doc_id", "doc_tokens").agg(F.sum("doc_tokens")).first()[0]
    assert token_counts.count_tokens(docs).count() == bpe.digests(docs).count() == docs.count()
    assert packing.packed(none).count() == token_counts.count_tokens(none).count() == bpe.digests(none).count() == 0


def test_word_parts_are_merged_once(library):
    own, seen = bpe.WordBpe(), []
    merge = own.merge
    own.merge = lambda part: seen.append(part) or merge(part)
    text = "Tidegauge (tidegauge) tidegauge, TIDEGAUGE."
    assert own.round_trip(text)[1].split() == [str(i) for i in library[bpe.WORD_BPE].encode(text, add_special_tokens=False).ids]
    assert seen.count("tidegauge") == 1

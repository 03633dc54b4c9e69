"""Byte-level BPE against the library of the rank file."""

import base64
import hashlib
import random
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fixtures import CLASHING, COLUMNS, corpus, frame, odd_rows
from tidegauge.llm import byte_bpe
from tidegauge.llm.token_counts import tokenizer_path

ODD = ["a  b \n\n c", " lead", "trail  ", "\x1c\x1d a\x1e\x1fb", "I'm you'll WE'VE", "１２３ 四五", "é ﬁ İ ǅ", "🙂🙂 \U0001f9d1‍\U0001f33e", "<|endoftext|>", "\u0000\x85 x", "᠎ "]


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    with open(tokenizer_path(byte_bpe.RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    return byte_bpe.worker_bpe(byte_bpe.RANKS)


def test_ids_equal_the_library(own, library):
    rng = random.Random(2)
    long = ["x" * 9000, "ab" * 5000, "".join(rng.choice("abcdeé😀") for _ in range(8000)), "=" * 5000, " " * 6000 + "a"]
    for t in ODD + long + [r[1] or "" for r in corpus(n=20)]:
        assert own.encode(t) == library.encode_ordinary(t)
        assert own.decode(own.encode(t)) == t.encode()


def test_every_kind_of_sign_is_cut_like_the_library(own, library):
    for c in [*range(0x3100), *range(0x3100, 0x110000, 37)]:
        if not 0xD800 <= c < 0xE000:
            t = f"a{chr(c)}1 {chr(c)}{chr(c)}  b"
            assert own.encode(t) == library.encode_ordinary(t), hex(c)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40))
def test_any_text(own, library, text):
    ids, content = own.round_trip(text)
    assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == library.encode_ordinary(text) and content == text.encode()


def test_merges_of_any_piece(own, library):
    rng = random.Random(4)
    for n in [2, 3, 4, 5, 8, 9, 31, 32, 33, 400]:
        for _ in range(20):
            piece = bytes(rng.choice(b"the inaer\xc3\xa9\xff") for _ in range(n))
            want = library._core_bpe.encode_single_piece(piece)
            assert own.ids_of(piece) == want


def want_row(library, doc_id, text):
    ids = library.encode_ordinary(text or "")
    packed = struct.pack(f"<{len(ids)}I", *ids)
    return doc_id, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_digests_of_a_table(spark, library):
    rows = corpus()
    assert sorted(map(tuple, byte_bpe.digests(frame(spark, rows)).collect())) == sorted(want_row(library, r[0], r[1]) for r in rows)


def test_odd_tables(spark, library):
    rows = odd_rows()
    got = sorted(map(tuple, byte_bpe.digests(frame(spark, rows, CLASHING)).collect()), key=str)
    assert got == sorted((want_row(library, r[0], r[1]) for r in rows), key=str)
    assert byte_bpe.digests(spark.createDataFrame([], COLUMNS)).count() == 0


def test_round_trip_of_tables(spark, library):
    rows = [r for r in corpus(n=15) if len(r[1] or "") < 5000]
    held = byte_bpe.encoded(frame(spark, rows)).cache()
    texts = {r[0]: r[1] or "" for r in rows}
    for r in held.collect():
        assert list(r["ids"]) == library.encode_ordinary(texts[r["doc_id"]]) and r["decoded"] == texts[r["doc_id"]]
    assert {r["doc_id"]: bytes(r["content"]).decode() for r in byte_bpe.decoded(held).collect()} == texts

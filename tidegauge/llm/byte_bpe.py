"""Byte-level BPE encoding and decoding with rank files.

A text is cut by the pattern of the vocabulary. A piece that is a token gets its id. Any other piece
starts as single bytes, and a segment tree over its byte positions holds, at the leaf of a part's
first byte, the rank of that part joined with the next one; an inner node keeps the smaller of its
two children, ties by position. The root is then the leftmost minimum. A merge writes three leaves:
the merged part, its live left neighbour, and the part that is gone, each up a path of logarithmic
length that ends where a minimum does not change. Decoding joins the bytes of the ids.

Scale: no shuffle; each task reads its rows once. A worker keeps short pieces it has met, a bounded
number of bounded length. A piece of n bytes takes O(n log n) steps and about 40 bytes of memory a
byte, whatever it holds, so a very long text without blanks is encoded like any other.

Defined results: null text is empty, with no ids and an empty decoding; repeated rows are encoded
alike; null doc_ids stay; bytes without a rank are an error of the vocabulary and raise; an empty
table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import struct
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import Memo, map_rows, text_of
from tidegauge.llm.token_counts import tokenizer_path

RANKS = "byte_bpe_50k.tiktoken"
NONE = 2**62  # no such pair
KNOWN_SIGNS, KNOWN = 64, 300_000  # pieces that a worker keeps: characters of one, number
LARGE = 4096  # bytes from which a tree lies in an array instead of a list


class ByteBpe:
    """Encoder and decoder of a rank file: lines of a base64 token and its rank, which is its id."""

    def __init__(self, name: str = RANKS, pattern: str | None = None):
        if pattern is None:
            from public_tokenizers import PATTERN as pattern
        with open(tokenizer_path(name), "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        # Python counts four control characters as white space, the vocabulary's pattern does not
        self.pattern = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.short = Memo(self.packed, KNOWN)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece by merges of its bytes."""
        rank_of, longest, n = self.ranks.get, self.longest, len(piece)
        size = 1 << max(n - 2, 0).bit_length()
        # leaf size + i: rank * n + i of the part that starts at byte i with the next part
        line = list if n < LARGE else lambda values: array("q", values)
        tree = line([NONE]) * (2 * size)
        for i in range(n - 1):
            rank = rank_of(piece[i : i + 2])
            if rank is not None:
                tree[size + i] = rank * n + i
        for k in range(size - 1, 0, -1):
            x, y = tree[2 * k], tree[2 * k + 1]
            tree[k] = x if x < y else y
        after, before = line(range(1, n + 1)), line(range(-1, n - 1))
        while (least := tree[1]) != NONE:
            left = least % n
            right = after[left]
            end = after[left] = after[right]
            joined = NONE
            if end < n:
                before[end] = left
                to = after[end]
                rank = rank_of(piece[left:to]) if to - left <= longest else None
                if rank is not None:
                    joined = rank * n + left
            changes = [(left, joined), (right, NONE)] if right < n - 1 else [(left, joined)]
            earlier = before[left]
            if earlier >= 0:
                rank = rank_of(piece[earlier:end]) if end - earlier <= longest else None
                changes.append((earlier, NONE if rank is None else rank * n + earlier))
            for at, value in changes:
                k = size + at
                while tree[k] != value:
                    tree[k] = value
                    other = tree[k ^ 1]
                    if other < value:
                        value = other
                    k >>= 1
                    if not k:
                        break
        ids, at, ranks = [], 0, self.ranks
        while at < n:
            ids.append(ranks[piece[at : after[at]]])
            at = after[at]
        return ids

    def ids_of(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        return self.merge(piece) if whole is None else [whole]

    def pieces(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def encode(self, text: str) -> list[int]:
        return [i for piece in self.pieces(text) for i in self.ids_of(piece.encode())]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def packed(self, piece: str) -> bytes:
        """Ids of one piece as little-endian unsigned 32-bit integers."""
        ids = self.ids_of(piece.encode())
        return struct.pack(f"<{len(ids)}I", *ids)

    def round_trip(self, text: str) -> tuple[bytes, bytes]:
        """(packed ids, decoded bytes) of a text."""
        pieces = self.pieces(text)
        if max(map(len, pieces), default=0) <= KNOWN_SIGNS:
            ids = b"".join(map(self.short.__getitem__, pieces))
        else:
            ids = b"".join([self.short[p] if len(p) <= KNOWN_SIGNS else self.packed(p) for p in pieces])
        return ids, self.decode(struct.unpack(f"<{len(ids) // 4}I", ids))


@functools.cache
def worker_bpe(name: str) -> ByteBpe:
    """One encoder for all tasks of a worker, so that its pieces stay known."""
    return ByteBpe(name)


def encoded(docs: DataFrame, name: str = RANKS) -> DataFrame:
    """doc_id, ids (array) and decoded text of every document."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        bpe = worker_bpe(name)
        for b in batches:
            ids = [bpe.encode(t) for t in b["text"]]
            yield {"doc_id": b["doc_id"], "ids": ids, "decoded": [bpe.decode(i).decode() for i in ids]}

    return map_rows(_rows(docs), run, "doc_id long, ids array<int>, decoded string", 64)


def decoded(rows: DataFrame, name: str = RANKS) -> DataFrame:
    """doc_id and bytes of ids that were encoded before, in any session."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        bpe = worker_bpe(name)
        for b in batches:
            yield {"doc_id": b["doc_id"], "content": [bpe.decode(i or []) for i in b["ids"]]}

    return map_rows(rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ids"), run, "doc_id long, content binary", 64)


def digests(docs: DataFrame, name: str = RANKS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: ``encoded`` without moving ids and texts."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        bpe = worker_bpe(name)
        for b in batches:
            found = [bpe.round_trip(t) for t in b["text"]]
            hashes = [hashlib.sha256(x).hexdigest() for x in chain.from_iterable(found)]
            yield {"doc_id": b["doc_id"], "n_tokens": [len(f[0]) // 4 for f in found], "ids_sha256": hashes[::2], "decoded_sha256": hashes[1::2]}

    return map_rows(_rows(docs), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", 128)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))

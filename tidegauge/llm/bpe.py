"""BPE encoding and decoding for vocabularies with word ends.

A word starts as a doubly linked list of symbols, the last one with the word-end suffix. A heap
holds the merges of neighbouring symbols by (rank, position). The lowest is taken; an entry whose
symbols have changed since is stale and skipped; a merge links the list anew and pushes the two
new neighbour pairs. Decoding joins vocabulary strings.

Text is prepared as the vocabulary file asks: special strings are cut out first, then NFC, white
space, lower case, and the split into letters, single digits and other signs. The steps after the
first two look at nothing beyond white space, so every word is encoded once per worker and kept,
and so is every part of a word, which the same word in capitals or beside other signs shares.

Scale: no shuffle; each task reads its rows once and holds a bounded number of words.

Defined results: null text is empty, with no ids and an empty decoding; bytes without a symbol in
the vocabulary give no id; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import Memo, byte_symbols, map_rows, text_of
from tidegauge.llm.token_counts import tokenizer_path

WORD_BPE = "word_bpe_49k.json"
SPACES = regex.compile(r"\p{White_Space}+")
ODD_SPACE = regex.compile(r"[\x1c-\x1f]")  # white space for str.split, not for the vocabulary


class WordBpe:
    """Encoder and decoder of a vocabulary file in the tokenizers format."""

    def __init__(self, name: str = WORD_BPE):
        with open(tokenizer_path(name), encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a + b])
        self.strings = {i: t for t, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings |= {i: t for t, i in self.special.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(pattern)
        self.inner = [self.vocab.get(c) for c in byte_symbols()]  # by byte, within and at the end of a word
        self.final = [self.vocab.get(c + self.suffix) for c in byte_symbols()]
        self.known = Memo(self.encode_part, 200_000)
        self.words = Memo(self.encode_word, 300_000)

    def merge(self, word: str) -> list[int]:
        """Ids of one pre-token."""
        raw = word.encode()
        ids = [*map(self.inner.__getitem__, raw[:-1]), self.final[raw[-1]]]
        if None in ids:
            ids = [i for i in ids if i is not None]
        n = len(ids)
        merges = self.merges
        heap: list[tuple[int, int, int, int, int]] = []
        for i, pair in enumerate(zip(ids, ids[1:])):
            got = merges.get(pair)
            if got:
                heap.append((got[0], i, *pair, got[1]))
        if not heap:
            return ids
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heapq.heapify(heap)
        while heap:
            _, left, a, b, new = heapq.heappop(heap)
            right = after[left]
            if ids[left] != a or right < 0 or ids[right] != b:
                continue  # stale: one of the two was merged meanwhile
            ids[left], ids[right] = new, -1
            after[left] = further = after[right]
            if further >= 0:
                before[further] = left
                got = merges.get((new, ids[further]))
                if got:
                    heapq.heappush(heap, (got[0], left, new, ids[further], got[1]))
            earlier = before[left]
            if earlier >= 0:
                got = merges.get((ids[earlier], new))
                if got:
                    heapq.heappush(heap, (got[0], earlier, ids[earlier], new, got[1]))
        return [i for i in ids if i >= 0]

    def encode_part(self, part: str) -> tuple[int, str, str]:
        """(number of ids, ids, decoded) of one pre-token."""
        ids = self.merge(part)
        return len(ids), " ".join(map(str, ids)), self.decode(ids)

    def encode_word(self, word: str) -> tuple[int, str, str]:
        """(number of ids, ids, decoded) of the text between two white spaces; ids as text."""
        found = list(map(self.known.__getitem__, self.split.findall(word.replace("Σ", "σ").lower())))
        if len(found) == 1:
            return found[0]
        found = [p for p in found if p[0]]
        return sum([p[0] for p in found]), " ".join([p[1] for p in found]), " ".join([p[2] for p in found])

    def parts(self, text: str) -> Iterator[tuple[int, str, str]]:
        for piece in self.cut.split(text) if self.cut else [text]:
            if piece in self.special:
                yield 1, str(self.special[piece]), piece
                continue
            if not unicodedata.is_normalized("NFC", piece):
                piece = unicodedata.normalize("NFC", piece)
            words = SPACES.split(piece) if ODD_SPACE.search(piece) else piece.split()
            yield from map(self.words.__getitem__, filter(None, words))

    def encode(self, text: str) -> tuple[int, str]:
        """(number of ids, ids joined by blanks)."""
        found = list(self.parts(text))
        return sum(p[0] for p in found), " ".join([p[1] for p in found if p[0]])

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings joined by blanks, as a file without decoder asks."""
        return " ".join([self.strings[i] for i in ids if i in self.strings])

    def round_trip(self, text: str) -> tuple[int, str, str]:
        """(number of ids, ids, decoded text)."""
        found = [p for p in self.parts(text) if p[0]]
        return sum([p[0] for p in found]), " ".join([p[1] for p in found]), " ".join([p[2] for p in found])


@functools.cache
def worker_bpe(name: str) -> WordBpe:
    """One encoder for all tasks of a worker, so that its words stay known."""
    return WordBpe(name)


def encoded(docs: DataFrame, name: str = WORD_BPE) -> DataFrame:
    """doc_id, ids (array) and decoded text of every document."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        bpe = worker_bpe(name)
        for b in batches:
            found = [bpe.round_trip(t) for t in b["text"]]
            yield {"doc_id": b["doc_id"], "ids": [[int(i) for i in f[1].split()] for f in found], "decoded": [f[2] for f in found]}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return map_rows(rows, run, "doc_id long, ids array<int>, decoded string", 128)


def digests(docs: DataFrame, name: str = WORD_BPE) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: ``encoded`` without moving ids and texts."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        bpe = worker_bpe(name)
        for b in batches:
            found = [bpe.round_trip(t) for t in b["text"]]
            yield {
                "doc_id": b["doc_id"],
                "n_tokens": [f[0] for f in found],
                "ids_sha256": [hashlib.sha256(f[1].encode()).hexdigest() for f in found],
                "decoded_sha256": [hashlib.sha256(f[2].encode()).hexdigest() for f in found],
            }

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return map_rows(rows, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", 128)

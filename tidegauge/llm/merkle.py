"""Document fingerprints as Merkle trees over sections, paragraphs and phrases.

A text is cut without loss: paragraphs end with a line feed; a section ends with a blank line or
where a paragraph's own hash says so; a phrase is a word, the white space behind it and the word
before it, in paragraphs of any length. Nodes hash their children, the root is 32 hex digits. All
cuts follow from content, so an edit changes the words it touches, the phrase after them and the
nodes above, wherever it lies. Runs of more than 64 characters without white space are words of
64 characters.

A fingerprint is text: ``root:sections``, sections separated by ``/``, paragraphs by ``.``, four
characters for each phrase. Inner nodes follow from the phrases below them: equal strings are
equal branches, so ``changes`` skips them and reports the paragraphs in which two texts differ.
``likeness`` is twice the number of phrases in common over the number of phrases of both.

Scale: a document has to meet the next one by doc_id. Range bounds are taken from quantiles of the
ids; each document is sent to its range, and the first one of a range also to the range before,
so texts are shuffled once and no order over the whole table is needed. Tasks stream their
sorted rows and hold two texts.

Defined results: null text is empty; the empty text has a root and no phrases; two empty texts
have likeness 1. Rows with the same doc_id are ordered by a hash of their text, a null doc_id
comes last; the last document is followed by the first, a single one by itself. An empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import Memo, map_rows, partitions, text_of

PARAGRAPH = re.compile(r"[^\n]*\n|[^\n]+")
WORD = re.compile(r"\S{1,64}\s*|\s+")
PHRASE, SHORT = WORD, 0  # the same leaves in paragraphs of any length


MIX = np.uint64(0x9E3779B97F4A7C15)


def word_hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")


HASHES = Memo(word_hash, 50_000)


def leaves(words: list[str]) -> tuple[bytes, str]:
    """Hashes of the words of a paragraph, and four characters for each of its phrases."""
    own = np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))
    mixed = own.copy()
    mixed[1:] += (own[:-1] ^ (own[:-1] >> np.uint64(29))) * MIX
    mixed ^= mixed >> np.uint64(32)
    return own.tobytes(), base64.urlsafe_b64encode(mixed.view(np.uint8).reshape(-1, 8)[:, :3].tobytes()).decode()


def digest(parts: list[bytes], size: int = 16) -> bytes:
    return hashlib.blake2b(b"".join(parts), digest_size=size).digest()


def branch(paragraph: str) -> tuple[bytes, str]:
    """Node of a paragraph and its phrases."""
    own, shown = leaves(WORD.findall(paragraph))
    return digest([own]), shown


def fingerprint(text: str, known: dict[str, tuple[bytes, str]] | None = None) -> str:
    """``known`` holds branches of paragraphs; those that it lacks are added."""
    known = {} if known is None else known
    sections, roots = [], []
    section, nodes = [], []
    for paragraph in PARAGRAPH.findall(text):
        got = known.get(paragraph)
        if got is None:
            got = known[paragraph] = branch(paragraph)
        node, shown = got
        section.append(shown)
        nodes.append(node)
        if not paragraph.strip() or node[0] < 32:
            sections.append(".".join(section))
            roots.append(digest(nodes))
            section, nodes = [], []
    if section:
        sections.append(".".join(section))
        roots.append(digest(nodes))
    return digest(roots).hex() + ":" + "/".join(sections)


def phrases(mark: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct phrases, four characters as one number, and how often each occurs."""
    found = mark[33:].replace("/", "").replace(".", "").encode()
    return np.unique(np.frombuffer(found, np.uint32), return_counts=True)


def likeness(a: str, b: str) -> float:
    """0 to 1; equal roots need no comparison."""
    if a[:32] == b[:32]:
        return 1.0
    (left, n), (right, m) = phrases(a), phrases(b)
    total = int(n.sum() + m.sum())
    _, i, j = np.intersect1d(left, right, True, True)
    return 2 * int(np.minimum(n[i], m[j]).sum()) / total if total else 0.0


def changes(a: str, b: str) -> list[tuple[int, int]]:
    """(section, paragraph) of ``a`` whose branch does not occur in ``b``; equal roots: none."""
    if a[:32] == b[:32]:
        return []
    sections = set(b[33:].split("/"))
    paragraphs = set(b[33:].replace("/", ".").split("."))
    return [
        (i, j)
        for i, section in enumerate(a[33:].split("/"))
        if section not in sections
        for j, paragraph in enumerate(section.split("."))
        if paragraph not in paragraphs
    ]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of every document."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            yield {"doc_id": b["doc_id"], "fingerprint": [fingerprint(t) for t in b["text"]]}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return map_rows(rows, run, "doc_id long, fingerprint string", 256)


def with_next(docs: DataFrame, fn, schema: str) -> DataFrame:
    """``fn`` over (row, next row) for documents in ascending doc_id, the last followed by the first.

    ``fn`` gets and yields as in ``map_rows``, with columns doc_id, text, next_text.
    """
    spark = docs.sparkSession
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    n = 4 * partitions(spark)
    cuts = ids.agg(
        F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n).alias("cuts"), F.min("doc_id").alias("least"), F.count("*").alias("n")
    ).first()
    bounds = np.array(sorted(set(cuts.cuts or [])), np.int64)
    first, last = cuts.least, len(bounds)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))

    def place(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            out = {"range": [], "doc_id": [], "text": [], "ahead": []}
            for doc, text in zip(b["doc_id"], b["text"]):
                at = last if doc is None else int(np.searchsorted(bounds, doc, "right"))
                ahead = []
                if doc is not None and at and doc == bounds[at - 1]:
                    ahead.append(at - 1)
                if doc == first:
                    ahead.append(last)
                for to, flag in ((at, 0), *((to, 1 if to < last or doc != first else 2) for to in ahead)):
                    for c, v in zip(out, (to, doc, text, flag)):
                        out[c].append(v)
            yield out

    def pair(batches: Iterator[dict]) -> Iterator[dict]:
        held, heading = None, None  # the last row of its range that waits for the next; its range
        waiting = False
        for b in batches:
            out = {"doc_id": [], "text": [], "next_text": []}
            for to, doc, text, ahead in zip(b["range"], b["doc_id"], b["text"], b["ahead"]):
                if to == heading and waiting:
                    for c, v in zip(out, (*held, text)):
                        out[c].append(v)
                waiting = not ahead
                held, heading = (doc, text), to
            yield out

    dealt = (
        map_rows(rows, place, "range int, doc_id long, text string, ahead int", 256)
        .repartition(partitions(spark), "range")
        .sortWithinPartitions("range", "ahead", F.col("doc_id").asc_nulls_last(), F.xxhash64("text"))
    )
    return map_rows(dealt, lambda batches: fn(pair(batches)), schema, 256)


def edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its half-replaced form, and how alike they are."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        memo: tuple[str | None, str] = (None, "")
        known: dict = {}  # branches of this text and the next one: the edited text is made of their paragraphs
        for b in batches:
            out = {c: [] for c in ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")}
            for doc, text, following in zip(b["doc_id"], b["text"], b["next_text"]):
                half = len(text) // 2
                changed = text[: len(text) - half] + following[:half]
                own = memo[1] if memo[0] == text else fingerprint(text, known)
                ahead: dict = {}
                memo = (following, own if following == text else fingerprint(following, ahead))
                other = own if changed == text else fingerprint(changed, known | ahead)
                sha = hashlib.sha256(changed.encode()).hexdigest()
                values = (doc, len(text), sha, own, other, likeness(own, other), likeness(own, memo[1]))
                for c, v in zip(out, values):
                    out[c].append(v)
                known = known if following == text else ahead
            yield out

    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    return with_next(docs, run, schema)

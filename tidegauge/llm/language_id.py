"""Language identification with hyperdimensional n-gram profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. An n-gram binds its
letters' vectors, each permuted (rotated) by its place in the n-gram, by multiplication. A document
bundles, that is adds, the vectors of all its n-grams; a language prototype bundles the documents
of that language. A document gets the language whose prototype has the largest cosine.

Text is lower-cased; every run of characters that are not letters is one boundary sign, which has
a vector like a letter, so words of any length have n-grams.

Scale: training adds up inside each task and sends ``dim`` numbers per language and task; the
prototypes (languages x ``dim`` numbers, whatever the data) reach the tasks as a constant.
Prediction needs no shuffle. A worker keeps n-gram vectors as bits in one table of
fixed size, a bit for each number, and turns a part of them into floats at a time. A very long text adds one
number for each of its letters while it is read.

Defined results: ``und`` with score 0 for null text, text without a letter, or when nothing was
learned; the score is the cosine, negative ones as 0; ties go to the first language by name; rows
without language or text teach nothing; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import map_rows

UNKNOWN = "und"
SMALLEST = 5  # texts of fewer n-grams than 2 to this say too little to be like no language
LARGEST = 9  # texts of more n-grams than 2 to this are judged alike
SEGMENT = 1 << 17  # n-grams of learned texts that are cut into pieces at once, a multiple of all sizes
LIKENESS = 1 << 18  # products of n-grams and prototypes that a task keeps


class Encoder:
    """Document vectors of ``dim`` numbers from letter ``n``-grams."""

    KEEP = 30_000
    PART = 512  # n-grams that are multiplied at once

    def __init__(self, dim: int, n: int, seed: int):
        self.dim, self.n, self.seed = dim, n, seed
        self.KEEP = max(self.PART, min(self.KEEP, 64_000_000 // dim))  # 8 MB of bits
        self.letters: dict[int, np.ndarray] = {}
        self.table = np.zeros(0x110000, np.int32) - 1  # code point -> 0 boundary, else itself
        self.grams: dict[int, int] = {}
        self.vectors = np.empty((self.KEEP, -(-dim // 8)), np.uint8)  # a bit for each number

    def letter(self, code: int) -> np.ndarray:
        got = self.letters.get(code)
        if got is None:
            got = np.random.default_rng([self.seed, code]).integers(0, 2, self.dim, dtype=np.int8) * 2 - 1
            self.letters[code] = got
        return got

    def bind(self, gram: int) -> np.ndarray:
        out = np.ones(self.dim, np.int8)
        for place in range(self.n):
            out = out * np.roll(self.letter(gram >> (21 * place) & 0x1FFFFF), place)
        return out

    def codes(self, text: str) -> np.ndarray:
        """n-grams of a text as numbers; empty without a letter."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
        signs = self.table[points]
        if (signs < 0).any():
            for p in np.unique(points[signs < 0]).tolist():
                self.table[p] = p if unicodedata.category(chr(p))[0] == "L" else 0
            signs = self.table[points]
        if not signs.any():
            return np.empty(0, np.int64)
        signs = np.concatenate([[0], signs, [0]]).astype(np.int64)
        keep = np.ones(len(signs), bool)
        keep[1:] = (signs[1:] != 0) | (signs[:-1] != 0)
        signs = signs[keep]
        if len(signs) < self.n:
            signs = np.concatenate([signs, np.zeros(self.n - len(signs), np.int64)])
        out = signs[: len(signs) - self.n + 1].copy()
        for place in range(1, self.n):
            out |= signs[place : len(signs) - self.n + 1 + place] << (21 * place)
        return out

    def vectors_of(self, grams: np.ndarray) -> np.ndarray:
        """Bound vectors of ``PART`` distinct n-grams at most; the table that keeps them starts anew when full."""
        known, listed = self.grams, grams.tolist()
        new = [g for g in listed if g not in known]
        if len(known) + len(new) > self.KEEP:
            known.clear()
            new = listed
        for g in new:
            self.vectors[len(known)] = np.packbits(self.bind(g) > 0)
            known[g] = len(known)
        bits = self.vectors[np.fromiter(map(known.__getitem__, listed), np.int64, len(listed))]
        return np.unpackbits(bits, axis=1, count=self.dim).view(np.int8) * np.int8(2) - np.int8(1)

    def bundle(self, texts: list[str | None]) -> np.ndarray:
        """One vector for each text, zero for texts without a letter."""
        out = np.zeros((len(texts), self.dim), np.float32)
        codes = [self.codes(t) if t else np.empty(0, np.int64) for t in texts]
        owner = np.repeat(np.arange(len(texts)), [len(c) for c in codes])
        grams, at = np.unique(np.concatenate(codes), return_inverse=True) if codes else (np.empty(0, np.int64), np.empty(0, np.int64))
        order = np.argsort(at, kind="stable")
        owner, at = owner[order], at[order]
        for first in range(0, len(grams), self.PART):
            part = grams[first : first + self.PART]
            inside = slice(*np.searchsorted(at, [first, first + len(part)]))
            count = np.bincount(owner[inside] * len(part) + at[inside] - first, minlength=len(texts) * len(part))
            out += count.reshape(len(texts), len(part)).astype(np.float32) @ self.vectors_of(part).astype(np.float32)
        return out


@functools.cache
def worker_encoder(dim: int, n: int, seed: int) -> Encoder:
    """One encoder for all tasks of a worker, so that its vectors stay known and are held once."""
    return Encoder(dim, n, seed)


class Profiles:
    """Language prototypes, one row each, languages in order."""

    def __init__(self, langs: list[str], matrix: np.ndarray, dim: int, n: int, seed: int, letters: tuple | list = ()):
        self.langs, self.dim, self.n, self.seed = langs, dim, n, seed
        self.letters = np.array(sorted(letters), np.int64)
        norm = np.linalg.norm(matrix, axis=1, keepdims=True)
        self.matrix = (matrix / np.where(norm == 0, 1, norm)).astype(np.float32)


def fit(labelled: DataFrame, dim: int = 512, n: int = 3, seed: int = 7) -> Profiles:
    """Prototypes from rows with text and lang; all rows are used.

    The number of languages times ``dim`` and the distinct letters are what reaches the driver.
    """

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        encoder = worker_encoder(dim, n, seed)
        letters: set[int] = set()
        counts: dict[str, Counter] = {}
        sums: dict[str, np.ndarray] = {}

        def bundle() -> None:
            for lang, mine in counts.items():
                grams = np.fromiter(mine, np.int64, len(mine))
                weights = np.fromiter(mine.values(), np.float64, len(mine))
                total = sums.setdefault(lang, np.zeros(dim))
                for at in range(0, len(grams), encoder.PART):
                    total += weights[at : at + encoder.PART] @ encoder.vectors_of(grams[at : at + encoder.PART]).astype(np.float64)
            counts.clear()

        for b in batches:
            found: dict[str, list] = {}
            for text, lang in zip(b["text"], b["lang"]):
                found.setdefault(lang, []).append(encoder.codes(text))
            for lang, codes in found.items():
                grams, n_of = np.unique(np.concatenate(codes), return_counts=True)
                counts.setdefault(lang, Counter()).update(dict(zip(grams.tolist(), n_of.tolist())))
                for place in range(n):
                    letters.update(np.unique(grams >> (21 * place) & 0x1FFFFF).tolist())
            if sum(map(len, counts.values())) > encoder.KEEP:
                bundle()
        bundle()
        for lang, vector in sums.items():
            yield {"lang": [lang] * dim, "place": range(dim), "value": vector}
        seen = sorted(letters - {0})
        yield {"lang": [None] * len(seen), "place": seen, "value": [0.0] * len(seen)}

    rows = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    parts = map_rows(rows.filter("text is not null and lang is not null"), run, "lang string, place int, value double", 64)
    sums = parts.groupBy("lang", "place").agg(F.sum("value").alias("value")).collect()
    letters = [r.place for r in sums if r.lang is None]
    sums = [r for r in sums if r.lang is not None]
    langs = sorted({r.lang for r in sums})
    matrix = np.zeros((len(langs), dim))
    for r in sums:
        matrix[langs.index(r.lang), r.place] = r.value
    return Profiles(langs, matrix, dim, n, seed, letters)


def predict(docs: DataFrame, profiles: Profiles, keep: list[str] | None = None, evidence: bool = False) -> DataFrame:
    """``keep`` columns (default doc_id) with lang_pred and score.

    With ``evidence`` also ``size``, the binary logarithm of the number of n-grams, ``LARGEST`` at
    most, and ``known``, the share of the letters that were learned.
    """
    keep = ["doc_id"] if keep is None else keep

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        encoder = worker_encoder(profiles.dim, profiles.n, profiles.seed)
        for b in batches:
            vectors = encoder.bundle(b["_tg_text"])
            norms = np.linalg.norm(vectors, axis=1)
            langs, scores = [UNKNOWN] * len(norms), np.zeros(len(norms))
            if profiles.langs:
                cosines = (vectors @ profiles.matrix.T) / np.where(norms == 0, 1, norms)[:, None]
                best = cosines.argmax(axis=1)
                langs = [profiles.langs[k] if w > 0 else UNKNOWN for k, w in zip(best, norms)]
                scores = np.where(norms > 0, np.clip(cosines.max(axis=1), 0, 1), 0.0).astype(float)
            out = {**{c: b[c] for c in keep}, "lang_pred": langs, "score": scores}
            if evidence:
                codes = [encoder.codes(t) if t else np.empty(0, np.int64) for t in b["_tg_text"]]
                out["size"] = [min(max(len(c), 1).bit_length() - 1, LARGEST) for c in codes]
                middles = [c >> 21 & 0x1FFFFF for c in codes]
                middles = [m[m > 0] for m in middles]
                out["known"] = [float(np.isin(m, profiles.letters).mean()) if len(m) else 0.0 for m in middles]
            yield out

    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("string").alias("_tg_text"))
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    return map_rows(rows, run, ", ".join([*kept, "lang_pred string", "score double"] + ["size int", "known double"] * evidence), 64)


class Likeness(dict):
    """Products of an n-gram with all prototypes, at most ``keep`` n-grams; starts anew when full."""

    def __init__(self, keep: int):
        super().__init__()
        self.keep = keep

    def put(self, gram: int, products: np.ndarray) -> np.ndarray:
        if len(self) >= self.keep:
            self.clear()
        self[gram] = products
        return products


def segments(codes: list[np.ndarray]) -> Iterator[list[tuple[int, np.ndarray]]]:
    """(place of the text, n-grams) of whole texts, ``SEGMENT`` n-grams or the rest, some at a time."""
    block, held = [], 0
    for k, c in enumerate(codes):
        n = max(1, len(c) // SEGMENT)
        for i in range(n):
            block.append((k, c[i * SEGMENT : (i + 1) * SEGMENT if i < n - 1 else None]))
            held += len(block[-1][1])
            if held >= SEGMENT:
                yield block
                block, held = [], 0
    if block:
        yield block


def piece_scores(encoder: Encoder, profiles: Profiles, likeness: Likeness, codes: list[np.ndarray]) -> dict[tuple[int, int], float]:
    """(place of the text, size) -> mean score of the text's pieces of 2 ** size n-grams.

    Pieces cover the whole text, the last one takes the rest. The products of n-grams with the prototypes
    are added up; bound vectors are nearly orthogonal, so a piece's length is taken from its counts.
    """
    total: dict[tuple[int, int], np.ndarray] = {}
    for block in segments(codes):
        grams, at = np.unique(np.concatenate([c for _, c in block]), return_inverse=True)
        products = [likeness.get(g) for g in grams.tolist()]
        new = [i for i, k in enumerate(products) if k is None]
        for first in range(0, len(new), encoder.PART):
            part = new[first : first + encoder.PART]
            for i, k in zip(part, encoder.vectors_of(grams[part]).astype(np.float32) @ profiles.matrix.T):
                products[i] = likeness.put(int(grams[i]), k)
        products = np.array(products)
        ends = np.cumsum([len(c) for _, c in block])
        for size in range(SMALLEST, LARGEST + 1):
            mine = [(i, len(c) >> size) for i, (_, c) in enumerate(block) if len(c) >> size]
            if not mine:
                break
            starts = np.concatenate([ends[i] - len(block[i][1]) + (np.arange(n) << size) for i, n in mine])
            lengths = np.concatenate([[1 << size] * (n - 1) + [len(block[i][1]) - (n - 1 << size)] for i, n in mine])
            firsts = np.cumsum(lengths) - lengths
            inside = at[np.repeat(starts - firsts, lengths) + np.arange(lengths.sum())]
            sums = np.add.reduceat(products[inside], firsts)
            keys = np.sort(np.repeat(np.arange(len(starts)), lengths) << 32 | inside)
            runs = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            squares = np.bincount(keys[runs] >> 32, np.diff(runs, append=len(keys)).astype(float) ** 2)
            scores = np.clip(sums.max(axis=1) / np.sqrt(squares * profiles.dim), 0, 1)
            for (i, n), own in zip(mine, np.split(scores, np.cumsum([n for _, n in mine])[:-1])):
                total.setdefault((block[i][0], size), np.zeros(2))[:] += own.sum(), n
    return {key: float(s / n) for key, (s, n) in total.items()}


def floors(labelled: DataFrame, profiles: Profiles) -> dict[tuple[str, int], float]:
    """(language, size) -> score below which a text is like none: half the 1 % point of learned texts.

    A learned text counts once for each size that it reaches, with the mean of all its pieces of that
    size: a few junk pieces inside a text of its language lower nothing. Shorter texts have no floor.
    """

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        encoder = worker_encoder(profiles.dim, profiles.n, profiles.seed)
        likeness = Likeness(max(1, LIKENESS // len(profiles.langs)))
        for b in batches:
            found = piece_scores(encoder, profiles, likeness, [encoder.codes(t) for t in b["text"]])
            yield {"lang": [b["lang"][k] for k, _ in found], "size": [size for _, size in found], "score": list(found.values())}

    rows = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    scored = map_rows(rows.filter("text is not null and lang is not null"), run, "lang string, size int, score double", 64)
    rows = scored.filter("score > 0").groupBy("lang", "size").agg((F.percentile_approx("score", 0.01, 1000) / 2).alias("floor")).collect()
    return {(r.lang, r["size"]): r.floor for r in rows}


def held_out(name: str = "doc_id"):
    """Rows that teach nothing: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(name).cast("string")) % 3 == 1, F.lit(True))


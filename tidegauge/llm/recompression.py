"""Repetitions in word sequences by recompression.

``recompress`` turns a sequence into a run-length grammar by rounds that alternate

* block compression: a maximal block of one symbol becomes one symbol, named by (symbol, length);
* pair compression: symbols are dealt to a left and a right side by a hash, and each left symbol
  followed by a right one becomes one symbol, named by the two.

Equal stretches are cut alike but for a symbol at either end of a level. ``extension`` uses that to
answer many longest-common-extension queries at once: both positions climb while they can be
brought to symbol starts by one comparison, and after the first difference they descend one level
at a time. No suffix array is built.

``runs`` looks for stretches with period q and at least four periods. One holds a multiple of 3 q
whose word is repeated q words on, so the candidates lie on the harmonic grid (n / 3q places for
every q); each is extended exactly in both directions by the grammar.

Many documents are handled in one sequence, with a separator before, between and after them.

Scale: no shuffle. A task takes documents in groups of about ``GROUP_WORDS`` words; a longer one
stands alone. Memory is proportional to the group's words, as candidates are extended in blocks;
the candidates number n log n / 3 at most and are filtered by one comparison.

Defined results: null and empty texts have no words, no runs and an empty rest; repeated rows are
treated alike; a null doc_id is left unplanted; runs that tie in exponent are decided by start, then
period; an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import map_rows, text_of

PERIODS, SHORTEST = 4, 6  # a run has four periods and six words at least
GROUP_WORDS = 100_000
BLOCK = 200_000  # candidates that are extended together
TOP = 8  # symbols of a document at which the grammar stops
SEPARATOR = 0


@dataclass
class Side:
    """One reading direction of a grammar: for each level its symbols, and how they are joined."""

    symbols: list[np.ndarray] = field(default_factory=list)
    first: list[np.ndarray] = field(default_factory=list)  # first child of each symbol of the next level
    parent: list[np.ndarray] = field(default_factory=list)

    def join(self, symbols: np.ndarray, counts: np.ndarray) -> None:
        first = np.zeros(len(counts), np.int32)
        np.cumsum(counts[:-1], out=first[1:])
        self.symbols.append(symbols)
        self.first.append(first)
        self.parent.append(np.repeat(np.arange(len(counts), dtype=np.int32), counts))


@dataclass
class Grammar:
    """Run-length grammar; ``blocks[l]`` tells whether level l + 1 joins blocks or pairs."""

    forward: Side
    backward: Side
    blocks: list[bool]
    counts: list[np.ndarray]

    @property
    def length(self) -> int:
        return len(self.forward.symbols[0])

    def add(self, symbols: np.ndarray, counts: np.ndarray, block: bool) -> None:
        self.forward.join(symbols, counts)
        self.backward.join(symbols[::-1], counts[::-1])
        self.blocks.append(block)
        self.counts.append(counts)


def _named(keys: np.ndarray, fresh: int) -> tuple[np.ndarray, int]:
    """Equal keys get equal new symbols, from ``fresh`` on."""
    distinct, names = np.unique(keys, return_inverse=True)
    return (names + fresh).astype(np.int32), fresh + len(distinct)


def recompress(words: np.ndarray) -> Grammar:
    """Grammar of positive word numbers with a separator at both ends and between documents."""
    grammar = Grammar(Side(), Side(), [], [])
    now, fresh, turn = words.astype(np.int32), int(words.max()) + 1, 0
    while np.diff(np.flatnonzero(now == SEPARATOR)).max(initial=0) > TOP + 1:
        starts = np.flatnonzero(np.concatenate(([True], now[1:] != now[:-1])))
        if len(starts) < len(now):
            counts = np.diff(starts, append=len(now))
            longer = counts > 1
            above = now[starts]
            above[longer], fresh = _named(above[longer].astype(np.int64) * (len(now) + 1) + counts[longer], fresh)
            grammar.add(now, counts.astype(np.int32), True)
            now = above
            continue
        # a multiplier per turn deals the symbols anew; of both orders the one with more pairs is taken
        turn += 1
        side = (now.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15 * (2 * turn + 1) % 2**64)) >> np.uint64(63)
        side = np.where(now == SEPARATOR, 2, side.astype(np.int8))
        orders = [np.flatnonzero((side[:-1] == left) & (side[1:] == 1 - left)) for left in (0, 1)]
        pairs = max(orders, key=len)
        if not len(pairs):
            continue
        counts = np.ones(len(now), np.int32)
        counts[pairs] = 2
        counts = np.delete(counts, pairs + 1)
        above = np.delete(now, pairs + 1)
        at = pairs - np.arange(len(pairs))
        above[at], fresh = _named(now[pairs].astype(np.int64) * fresh + now[pairs + 1], fresh)
        grammar.add(now, counts, False)
        now = above
    for side, symbols in ((grammar.forward, now), (grammar.backward, now[::-1])):
        side.symbols.append(symbols)
    return grammar


def extension(grammar: Grammar, side: Side, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each pair of positions in one document, i < j or i > j throughout, in the order of ``side``: words that agree from there on."""
    a, b = i.astype(np.int64), j.astype(np.int64)
    top = len(grammar.blocks)
    stop = np.full(len(a), top)
    live = np.arange(len(a))
    for level, block in enumerate(grammar.blocks):
        symbols, first, parent = side.symbols[level], side.first[level], side.parent[level]
        x, y = a[live], b[live]
        up_x, up_y = parent[x], parent[y]
        inside = (first[up_x] != x) | (first[up_y] != y)
        at = np.flatnonzero(inside)
        if len(at):
            x, y = x[at], y[at]
            same = symbols[x] == symbols[y]
            if block:
                ends = np.append(first, len(symbols))
                rest_x, rest_y = ends[up_x[at] + 1] - x, ends[up_y[at] + 1] - y
                moved = np.where(same, np.minimum(rest_x, rest_y), 0)
                same &= rest_x == rest_y
            else:
                moved = same.astype(np.int64)
            a[live[at]] += moved
            b[live[at]] += moved
            stop[live[at[~same]]] = level
            keep = np.ones(len(live), bool)
            keep[at[~same]] = False
            live = live[keep]
        if not len(live):
            break
        a[live], b[live] = parent[a[live]], parent[b[live]]
    symbols = side.symbols[top]
    while len(live):
        live = live[symbols[a[live]] == symbols[b[live]]]
        a[live] += 1
        b[live] += 1
    for level in range(int(stop.max(initial=0)) - 1, -1, -1):
        symbols, first = side.symbols[level], side.first[level]
        live = np.flatnonzero(stop > level)
        up_x, up_y = a[live], b[live]
        x, y = first[up_x].astype(np.int64), first[up_y].astype(np.int64)
        moved = (symbols[x] == symbols[y]).astype(np.int64)
        if grammar.blocks[level]:
            ends = np.append(first, len(symbols))
            moved *= np.minimum(ends[up_x + 1] - x, ends[up_y + 1] - y)
        a[live], b[live] = x + moved, y + moved
    return a - i


def candidates(words: np.ndarray, document: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (position, period) on the harmonic grid whose word comes again one period on."""
    n, found, size = len(words), [], 0
    for q in range(1, longest // PERIODS + 1):
        at = np.flatnonzero(words[: n - q : PERIODS * q - q] == words[q :: PERIODS * q - q]) * (PERIODS * q - q)
        at = at[(document[at] == document[at + q]) & (words[at] != SEPARATOR)]
        for part in range(0, len(at), BLOCK):
            found.append((at[part : part + BLOCK], np.full(len(at[part : part + BLOCK]), q)))
            size += len(found[-1][0])
            if size >= BLOCK:
                yield tuple(map(np.concatenate, zip(*found)))
                found, size = [], 0
    if size:
        yield tuple(map(np.concatenate, zip(*found)))


def _smallest_period(start: np.ndarray, length: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, ...]:
    """One entry for each stretch: by Fine and Wilf, longer periods that it has are multiples of the smallest."""
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    return start[new], length[new], period[new]


def runs(sequences: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(starts, lengths, periods) of the runs of each sequence of positive numbers, by start, then period."""
    none = np.zeros(0, np.int64)
    out = [(none, none, none)] * len(sequences)
    held = [k for k, s in enumerate(sequences) if len(s) >= SHORTEST]
    if not held:
        return out
    sizes = np.array([len(sequences[k]) for k in held])
    begin = np.concatenate(([1], 1 + np.cumsum(sizes + 1)[:-1]))
    words = np.zeros(int(sizes.sum()) + len(held) + 1, np.int32)
    document = np.full(len(words), -1, np.int32)
    for n, (k, at) in enumerate(zip(held, begin.tolist())):
        words[at : at + len(sequences[k])] = sequences[k]
        document[at : at + len(sequences[k])] = n
    grammar, last = None, len(words) - 1
    stretches = (none, none, none)
    for at, period in candidates(words, document, int(sizes.max())):
        grammar = grammar or recompress(words)
        after = extension(grammar, grammar.forward, at, at + period)
        ahead = extension(grammar, grammar.backward, last - (at - 1), last - (at + period - 1))
        length = ahead + period + after
        long = length >= np.maximum(SHORTEST, PERIODS * period)
        new = (at - ahead)[long], length[long], period[long]
        stretches = _smallest_period(*(np.concatenate(pair) for pair in zip(stretches, new)))
    start, length, period = stretches
    order = np.lexsort((period, start))
    start, length, period = start[order], length[order], period[order]
    of = document[start]
    edges = np.searchsorted(of, np.arange(len(held) + 1))
    for n, k in enumerate(held):
        part = slice(edges[n], edges[n + 1])
        out[k] = (start[part] - begin[n], length[part], period[part])
    return out


def repeated_words(n: int, starts: np.ndarray, lengths: np.ndarray, periods: np.ndarray) -> np.ndarray:
    """Which of n words a run contains after its first period."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts + periods, 1)
    np.add.at(steps, starts + lengths, -1)
    return np.cumsum(steps[:-1]) > 0


class _Numbers(dict):
    """Numbers words from 1 on."""

    def __missing__(self, word):
        self[word] = found = len(self) + 1
        return found


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with the repetition that a tenth of the documents get, fixed by their doc_id."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def _groups(words: list[list[bytes]]) -> Iterator[list[int]]:
    """Neighbouring rows with about GROUP_WORDS words together."""
    held, size = [], 0
    for k, w in enumerate(words):
        if held and size + len(w) > GROUP_WORDS:
            yield held
            held, size = [], 0
        held.append(k)
        size += len(w)
    if held:
        yield held


def find_runs(words: list[list[bytes]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of each list of words."""
    out = []
    for group in _groups(words):
        number = _Numbers()
        out += runs([np.fromiter(map(number.__getitem__, words[k]), np.int32, len(words[k])) for k in group])
    return out


def best_run(starts: np.ndarray, lengths: np.ndarray, periods: np.ndarray) -> tuple[int, int, int]:
    """The run with the greatest exact exponent; ties by start, then period, which is their order."""
    best = (0, 0, 1)
    for s, n, q in zip(starts.tolist(), lengths.tolist(), periods.tolist()):
        if n * best[2] > best[1] * q:
            best = (s, n, q)
    return best


SCHEMA = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string"
)


def _words(text: str) -> list[bytes]:
    return text.encode().split()  # bytes are split at the six ASCII blanks alone


def run_report(docs: DataFrame, plant: bool = False) -> DataFrame:
    """Number of runs, the strongest one, and digests of all runs and of the text without repeats."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            words = [_words(t) for t in b["text"]]
            if plant:
                words = [planted(w, d) for w, d in zip(words, b["doc_id"])]
            out: dict[str, list] = {name: [] for name in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")}
            for w, found in zip(words, find_runs(words)):
                lines, best = "", (None, None, None, None)
                if len(found[0]):
                    lines = "".join(f"{s},{n},{q}\n" for s, n, q in zip(*(x.tolist() for x in found)))
                    s, n, q = best_run(*found)
                    best = (s, n, q, 1000 * n // q)
                    w = [x for x, drop in zip(w, repeated_words(len(w), *found).tolist()) if not drop]
                row = (len(found[0]), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(w)).hexdigest())
                for column, value in zip(out.values(), row):
                    column.append(value)
            yield {"doc_id": b["doc_id"], **out}

    return map_rows(_rows(docs), run, SCHEMA, 256)


def collapse(docs: DataFrame) -> DataFrame:
    """doc_id, text with the repeats of every run left out (words joined by one blank), and n_dropped."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            words = [_words(t) for t in b["text"]]
            texts, dropped = [], []
            for w, found in zip(words, find_runs(words)):
                drop = repeated_words(len(w), *found).tolist()
                texts.append(b" ".join([x for x, d in zip(w, drop) if not d]).decode())
                dropped.append(sum(drop))
            yield {"doc_id": b["doc_id"], "text": texts, "n_dropped": dropped}

    return map_rows(_rows(docs), run, "doc_id long, text string, n_dropped long", 256)


def run_spans(docs: DataFrame) -> DataFrame:
    """One row for every run: doc_id, start, length, period in words."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            for d, found in zip(b["doc_id"], find_runs([_words(t) for t in b["text"]])):
                s, n, q = (x.tolist() for x in found)
                yield {"doc_id": [d] * len(s), "start": s, "length": n, "period": q}

    return map_rows(_rows(docs), run, "doc_id long, start long, length long, period long", 256)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))

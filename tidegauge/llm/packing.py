"""Sequence packing by shortest-pack-first over the length histogram.

Documents are tokenized, closed by an end id and cut into pieces of at most ``size`` ids. The
histogram of piece lengths (at most ``size`` rows, whatever the data) is packed at once: lengths
are placed longest first, each into the packs with the fewest ids so far that still have room, by
updating how often each packing pattern occurs. Patterns are then joined back to the pieces by
the rank of a piece among those of its length.

Scale: a piece's rank is its rank inside its input part plus the pieces of its length in earlier
parts, so ranking needs the counts per (part, length) only. A length splits a
pattern at most twice and opens at most two, so there are at most 4 * ``size`` patterns with few
entries each; the pattern table depends on ``size``, not on the data, and is broadcast. Ids are not shuffled unless ``sequences`` builds the sequences.

Defined results: null text is an empty document, the end id alone; repeated rows are packed each
for itself; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import map_rows, text_of
from tidegauge.llm.token_counts import BYTE_BPE, worker_encoder
from tidegauge.session import cut_lineage, local_rows

SIZE = 2048
END = 1


def pieces(docs: DataFrame, tokenizer: str = BYTE_BPE, size: int = SIZE, end: int = END) -> DataFrame:
    """doc_id, start, length, ids (little-endian 32 bit), doc_tokens, part, nth of every piece.

    ``nth`` counts the pieces of one length inside the input part.
    """

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        encoder = worker_encoder(tokenizer)
        seen = [0] * (size + 1)
        for b in batches:
            out = {c: [] for c in ("doc_id", "start", "length", "ids", "doc_tokens", "part", "nth")}
            for doc, part, text in zip(b["doc_id"], b["part"], b["text"]):
                found = [*encoder(text), end]
                total = len(found)
                ids = struct.pack(f"<{total}I", *found)
                for start in range(0, total, size):
                    n = min(size, total - start)
                    for c, v in zip(out, (doc, start, n, ids[4 * start : 4 * (start + n)], total, part, seen[n])):
                        out[c].append(v)
                    seen[n] += 1
            yield out

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.spark_partition_id().alias("part"), text_of().alias("text"))
    return map_rows(rows, run, "doc_id long, start long, length int, ids binary, doc_tokens long, part int, nth long", 128)


def patterns(histogram: dict[int, int], size: int = SIZE) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Packing patterns as ((length, times), ...) with how often each occurs.

    A heap has the open patterns by the ids that they hold. Each length goes to the emptiest
    patterns first, once or, where pieces outnumber packs, several times; a pattern that occurs
    more often than needed is split into a longer and an old part. If the emptiest pattern has no
    room none has, and new packs of this length alone are opened, as full as they get.
    """
    open_packs: list[tuple[int, int, tuple, int]] = []
    done, made = [], 0

    def put(used: int, pattern: tuple, count: int) -> None:
        nonlocal made
        made += 1
        if used < size:
            heapq.heappush(open_packs, (used, made, pattern, count))
        else:
            done.append((used, made, pattern, count))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left and open_packs and open_packs[0][0] + length <= size:
            used, _, pattern, count = heapq.heappop(open_packs)
            times = min((size - used) // length, max(1, left // count))
            packs = min(count, left // times)
            left -= packs * times
            put(used + times * length, (*pattern, (length, times)), packs)
            if count > packs:
                put(used, pattern, count - packs)
        if left:
            times = min(size // length, left)
            put(times * length, ((length, times),), left // times)
            if left % times:
                put(left % times * length, ((length, left % times),), 1)
    return [(pattern, count) for _, _, pattern, count in done + sorted(open_packs)]


def slots(found: list[tuple[tuple[tuple[int, int], ...], int]]) -> list[tuple[int, ...]]:
    """(length, first rank, end rank, times, first offset, first sequence) of each pattern entry."""
    ranks: dict[int, int] = {}
    out, sequence = [], 0
    for pattern, count in found:
        offset = 0
        for length, times in pattern:
            first = ranks.get(length, 0)
            ranks[length] = first + times * count
            out.append((length, first, ranks[length], times, offset, sequence))
            offset += length * times
        sequence += count
    return out


def pack(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """Stored pieces (length, part, nth, ...) with ``sequence_id`` and ``offset``."""
    counts = cut_lineage(cut.groupBy("part", "length").agg(F.count("*").alias("_n")))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    w = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", "length", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    schema = "_length int, _first long, _end long, _times int, _offset long, _sequence long"
    table = F.broadcast(local_rows(cut.sparkSession, slots(patterns(histogram, size)), schema))
    rank = F.col("nth") + F.col("_before")
    at = rank - F.col("_first")
    joined = cut.join(starts, ["part", "length"]).join(
        table, (F.col("length") == F.col("_length")) & (rank >= F.col("_first")) & (rank < F.col("_end"))
    )
    sequence: Column = F.col("_sequence") + F.floor(at / F.col("_times")).cast("long")
    return joined.select(
        *cut.columns,
        sequence.alias("sequence_id"),
        (F.col("_offset") + (at % F.col("_times")) * F.col("length")).cast("long").alias("offset"),
    )


def packed(docs: DataFrame, tokenizer: str = BYTE_BPE, size: int = SIZE, end: int = END) -> DataFrame:
    """Where each piece goes; the ids are kept as their CRC-32."""
    cut = cut_lineage(pieces(docs, tokenizer, size, end).withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return pack(cut, size).select(
        "doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


def sequences(docs: DataFrame, tokenizer: str = BYTE_BPE, size: int = SIZE, end: int = END, pad: int = 0) -> DataFrame:
    """The sequences themselves: sequence_id, n_tokens, ids (array, padded to ``size``), doc_ids."""
    placed = pack(cut_lineage(pieces(docs, tokenizer, size, end)), size)

    def build(table):
        import pyarrow as pa

        rows = sorted(zip(*[table[c].to_pylist() for c in ("offset", "ids", "doc_id")]), key=lambda r: r[0])
        ids = np.frombuffer(b"".join(r[1] for r in rows), "<u4").astype(np.int32)
        filled = np.concatenate([ids, np.full(size - len(ids), pad, np.int32)])
        return pa.table(
            {
                "sequence_id": pa.array([table["sequence_id"][0].as_py()], pa.int64()),
                "n_tokens": pa.array([len(ids)], pa.int32()),
                "ids": pa.array([filled.tolist()], pa.list_(pa.int32())),
                "doc_ids": pa.array([[r[2] for r in rows]], pa.list_(pa.int64())),
            }
        )

    return placed.groupBy("sequence_id").applyInArrow(build, "sequence_id long, n_tokens int, ids array<int>, doc_ids array<long>")

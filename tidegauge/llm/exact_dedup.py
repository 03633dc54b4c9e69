"""Exact deduplication with a sharded cuckoo-filter index.

A document's key is the SHA-256 of its text without white space. The index is split into shards
by key; a shard is one cuckoo filter (16-bit fingerprints, 4 slots a bucket) and the content
store, whose keys lie in the filter's buckets. Each incoming key probes the filter. A miss is new
and is inserted in filter and store. A hit is verified against the bucket's stored keys: an equal
key joins that group, a false positive is inserted as a new key. When a key finds no place
within ``MAX_KICKS`` moves the filter doubles and is filled again from the stored keys. Deletion
takes one fingerprint of a key that the store holds, so other keys are never lost.

Scale: rows are combined by key inside each task before they are shuffled, so a key that holds a
third of all rows sends one row per task. The number of shards follows the number of rows; one
shard holds about ``SHARD_KEYS`` keys. Index versions are tables in the shared folder.

Defined results: null text counts as empty; all empty texts are one group. Of a group the longest
original text stays, then the smallest doc_id (null last), then the first row. Rows that repeat
both doc_id and text are copies like any other: one stays. An empty table gives no rows. Further
columns, whatever their names, are not read (``deduplicate`` passes them on).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.common import keep_rows, map_rows, partitions, row_key, text_of
from tidegauge.session import cut_lineage, new_folder

SLOTS = 4
MAX_KICKS = 500
SHARD_KEYS = 50_000
SPACE = " \t\n\x0b\f\r"

ENTRIES = "shard int, bucket int, key binary, keep_id long, keep_chars long, keep_row long, group_size long, slots binary"
ENTRY = pa.schema([(c.split()[0], {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]]) for c in ENTRIES.split(", ")])


class CuckooShard:
    """One cuckoo filter with its bucketed content store.

    ``slots`` holds ``SLOTS`` fingerprints for each bucket, 0 for a free slot. ``content`` has
    for each home bucket the live keys and their entries.
    """

    def __init__(self, buckets: int = 16):
        self.clear(max(2, 1 << (buckets - 1).bit_length()))
        self.content: list[dict[bytes, list]] = [{} for _ in range(self.buckets)]
        self.size = 0

    def clear(self, buckets: int) -> None:
        self.buckets = buckets
        self.slots = [0] * (buckets * SLOTS)

    def places(self, key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[8:10], "little") or 1
        home = int.from_bytes(key[:8], "little") & (self.buckets - 1)
        return mark, home, self.other(home, mark)

    def other(self, bucket: int, mark: int) -> int:
        return bucket ^ ((mark * 0x5BD1E995 >> 7) & (self.buckets - 1))

    def may_hold(self, key: bytes) -> bool:
        mark, a, b = self.places(key)
        s = self.slots
        return mark in s[a * SLOTS : a * SLOTS + SLOTS] or mark in s[b * SLOTS : b * SLOTS + SLOTS]

    def find(self, key: bytes) -> list | None:
        """The live entry of a key: a filter hit, verified against the bucket's stored keys."""
        if not self.may_hold(key):
            return None
        return self.content[int.from_bytes(key[:8], "little") & (self.buckets - 1)].get(key)

    def _place(self, key: bytes) -> bool:
        mark, a, b = self.places(key)
        bucket = a
        for turn in range(MAX_KICKS):
            for at in (a, b) if turn == 0 else (bucket,):
                for i in range(at * SLOTS, at * SLOTS + SLOTS):
                    if not self.slots[i]:
                        self.slots[i] = mark
                        return True
            i = bucket * SLOTS + (mark + turn) % SLOTS
            mark, self.slots[i] = self.slots[i], mark
            bucket = self.other(bucket, mark)
        return False

    def grow(self) -> None:
        """Double the filter until every stored key has a place."""
        live = [(k, e) for bucket in self.content for k, e in bucket.items()]
        buckets = self.buckets
        while True:
            buckets *= 2
            self.clear(buckets)
            if all(self._place(k) for k, _ in live):
                break
        self.content = [{} for _ in range(buckets)]
        for k, e in live:
            self.content[int.from_bytes(k[:8], "little") & (buckets - 1)][k] = e

    def insert(self, key: bytes, entry: list) -> None:
        """Add a key that ``find`` did not give."""
        self.content[int.from_bytes(key[:8], "little") & (self.buckets - 1)][key] = entry
        self.size += 1
        if not self._place(key):
            self.grow()

    def delete(self, key: bytes) -> bool:
        """Remove a live key; False if the store does not hold it."""
        if self.find(key) is None:
            return False
        mark, a, b = self.places(key)
        for at in (a, b):
            for i in range(at * SLOTS, at * SLOTS + SLOTS):
                if self.slots[i] == mark:
                    self.slots[i] = 0
                    del self.content[int.from_bytes(key[:8], "little") & (self.buckets - 1)][key]
                    self.size -= 1
                    return True
        return False

    @classmethod
    def load(cls, rows: pa.Table) -> CuckooShard:
        shard, cols = cls(), rows.to_pydict()
        for raw in cols["slots"]:
            if raw is not None:
                shard.slots = [int.from_bytes(raw[i : i + 2], "little") for i in range(0, len(raw), 2)]
                shard.buckets = len(shard.slots) // SLOTS
        shard.content = [{} for _ in range(shard.buckets)]
        names = ("bucket", "key", "keep_chars", "keep_id", "keep_row", "group_size")
        for at, key, *entry in zip(*[cols[n] for n in names]):
            if key is not None:
                shard.content[at][key] = entry
                shard.size += 1
        return shard

    def dump(self, number: int) -> pa.Table:
        rows = [
            (number, at, key, keep_id, chars, row, size, None)
            for at, bucket in enumerate(self.content)
            for key, (chars, keep_id, row, size) in bucket.items()
        ]
        raw = b"".join(m.to_bytes(2, "little") for m in self.slots)
        rows.append((number, None, None, None, None, None, None, raw))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), ENTRY)], schema=ENTRY)


def better(a: list, b: list) -> bool:
    """Is entry a (chars, id, row, ...) kept rather than b?"""
    order = [(-e[0], e[1] is None, e[1] if e[1] is not None else 0, e[2]) for e in (a, b)]
    return order[0] < order[1]


def merge(into: list, other: list) -> None:
    size = into[3] + other[3]
    if better(other, into):
        into[:3] = other[:3]
    into[3] = size


def normalised(name: str = "text") -> Column:
    return F.translate(text_of(name), SPACE, "")


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, key, row_no) of every row, stored: the text is read once."""
    return cut_lineage(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.char_length(text_of()).cast("long").alias("n_chars"),
            F.unhex(F.sha2(normalised(), 256)).alias("key"),
            F.monotonically_increasing_id().alias("row_no"),
        )
    )


class CuckooIndex:
    """A versioned index in the shared folder: ``insert``, ``delete``, ``entries``, ``lookup``."""

    def __init__(self, spark: SparkSession, shards: int, folder: str | None = None):
        self.spark, self.shards = spark, shards
        self.folder = folder or new_folder(spark, "cuckoo")
        self.version = 0

    @classmethod
    def sized(cls, rows: DataFrame) -> CuckooIndex:
        """An empty index for as many keys as ``rows`` can hold."""
        spark = rows.sparkSession
        return cls(spark, max(partitions(spark), -(-rows.count() // SHARD_KEYS)))

    def _stored(self) -> DataFrame:
        if not self.version:
            return self.spark.createDataFrame([], ENTRIES)
        return self.spark.read.schema(ENTRIES).parquet(f"{self.folder}/v{self.version:06d}")

    def _next(self, df: DataFrame) -> None:
        df.write.parquet(f"{self.folder}/v{self.version + 1:06d}")
        self.version += 1

    def _combined(self, rows: DataFrame) -> DataFrame:
        """Rows combined by key inside each task, with their shard."""
        shards = self.shards

        def flush(seen: dict) -> dict:
            out = {c: [] for c in ("shard", "key", "chars", "id", "row", "n")}
            for key, (chars, doc, row, n) in seen.items():
                for c, v in zip(out, (int.from_bytes(key[16:20], "little") % shards, key, chars, doc, row, n)):
                    out[c].append(v)
            seen.clear()
            return out

        def combine(batches: Iterator[dict]) -> Iterator[dict]:
            seen: dict[bytes, list] = {}
            for b in batches:
                for key, chars, doc, row in zip(b["key"], b["n_chars"], b["doc_id"], b["row_no"]):
                    entry = [chars, doc, row, 1]
                    if key in seen:
                        merge(seen[key], entry)
                    else:
                        seen[key] = entry
                if len(seen) > 100_000:
                    yield flush(seen)
            yield flush(seen)

        return map_rows(rows, combine, "shard int, key binary, chars long, id long, row long, n long")

    def insert(self, rows: DataFrame) -> None:
        """Insert rows of ``keyed``; equal keys join the live entry."""

        def add(stored: pa.Table, new: pa.Table) -> pa.Table:
            shard = CuckooShard.load(stored) if len(stored) else CuckooShard(len(new) // 3 + 1)
            cols = (new if len(new) else stored).to_pydict()
            for key, *entry in zip(*[cols[n] for n in ("key", "chars", "id", "row", "n")]) if len(new) else ():
                live = shard.find(key)
                if live is None:
                    shard.insert(key, entry)
                else:
                    merge(live, entry)
            return shard.dump(cols["shard"][0])

        old, new = self._stored(), self._combined(rows)
        self._next(old.groupBy("shard").cogroup(new.groupBy("shard")).applyInArrow(add, ENTRIES))

    def delete(self, keys: DataFrame) -> None:
        """Take live digests (a column ``key``) out of the index; unknown ones change nothing."""
        shards = self.shards

        def drop(stored: pa.Table, gone: pa.Table) -> pa.Table:
            if not len(stored):
                return ENTRY.empty_table()
            shard = CuckooShard.load(stored)
            for key in gone["key"].to_pylist():
                shard.delete(key)
            return shard.dump(stored["shard"][0].as_py())

        def number(batches):
            for b in batches:
                found = [k for k in b["key"] if k is not None]
                yield {"shard": [int.from_bytes(k[16:20], "little") % shards for k in found], "key": found}

        gone = map_rows(keys.select("key").distinct(), number, "shard int, key binary")
        self._next(self._stored().groupBy("shard").cogroup(gone.groupBy("shard")).applyInArrow(drop, ENTRIES))

    def entries(self) -> DataFrame:
        """Live keys with the row that stays and the size of the group."""
        return self._stored().filter("slots is null").select("key", "keep_id", "keep_chars", "keep_row", "group_size")

    def lookup(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the entry of their key, null for keys that are not live.

        An equi-join on the key that Spark can split where a key is hot.
        """
        return rows.join(self.entries(), "key", "left")


def duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, row_no."""
    rows = keyed(docs)
    index = CuckooIndex.sized(rows)
    index.insert(rows)
    return index.lookup(rows).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("row_no") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("key")).alias("text_sha256"),
        "row_no",
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns."""
    stay = duplicates(docs).filter("kept").select(row_key(F.col("doc_id"), F.col("text_sha256")).alias("_tg_key"))
    key = row_key(F.col("doc_id").cast("long"), F.sha2(normalised(), 256))
    return keep_rows(docs, key, stay, [F.char_length(text_of()).desc(), text_of()])

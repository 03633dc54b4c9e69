"""Token counts through a digest cache.

A cached count is named by two digests: of the normalised content and of the tokenizer version.
Normalising here means null as empty text and UTF-8; nothing else may change, as the counts are
those of the exact text. A call joins the distinct digests of its documents to the cache, encodes
only the distinct misses, appends them, and reads every count from the cache.

Counts are those of the tokenizers library (``TextEncoder``).

Scale: with an empty cache texts are grouped by digest, copies combined before the shuffle.
Otherwise documents are shuffled as digests only, and texts of misses are fetched by the doc_id of
one holder; a warm cache leaves few misses, which Spark can broadcast by their measured size. A
text that holds a third of all rows is neither sent to one task row by row nor encoded twice.

Defined results: null and empty text have 0 tokens; repeated rows are counted alike; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.common import byte_symbols, map_rows, text_of
from tidegauge.session import cut_lineage, new_folder

BYTE_BPE = "byte_bpe_50k.json"
RUN = 400  # characters without (or of) white space that make a long run
SPACE_RUN = re.compile(r"\s{%d}" % RUN)
#: Fixed value: how byte-level files split text.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def tokenizer_path(name: str) -> str:
    """A path as it is; a bare file name lies in the installed vocabulary package."""
    if os.path.dirname(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def has_long_run(text: str) -> bool:
    words = text.split()
    if max(map(len, words), default=0) >= RUN:
        return True
    spaces = len(text) - sum(map(len, words))
    return spaces >= len(words) + RUN - 2 and SPACE_RUN.search(text) is not None


class TextEncoder:
    """Ids that the tokenizers library gives for whole texts.

    For a byte-level file whose merges are numbered in order, tiktoken gets the same vocabulary as
    ranks and encodes about five times as fast, with equal ids. Texts with a very long run, on
    which its merging is slow, and other files go through the library itself.
    """

    def __init__(self, name: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(tokenizer_path(name))
        self.library.no_truncation()
        self.library.no_padding()
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.fast = self._fast(json.loads(self.library.to_str()))

    def _fast(self, spec: dict):
        split, model = spec["pre_tokenizer"] or {}, spec["model"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
        vocab = model["vocab"]
        plain = (
            spec["normalizer"] is None
            and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
            and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
            and len(vocab) == 256 + len(merges)
            and all(vocab[a + b] == 256 + i for i, (a, b) in enumerate(merges))
        )
        if not plain:
            return None
        import tiktoken

        byte = {c: b for b, c in enumerate(byte_symbols())}
        ranks = {bytes([byte[c] for c in token]): i for token, i in vocab.items()}
        return tiktoken.Encoding("own", pat_str=PRETOKEN, mergeable_ranks=ranks, special_tokens=self.special)

    def __call__(self, text: str) -> list[int]:
        if self.fast is None or has_long_run(text):
            return self.library.encode(text, add_special_tokens=False).ids
        if any(s in text for s in self.special):
            return self.fast.encode(text, allowed_special="all")
        return self.fast.encode_ordinary(text)


@functools.cache
def worker_encoder(name: str) -> TextEncoder:
    """One encoder for all tasks of a worker."""
    return TextEncoder(name)


def tokenizer_digest(name: str) -> str:
    with open(tokenizer_path(name), "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


CACHE = "content binary, tokenizer string, n_tokens long"


class CountCache:
    """Stored token counts below a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = folder or new_folder(spark, "token-counts")
        spark.createDataFrame([], CACHE).write.mode("append").parquet(self.folder)

    def read(self, version: str) -> DataFrame:
        stored = self.spark.read.schema(CACHE).parquet(self.folder)
        return stored.filter(F.col("tokenizer") == version).select("content", "n_tokens")

    def append(self, counts: DataFrame) -> None:
        counts.write.mode("append").parquet(self.folder)


def count_tokens(docs: DataFrame, tokenizer: str = BYTE_BPE, cache: CountCache | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every document."""
    cache = cache or CountCache(docs.sparkSession)
    version = tokenizer_digest(tokenizer)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    rows = cut_lineage(
        texts.select(
            "doc_id",
            F.octet_length("text").cast("long").alias("n_bytes"),
            F.unhex(F.sha2(F.col("text"), 256)).alias("content"),
        )
    )

    def encode(batches: Iterator[dict]) -> Iterator[dict]:
        encoder = worker_encoder(tokenizer)
        for b in batches:
            done = {t: None for t in b["text"]}
            yield {
                "content": [hashlib.sha256(t.encode()).digest() for t in done],
                "tokenizer": [version] * len(done),
                "n_tokens": [len(encoder(t)) for t in done],
            }

    distinct = rows.groupBy("content").agg(F.min("doc_id").alias("_holder"))
    misses = cut_lineage(distinct.join(cache.read(version), "content", "left_anti"))
    # Neither side has a bound, so neither is broadcast: texts are dealt by id once, at every size, and not sorted.
    holders = misses.select("_holder").distinct().hint("shuffle_hash")
    wanted = texts.join(holders, F.col("doc_id").eqNullSafe(F.col("_holder")), "left_semi").select("text")
    fresh = map_rows(wanted, encode, CACHE, 256).join(misses.select("content"), "content", "left_semi")
    cache.append(fresh.dropDuplicates(["content"]))
    return rows.join(cache.read(version), "content").select("doc_id", "n_bytes", "n_tokens")

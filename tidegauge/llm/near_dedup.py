"""MinHash near-deduplication with sequential Bayesian verification.

Texts (A-Z lower-cased, words between white space) become sets of word shingles. Equal word
sequences form one class at once. Each class gets a MinHash signature whose bands give the
candidates. A candidate pair is verified step by step: after each batch of signature values the
posterior of its similarity (uniform prior, binomial matches) bounds the chance that it reaches
the threshold; the pair is pruned as soon as that chance is below ``miss``. Survivors are verified
exactly, on the full shingle sets of the whole texts. ``bands`` are chosen so that a pair at
the threshold shares no band with a chance below ``miss``.

Scale: signatures are computed where the text lies; only keys and signatures are shuffled, and the
texts of classes that occur in surviving pairs. Groups are found by ``components.link``, which
compares a crowded bucket against one member before it looks at pairs across groups; those come
from the rare shingles of the texts that are left (``rare_shingle_pairs``).

Defined results: null text and text without words have an empty set, link with nothing and stay.
With fewer words than a shingle takes, the whole sequence is the one shingle. component_id is the
smallest doc_id of the group; a null doc_id is last in that order; of rows that share the smallest
one, the first stays. Repeated rows are copies. An empty table gives no rows. Other columns are
not read (``deduplicate`` passes them on).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import Memo, keep_rows, map_rows, row_key, text_of
from tidegauge.llm.components import link
from tidegauge.session import cut_lineage

HEAD = 64  # rarest shingles of a set that travel with each of them
WORDS = 50_000  # word hashes that a task keeps, twice
STEP = 32  # signature values per verification step


@dataclass(frozen=True)
class Similarity:
    """Shingle width in words, threshold as a fraction num / den, and the chance of a miss."""

    words: int = 5
    num: int = 80
    den: int = 100
    miss: float = 1e-6
    rows: int = field(default=0)
    bands: int = field(default=0)

    def __post_init__(self):
        t = self.num / self.den
        rows = self.rows or (6 if t >= 0.85 else 5)
        bands = self.bands or math.ceil(math.log(self.miss) / math.log(1 - t**rows))
        object.__setattr__(self, "rows", rows)
        object.__setattr__(self, "bands", bands)

    @property
    def size(self) -> int:
        return self.rows * self.bands

    def least_matches(self) -> list[tuple[int, int]]:
        """(values compared, fewest matches that go on) of each verification step.

        With m of n values equal, the posterior is Beta(m + 1, n - m + 1); it exceeds t with the
        chance that a Binomial(n + 1, t) is at most m.
        """
        t, out = self.num / self.den, []
        for n in [*range(STEP, self.size, STEP), self.size]:
            total, m = 0.0, -1
            while total < self.miss and m < n:
                m += 1
                total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            out.append((n, m))
        return out


def words_of(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def shingles(words: list[bytes], k: int) -> set:
    """The distinct shingles themselves."""
    if len(words) < k:
        return {tuple(words)} if words else set()
    return set(zip(*[words[i:] for i in range(k)]))


def class_of(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


class Sketcher:
    """Hashes of distinct shingles and their MinHash signature."""

    def __init__(self, like: Similarity):
        self.k = like.words
        draw = np.random.default_rng(20240607)
        self.mul = (draw.integers(0, 2**31, like.size, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
        self.add = draw.integers(0, 2**32, like.size, dtype=np.uint32)[:, None]
        self.word = Memo(lambda w: int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little"), WORDS)

    def hashes(self, words: list[bytes]) -> np.ndarray:
        h = np.fromiter(map(self.word.__getitem__, words), np.uint64, len(words))
        k = min(self.k, len(h))
        n = len(h) - k + 1
        out = np.zeros(n, np.uint64)
        for i in range(k):
            out = (out ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return np.unique(out)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        high, best = (hashes >> np.uint64(32)).astype(np.uint32), None
        for at in range(0, len(high), 512):
            part = (self.mul * high[None, at : at + 512] + self.add).min(axis=1)
            best = part if best is None else np.minimum(best, part)
        return best


def sketches(docs: DataFrame, like: Similarity) -> DataFrame:
    """(doc_id, row_no, digest, cls, n_shingles, sig) of every row, stored; sig is null for empty sets."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        sketcher = Sketcher(like)
        for b in batches:
            out = {**{c: b[c] for c in ("doc_id", "row_no", "digest")}, "cls": [], "n_shingles": [], "sig": []}
            done: dict[bytes, tuple] = {}
            for text in b["text"]:
                words = words_of(text)
                cls = class_of(words)
                if cls not in done:
                    if words:
                        hashes = sketcher.hashes(words)
                        done[cls] = (len(hashes), sketcher.signature(hashes).tobytes())
                    else:
                        done[cls] = (0, None)
                n, sig = done[cls]
                out["cls"].append(cls)
                out["n_shingles"].append(n)
                out["sig"].append(sig)
            yield out

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row_no"), F.md5(text_of()).alias("digest"), text_of().alias("text"))
    return cut_lineage(map_rows(rows, run, "doc_id long, row_no long, digest string, cls binary, n_shingles long, sig binary", 256))


def classes_of(rows: DataFrame) -> DataFrame:
    """Equal word sequences as one row: cls, its first doc_id, that row's number as node, sig; stored."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_no"))
    grouped = rows.groupBy("cls").agg(first.alias("_f"), F.first("sig").alias("sig"))
    return cut_lineage(grouped.select("cls", F.col("_f.doc_id").alias("doc_id"), F.col("_f.row_no").alias("node"), "sig"))


def band_members(classes: DataFrame, like: Similarity) -> DataFrame:
    """(bucket, node) for every band of every class."""
    rows, bands = like.rows, like.bands

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            if not b["sig"]:
                continue
            sig = np.frombuffer(b"".join(b["sig"]), np.uint32).reshape(len(b["sig"]), bands, rows)
            h = np.repeat(np.arange(1, bands + 1, dtype=np.uint64)[None, :], len(sig), 0) * np.uint64(0xD6E8FEB86659FD93)
            for r in range(rows):
                h = (h ^ sig[:, :, r]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(31)
            yield {"bucket": h.view(np.int64).ravel(), "node": np.repeat(np.array(b["node"], np.int64), bands)}

    return map_rows(classes.filter("sig is not null").select("node", "sig"), run, "bucket long, node long", 1024)


def verifier(docs: DataFrame, classes: DataFrame, like: Similarity):
    """Verify (a, b): posterior pruning on signatures, then exact sets of whole texts."""
    steps, k, num, den = like.least_matches(), like.words, like.num, like.den

    def prune(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            if not b["a"]:
                continue
            left = np.frombuffer(b"".join(b["sig_a"]), np.uint32).reshape(len(b["a"]), -1)
            right = np.frombuffer(b"".join(b["sig_b"]), np.uint32).reshape(len(b["a"]), -1)
            alive, matches, at = np.arange(len(left)), np.zeros(len(left), int), 0
            for n, least in steps:
                matches = matches + (left[alive, at:n] == right[alive, at:n]).sum(axis=1)
                go_on = matches >= least
                alive, matches, at = alive[go_on], matches[go_on], n
            yield {"a": [b["a"][i] for i in alive], "b": [b["b"][i] for i in alive]}

    def read(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            yield {"cls": [class_of(words_of(t)) for t in b["text"]], "text": b["text"]}

    def exact(batches: Iterator[dict]) -> Iterator[dict]:
        last: tuple[int | None, set] = (None, set())
        for b in batches:
            a_out, b_out = [], []
            for a, c, text_a, text_b in zip(b["a"], b["b"], b["text_a"], b["text_b"]):
                if last[0] != a:
                    last = (a, shingles(words_of(text_a), k))
                right = shingles(words_of(text_b), k)
                both = len(last[1] & right)
                if den * both >= num * (len(last[1]) + len(right) - both):
                    a_out.append(a)
                    b_out.append(c)
            yield {"a": a_out, "b": b_out}

    def verify(pairs: DataFrame) -> DataFrame:
        sig_a = classes.select(F.col("node").alias("a"), F.col("sig").alias("sig_a"))
        sig_b = classes.select(F.col("node").alias("b"), F.col("sig").alias("sig_b"))
        alive = cut_lineage(map_rows(pairs.select("a", "b").join(sig_a, "a").join(sig_b, "b"), prune, "a long, b long", 1024))
        if alive.isEmpty():
            return alive
        nodes = alive.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        involved = cut_lineage(classes.join(nodes, "node", "left_semi").select("cls", "node", "doc_id"))
        found = map_rows(texts_of(docs, involved), read, "cls binary, text string", 256)
        own = cut_lineage(found.join(involved.select("cls", "node"), "cls").dropDuplicates(["node"]))
        text_a = own.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
        text_b = own.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
        full = alive.join(text_b, "b").join(text_a, "a")
        return map_rows(full, exact, "a long, b long", 64).distinct()

    return verify


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Texts of the documents that hold classes (cls, node, doc_id); others with these ids too."""
    texts = docs.select(F.col("doc_id").cast("long").alias("_doc"), text_of().alias("text"))
    ids = wanted.select(F.col("doc_id").alias("_id")).distinct()
    return texts.join(ids, F.col("_doc").eqNullSafe(F.col("_id")), "left_semi").select("text")


def rare_shingle_pairs(docs: DataFrame, classes: DataFrame, like: Similarity):
    """Candidate pairs across groups for texts whose buckets hold several groups.

    Such buckets come from passages that many texts share and from families of texts that are
    alike, but not enough; banding would pair all their members. Here the shingles of a set are
    ordered from rare to frequent. Two sets that reach the threshold t share one of the first
    n - ceil(t n) + 1 shingles of both, and from that place on enough are left to reach the overlap
    that t asks for. So this misses no link, and shared passages, being frequent, pair nothing.
    """
    num, den = like.num, like.den

    def spread(batches: Iterator[dict]) -> Iterator[dict]:
        sketcher = Sketcher(like)
        for b in batches:
            for text in b["text"]:
                words = words_of(text)
                if words:
                    hashes = sketcher.hashes(words)
                    yield {"cls": [class_of(words)] * len(hashes), "n": [len(hashes)] * len(hashes), "shingle": hashes.view(np.int64)}

    def pairs(open_nodes: DataFrame) -> DataFrame:
        named = cut_lineage(classes.join(open_nodes, "node").select("cls", "node", "group", "doc_id"))
        found = map_rows(texts_of(docs, named), spread, "cls binary, n long, shingle long", 256)
        rows = cut_lineage(found.join(named.select("cls", "node", "group"), "cls").select("node", "group", "n", "shingle").distinct())
        shared = rows.groupBy("shingle").agg(F.count("*").alias("df"))
        order = Window.partitionBy("node").orderBy("df", "shingle")
        least = F.ceil(F.col("n") * num / den)
        first = (
            rows.join(shared, "shingle")
            .withColumn("at", F.row_number().over(order))
            .filter((F.col("at") <= F.col("n") - least + 1) & (F.col("df") > 1))
        )
        # A pair is made at the first shingle that both share, where that is among their HEAD rarest.
        mine = Window.partitionBy("node")
        first = first.withColumn("nth", F.row_number().over(mine.orderBy("at")))
        whole = mine.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        first = first.withColumn("head", F.collect_list(F.when(F.col("nth") <= HEAD, F.col("shingle"))).over(whole))
        kept = ("node", "group", "n", "at", "nth", "head")
        first = cut_lineage(first.select("shingle", *kept))
        left = first.select("shingle", *[F.col(c).alias(f"{c}_a") for c in kept])
        right = first.select("shingle", *[F.col(c).alias(f"{c}_b") for c in kept])
        once = (F.greatest("nth_a", "nth_b") > HEAD) | (F.get(F.array_intersect("head_a", "head_b"), 0) == F.col("shingle"))
        still = 1 + F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
        reach = still * (num + den) >= num * (F.col("n_a") + F.col("n_b"))
        return (
            left.join(right, "shingle")
            .filter((F.col("node_a") < F.col("node_b")) & (F.col("group_a") != F.col("group_b")) & reach & once)
            .select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
            .distinct()
        )

    return pairs


def near_duplicates(docs: DataFrame, like: Similarity = Similarity()) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, row_no, digest (MD5 of the text)."""
    rows = sketches(docs, like)
    classes = classes_of(rows)
    groups = link(band_members(classes, like), verifier(docs, classes, like), across=rare_shingle_pairs(docs, classes, like))
    if groups is None:
        named = classes.withColumn("group", F.col("node"))
    else:
        named = classes.join(groups, "node", "left").withColumn("group", F.coalesce("group", "node"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col("node").alias("row_no")))
    heads = named.groupBy("group").agg(first.alias("_f"))
    owner = named.select("cls", "group").join(heads, "group").select("cls", F.col("_f.doc_id").alias("component_id"), F.col("_f.row_no").alias("_head"))
    alone = F.col("n_shingles") == 0
    return rows.join(owner, "cls").select(
        "doc_id",
        "n_shingles",
        F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        (alone | (F.col("row_no") == F.col("_head"))).alias("kept"),
        "row_no",
        "digest",
    )


def deduplicate(docs: DataFrame, like: Similarity = Similarity()) -> DataFrame:
    """One document of each group, with all its columns; documents without words all stay.

    A document is named by doc_id and text, so of rows that repeat both one stays.
    """
    decided = near_duplicates(docs, like).filter("kept and n_shingles > 0")
    stay = decided.select(row_key(F.col("doc_id"), F.col("digest")).alias("_tg_key"))
    empty = F.length(F.translate(text_of(), " \t\n\x0b\f\r", "")) == 0
    key = row_key(F.col("doc_id").cast("long"), F.md5(text_of()))
    return keep_rows(docs.filter(~empty), key, stay, [text_of()]).unionByName(docs.filter(empty))

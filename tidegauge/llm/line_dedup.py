"""Fuzzy line deduplication with SimHash, with DataFrame functions only.

Lines are normalised (lower case, runs of white space as one blank, trimmed). The SimHash of a
line takes the majority of each bit over the hashes of its words of four letters or more (of all
words, if there is none so long); in a tie the smallest hash decides. Two lines are candidates if their
SimHashes differ in at most ``radius`` of 64 bits. The bits are cut into ``radius`` + ``EQUAL`` blocks,
of which ``EQUAL`` at least are then equal (pigeonhole), so lines meet in one bucket per choice of
that many blocks. Three equal blocks are 32 bits: with two, 26 bits, chance fills the buckets of large tables.
Candidates are verified by edit similarity, 1 - edit distance / longer length, of the normalised
lines. One occurrence of each connected group stays, the first by row and line.

Scale: lines travel as (row, line, hash) and the bit sums of their words, texts only where a
candidate pair needs them. The hashes of seven words at a time are added up bit by bit, then in
longs with four 16-bit counters, before the shuffle. Pairs are settled by whole words where those bound
the edit distance, the others by letters. Expressions avoid nulls and repeated parts: the JVM
does not compile generated methods above 8,000 bytes. A line of more than ``LONGEST`` words counts as several lines of that many words at
most. Groups are found by ``components.link``: a crowded bucket is compared with one member
first.

Defined results: blank lines are kept and not reported; null text has no lines; repeated rows
repeat their lines and go as copies; an empty table gives no rows; other columns are not read
(``clean`` passes them on). Lines are named by a 64-bit hash of the normalised text.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.common import text_of
from tidegauge.llm.components import link, sieve
from tidegauge.session import cut_lineage

RADIUS = 3
SIMILARITY = 0.8
LONGEST = 60_000
TELLING = 4  # letters of a word that counts, in lines that have such words
LANES = 0x0001000100010001
HALVES = 0x0000000100000001
SPACES = "\t\x0b\f\r"
EQUAL = 3  # equal blocks of a candidate pair


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def line_rows(docs: DataFrame) -> DataFrame:
    """(row_no, doc_id, line_no, part_no, line, words, node) of every line that is not blank, normalised."""
    numbered = docs.select(F.monotonically_increasing_id().alias("row_no"), F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    rows = numbered.select("row_no", "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    rows = rows.filter(F.ltrim("line", F.lit(" " + SPACES)) != "")
    # Few lines have other white space than single blanks; only those pay for its replacement.
    spaced = F.lit(False)
    for sign in SPACES:
        spaced = spaced | F.contains("line", F.lit(sign))
    plain = F.when(spaced, F.translate("line", SPACES, " " * len(SPACES))).otherwise(F.col("line"))
    keys = ["row_no", "doc_id", "line_no"]
    clean = rows.select(*keys, F.trim(F.lower(plain)).alias("line"))
    clean = clean.withColumn("line", F.when(F.contains("line", F.lit("  ")), F.regexp_replace("line", " +", " ")).otherwise(F.col("line")))
    cut = clean.withColumn("all", F.split("line", " "))
    cut = cut.select(*keys, "line", "all", F.explode(F.sequence(F.lit(0), F.floor((F.size("all") - 1) / LONGEST).cast("int"))).alias("part_no"))
    whole = F.size("all") <= LONGEST
    cut = cut.withColumn("words", F.when(whole, F.col("all")).otherwise(F.slice("all", F.col("part_no") * LONGEST + 1, F.lit(LONGEST))))
    cut = cut.withColumn("line", F.when(whole, F.col("line")).otherwise(F.array_join("words", " ")))
    return cut.select(*keys, "part_no", "line", "words", F.xxhash64("line").alias("node"))


def add_bits(a: Column, b: Column, c: Column) -> tuple[Column, Column]:
    """Ones and twos of the sum of three longs, bit by bit."""
    return a.bitwiseXOR(b).bitwiseXOR(c), a.bitwiseAND(b).bitwiseOR(c.bitwiseAND(a.bitwiseXOR(b)))


def simhashes(lines: DataFrame) -> DataFrame:
    """(row_no, doc_id, line_no, part_no, node, simhash) of every line, stored."""
    keys = ["row_no", "doc_id", "line_no", "part_no", "node"]
    # Short words are mostly the same few in all lines of a language and would make lines alike.
    lines = lines.withColumn("telling", F.col("line").rlike("[^ ]{%d}" % TELLING))
    # Seven words make a row: their hashes are added up bit by bit into three longs before they are counted.
    rows = lines.select(*keys, "words", "telling", F.explode(F.sequence(F.lit(0), F.floor((F.size("words") - 1) / 7).cast("int"))).alias("_at"))
    some = [F.get("words", F.col("_at") * 7 + i) for i in range(7)]
    tells = [w.isNotNull() & ((F.length(w) >= TELLING) | ~F.col("telling")) for w in some]
    rows = rows.select(*keys, *[F.when(t, F.xxhash64(w)).alias(f"h{i}") for i, (w, t) in enumerate(zip(some, tells))])
    h = [F.coalesce(f"h{i}", F.lit(0).cast("long")) for i in range(7)]
    n = sum((F.col(f"h{i}").isNotNull().cast("int") for i in range(1, 7)), F.col("h0").isNotNull().cast("int"))
    rows = rows.select(*keys, n.alias("n"), F.least(*[f"h{i}" for i in range(7)]).alias("lead"), *[c.alias(f"h{i}") for i, c in enumerate(h)])
    for ones, twos, three in (("a", "p", "h0 h1 h2"), ("b", "q", "h3 h4 a"), ("ones", "r", "h5 h6 b"), ("twos", "fours", "p q r")):
        first, second = add_bits(*[F.col(c) for c in three.split(" ")])
        rows = rows.withColumns({ones: first, twos: second})
    lane = lambda c, k: F.shiftrightunsigned(c, k).bitwiseAND(F.lit(LANES))
    sums = [F.sum(lane("ones", k) + F.shiftleft(lane("twos", k), 1) + F.shiftleft(lane("fours", k), 2)).alias(f"s{k}") for k in range(16)]
    counted = rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("lead").alias("lead"), *sums)
    # Two counters at a time: 2 * ones + the bit of the smallest hash > n, read from bit 30 of each half.
    filled = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counted.columns if c not in keys]  # no nulls: shorter code
    counted = counted.select(*keys, *filled).withColumn("_less", F.lit(HALVES << 30) - (F.col("n") + 1) * F.lit(HALVES))
    bits = F.lit(0).cast("long")
    for k in range(16):
        for odd in (0, 16):
            ones = F.shiftrightunsigned(f"s{k}", odd).bitwiseAND(F.lit(HALVES * 0xFFFF))
            lead = F.shiftrightunsigned("lead", k + odd).bitwiseAND(F.lit(HALVES))
            more = F.shiftrightunsigned(F.shiftleft(ones, 1).bitwiseOR(lead) + F.col("_less"), 30).bitwiseAND(F.lit(HALVES))
            bits = bits.bitwiseOR(F.shiftleft(more, k + odd))
    return cut_lineage(counted.select(*keys, bits.alias("simhash")))


def blocks(radius: int = RADIUS, equal: int = 2) -> list[tuple[int, int]]:
    """(first bit, width) of each of the ``radius`` + ``equal`` blocks of 64 bits."""
    n = radius + equal
    edges = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def buckets(simhash: Column, radius: int = RADIUS) -> Column:
    """One long for each choice of ``EQUAL`` blocks: their bits, above them the number of the choice."""
    out = []
    chosen = list(combinations(blocks(radius, EQUAL), EQUAL))
    top = max(sum(width for _, width in some) for some in chosen)
    simhash = F.coalesce(simhash, F.lit(0).cast("long"))  # no nulls: shorter code
    for number, some in enumerate(chosen):
        bucket, at = F.lit(number << top).cast("long"), 0
        for first, width in some:
            bucket = bucket.bitwiseOR(F.shiftleft(F.shiftrightunsigned(simhash, first).bitwiseAND(F.lit((1 << width) - 1).cast("long")), at))
            at += width
        out.append(bucket)
    return F.explode(F.array(*out))


def after_shared(a: Column, b: Column) -> Column:
    """Struct of two arrays of words without those that both begin or end with."""

    def rest(x: Column, y: Column) -> Column:
        first = F.array_position(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), False)
        at = F.when(first == 0, F.least(F.size(x), F.size(y)) + 1).otherwise(first).cast("int")
        cut = lambda v, at: F.reverse(F.slice(v, at, F.greatest(F.size(v) - at + 1, F.lit(0))))
        return let(at, lambda at: F.struct(cut(x, at).alias("x"), cut(y, at).alias("y")))

    return let(F.struct(F.split(a, " ").alias("x"), F.split(b, " ").alias("y")), lambda v: let(rest(v["x"], v["y"]), lambda w: rest(w["x"], w["y"])))


def spaced(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: F.concat(F.lit(" "), w)), "")


def edit_distance(a: str, b: str, most: Column | None = None) -> Column:
    """Edit distance of two normalised lines; words that both begin or end with are left out.

    With ``most`` a larger distance is -1, and only that many places beside the diagonal are looked at.
    """
    return let(after_shared(F.col(a), F.col(b)), lambda v: let(F.struct(spaced(v["x"]).alias("x"), spaced(v["y"]).alias("y")), lambda t: distance(t["x"], t["y"], most)))


def distance(x: Column, y: Column, most: Column | None) -> Column:
    # Most pairs are very near: small bounds cost little and settle them.
    bounded = [F.levenshtein(x, y, bound) for bound in (16, 256)]
    if most is None:
        return let(bounded[0], lambda d: F.when(d >= 0, d).otherwise(let(bounded[1], lambda e: F.when(e >= 0, e).otherwise(F.levenshtein(x, y)))))
    last = F.when(most > 256, F.call_function("levenshtein", x, y, most)).otherwise(F.lit(-1))
    wider = F.when(most <= 16, F.lit(-1)).otherwise(let(bounded[1], lambda e: F.when(e >= 0, e).otherwise(last)))
    found = let(bounded[0], lambda d: F.when(d >= 0, d).otherwise(wider))
    return let(found, lambda d: F.when(d <= most, d).otherwise(F.lit(-1)))


def within(a: str, b: str, most: str) -> Column:
    """Whether the edit distance of two normalised lines is at most ``most``.

    Words settle most pairs: the words between the shared ends are replaced as a whole, or place by place, or by edits of
    whole words, of which each costs the longest word and a blank at most. Other pairs are compared by letters.
    """
    most = F.col(most)
    length = lambda v: F.aggregate(v, F.lit(0), lambda n, w: n + F.length(w) + 1)
    # A word without a partner stands against null and costs its blank too.
    cost = lambda p, q: F.when(p.eqNullSafe(q), F.lit(0)).otherwise(F.greatest(F.length(p) + q.isNull().cast("int"), F.length(q) + p.isNull().cast("int")))

    def by_words(x: Column, y: Column) -> Column:
        known = F.array_distinct(F.concat(x, y))
        longest = F.array_max(F.transform(known, lambda w: F.length(w))) + 1

        def edits(v: Column) -> Column:
            # Each known word becomes one character, its number in UTF-16 below the surrogates.
            coded = [F.decode(F.unhex(F.array_join(F.transform(c, lambda w: F.lpad(F.hex(F.array_position(v["known"], w)), 4, "0")), "")), "UTF-16BE") for c in (x, y)]
            allowed = F.floor(most / v["longest"]).cast("int")
            return (F.size(v["known"]) < 0xD800) & (F.call_function("levenshtein", *coded, allowed) >= 0)

        return let(F.struct(known.alias("known"), longest.alias("longest")), edits)

    def decide(v: Column) -> Column:
        x, y = v["x"], v["y"]
        placed = F.aggregate(F.zip_with(x, y, cost), F.lit(0), lambda n, c: n + c)
        return (
            F.when(F.greatest(length(x), length(y)) <= most, F.lit(True)).when(placed <= most, F.lit(True)).when(by_words(x, y), F.lit(True))
            .otherwise(let(F.struct(spaced(x).alias("x"), spaced(y).alias("y")), lambda t: distance(t["x"], t["y"], most)) >= 0)
        )

    return let(after_shared(F.col(a), F.col(b)), decide)


def groups(docs: DataFrame, radius: int = RADIUS, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Occurrences of lines, and (node, group) of the lines that have a partner."""
    found = simhashes(line_rows(docs))
    distinct = cut_lineage(found.groupBy("node").agg(F.min("simhash").alias("mark")))
    members = distinct.select(buckets(F.col("mark"), radius).alias("bucket"), "node", "mark")

    def close(pairs: DataFrame) -> DataFrame:
        return pairs.filter(F.bit_count(F.col("mark_a").bitwiseXOR(F.col("mark_b"))) <= radius)

    def verify(pairs: DataFrame) -> DataFrame:
        nodes = cut_lineage(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        holders = cut_lineage(
            sieve(found, "node", nodes).join(nodes, "node", "left_semi").groupBy("node").agg(F.min(F.struct("row_no", "line_no", "part_no", "doc_id")).alias("_f"))
            .select("node", F.col("_f.doc_id").alias("_doc"))
        )
        ids = cut_lineage(holders.select("_doc").distinct())
        some = sieve(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", ids)
        some = some.join(ids, F.col("doc_id").eqNullSafe(F.col("_doc")), "left_semi")
        texts = sieve(line_rows(some).select("node", "line"), "node", nodes)
        texts = cut_lineage(texts.join(holders.select("node"), "node", "left_semi").groupBy("node").agg(F.first("line").alias("line")))
        both = (
            pairs.select("a", "b")
            .join(texts.select(F.col("node").alias("a"), F.col("line").alias("line_a")), "a")
            .join(texts.select(F.col("node").alias("b"), F.col("line").alias("line_b")), "b")
        )
        both = both.select("a", "b", "line_a", "line_b", F.length("line_a").alias("_na"), F.length("line_b").alias("_nb"))
        most = F.floor(F.greatest("_na", "_nb") * F.lit(1 - similarity) + F.lit(1e-9)).cast("int")
        near = both.withColumn("_most", most).filter(F.abs(F.col("_na") - F.col("_nb")) <= F.col("_most"))
        return near.filter(within("line_a", "line_b", "_most")).select("a", "b")

    return found, link(members, verify, close)


def duplicate_lines(docs: DataFrame, radius: int = RADIUS, similarity: float = SIMILARITY) -> DataFrame:
    """One row per line that is not blank: doc_id, line_no, part_no, group_id, group_size, kept, row_no.

    ``group_id`` is the smallest hash of the group's lines, ``line_no`` counts from 0.
    """
    found, linked = groups(docs, radius, similarity)
    first = F.min(F.struct("row_no", "line_no", "part_no")).alias("_f")
    nodes = found.groupBy("node").agg(first, F.count("*").alias("_n"))
    if linked is None:
        named = nodes.withColumn("group", F.col("node"))
    else:
        named = nodes.join(linked, "node", "left").withColumn("group", F.coalesce("group", "node"))
    heads = named.groupBy("group").agg(F.min("_f").alias("_head"), F.sum("_n").alias("group_size"))
    owner = named.select("node", "group").join(heads, "group")
    return found.join(owner, "node").select(
        "doc_id",
        F.col("line_no").cast("long").alias("line_no"),
        F.col("part_no").cast("long").alias("part_no"),
        F.col("group").alias("group_id"),
        "group_size",
        ((F.col("row_no") == F.col("_head.row_no")) & (F.col("line_no") == F.col("_head.line_no")) & (F.col("part_no") == F.col("_head.part_no"))).alias("kept"),
        "row_no",
    )


def clean(docs: DataFrame, radius: int = RADIUS, similarity: float = SIMILARITY) -> DataFrame:
    """The documents without the lines that go; documents keep their rows and other columns.

    The rows are stored first, so that their numbers are the same at each reading. A line is
    dropped when none of its parts stays.
    """
    docs = cut_lineage(docs)
    numbered = docs.withColumn("_tg_row", F.monotonically_increasing_id())
    gone = (
        duplicate_lines(docs, radius, similarity)
        .groupBy("row_no", "line_no")
        .agg(F.max("kept").alias("_stay"))
        .filter("not _stay")
        .groupBy(F.col("row_no").alias("_tg_row"))
        .agg(F.collect_set("line_no").alias("_tg_gone"))
    )
    lines = F.split(F.col("text"), "\n")
    left = F.filter(lines, lambda _, i: ~F.coalesce(F.array_contains("_tg_gone", i.cast("long")), F.lit(False)))
    joined = numbered.join(gone, "_tg_row", "left")
    text = F.when(F.col("_tg_gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    return joined.withColumn("text", text).select(*[F.col(f"`{c}`") for c in docs.columns])

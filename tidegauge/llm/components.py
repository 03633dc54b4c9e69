"""Connected groups of a similarity relation without all pairs, with DataFrame functions only.

``link`` takes members (bucket, node): nodes that share a bucket are candidates. It finds the
connected groups of the verified candidate pairs in these rounds:

1. every node is compared with the smallest node of its buckets, the one it meets most often;
2. every node is compared with the smallest node of each of its buckets, where the two are not
   connected yet;
3. in buckets that still hold several groups, every node is compared with a drawn member of each
   of its buckets that is of another group, one draw after the other, as long as there are many
   more pairs across groups than rows and the last draw has made them clearly fewer;
4. every pair across the groups that are left is compared; a caller may give a narrower complete
   source of such pairs.

Pairs inside a connected group are never formed, so a bucket of n alike members costs n
comparisons a round, also where members are alike to some of the others only, and no pair that could
connect two groups is left out. Groups, links and labels stay
distributed and are written between the rounds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.session import cut_lineage

SLOTS = 1 << 26  # bits of a sieve at most: a million rows
FEW = 2  # pairs across groups for each row of a mixed bucket that are compared without further draws
LESS = 0.9  # share of those pairs that a draw may leave for the next draw to be made

Verify = Callable[[DataFrame], DataFrame]


def sieve(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows whose ``key`` may be in the only column of ``wanted``, a stored table: all that are, and few others.

    The wanted keys set bits of at most ``SLOTS``, 64 to a row, whose table is broadcast, whatever the number of
    keys. What is left can be joined without shuffling the rest.
    """
    slots = 64
    while slots < min(SLOTS, 16 * wanted.count()):
        slots *= 2
    slot = lambda c: F.xxhash64(c).bitwiseAND(F.lit(slots - 1))
    set_ = wanted.select(slot(F.col(wanted.columns[0])).alias("_slot")).withColumn("_bit", F.expr("shiftleft(1L, cast(_slot & 63 as int))"))
    bits = set_.groupBy(F.shiftright("_slot", 6).alias("_word")).agg(F.bit_or("_bit").alias("_bits"))
    placed = rows.withColumn("_slot", slot(F.col(key))).withColumn("_word", F.shiftright("_slot", 6))
    met = placed.join(F.broadcast(bits), "_word").filter("(shiftrightunsigned(_bits, cast(_slot & 63 as int)) & 1L) = 1")
    return met.select(*[F.col(f"`{c}`") for c in rows.columns])


def components(links: DataFrame) -> DataFrame:
    """(node, group) of the nodes of ``links`` (a, b); a group is named by its smallest node.

    Labels start at the smallest neighbour; then links between labels are contracted, and labels
    of labels are looked up, until no link crosses two labels.
    """
    both = links.select("a", "b").filter("a <> b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_m")).select("node", F.least("node", "_m").alias("group")))
    edges = links.select("a", "b")
    current = labels
    while True:
        at_a = current.select(F.col("node").alias("a"), F.col("group").alias("ga"))
        at_b = current.select(F.col("node").alias("b"), F.col("group").alias("gb"))
        edges = cut_lineage(
            edges.join(at_a, "a").join(at_b, "b").filter("ga <> gb")
            .select(F.least("ga", "gb").alias("a"), F.greatest("ga", "gb").alias("b")).distinct()
        )
        if edges.isEmpty():
            return labels
        turned = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        current = cut_lineage(turned.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_m")).select("node", F.least("node", "_m").alias("group")))
        onward = current.select(F.col("node").alias("group"), F.col("group").alias("_next"))
        labels = cut_lineage(labels.join(onward, "group", "left").select("node", F.coalesce("_next", "group").alias("group")))


def apart(pairs: DataFrame, groups: DataFrame | None) -> DataFrame:
    """Pairs (a, b, ...) whose ends are in different groups; a node without a group is its own."""
    if groups is None:
        return pairs
    at_a = groups.select(F.col("node").alias("a"), F.col("group").alias("_ga"))
    at_b = groups.select(F.col("node").alias("b"), F.col("group").alias("_gb"))
    joined = pairs.join(at_a, "a", "left").join(at_b, "b", "left")
    return joined.filter(F.coalesce("_ga", "a") != F.coalesce("_gb", "b")).select(*pairs.columns)


def link(
    members: DataFrame, verify: Verify, close: Callable[[DataFrame], DataFrame] | None = None,
    across: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame | None:
    """(node, group) of all nodes that have a verified link; None if there is none.

    ``members`` has ``bucket`` and ``node`` (longs) and possibly ``mark``; a node is in a bucket once. ``close`` may drop pairs
    (a, b, mark_a, mark_b) by their marks, ``verify`` returns the linked ones of pairs (a, b).
    ``across`` gives, for nodes (node, group) of mixed buckets, pairs (a, b) of different groups,
    a < b, among which is every pair that ``verify`` would link.
    """
    marked = "mark" in members.columns
    if not marked:
        members = members.withColumn("mark", F.lit(None).cast("long"))
    close = close or (lambda pairs: pairs)
    shared = cut_lineage(members.groupBy("bucket").agg(F.count("*").alias("_n")).filter("_n > 1").select("bucket"))
    filled = cut_lineage(sieve(members, "bucket", shared).join(shared, "bucket"))
    crowded = cut_lineage(filled.join(filled.groupBy("bucket").agg(F.min("node").alias("_hub")), "bucket"))
    stars = crowded.filter("node <> _hub").select("bucket", F.col("_hub").alias("a"), F.col("node").alias("b"), F.col("mark").alias("mark_b"))
    if marked:
        hubs = crowded.filter("node = _hub").select("bucket", F.col("mark").alias("mark_a"))
        stars = stars.join(hubs, "bucket")
    stars = cut_lineage(close(stars).groupBy("a", "b").agg(F.count("*").alias("_n")))
    best = stars.groupBy("b").agg(F.min_by("a", F.struct(-F.col("_n"), F.col("a"))).alias("a")).select("a", "b")
    links = cut_lineage(verify(best))
    groups = None if links.isEmpty() else components(links)
    rest = cut_lineage(apart(stars.select("a", "b").join(best, ["a", "b"], "left_anti"), groups))
    if not rest.isEmpty():
        more = cut_lineage(verify(rest))
        if not more.isEmpty():
            links = cut_lineage(links.unionByName(more))
            groups = components(links)
    tried = stars.select("a", "b")
    open_rows, before, draw = cut_lineage(mixed_rows(crowded, groups)), None, 0
    while True:
        n_rows, n_pairs = open_rows.agg(F.count("*")).first()[0], pairs_across(open_rows)
        if n_pairs <= FEW * n_rows or (before is not None and n_pairs > LESS * before):
            break
        before, draw = n_pairs, draw + 1
        pairs = cut_lineage(drawn_pairs(open_rows, close, draw).join(tried, ["a", "b"], "left_anti"))
        more = cut_lineage(verify(pairs))
        tried = tried.unionByName(pairs)
        if more.isEmpty():
            break
        links = cut_lineage(links.unionByName(more))
        groups = components(links)
        open_rows = cut_lineage(mixed_rows(crowded, groups))
    if not n_rows:
        return groups
    if across:
        pairs = across(open_rows.select("node", "group").distinct())
    else:
        pairs = across_in_buckets(open_rows, close)
    pairs = cut_lineage(pairs.join(tried, ["a", "b"], "left_anti"))
    if not pairs.isEmpty():
        more = cut_lineage(verify(pairs))
        if not more.isEmpty():
            groups = components(links.unionByName(more))
    return groups


def mixed_rows(crowded: DataFrame, groups: DataFrame | None) -> DataFrame:
    """(bucket, node, mark, group) of the buckets of more than two members that hold several groups."""
    named = crowded.select("bucket", "node", "mark")
    if groups is not None:
        named = named.join(groups, "node", "left").withColumn("group", F.coalesce("group", "node"))
    else:
        named = named.withColumn("group", F.col("node"))
    mixed = named.groupBy("bucket").agg(F.min("group").alias("_lo"), F.max("group").alias("_hi"), F.count("*").alias("_n"))
    return named.join(mixed.filter("_lo <> _hi and _n > 2").select("bucket"), "bucket", "left_semi")


def pairs_across(open_rows: DataFrame) -> float:
    """How many pairs of members of a bucket are in different groups, counted without forming them."""
    sizes = open_rows.groupBy("bucket", "group").agg(F.count("*").cast("double").alias("_n"))
    of_bucket = sizes.groupBy("bucket").agg((F.pow(F.sum("_n"), F.lit(2)) - F.sum(F.col("_n") * F.col("_n"))).alias("_p"))
    return (of_bucket.agg(F.sum("_p")).first()[0] or 0.0) / 2


def drawn_pairs(open_rows: DataFrame, close: Callable[[DataFrame], DataFrame], draw: int) -> DataFrame:
    """Close pairs (a, b) of each member and the one drawn from its bucket, where their groups differ."""
    chance = F.struct(F.xxhash64("bucket", "node", F.lit(draw)), F.col("node"))
    drawn = open_rows.groupBy("bucket").agg(F.min_by(F.struct("node", "group", "mark"), chance).alias("_d"))
    met = open_rows.join(drawn, "bucket").filter(F.col("group") != F.col("_d.group"))
    first = F.col("node") < F.col("_d.node")
    pairs = met.select(
        F.least("node", "_d.node").alias("a"),
        F.greatest("node", "_d.node").alias("b"),
        F.when(first, F.col("mark")).otherwise(F.col("_d.mark")).alias("mark_a"),
        F.when(first, F.col("_d.mark")).otherwise(F.col("mark")).alias("mark_b"),
    )
    return close(pairs).select("a", "b").distinct()


def across_in_buckets(open_rows: DataFrame, close: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Close pairs (a, b) of members that share a bucket and not their group."""
    left = open_rows.select("bucket", F.col("node").alias("a"), F.col("group").alias("_ga"), F.col("mark").alias("mark_a"))
    right = open_rows.select("bucket", F.col("node").alias("b"), F.col("group").alias("_gb"), F.col("mark").alias("mark_b"))
    pairs = left.join(right, "bucket").filter("a < b and _ga <> _gb")
    return close(pairs).select("a", "b").distinct()

"""Prefix trie of conversations by whole-sequence collapse, with DataFrame functions.

1. Turns are reduced to two 64-bit digests and a length before anything is shuffled. A prefix of d
   turns is named by the exclusive or of its elements, an element being the digests of its turn
   hashed once more with its depth; names of prefixes are therefore running aggregates.
2. Conversations with the same name of the whole sequence collapse into one weighted sequence with
   the list of their ids, the end list.
3. The prefixes of each distinct sequence are rows; added up by name with the weights they are the
   nodes. A sequence that is the parent of a node is a proper prefix; the anti-join with the parents
   leaves the leaves.
4. A node belongs to one of the leaves below it. What is to be summed over subtrees is put at
   the owner's place on its path, summed from the end of each path, and added up by node; every node
   below counts once.

Scale: linear in turns; no path is paired with itself and texts are not shuffled. Running
aggregates (``running``) go over blocks of 1,024 places, then over the blocks, so one conversation
with a third of all rows is spread. Hot prefixes, the root among them, are combined before the
shuffle; hot parents of the last join are looked up in a table of parents with their children counted, which
adaptive execution splits. End lists are joined in chunks of 4,096 ids; a digest then reads the chunks of
one end in order, with constant memory.

Defined results: null role or text is empty; null turns come first, equal turns in the order of the
turns' digests; rows without conv_id belong to no conversation and are left out; repeated rows are
turns of their own; an empty table has no nodes; other columns, whatever their names, are not read.
Long texts only make digests slower.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import map_rows
from tidegauge.session import cut_lineage

BLOCK = 10  # binary digits of the places that one window sorts
CHUNK = 12  # binary digits of the ids that one piece of an end list covers
GROUP = 100  # conversations that share a head
HEAD = 5  # longest shared head
NODE = ["k1", "k2"]
PARENT = ["p1", "p2"]
EMPTY = hashlib.sha256(b"").hexdigest()


def running(df: DataFrame, keys: Sequence[str], block: Column, order: Sequence[Column], xor: Sequence[str] = (), total: Sequence[str] = ()) -> DataFrame:
    """Replace columns by their running exclusive or or sum within ``keys``, ascending by block and order.

    A window covers one block; a second one, over block totals, serves the blocks after the first.
    """
    keys, columns = list(keys), [*xor, *total]
    df = df.withColumn("_block", block)
    inner = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy(F.col("_block").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)

    def fold(name: str) -> Column:
        return F.bit_xor(name) if name in xor else F.sum(name)

    before = df.groupBy(*keys, "_block").agg(*[fold(c).alias(c) for c in columns])
    before = before.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_block").alias("_at"), *[fold(c).over(earlier).alias(f"_before_{c}") for c in columns])
    before = before.filter(F.col(f"_before_{columns[0]}").isNotNull())
    local = df.withColumns({c: fold(c).over(inner) for c in columns})
    match = F.col("_block").eqNullSafe(F.col("_at"))
    for k in keys:
        match = match & (F.col(k) == F.col(f"_{k}"))
    joined = local.join(before, match, "left")

    def whole(name: str) -> Column:
        offset = F.coalesce(F.col(f"_before_{name}"), F.lit(0))
        return F.col(name).bitwiseXOR(offset) if name in xor else F.col(name) + offset

    return joined.withColumns({c: whole(c) for c in columns}).select(*[c for c in df.columns if c != "_block"])


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), d1, d2 (digests of role and text) and chars of every turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.xxhash64(F.lit(1), digest).alias("d1"), F.xxhash64(F.lit(2), digest).alias("d2"), F.length(text).cast("long").alias("chars"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("d1"), F.col("d2")]
    ranked = running(rows.withColumn("pos", F.lit(1).cast("long")), ["conv_id"], F.shiftright("turn", BLOCK), order, total=["pos"])
    return ranked.select("conv_id", (F.col("pos") - 1).alias("pos"), "d1", "d2", "chars")


def shared_heads(rows: DataFrame) -> DataFrame:
    """conv_id, depth (from 1), d1, d2, chars of the rebuilt conversations.

    A conversation starts with the first h turns of the first one of its hundred, followed by its
    own turns after its first h, h = crc32(conv_id) % 6; the remainder by 100 has the sign of conv_id. Heads are at most five turns, given to at
    most a hundred conversations.
    """
    base, h = F.col("conv_id") - F.col("conv_id") % GROUP, F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEAD + 1)
    first = rows.filter((F.col("conv_id") % GROUP == 0) & (F.col("pos") < HEAD))
    sizes = first.groupBy(F.col("conv_id").alias("base")).agg(F.count("*").alias("_held"))
    convs = rows.groupBy("conv_id").agg(F.lit(1).alias("_one")).select("conv_id", base.alias("base"), h.alias("_h"))
    heads = convs.join(first.select(F.col("conv_id").alias("base"), "pos", "d1", "d2", "chars"), "base").filter("pos < _h")
    own = rows.withColumns({"base": base, "_h": h}).filter("pos >= _h").join(sizes, "base", "left")
    depth = F.least(F.coalesce("_held", F.lit(0)), F.col("_h")) + F.col("pos") - F.col("_h") + 1
    return heads.select("conv_id", (F.col("pos") + 1).alias("depth"), "d1", "d2", "chars").unionByName(
        own.select("conv_id", depth.alias("depth"), "d1", "d2", "chars")
    )


def prefixes(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """conv_id, depth, name (k1, k2), parent's name (p1, p2) and chars of every prefix, roots included.

    ``rows`` has conv_id, depth, d1, d2, chars; ``ids`` every conv_id, also those without turns.
    """
    element = {f"e{i}": F.xxhash64(F.lit(i), "d1", "d2", "depth") for i in (1, 2)}
    named = rows.withColumns(element).withColumns({"k1": F.col("e1"), "k2": F.col("e2")})
    named = running(named, ["conv_id"], F.shiftright(F.col("depth") - 1, BLOCK), [F.col("depth")], xor=NODE)
    parents = [F.col(k).bitwiseXOR(F.col(e)).alias(p) for k, e, p in zip(NODE, element, PARENT)]
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    roots = ids.select("conv_id", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), none.alias("p1"), none.alias("p2"), zero.alias("chars"))
    return named.select("conv_id", "depth", *NODE, *parents, "chars").unionByName(roots)


def end_lists(members: DataFrame) -> DataFrame:
    """k1, k2 and ends_sha256: digest of the ids of the conversations that end there, ascending, joined by commas.

    ``members`` has conv_id and k1, k2. Chunks are joined where they are grouped; a partition then
    reads the chunks of its ends in order and keeps one digest open.
    """
    chunks = members.groupBy(*NODE, F.shiftright("conv_id", CHUNK).alias("chunk")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("ids"))
    ordered = chunks.repartition(*NODE).sortWithinPartitions(*NODE, "chunk")

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        node, digest = None, None
        for b in batches:
            done: dict[str, list] = {"k1": [], "k2": [], "ends_sha256": []}

            def close() -> None:
                for column, value in zip(done.values(), (*node, digest.hexdigest())):
                    column.append(value)

            for *key, ids in zip(b["k1"], b["k2"], b["ids"]):
                if key == node:
                    digest.update(b",")
                else:
                    if node:
                        close()
                    node, digest = key, hashlib.sha256()
                digest.update(ids.encode())
            yield done
        if node:
            yield {"k1": [node[0]], "k2": [node[1]], "ends_sha256": [digest.hexdigest()]}

    return map_rows(ordered.select(*NODE, "ids"), run, "k1 long, k2 long, ends_sha256 string", 256)


def trie(paths: DataFrame) -> DataFrame:
    """Nodes of the trie of ``paths`` (see ``prefixes``)."""
    paths = cut_lineage(paths)
    members = paths.groupBy("conv_id").agg(F.max(F.struct("depth", *NODE)).alias("_end")).select("conv_id", "_end.*")
    members = cut_lineage(members)
    sequences = cut_lineage(members.groupBy(*NODE).agg(F.count("*").alias("weight"), F.min("conv_id").alias("conv_id")))

    weighted = paths.join(sequences.select("conv_id", "weight"), "conv_id")
    nodes = weighted.groupBy(*NODE).agg(
        F.min("depth").alias("depth"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("chars").alias("chars"),
        F.sum("weight").alias("n_convs"), F.min("conv_id").alias("conv_id"),
    )
    nodes = cut_lineage(nodes)
    parents = cut_lineage(nodes.filter("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children")))

    leaves = sequences.join(parents, NODE, "left_anti").select("conv_id")
    leaf_paths = cut_lineage(paths.join(leaves, "conv_id", "left_semi").select("conv_id", "depth", *NODE))
    below = cut_lineage(leaf_paths.groupBy(*NODE).agg(F.count("*").alias("n_leaves"), F.min("conv_id").alias("_owner")))

    # nodes with one member save nothing, nor does anything below them
    shared = nodes.filter("n_convs > 1").join(below, NODE)
    owned = shared.select(F.col("_owner").alias("conv_id"), "depth", ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    on_paths = leaf_paths.join(shared.select(*NODE), NODE, "left_semi").join(owned, ["conv_id", "depth"], "left")
    on_paths = on_paths.withColumn("saved", F.coalesce("saved", F.lit(0).cast("long")))
    from_end = running(on_paths, ["conv_id"], F.shiftright(-F.col("depth"), BLOCK), [F.col("depth").desc()], total=["saved"])
    saved = from_end.groupBy(*NODE).agg(F.sum("saved").alias("saved_tokens"))

    names = nodes.join(parents, NODE).select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    joined = nodes.join(below, NODE).join(parents, NODE, "left").join(saved, NODE, "left").join(end_lists(members), NODE, "left").join(names, PARENT, "left")
    none = F.lit(0).cast("long")
    return joined.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", none).alias("n_children"), "n_leaves",
        F.coalesce("saved_tokens", none).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame, rebuild: bool = False) -> DataFrame:
    """One row for every distinct prefix of the conversations, or of the rebuilt ones."""
    rows = cut_lineage(turns(conversations))
    ids = rows.select("conv_id").distinct()
    rebuilt = shared_heads(rows) if rebuild else rows.select("conv_id", (F.col("pos") + 1).alias("depth"), "d1", "d2", "chars")
    return trie(prefixes(rebuilt, ids))

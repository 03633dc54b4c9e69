"""Registered queries of the corpus operators, over the whole ``documents`` table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm import (
    bpe,
    byte_bpe,
    exact_dedup,
    language_id,
    line_dedup,
    merkle,
    near_dedup,
    packing,
    prefix_trie,
    recompression,
    secret_scan,
    sharding,
    token_counts,
)
from tidegauge.llm.common import table

TOKEN_LIMIT = 1024


def op1_exact_dedup(spark: SparkSession, path: str) -> DataFrame:
    found = exact_dedup.duplicates(table(spark, path, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_secret_scan(spark: SparkSession, path: str) -> DataFrame:
    return secret_scan.scan(table(spark, path, "documents")).drop("row_no")


def op3_packing(spark: SparkSession, path: str) -> DataFrame:
    return packing.packed(table(spark, path, "documents"))


def op4_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    return merkle.edited(table(spark, path, "documents"))


def op5_near_dedup(spark: SparkSession, path: str) -> DataFrame:
    like = near_dedup.Similarity(words=3, num=85, den=100)
    found = near_dedup.near_duplicates(table(spark, path, "documents"), like)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), "kept")  # also for rows that repeat an id
    return found.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def op6_token_counts(spark: SparkSession, path: str) -> DataFrame:
    counts = token_counts.count_tokens(table(spark, path, "documents"))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op7_sharding(spark: SparkSession, path: str) -> DataFrame:
    return sharding.shards(table(spark, path, "documents"))


def op8_bpe(spark: SparkSession, path: str) -> DataFrame:
    return bpe.digests(table(spark, path, "documents"))


def op9_line_dedup(spark: SparkSession, path: str) -> DataFrame:
    return line_dedup.duplicate_lines(table(spark, path, "documents")).drop("row_no")


def op10_language_id(spark: SparkSession, path: str) -> DataFrame:
    docs = table(spark, path, "documents")
    out = language_id.held_out()
    profiles = language_id.fit(docs.filter(~out).select("text", "lang"))
    return language_id.predict(docs, profiles).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op11_recompression_runs(spark: SparkSession, path: str) -> DataFrame:
    return recompression.run_report(table(spark, path, "documents"), plant=True)


def op12_prefix_trie(spark: SparkSession, path: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, path, "conversations"), rebuild=True)


def op13_byte_bpe(spark: SparkSession, path: str) -> DataFrame:
    return byte_bpe.digests(table(spark, path, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_exact_dedup, op2_secret_scan, op3_packing, op4_fingerprints, op5_near_dedup,
        op6_token_counts, op7_sharding, op8_bpe, op9_line_dedup, op10_language_id,
        op11_recompression_runs, op12_prefix_trie, op13_byte_bpe,
    )
}

SQL: dict[str, str] = {
    "op1_exact_dedup": r"""
with bare as (
  select doc_id, length(coalesce(text, '')) as chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as bare
  from documents)
select doc_id,
       first_value(doc_id) over w as keep_id,
       count(*) over (partition by bare) as group_size,
       row_number() over w = 1 as kept,
       sha256(bare) as text_sha256
from bare
window w as (partition by bare order by chars desc, doc_id)""",
    "op5_near_dedup": r"""
with recursive words as (
  select doc_id, list_filter(string_split_regex(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents),
sets as (
  select doc_id, unnest(case when len(w) = 0 then []::varchar[] when len(w) < 3 then [array_to_string(w, ' ')]
           else list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' '))) end) as s
  from words),
sizes as (select doc_id, count(*) as n from sets group by doc_id),
common as (
  select a.doc_id as a, b.doc_id as b, count(*) as n
  from sets a join sets b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
links as (
  select c.a, c.b from common c join sizes x on x.doc_id = c.a join sizes y on y.doc_id = c.b
  where 100 * c.n >= 85 * (x.n + y.n - c.n)),
both_ways as (select a, b from links union all select b, a from links),
reach as (
  select doc_id, doc_id as other from documents
  union
  select r.doc_id, e.b from reach r join both_ways e on e.a = r.other),
named as (select doc_id, min(other) as component_id from reach group by doc_id)
select d.doc_id, coalesce(z.n, 0) as n_shingles, g.component_id, d.doc_id = g.component_id as kept
from documents d join named g on g.doc_id = d.doc_id left join sizes z on z.doc_id = d.doc_id""",
    "op12_prefix_trie": r"""
with recursive ordered as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
         row_number() over (partition by conv_id order by turn nulls first) - 1 as pos
  from conversations where conv_id is not null),
bits as (
  select conv_id, 4294967295 as crc, cast(conv_id as varchar) as rest, 0 as k from (select distinct conv_id from ordered) as c
  union all
  select conv_id, case when k = 0 then xor(crc, ascii(rest)) else case when crc % 2 = 1 then xor(crc // 2, 3988292384) else crc // 2 end end,
         case when k = 8 then substr(rest, 2) else rest end, (k + 1) % 9
  from bits where rest <> ''),
heads as (select conv_id, conv_id - conv_id % 100 as base, xor(crc, 4294967295) % 6 as h from bits where rest = ''),
rebuilt as (
  select h.conv_id, 0 as part, o.pos, o.role, o.text from heads h join ordered o on o.conv_id = h.base and o.pos < h.h
  union all
  select h.conv_id, 1, o.pos, o.role, o.text from heads h join ordered o on o.conv_id = h.conv_id and o.pos >= h.h),
items as (
  select conv_id, row_number() over w as depth, length(text) as chars, list({'role': role, 'text': text}) over w as path
  from rebuilt window w as (partition by conv_id order by part, pos)),
paths as (
  select conv_id, depth, chars, path from items
  union all
  select conv_id, 0, 0, [] from heads),
nodes as (
  select path, any_value(depth) as depth, any_value(chars) as chars, min(conv_id) as conv_id, count(*) as n_convs
  from paths group by path),
ends as (
  select path, sha256(string_agg(cast(conv_id as varchar), ',' order by conv_id)) as ends_sha256
  from (select conv_id, max_by(path, depth) as path from paths group by conv_id) as e group by path),
children as (
  select p.path, count(c.path) as n_children
  from nodes p left join nodes c on c.depth = p.depth + 1 and c.path[:p.depth] = p.path group by p.path),
below as (
  select a.path, sum((u.n_convs - 1) * u.chars) as saved_tokens, count(*) filter (k.n_children = 0) as n_leaves
  from nodes u join children k on k.path = u.path join paths a on a.conv_id = u.conv_id and a.depth <= u.depth group by a.path)
select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n_convs, c.n_children, b.n_leaves, cast(b.saved_tokens as bigint) as saved_tokens,
       coalesce(e.ends_sha256, sha256('')) as ends_sha256
from nodes n join children c on c.path = n.path join below b on b.path = n.path
left join ends e on e.path = n.path
left join nodes p on p.depth = n.depth - 1 and p.path = n.path[:n.depth - 1]""",
}

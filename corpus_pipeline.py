"""Text-corpus pipeline: each stage works on all that the one before it kept.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last return the columns of
``documents``. ``run`` writes each stage's result to the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm import exact_dedup, language_id, near_dedup, packing, secret_scan
from tidegauge.llm.common import table
from tidegauge.session import cut_lineage

DIM = 4096  # unrelated texts then have cosines with a deviation of 1 / 64
KNOWN = 0.5  # share of letters that must have been learned


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter and those that resemble no learned language.

    Floors of the score come from the learned rows, by language and length of text; most letters
    of a text must be learned ones. When no row has a language nothing can be learned and only texts without letters go.
    """
    learned = docs.filter(~language_id.held_out()).select("text", "lang")
    profiles = language_id.fit(learned, DIM)
    if not profiles.langs:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    columns = docs.columns
    keep = docs.select(*[F.col(f"`{c}`").alias(f"_tg_{i}") for i, c in enumerate(columns)], F.col("text").alias("text"))
    judged = language_id.predict(keep, profiles, [f"_tg_{i}" for i in range(len(columns))], True)
    floors = language_id.floors(learned, profiles)
    floor = F.lit(0.0)
    for (lang, size), least in sorted(floors.items()):
        floor = F.when((F.col("lang_pred") == lang) & (F.col("size") == size), F.lit(least)).otherwise(floor)
    stay = judged.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("known") >= KNOWN) & (F.col("score") >= floor))
    return stay.select(*[F.col(f"_tg_{i}").alias(c) for i, c in enumerate(columns)])


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal without white space."""
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: shingles of five words, similarity 0.8."""
    return near_dedup.deduplicate(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked."""
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    return packing.packed(docs)


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("secret_scan", secrets),
    ("packing", pack),
]

#: Language profiles, the forest and tokenizing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

"""Schema resolution: which physical column carries each logical variable in each wave.

Inputs are header tables (wave, name, pos); pos is the column's place in the file.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.functions.codes import CATALOGUE, FAMILIES, PER_WAVE
from tidegauge.session import attach, local_rows


def header_table(spark: SparkSession, headers: Mapping[int, Sequence[str]]) -> DataFrame:
    rows = [(w, name, i) for w, names in headers.items() for i, name in enumerate(names)]
    return local_rows(spark, rows, "wave int, name string, pos int")


def alias_table(spark: SparkSession, catalogue: Mapping[str, Sequence[str]] = CATALOGUE) -> DataFrame:
    rows = [(k, a, i) for k, names in catalogue.items() for i, a in enumerate(names)]
    return local_rows(spark, rows, "logical string, alias string, priority int")


def logical_table(spark: SparkSession, catalogue: Mapping[str, Sequence[str]] = CATALOGUE) -> DataFrame:
    return local_rows(spark, [(k,) for k in catalogue], "logical string")


def by_alias(columns: DataFrame, aliases: DataFrame) -> DataFrame:
    """First alias in catalogue order that the wave has."""
    return (
        columns.join(aliases, columns["name"] == aliases["alias"])
        .groupBy("wave", "logical")
        .agg(F.min_by("name", "priority").alias("physical"))
    )


def by_family(columns: DataFrame, families: Mapping[str, str] = FAMILIES) -> DataFrame:
    """First column in file order whose name starts with the family pattern, ignoring case."""
    hits = F.filter(
        F.array(
            *[F.when(F.col("name").rlike(f"(?i)^(?:{p})"), F.lit(k)) for k, p in families.items()]
        ),
        lambda x: x.isNotNull(),
    )
    return (
        columns.select("wave", "name", "pos", F.explode(hits).alias("logical"))
        .groupBy("wave", "logical")
        .agg(F.min_by("name", "pos").alias("physical"))
    )


def resolve(columns: DataFrame, aliases: DataFrame, families: Mapping[str, str] = FAMILIES) -> DataFrame:
    """(wave, logical, physical): family rule where there is one, alias rule otherwise."""
    plain = by_alias(columns, aliases).filter(~F.col("logical").isin(*families))
    return by_family(columns, families).unionByName(plain)


def missing_report(resolved: DataFrame, logical: DataFrame, waves: DataFrame) -> DataFrame:
    """Per wave: number found and the sorted names without a hit."""
    catalogue = logical.agg(F.sort_array(F.collect_list("logical")).alias("all"))
    found = resolved.groupBy("wave").agg(F.collect_set("logical").alias("hit"))
    return (
        attach(waves.select("wave").distinct(), catalogue, [])
        .join(found, "wave", "left")
        .select(
            "wave",
            F.coalesce(F.size("hit"), F.lit(0)).alias("n_found"),
            F.array_join(
                F.array_except("all", F.coalesce("hit", F.array().cast("array<string>"))), ","
            ).alias("missing"),
        )
    )


def canonical_choice(resolved: DataFrame, per_wave: Sequence[str] = PER_WAVE) -> DataFrame:
    """(logical, physical, n_waves): the name seen in most waves, later last wave on ties."""
    return (
        resolved.filter(~F.col("logical").isin(*per_wave))
        .groupBy("logical", "physical")
        .agg(F.count("*").alias("n_waves"), F.max("wave").alias("last_wave"))
        .groupBy("logical")
        .agg(
            F.max_by("physical", F.struct("n_waves", "last_wave")).alias("physical"),
            F.max("n_waves").alias("n_waves"),
        )
    )


def wave_overrides(resolved: DataFrame, per_wave: Sequence[str] = PER_WAVE) -> DataFrame:
    return resolved.filter(F.col("logical").isin(*per_wave))


def mapping_table(
    columns: DataFrame, aliases: DataFrame, resolved: DataFrame, per_wave: Sequence[str] = PER_WAVE
) -> DataFrame:
    """(wave, logical, physical, rule): override, else the winner if the wave has it, else alias."""
    names = columns.select("wave", F.col("name").alias("physical"))
    waves = columns.select("wave").distinct()
    winner = canonical_choice(resolved, per_wave).select("logical", "physical")
    # candidates: (wave, logical, physical) from each rule, lowest rank wins
    override = wave_overrides(resolved, per_wave).select(
        "wave", "logical", "physical", F.lit(0).alias("rank"), F.lit("override").alias("rule")
    )
    chosen = names.join(winner, "physical").select(
        "wave", "logical", "physical", F.lit(1).alias("rank"), F.lit("winner").alias("rule")
    )
    alias = by_alias(columns, aliases).select(
        "wave", "logical", "physical", F.lit(2).alias("rank"), F.lit("alias").alias("rule")
    )
    best = Window.partitionBy("wave", "logical").orderBy("rank")
    return (
        override.unionByName(chosen)
        .unionByName(alias)
        .join(waves, "wave", "left_semi")
        .withColumn("_r", F.row_number().over(best))
        .filter(F.col("_r") == 1)
        .select("wave", "logical", "physical", "rule")
    )


def mapping_dict(mapping: DataFrame) -> dict[int, dict[str, str]]:
    """Mapping as nested dict (18 names per wave), used to build the select lists."""
    out: dict[int, dict[str, str]] = {}
    for r in mapping.collect():
        out.setdefault(r["wave"], {})[r["logical"]] = r["physical"]
    return out


def require_columns(df: DataFrame, required: Sequence[str]) -> None:
    """Fail before any work when required columns are missing."""
    lacking = sorted(set(required) - set(df.columns))
    if lacking:
        raise ValueError(f"missing columns: {', '.join(lacking)}")


def has_columns(df: DataFrame, names: Sequence[str]) -> bool:
    return set(names) <= set(df.columns)

"""Session settings and the few helpers that talk to the session."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def local_session(cores: int = 8, name: str = "tidegauge") -> SparkSession:
    """Session for tests and the bench. On a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder of this application below the cluster's shared folder (spark.checkpoint.dir).

    Where that setting is absent a local session, as in tests, gets a scratch folder; on a cluster
    it is an error, since executors do not share local folders. Everything the library keeps
    lies below one folder per application, which can be dropped afterwards.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidegauge-"))
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/tidegauge-{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a result that several steps read to the shared folder and read it back.

    The table survives lost executors, is computed once, and its size on disk tells Spark
    whether it can be broadcast.
    """
    folder = new_folder(df.sparkSession, "step")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def local_rows(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Frame of a few driver-side rows (settings, fitted terms) as a local relation."""
    kind = StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)
    columns = list(zip(*rows)) if rows else [()] * len(kind.names)
    table = pa.table([pa.array(list(c), f.type) for c, f in zip(columns, arrow)], schema=arrow)
    return spark.createDataFrame(table, kind)


def small_table(df: DataFrame) -> DataFrame:
    """A fitted summary (medians, cut-offs, level weights) as a stored table.

    It is computed once, whatever joins it, and nothing reaches the driver. Whether it is
    broadcast follows from its measured size in bytes; beyond Spark's limit the join shuffles.
    """
    return cut_lineage(df)


def attach(df: DataFrame, summary: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join a summary to rows on ``keys``, null-safe, without naming a strategy.

    Without keys the summary is one row of totals; its values become literals.
    """
    if not keys:
        rows = summary.take(2)
        if len(rows) != 1:
            raise ValueError("a summary without keys must have one row")
        kinds = {f.name: f.dataType for f in summary.schema.fields}
        return df.withColumns({k: F.lit(v).cast(kinds[k]) for k, v in rows[0].asDict().items()})
    right = summary.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys],
        *[c for c in summary.columns if c not in keys],
    )
    cond = None
    for k in keys:
        eq = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        cond = eq if cond is None else cond & eq
    return df.join(right, cond, how).drop(*[f"_r_{k}" for k in keys])

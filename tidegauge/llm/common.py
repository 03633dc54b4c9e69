"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 1024


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def map_rows(df: DataFrame, fn: Callable[[Iterator[dict]], Iterator[dict]], schema: str, rows: int = 4096) -> DataFrame:
    """mapInArrow for functions on columns: ``fn`` gets and yields dicts of name -> list.

    A yielded dict holds equally long lists. Input batches are re-cut to ``rows`` rows at most,
    so that the Python side of a task holds few texts at a time. Spark is told to send
    ``BATCH_ROWS`` rows at most in a batch, which both sides hold whole.
    """
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(BATCH_SETTING)) <= BATCH_ROWS:
        conf.set(BATCH_SETTING, str(BATCH_ROWS))
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        def columns():
            for whole in batches:
                for at in range(0, whole.num_rows, rows):
                    b = whole.slice(at, rows)
                    yield {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}

        for got in fn(columns()):
            arrays = [pa.array(got[f.name], f.type) for f in out]
            yield pa.RecordBatch.from_arrays(arrays, schema=out)

    return df.mapInArrow(run, schema)


def row_key(*columns: Column) -> Column:
    """One string that names a row by some columns, nulls included."""
    return F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("~")) for c in columns])


def keep_rows(docs: DataFrame, key: Column, keepers: DataFrame, order: list[Column]) -> DataFrame:
    """Rows of ``docs`` whose key is in ``keepers`` (a column ``_tg_key``), one row for each key.

    Of rows with the same key the first in ``order`` stays. All columns are kept. The documents
    are shuffled once: join and rank share the distribution by key.
    """
    from pyspark.sql import Window

    keyed = docs.withColumn("_tg_key", key)
    kept = keyed.join(keepers.select("_tg_key").distinct(), "_tg_key", "left_semi")
    w = Window.partitionBy("_tg_key").orderBy(*order)
    return (
        kept.withColumn("_tg_rank", F.row_number().over(w))
        .filter("_tg_rank = 1")
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )


class Memo(dict):
    """Results of a pure function, kept in two bounded generations inside one worker."""

    def __init__(self, fn: Callable, keep: int = 200_000):
        super().__init__()
        self.fn, self.keep, self.old = fn, keep, {}

    def __missing__(self, key):
        got = self.old.get(key)
        if got is None:
            got = self.fn(key)
        if len(self) >= self.keep:
            self.old = dict(self)
            self.clear()
        self[key] = got
        return got


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}
    extra = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(extra)) for b in range(256)]

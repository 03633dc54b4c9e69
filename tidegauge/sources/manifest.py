"""File checksums and drift against an earlier inventory.

Files are read as bytes by Spark's text reader, cut behind one mark and hashed piece by piece in their order. Any store
that Spark reads will do, nothing is shuffled, and a task holds a batch of pieces, not a file. The bytes hashed must be
as many as the file has: a file with too long a piece, whose first bytes the reader took for a byte-order mark, or whose
reading ended early is read once more in another way. An error that stays is raised by the last of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.session import cut_lineage, new_folder

MIN_BYTES = 1024  # fixed value: smaller files are not listed
LONGEST = 4 << 20  # bytes between two marks that a task holds
BOM = b"\xef\xbb\xbf"  # the reader leaves it out at the start of a file
# (mark, first bytes that the reader left out): the first way makes long pieces of compressed tables, the next ones cut texts
WAYS = [(b"\0\1", b""), *[(mark, lead) for mark in (b"\n", b" ", b"\0", b"\xff") for lead in (b"", BOM)]]
PACKED = r"\.(bz2|deflate|gz|gzip|lz4|snappy|zst|zstd)$"  # names whose content the reader would unpack
UNCUT = 1 << 40  # a file is never cut, and shares no task with another
LINE_LIMIT = "mapreduce.input.linerecordreader.line.maxlength"
FOUND = "file string, sha256 string"


def _reader_session(spark: SparkSession) -> SparkSession:
    """Session with the caller's settings in which one task reads one file from start to end."""
    own = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if own.conf.isModifiable(name):
            own.conf.set(name, value)
    for name in ("maxPartitionBytes", "openCostInBytes"):
        own.conf.set(f"spark.sql.files.{name}", str(UNCUT))
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(1 << 16))
    own.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(LONGEST))
    return own


def _listed() -> Column:
    return (F.col("_metadata.file_size") >= MIN_BYTES) & ~F.lower("_metadata.file_name").endswith(".json")


def _suffix() -> Column:
    return F.regexp_extract(F.lower("_metadata.file_name"), PACKED, 0)


def _hasher(mark: bytes, lead: bytes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Turns batches of (file, size, piece) into ``FOUND`` of the files that came whole.

    The pieces of such a file are as long as the file, or one mark longer where it does not end with the mark.
    """
    whole = (0, -len(mark))

    def content(pieces):  # bytes of all pieces, not copied
        ends = memoryview(pieces.buffers()[1]).cast("q" if pa.types.is_large_binary(pieces.type) else "i")
        return memoryview(pieces.buffers()[2])[ends[pieces.offset] : ends[pieces.offset + len(pieces)]]

    def found(name, digest):
        return pa.RecordBatch.from_pydict({"file": [name], "sha256": [digest.hexdigest()]})

    def run(batches):
        name, left, digest = None, None, None
        for batch in batches:
            runs, start = pc.run_end_encode(batch.column(0)), 0
            for file, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
                if file != name:
                    if left in whole:
                        yield found(name, digest)
                    name, left, digest = file, batch.column(1)[start].as_py() - len(lead), hashlib.sha256(lead)
                data = content(batch.column(2).slice(start, end - start))
                digest.update(data[: max(left, 0)])
                left -= len(data)
                start = end
        if left in whole:
            yield found(name, digest)

    return run


def _pieces(own: SparkSession, files: str, suffix: str, mark: bytes) -> DataFrame:
    """(file, size, piece) of files with this suffix of ``PACKED`` or none, in their order."""
    passthrough = "compress.passthrough.extension"
    raw = {f"{where}io.{passthrough}": suffix or ".none" for where in ("", "org.apache.hadoop.shaded.")}
    raw["io.compression.codecs"] = "org.apache.hadoop.io.compress.PassthroughCodec"
    cut = {"lineSep": mark.decode("latin-1"), "encoding": "ISO-8859-1", LINE_LIMIT: LONGEST}
    rows = own.read.format("text").options(recursiveFileLookup=True, ignoreCorruptFiles=True, **raw, **cut).load(files)
    piece = F.concat(F.col("value").cast("binary"), F.lit(mark))
    return rows.filter(_listed() & (_suffix() == suffix)).select("_metadata.file_path", "_metadata.file_size", piece)


def checksums(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, sha256) of files of at least 1 KiB, JSON files left out. One task reads one file.

    ``pattern`` matches files of the folder or folders in it, whose files are all listed. Files that no
    way cuts are read whole, which is an error above 2 GiB.
    """
    whole = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{folder}/{pattern}").filter(_listed())
    at = F.col("_metadata.file_path")
    files = cut_lineage(whole.select("path", at.alias("file"), _suffix().alias("suffix")))
    out, own, names = new_folder(spark, "checksums"), _reader_session(spark), None
    suffixes = {"", *(r.suffix for r in files.select("suffix").distinct().collect())}
    for mark, lead in WAYS:
        for suffix in suffixes:
            rows = _pieces(own, f"{folder}/{pattern}", suffix, mark)
            rows = rows if names is None else rows.filter(at.isin(names))
            rows.mapInArrow(_hasher(mark, lead), FOUND).write.mode("append").parquet(out)
        rest = files.join(spark.read.schema(FOUND).parquet(out), "file", "left_anti").collect()
        names, suffixes = [r.file for r in rest], {r.suffix for r in rest}
        if not names:
            break
    else:
        found = whole.filter(at.isin(names)).select(at.alias("file"), F.sha2("content", 256).alias("sha256"))
        found.write.mode("append").parquet(out)
    return files.join(spark.read.schema(FOUND).parquet(out), "file").select("path", "sha256")


def drift(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Files whose checksum differs from the earlier inventory."""
    old = previous.select("path", F.col("sha256").alias("previous"))
    return current.join(old, "path", "left").filter(
        F.col("previous").isNotNull() & (F.col("previous") != F.col("sha256"))
    )


def write_manifest(df: DataFrame, path: str) -> str:
    """Text lines of "hash  path"."""
    df.select(F.concat_ws("  ", "sha256", "path").alias("value")).write.mode("overwrite").text(path)
    return path


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    parts = F.split("value", "  ", 2)
    return spark.read.text(path).select(parts[1].alias("path"), parts[0].alias("sha256"))

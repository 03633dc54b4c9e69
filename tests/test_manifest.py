"""Checksums of files that no task may hold whole, cut in any way."""

import contextlib
import hashlib
import os
import random

import pytest

import __spark_entry__
from conftest import DATA
from tidegauge.session import new_folder
from tidegauge.sources import manifest

BOM = b"\xef\xbb\xbf"
NOISE = random.Random(5).randbytes(300_000)
ODD = {
    "noise.parquet": NOISE,
    "ends_with_mark.parquet": NOISE[:9_000] + b"\0\1",
    "ends_with_half_a_mark.parquet": NOISE[:9_000] + b"\0",
    "marks_only": b"\0\1" * 3_000,
    "no_suffix": NOISE[5:],
    "unpacked.gz": NOISE[7:],
    "UNPACKED.ZST": NOISE[9:],
    "a b%20[1]*.bz2": NOISE[11:],
    "lines.csv": b"1,2,3\n" * 50_000,
    "mark_of_order.csv": BOM + b"1,2,3\r\n" * 50_000,
    "words": b"one two " * 20_000,
    "zeros": bytes(100_000),
    "ones": BOM + b"\xff" * 100_000,
    "nothing_to_cut": b"a" * 100_000,
    "deep.parquet/of/part-0": NOISE[13:],
    "least": b"b" * 1024,
    "too_small": b"b" * 1023,
    "left_out.json": NOISE,
    "_hidden": NOISE,
}


@contextlib.contextmanager
def settings(spark, **values):
    before = {k: spark.conf.get(k) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def small_tasks(spark, most: int):
    """A task gets at most so many bytes of a file, and none may be held whole."""
    return settings(spark, **{"spark.sql.sources.binaryFile.maxLength": str(most), "spark.sql.files.maxPartitionBytes": str(most)})


def sha256(content: bytes) -> str:
    return hashlib.sha256(content).hexdigest()


def written(spark, files: dict[str, bytes]) -> str:
    base = new_folder(spark, "files").removeprefix("file:")
    for name, content in files.items():
        os.makedirs(os.path.dirname(f"{base}/{name}"), exist_ok=True)
        with open(f"{base}/{name}", "wb") as f:
            f.write(content)
    return base


def test_files_are_not_held_whole(spark):
    files = {f"{i}.parquet": NOISE[i:] for i in range(3)}
    base = written(spark, files)
    with small_tasks(spark, 65_536):
        got = manifest.checksums(spark, base, "*.parquet").collect()
    assert sorted(got) == [(f"file:{base}/{name}", sha256(content)) for name, content in sorted(files.items())]


@pytest.mark.parametrize("longest", [4096, 4 << 20])
def test_any_content_and_name(spark, monkeypatch, longest):
    monkeypatch.setattr(manifest, "LONGEST", longest)
    base = written(spark, ODD)
    got = {r.path: r.sha256 for r in manifest.checksums(spark, base).collect()}
    want = {f"file:{base}/{n}": sha256(c) for n, c in ODD.items() if n not in ("too_small", "left_out.json", "_hidden")}
    assert got == want


@pytest.mark.parametrize("name", ["checksum_drift", "file_checksums"])
def test_queries_hold_no_file(spark, name):
    if not os.path.isdir(DATA):
        pytest.skip("no data folder")
    want = set()
    for f in os.listdir(DATA):
        with open(f"{DATA}/{f}", "rb") as opened:
            content = opened.read()
        if f.endswith(".parquet") and len(content) >= manifest.MIN_BYTES:
            want.add((f"file:{DATA}/{f}", sha256(content)))
    if name == "checksum_drift":
        want = {(path, digest, "0") for path, digest in want if path.endswith("/part.parquet")}
    with small_tasks(spark, 1024):
        assert set(map(tuple, __spark_entry__.queries()[name](spark, DATA).collect())) == want

"""The corpus pipeline on a small table, stage by stage against brute force."""

import hashlib
import importlib.util
import os
import random

import pytest

from fixtures import CLASHING, COLUMNS, corpus, frame, odd_rows
from test_exact_dedup import bare
from test_near_dedup import brute

import corpus_pipeline as p
from tidegauge.llm import language_id
from tidegauge.llm.common import table
from tidegauge.llm.queries import QUERIES, SQL


def test_stages_against_brute_force(spark, tmp_path):
    rows = corpus(7)
    key = hashlib.sha1(b"k").hexdigest()
    rows += [(5000 + i, f'Some quite ordinary words stand here number{i} token = "{key}" and go on for a while', "en", "s", 90) for i in range(3)]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(p.STAGES)

    kept = stages["language_id"](spark, docs, str(tmp_path))
    assert kept.schema == docs.schema
    ids = {r.doc_id for r in kept.collect()}
    assert ids <= {r[0] for r in rows} and not any(r[0] in ids for r in rows if not any(c.isalpha() for c in r[1] or ""))
    assert len(ids) > 0.9 * sum(any(c.isalpha() for c in r[1] or "") for r in rows)
    left = [r for r in rows if r[0] in ids]

    exact = stages["exact_dedup"](spark, kept, str(tmp_path))
    groups = {}
    for r in left:
        groups.setdefault(bare(r[1]), []).append((-len(r[1]), r[0]))
    want = {min(g)[1] for g in groups.values()}
    assert sorted(r.doc_id for r in exact.collect()) == sorted(want)
    left = [r for r in left if r[0] in want]

    near = stages["near_dedup"](spark, exact, str(tmp_path))
    _, root = brute(left, 5, 80, 100)
    assert sorted(r.doc_id for r in near.collect()) == sorted({root[r[0]] for r in left})

    clean = stages["secret_scan"](spark, near, str(tmp_path))
    assert clean.count() == near.count() and clean.schema == docs.schema
    assert clean.filter(clean.text.contains(key)).count() == 0
    packed = stages["packing"](spark, clean, str(tmp_path))
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {root[r[0]] for r in left}
    whole = p.run(spark, str(tmp_path))
    assert whole.columns == packed.columns
    assert sorted(map(str, whole.select("doc_id", "start", "length", "ids_crc32").collect())) == sorted(map(str, packed.select("doc_id", "start", "length", "ids_crc32").collect()))


@pytest.mark.parametrize("name,stage", p.STAGES)
def test_stages_on_odd_and_empty_tables(spark, name, stage):
    for docs in (frame(spark, odd_rows(), CLASHING, 2), spark.createDataFrame([], COLUMNS)):
        out = stage(spark, docs, "")
        assert out.count() <= docs.count()
        assert name == "packing" or out.columns == docs.columns


def test_language_stage_drops_noise_and_keeps_short_texts(spark, tmp_path):
    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("no data folder")
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rng = random.Random(2)
    words = [w for r in docs.filter("n_chars > 300").limit(200).collect() for w in r.text.split()[5:25] if w.isalpha()]
    short = [(10**9 + i, " ".join(words[i * 3 : i * 3 + 1 + i % 3]), None, None, None) for i in range(300)]

    def noise(signs):
        return " ".join("".join(rng.choice(signs) for _ in range(rng.randint(2, 9))) for _ in range(60))

    scripts = ["абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω", "".join(chr(0x4E00 + i) for i in range(3000)), "abcdefghijklmnopqrstuvwxyz"]
    bad = [(2 * 10**9 + i, noise(scripts[i % 4]), None, None, None) for i in range(200)]
    kept = p.language(spark, docs.unionByName(spark.createDataFrame(short + bad, docs.schema)), "").select("doc_id").collect()
    ids = {r.doc_id for r in kept}
    assert [r[1] for r in short if r[0] not in ids] == []
    assert [r[1] for r in bad if r[0] in ids] == []


def test_registered_with_the_library():
    import __spark_entry__ as e

    names = e.queries()
    assert "pipeline" in names and set(QUERIES) <= set(names) and set(SQL) <= set(e.oracle_sql())
    assert len(QUERIES) == 13 and importlib.util.find_spec("tidegauge.llm") and language_id.UNKNOWN == "und"

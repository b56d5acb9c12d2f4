"""The pipeline, stage by stage, against plain decisions; the registry; the absent package."""

from __future__ import annotations

import random
import subprocess
import sys
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_lsh_forest import brute
from tests.llm.test_text_operators import base_spans
from tradeloom.llm import packing, queries
from tradeloom.llm.common import fold
from tradeloom.llm.tiling import Block

SMALL = "/root/testdata/sf0.001"


def test_stages_decide_as_plain_versions(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, inputs = docs.columns, docs.collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, spark.createDataFrame(inputs, docs.schema) if number else docs, SMALL)
        kept = docs.collect()
        if number == 0:
            gone = {r.doc_id for r in inputs} - {r.doc_id for r in kept}
            wrong = sum((labels[k] == 1) == (k in gone) for k in labels)
            assert gone and wrong <= 0.1 * len(labels)
        elif number == 1:
            want = {top for top, *_ in brute([(r.doc_id, r.text) for r in inputs]).values()}
            assert sorted(r.doc_id for r in kept) == sorted(want)
        elif number == 2:
            block = Block.of(items, 4)
            want = [r for r in inputs if not any(x[4] >= 0.5 for x in block.leaks(r.text, 0))]
            assert sorted(kept) == sorted(want) and len(kept) < len(inputs)
        elif number == 3:
            for before, after in zip(sorted(inputs), sorted(kept), strict=True):
                text, at = "", 0
                for begin, _, end, kind in base_spans(before.text):
                    text += before.text[at:begin] + f"[{kind.upper()}]"
                    at = end
                assert after.text == text + before.text[at:] and before.doc_id == after.doc_id
        else:
            assert sum(r.length for r in kept) == sum(len(packing.token_ids(r.text, None)) for r in inputs)
        if number < 4:
            assert docs.columns == columns
            assert number == 3 or set(map(tuple, kept)) <= set(map(tuple, inputs))
        inputs = kept


def test_run_gives_the_last_stage(spark):
    got = corpus_pipeline.run(spark, SMALL)
    assert got.count() > 50 and "sequence_id" in got.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "n-gram jaccard join", "benchmark decontamination", "personal data", "packing"]


@pytest.mark.parametrize("case", ["empty", "odd"])
def test_stages_bear_odd_rows(spark, case, tmp_path):
    chance = random.Random(1)
    text = " ".join(f"w{chance.randrange(900)}" for _ in range(300))
    rows = [] if case == "empty" else [
        (1, None, None, None, None, "c"), (2, "", "en", "s", 0, None), (3, text, "en", "s", 5, "c"), (3, text, "en", "s", 5, "c"),
        (None, text, None, "s", 5, "c"), (4, "x " * 100_000, "de", None, 9, "c"), (5, text + " a@b.cd", "en", "s", None, "c")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, quality string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, 1, 0)][: len(rows)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None)][: len(rows)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert (got.count() == 0) == (case == "empty")


def test_fold_is_crc32(spark):
    rows = spark.range(50).select("id", fold(F.col("id"), 7).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 7 for r in rows)


def test_all_are_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES) == list(range(1, len(queries.QUERIES) + 1))
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def test_entry_imports_without_this_package():
    root = Path(__file__).resolve().parents[2]
    code = (
        "import sys, importlib.util as u; real = u.find_spec\n"
        "u.find_spec = lambda name, *a: None if name in ('tradeloom.llm', 'corpus_pipeline') else real(name, *a)\n"
        "import __spark_entry__ as e; assert 'pipeline' not in e.queries() and len(e.queries()) > 50"
    )
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)

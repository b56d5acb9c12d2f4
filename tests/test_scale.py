"""Work is dealt to all tasks, and workers hold little, however the tables are cut into files."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tradeloom.operators import candidates as cand
from tradeloom.plans import details, reports, workloads
from tradeloom.sources import xmlnodes

WORDS = ("blue", "red", "green", "large", "small"), ("anvil", "rod", "ring", "hammer")


@pytest.fixture(scope="module")
def one_file(tmp_path_factory):
    """Parts in one file of one row group, which is read by one task though it may have many splits."""
    folder = tmp_path_factory.mktemp("parts")
    rows = [{"p_partkey": k, "p_name": f"{WORDS[0][k % 5]} {WORDS[1][k % 4]}", "p_brand": f"Brand#{k % 9}",
             "p_type": ("STEEL", "TIN", "WOOD PLATED")[k % 3], "p_size": k % 50, "p_retailprice": k / 4} for k in range(4000)]
    table = pa.Table.from_pylist(rows).cast(pa.schema([
        ("p_partkey", pa.int64()), ("p_name", pa.string()), ("p_brand", pa.string()), ("p_type", pa.string()),
        ("p_size", pa.int32()), ("p_retailprice", pa.float64())]))
    pq.write_table(table, f"{folder}/part.parquet", row_group_size=10_000)
    return str(folder)


@pytest.mark.parametrize("query", [details.vocabulary_class_rows, reports.nested_lists])
def test_values_are_parsed_in_all_tasks(spark, one_file, query):
    counts = query(spark, one_file).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(counts) >= 8 and max(r["count"] for r in counts) < 1000


def test_many_splits_of_one_row_group_are_dealt(spark, one_file):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = workloads.table(spark, one_file, "part")
        assert rows.rdd.getNumPartitions() >= 8
        sizes = [len(p) for p in workloads.deal(rows).rdd.glom().collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sum(sizes) == 4000 and max(sizes) < 1000


def test_no_task_holds_the_postings(spark, one_file, monkeypatch):
    kept, staged = {}, cand.staged

    def keep(rows, name):
        kept[name] = staged(rows, name)
        return kept[name]

    monkeypatch.setattr(cand, "staged", keep)
    assert workloads.evidenced_candidates(spark, one_file, 3).count() == 60
    files = kept["postings"].groupBy(F.input_file_name().alias("file")).count().collect()
    assert len(files) >= 8 and max(r["count"] for r in files) < 0.3 * sum(r["count"] for r in files)


def test_shredded_batches_are_small():
    item = b"<a>" + b"<b>word</b>" * 30 + b"</a>"
    long = b"<a>" + b"x" * 1_000_000 + b"</a>"
    for content, count in ((item, 5000), (long, 20)):
        given = pa.RecordBatch.from_arrays([pa.array(range(count)), pa.array([content] * count)], names=["k", "content"])
        parts = list(xmlnodes._shred_batches(iter([given])))
        assert pa.Table.from_batches(parts).column("k").to_pylist() == list(range(count))
        assert max(p.get_total_buffer_size() - given.get_total_buffer_size() for p in parts) < 12_000_000

"""Archives, directories, output names, sinks and the landing stream."""

from __future__ import annotations

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tests.samples import FAULTY, FULL, wrap
from tradeloom.operators import batch
from tradeloom.plans.convert import convert
from tradeloom.sinks import writers
from tradeloom.sinks import commits
from tradeloom.sources import files
from tradeloom.sources.files import ArchiveLimits, xml_directory, zip_entries
from tradeloom.streaming.landing import convert_landing, landing_documents


def archive(path, entries):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name, content in entries:
            z.writestr(name, content)
    path.write_bytes(buffer.getvalue())


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    return tmp_path / "in"


def test_archive_with_every_kind_of_entry(spark, folder):
    archive(folder / "a.zip", [
        ("ok.XML", FULL), ("notes.txt", b"x"), ("dir/", b""), ("bad.xml", b"<not-closed>"),
        ("../evil.xml", FULL), ("sub/again.xml", FULL), ("big.xml", b"<a>" + b" " * 9000 + b"</a>"),
        ("nogtin one.xml", FAULTY), ("dir2/nogtin_one.xml", FAULTY),
    ])
    limits = ArchiveLimits(max_file_bytes=8000)
    results, converted, refused = batch.convert_archives(
        zip_entries(spark, str(folder), limits))
    rows = results.orderBy("batch_order").collect()
    parts = writers.write_batch(results.drop("batch_order"), str(folder / "export"), converted)
    assert {"products", "mapping_report", "validation_report", "unmapped_fields", "errors"} <= set(parts)
    names = {r.output_name for r in spark.read.json(parts["products"]).collect()}
    assert names == {r.output_name for r in rows if r.status == "success"}
    assert spark.read.json(parts["errors"]).count() == sum(r.status == "error" for r in rows)
    shown = [(r.filename, r.status, r.output_name, r.error_type) for r in rows]
    assert shown == [
        ("../evil.xml", "error", "", "UnsafeZipPath"),
        ("ok.XML", "success", "product_04012345678901", ""),
        ("bad.xml", "error", "", "XMLParseError"),
        ("sub/again.xml", "success", "product_04012345678901_2", ""),
        ("big.xml", "error", "", "FileTooLarge"),
        ("nogtin one.xml", "success", "nogtin_one", ""),
        ("dir2/nogtin_one.xml", "success", "nogtin_one_2", ""),
    ]
    assert rows[1].validation_status == "valid" and rows[1].unmapped_count == 3
    assert rows[5].validation_status == "invalid" and rows[5].safe_filename == "nogtin_one.xml"
    total = batch.batch_totals(results).first()
    assert (total.xml_files_found, total.successful_conversions, total.failed_conversions) == (7, 4, 3)
    assert refused.count() == 0 and converted.count() == 5
    preview = {r.filename: r for r in batch.preview_rows(results).collect()}
    assert preview["big.xml"].error_summary.startswith("FileTooLarge: Uncompressed XML file size")
    assert preview["nogtin one.xml"].gtin_or_output_name == "nogtin_one"


def test_refused_archives(spark, folder):
    archive(folder / "many.zip", [(f"{i}.xml", b"<a/>") for i in range(4)])
    archive(folder / "heavy.zip", [("a.xml", b"<a>" + b"x" * 500 + b"</a>")])
    archive(folder / "none.zip", [("a.txt", b"")])
    (folder / "torn.zip").write_bytes(b"not a zip")
    limits = ArchiveLimits(max_files=3, max_total_bytes=400)
    _, converted, refused = batch.convert_archives(
        zip_entries(spark, str(folder), limits))
    found = {r.archive.rsplit("/", 1)[-1]: r.error_message for r in refused.collect()}
    assert found["many.zip"] == "ZIP contains 4 XML files; max_files is 3."
    assert found["none.zip"] == "No XML files found in ZIP."
    assert found["heavy.zip"].endswith("max_total_uncompressed_size: 507 > 400.")
    assert found["torn.zip"].startswith("Cannot read ZIP file:")
    assert converted.count() == 0
    with pytest.raises(ValueError, match="max_files must be at least 1"):
        ArchiveLimits(max_files=0)


def test_greedy_names_skip_taken_ones(spark):
    bases = ["x", "x_2", "x", "x", "x_2", "y"]
    rows = spark.createDataFrame(
        [("z", i, b, "success") for i, b in enumerate(bases)] + [("z", 9, "x", "error")],
        "archive string, entry_no int, base_name string, status string")
    named = batch.output_names(rows).orderBy("entry_no").collect()
    assert [r.output_name for r in named] == ["x", "x_2", "x_3", "x_4", "x_2_2", "y", ""]


def test_any_number_of_equal_names(spark):
    rows = spark.createDataFrame(
        [(a, i, "x" if i % 2 else f"x_{i}", "success") for a in "ab" for i in range(700)],
        "archive string, entry_no int, base_name string, status string")
    for archive in "ab":
        used = set()
        named = batch.output_names(rows).filter(f"archive = '{archive}'").orderBy("entry_no")
        for r in named.collect():
            name, n = r.base_name, 2
            while name in used:
                name, n = f"{r.base_name}_{n}", n + 1
            used.add(name)
            assert r.output_name == name


def test_corpus_run_and_sinks(spark, folder, tmp_path):
    for name, content in (("full", FULL), ("faulty", FAULTY), ("torn", b"<a")):
        (folder / f"{name}.xml").write_bytes(content)
    (folder / "skip.txt").write_text("x")
    docs = xml_directory(spark, str(folder))
    converted = convert(docs).cache()
    rows = batch.corpus_rows(converted, "file_name", "out/").orderBy("sample_file").collect()
    assert [(r.sample_file, r.conversion_success, r.failure_stage, r.mapped_field_count)
            for r in rows] == [("faulty.xml", False, "validation", 3), ("full.xml", True, "", 14),
                               ("torn.xml", False, "xml_parsing", 0)]
    assert rows[1].jsonld_output_file == "out/product_04012345678901.jsonld"
    assert rows[1].notes == "Converted successfully." and rows[1].unmapped_element_count == 3
    assert batch.corpus_totals(batch.corpus_rows(converted, "file_name")).first().asDict() == {
        "sample_count": 3, "successful_count": 1, "failed_count": 2, "successful": False}
    failed = batch.unusable_profile_rows(docs, "file_name", "it's bad").collect()
    assert {(r.failure_stage, r.exception_message) for r in failed} == {("mapping", "it's bad")}
    paths = writers.write_conversion(converted, str(tmp_path / "out"), ["file_name"])
    assert spark.read.parquet(str(tmp_path / "out" / "runs" / "*" / "converted")).count() == 3
    with pytest.raises(ValueError, match="No XML sample files found"):
        (tmp_path / "none").mkdir()
        xml_directory(spark, str(tmp_path / "none"))
    some = convert(docs, where="file_name = 'full.xml'")
    assert [r.file_name for r in some.select("file_name").collect()] == ["full.xml"]
    assert set(paths) == {"products", "validation", "unmapped", "mapping_report", "errors"}
    products = {r.file_name: r for r in spark.read.json(paths["products"]).collect()}
    assert json.loads(products["full.xml"].jsonld)["@type"] == "gs1:Product"
    assert products["faulty.xml"].gtin == "unknown"
    assert spark.read.json(paths["mapping_report"]).count() == 28
    assert [r.error_type for r in spark.read.json(paths["errors"]).collect()] == ["XMLParseError"]
    written = writers.write_batch(
        batch.file_results(converted.drop("doc_id"), "file_name"), str(tmp_path / "batch"))
    assert spark.read.json(written["files"]).where("status = 'error'").count() == 1
    writers.write_corpus(batch.corpus_rows(converted, "file_name"), str(tmp_path / "corpus"))
    converted.unpersist()


def test_large_archive_is_read_by_many_tasks(spark, folder, monkeypatch):
    monkeypatch.setattr(files, "_PART_ENTRIES", 50)
    bodies = {f"d/{k}.xml": f"<a>{k}</a>".encode() * (1 + k % 7) for k in range(430)}
    archive(folder / "large.zip", [*bodies.items(), ("note.txt", b"x")])
    spoiled = bytearray((folder / "large.zip").read_bytes())
    at = spoiled.index(b"d/7.xml") + len("d/7.xml") + 2
    spoiled[at] ^= 0xFF  # one entry's content no longer matches its checksum
    (folder / "large.zip").write_bytes(bytes(spoiled))
    read = zip_entries(spark, str(folder), ArchiveLimits(max_files=1000)).withColumn("task", F.spark_partition_id())
    rows = {r.entry: r for r in read.collect()}
    bad = rows.pop("d/7.xml")
    assert {k: bytes(r.content) for k, r in rows.items()} == {k: v for k, v in bodies.items() if k != "d/7.xml"}
    assert bad.content is None and bad.error_type in ("BadZipFile", "error") and [r.xml_files for r in rows.values()] == [430] * 429
    assert len({r.task for r in rows.values()}) >= 4 and sorted(r.entry_no for r in [*rows.values(), bad]) == list(range(430))


def test_a_failed_part_leaves_the_last_export(spark, tmp_path):
    path, rows = str(tmp_path / "export"), spark.range(3)
    with pytest.raises(ValueError, match="No complete export"):
        commits.current(spark, path)
    first = writers.write_sections({"a": rows, "b": rows, "c": rows}, path)
    failing = rows.select(F.raise_error(F.lit("third part")).alias("x"))
    with pytest.raises(Exception, match="third part"):
        writers.write_sections({"a": spark.range(9), "b": spark.range(9), "c": failing}, path)
    assert commits.current(spark, path) == first
    assert {n: spark.read.json(p).count() for n, p in commits.current(spark, path).items()} == {"a": 3, "b": 3, "c": 3}
    second = writers.write_sections({"a": spark.range(9)}, path)
    assert commits.current(spark, path) == second != first
    assert spark.read.json(first["c"]).count() == 3  # who still reads the former export is not disturbed


def test_landing_stream_converts_only_what_is_new(spark, folder, tmp_path):
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    (folder / "a.xml").write_bytes(FULL)
    for extra in (None, wrap("<~:gtin>4006381333931</~:gtin>")):
        if extra:
            (folder / "b.xml").write_bytes(extra)
        stream = convert_landing(landing_documents(spark, str(folder)), out, mark)
        assert stream.awaitTermination(120)
    rows = spark.read.parquet(out).collect()
    assert sorted(r.gtin for r in rows) == ["04012345678901", "4006381333931"]

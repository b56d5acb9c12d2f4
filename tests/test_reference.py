"""Vocabulary, explorer, snapshots, attribute sheets and manifests."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tradeloom.functions import linked
from tradeloom.plans.reference import Snapshot, check_updates, import_reference_data
from tradeloom.operators import explorer, inventory as inv, profiles, ranking, snapshots
from tradeloom.sinks import writers
from tradeloom.sources import documents as docs_in, tabular, vocabulary

GRAPH = {
    "@graph": [
        {"@id": "gs1:", "owl:versionInfo": "9.1", "dc:lastModified": {"@value": "2026-01-01"}},
        {"@id": "gs1:Product", "@type": ["owl:Class"], "rdfs:label": {"@value": "Product"},
         "rdfs:subClassOf": {"@id": "owl:Thing"}},
        {"@id": "gs1:gtin", "@type": ["owl:DatatypeProperty", "rdf:Property"],
         "rdfs:label": {"@value": "GTIN"}, "rdfs:domain": {"@id": "gs1:Product"},
         "rdfs:range": {"@id": "xsd:string"}, "sw:term_status": "stable"},
        {"@id": "gs1:link", "@type": "owl:ObjectProperty", "rdfs:label": ["A", {"@value": "B"}],
         "rdfs:subPropertyOf": {"@id": "gs1:linkType"}, "flag": True,
         "rdfs:range": {"@list": [{"@id": "x:1"}, {"@value": 2}]},
         "owl:equivalentProperty": [{"@id": "https://gs1.org/voc/other"}]},
        {"@id": "gs1:dpp", "@type": "rdf:Property", "rdfs:domain": [[{"@id": "a:b"}], "c"]},
        {"@id": "schema:name", "@type": "rdf:Property"},
        "noise", {"@id": 5},
    ]
}


def texts(spark, *values):
    return spark.createDataFrame([("", v) for v in values], "path string, text string")


@pytest.fixture
def items(spark):
    return vocabulary.graph_items(texts(spark, json.dumps(GRAPH), "not json", "[1]"))


def test_properties_and_classes(spark, items):
    links = vocabulary.linktypes_from_text(texts(spark, '{"dpp": {"title": "t"}, "odd": 1}'))
    found = {r.term_id: r for r in vocabulary.vocabulary_properties(items, links).collect()}
    assert set(found) == {"gs1:gtin", "gs1:link", "gs1:dpp"}
    assert found["gs1:gtin"].range == ["xsd:string"] and found["gs1:gtin"].term_status == "stable"
    assert found["gs1:link"].label == "A; B" and found["gs1:link"].range == ["x:1", "2"]
    assert found["gs1:link"].full_iri == "https://gs1.org/voc/other"
    assert found["gs1:dpp"].domain == ["a:b", "c"]
    assert {k: r.is_link_type for k, r in found.items()} == {
        "gs1:gtin": False, "gs1:link": True, "gs1:dpp": True}
    klass = vocabulary.vocabulary_classes(items).first()
    assert (klass.term_id, klass.sub_class_of) == ("gs1:Product", ["owl:Thing"])
    assert vocabulary.snapshot_metadata(items).first().asDict() == {
        "version": "9.1", "last_modified": "2026-01-01"}


def test_files_with_marks_and_turtle(spark, tmp_path):
    path = tmp_path / "v.jsonld"
    path.write_text(json.dumps(GRAPH), encoding="utf-8-sig")
    assert vocabulary.graph_from_file(spark, str(path)).count() == 7
    (tmp_path / "v.ttl").write_text("gs1:a a x .\n gs1:b a x .\ngs1:c-1\tp .\ngs1:a q .\n")
    names = {r.name for r in vocabulary.turtle_terms(spark, str(tmp_path / "v.ttl")).collect()}
    assert names == {"a", "c-1"}
    assert vocabulary.linktypes_from_file(spark, None).count() == 0


def test_snapshot_differences(spark):
    def terms(*entries):
        graph = {"@graph": [dict(zip(("@id", "x", "y"), e)) for e in entries]}
        return vocabulary.own_terms(vocabulary.graph_items(texts(spark, json.dumps(graph))))

    old = terms(("gs1:a", 1), ("gs1:b", 1), ("gs1:c", {"p": 1, "q": 2}), ("gs1:d", 9), ("gs1:d", 1))
    new = terms(("gs1:b", 2), ("gs1:c", {"q": 2, "p": 1}), ("gs1:d", 1), ("gs1:e", 1))
    found = {r.term_id: r.change for r in snapshots.diff_terms(old, new).collect()}
    assert found == {"gs1:a": "removed", "gs1:b": "changed", "gs1:e": "new"}

    def files(ttl):
        return spark.createDataFrame(
            [("jsonld", bytearray(b"1")), ("ttl", bytearray(ttl))], "source string, content binary")

    changes = snapshots.source_changes(files(b"x"), files(b"y"))
    assert {r.source: r.changed for r in changes.collect()} == {"jsonld": False, "ttl": True}
    assert snapshots.recommended_actions(changes).count() == 2
    alone = snapshots.source_changes(files(b"x"), None)
    assert [r.action for r in snapshots.recommended_actions(alone).collect()] == [
        "No snapshot refresh action is required."]
    counts = snapshots.term_counts(files(b""), files(b"").filter("source = 'ttl'"))
    assert {r.source: (r.term_count_local, r.term_count_remote) for r in counts.collect()} == {
        "jsonld": (1, 0), "ttl": (1, 1)}


def test_explorer(spark, items, tmp_path):
    names = ("canonical_field", "jsonld_property", "recommended_jsonld_property", "mapping_status",
             "confidence", "webvoc_property_status", "webvoc_property_validation", "review_action",
             "mapping_version", "technical_mapping_file", "scope_group", "gdsn_bms_id",
             "gdsn_xpath", "gdsn_attribute_name", "source")
    lines = [("gtin", "gs1:gtin", "", "mapped", "high", "", "", "OK"),
             ("gtin2", "gs1:gtin", "", "mapped", "low", "", "", "ok"),
             ("doc", "schema:x", "gs1:dpp", "mapped", "high", "", "", "")]
    rows = spark.createDataFrame(
        [(i + 2, *line, "", "", "", "7" if i == 0 else "", "", "", "") for i, line in enumerate(lines)],
        "row_number bigint, " + ", ".join(f"{n} string" for n in names))
    decisions = docs_in.backlog(texts(spark, json.dumps([
        {"id": "S1", "affected_properties": ["gs1:gtin"], "affected_fields": ["gtin"],
         "decision_file": "f", "status": "open", "warning_count": 2, "category": "c"},
        {"id": "S2", "affected_fields": ["gtin2"], "affected_properties": [], "status": "done"},
        5])))
    built = explorer.explore(vocabulary.vocabulary_properties(items), rows, decisions).cache()
    found = {r.term_id: r for r in built.collect()}
    assert found["gs1:gtin"].coverage_status == "high_confidence"
    assert [g.sdr_id for g in found["gs1:gtin"].governance] == ["S1", "S2"]
    assert (found["gs1:gtin"].evidence_count, found["gs1:dpp"].evidence_count) == (2, 1)
    evidence = explorer.evidence_by_term(rows)
    assert sorted(r.evidence.canonical_field for r in evidence.collect()) == ["doc", "doc", "gtin", "gtin2"]
    assert found["gs1:dpp"].coverage_status == "schema_org_fallback"
    assert found["gs1:dpp"].group == "Documents and DPP"
    assert found["gs1:link"].coverage_status == "unmapped"
    assert found["gs1:link"].group == "Digital Links & Services"
    assert explorer.explorer_summary(built).first().asDict() == {
        "property_count": 3, "mapped_property_count": 1, "standards_review_property_count": 1,
        "link_type_property_count": 1, "sdr_reference_count": 2}
    coverage, groups = explorer.explorer_counts(built)
    assert coverage.count() == 8 and groups.count() == 15
    assert coverage.filter("coverage_status = 'mapped'").first()["count"] == 0
    shown = {r.Property: r for r in explorer.display_rows(built).collect()}
    assert shown["gs1:gtin"]["BMS/XPath evidence"] == "yes"
    assert shown["gs1:gtin"]["SDR indicator"] == "S1, S2"

    def kept(**options):
        return {r.term_id for r in explorer.filter_properties(built, evidence, **options).collect()}

    assert kept() == set(found) and kept(only_mapped=True) == {"gs1:gtin"}
    assert kept(search=" GTIN2 ") == {"gs1:gtin"} and kept(only_standards_review=True) == {"gs1:gtin"}
    assert kept(group="Documents and DPP", coverage_status="unmapped") == set()
    writers.write_explorer(built, evidence, str(tmp_path / "explorer"))
    assert inv.backlog_summary(decisions).first().open_warnings == 2
    assert docs_in.backlog_from_file(spark, "/nowhere.json").count() == 0


def test_attribute_sheets(spark, tmp_path):
    active = spark.createDataFrame(
        [(67, " gtin\r\nx ", "Attribute", "/t/gtin", "67", True),
         (68, "Trade Item", "Class", "/t", "", False), (None, None, None, None, None, None)],
        "`BMS ID` int, `Name` string, `Type` string, `xPath` string, `Definition` string, "
        "`Language-Enabled` boolean")
    deleted = spark.createDataFrame([("9", "old", "")], "BMSID string, name string, change_type string")
    sheets = {"3.1.36": active, "Deleted Attributes": deleted, "Notes": active}
    rows = tabular.attribute_sheets(sheets, "3.1.36")
    found = {r.bms_id: r for r in rows.collect()}
    assert len(rows.columns) == 28 and set(found) == {"67", "68", "9"}
    assert found["67"].attribute_name == "gtin\nx" and found["67"].language_enabled == "Yes"
    assert [found[k].is_candidate_source for k in ("67", "68", "9")] == [True, False, False]
    assert found["9"].change_type == "D" and found["9"].source_sheet == "Deleted Attributes"
    profile = profiles.attribute_profile(rows).first()
    assert (profile.total_rows, profile.class_rows, profile.deleted_rows) == (3, 1, 1)
    assert profile.missing_row_type == 1 and profile.rows_with_definition == 1
    assert tabular.selected_sheet(["a", " 3.1.36 final"], "3.1.36") == " 3.1.36 final"
    with pytest.raises(ValueError, match="version sheet"):
        tabular.selected_sheet(["a"], "3.1.36")
    paths = writers.write_reference({"attributes": rows}, str(tmp_path / "ref"))
    cells = {r.bms_id: r for r in spark.read.csv(paths["attributes_csv"], header=True).collect()}
    assert cells["67"].attribute_name == "gtin x" and cells["67"].is_deleted == "false"


def test_manifests_and_checksums(spark):
    good = {k: "x" for k in docs_in.MANIFEST_REQUIRED} | {"source_id": "s1"}
    assert docs_in.manifest_problems(texts(spark, json.dumps({"sources": [good]}))).count() == 0
    bad = dict(good)
    del bad["sha256"], bad["title"]
    found = docs_in.manifest_problems(texts(spark, json.dumps({"sources": [bad, 3]}))).collect()
    assert sorted(r.problem for r in found) == [
        "Manifest source 's1' is missing required field(s): title, sha256",
        "Manifest source 2 must be an object."]
    empty = docs_in.manifest_problems(texts(spark, '{"sources": []}', "[]")).collect()
    assert sorted(r.problem for r in empty) == [
        "Source manifest must be a JSON object.",
        "Source manifest must contain a non-empty sources list."]
    digest = hashlib.sha256(b"abc").hexdigest()
    sources = spark.createDataFrame(
        [(0, "gdsn_1", "a\\b", digest.upper()), (1, "voc", "c", "zz"), (2, "gone", "d", "q")],
        "pos int, source_id string, local_path string, sha256 string")
    files = spark.createDataFrame(
        [("a\\b", bytearray(b"abc")), ("c", bytearray(b"abc"))], "local_path string, content binary")
    checks = profiles.checksum_checks(sources, files)
    assert {r.source_id: (r.exists, r.matches) for r in checks.collect()} == {
        "gdsn_1": (True, True), "voc": (True, False), "gone": (False, False)}
    with pytest.raises(Exception, match="checksum mismatch: voc"):
        profiles.require_matching(checks).collect()
    fine = profiles.require_matching(checks.filter("source_id <> 'voc'"))
    assert fine.count() == 2
    assert profiles.find_source(sources, "a/b", "voc").first().source_id == "gdsn_1"
    assert profiles.find_source(sources, "zz", "voc").first().source_id == "voc"


def test_reference_import(spark, items, tmp_path):
    sources = spark.createDataFrame(
        [("a", "w", hashlib.sha256(b"1").hexdigest()), ("b", "v", "00")],
        "source_id string, local_path string, sha256 string")
    files = spark.createDataFrame([("w", bytearray(b"1"))], "local_path string, content binary")
    sheet = spark.createDataFrame(
        [("1", "/p", "n", "Attribute"), ("1", "/p", "m", "Attribute")],
        "`BMS-ID` string, xpath string, name string, type string")
    done = import_reference_data(
        sources, files, {"3.1": sheet}, items, attribute_version="3.1",
        vocabulary_version="9.1", last_modified="2026-01-01")
    assert {r.source_id: r.matches for r in done.checks.collect()} == {"a": True, "b": False}
    assert done.properties.columns[-2:] == ["version", "last_modified"]
    assert {r.version for r in done.classes.collect()} == {"9.1"}
    assert done.attribute_summary().first().candidate_source_rows == 2
    summary = done.vocabulary_summary().first()
    assert (summary.property_count, summary.class_count) == (3, 1)
    assert sorted(tuple(r) for r in done.duplicates().collect()) == [
        ("/p", 2, "xpath"), ("1", 2, "bms_id")]
    writers.write_reference(done.datasets(), str(tmp_path / "out"))


def test_update_check(spark, items, tmp_path):
    def side(ttl, link, graph):
        files = spark.createDataFrame(
            [("ttl", bytearray(ttl)), ("linktypes", bytearray(link.encode()))],
            "source string, content binary")
        return Snapshot(files, graph, vocabulary.linktypes_from_text(texts(spark, link)))

    old = side(b"1", '{"a": {"title": "x", "status": "s"}, "b": {}}', items)
    new = side(b"2", '{"a": {"status": "s", "title": "x"}, "c": {}}',
               items.filter("term_id <> 'gs1:dpp'"))
    report = check_updates(old, new)
    assert {r.term_id: r.change for r in report["terms"].collect()} == {"gs1:dpp": "removed"}
    assert {r.name: r.change for r in report["linktypes"].collect()} == {"b": "removed", "c": "new"}
    rows = {r.source: r for r in report["sources"].collect()}
    assert rows["ttl"].changed and rows["linktypes"].term_count_local == 2
    assert report["actions"].count() == 2
    writers.write_update_report(report, str(tmp_path / "update"))
    metadata = vocabulary.snapshot_metadata(items)
    writers.write_snapshot(
        {"ttl": spark.createDataFrame([("gs1:a a b .",)], "value string")}, metadata,
        str(tmp_path / "snapshots"), "v2")
    current = writers.current_snapshot(spark, str(tmp_path / "snapshots"))
    assert current.endswith("/v2") and vocabulary.turtle_terms(spark, f"{current}/ttl").count() == 1
    with pytest.raises(Exception):  # noqa: B017  a failing part leaves the last version in place
        writers.write_snapshot({"ttl": spark.range(1)}, metadata, str(tmp_path / "snapshots"), "v3")
    assert writers.current_snapshot(spark, str(tmp_path / "snapshots")) == current


def test_numbering_spans_chunks(spark):
    rows = spark.range(1000).selectExpr("id AS pos", "IF(id % 3 = 0, 'hot', concat('c', id % 5)) AS k")
    got = {(r.k, r.pos): r.number for r in ranking.number_rows(rows, ["k"], "pos", chunk_rows=64).collect()}
    seen: dict = {}
    for pos in range(1000):
        k = "hot" if pos % 3 == 0 else f"c{pos % 5}"
        seen[k] = seen.get(k, 0) + 1
        assert got[(k, pos)] == seen[k]


def test_lines_are_numbered_across_partitions(spark):
    rows = spark.range(100, numPartitions=7).filter("id % 3 <> 1")
    got = [(r.id, r.n) for r in ranking.number_lines(rows, "n", first=2).orderBy("n").collect()]
    assert got == [(i, n) for n, i in enumerate((i for i in range(100) if i % 3 != 1), start=2)]


def test_positions_follow_the_order(spark):
    rows = spark.range(500, numPartitions=6).selectExpr("id", "id * 7919 % 503 AS v", "IF(id % 3 = 0, NULL, 'k') AS k")
    got = ranking.number_sorted(rows, [F.col("k").asc_nulls_last(), F.col("v").desc()], "n").collect()
    want = sorted(got, key=lambda r: (r.k is None, -r.v))
    assert [r.n for r in want] == list(range(1, 501))
    assert ranking.number_sorted(rows.limit(0), [F.col("v")], "n").count() == 0


def test_duplicates_ignore_blanks(spark):
    rows = spark.createDataFrame([(v,) for v in ["a", "a ", "b", "", " ", "c", "c", "c"]], "v string")
    assert [tuple(r) for r in ranking.duplicate_values(rows, "v").collect()] == [("c", 3), ("a", 2)]
    assert ranking.duplicate_values(rows, "v", limit=1).count() == 1
    best = ranking.best_row(rows.withColumn("n", F.length("v")), ["n"], [F.col("v")])
    assert {r.n: r.v for r in best.collect()} == {1: " ", 2: "a ", 0: ""}


def test_linked_values_of_any_depth(spark):
    def flat(v):
        if isinstance(v, list):
            return [x for e in v for x in flat(e)]
        if isinstance(v, dict):
            named = [v[k] for k in ("@id", "@value") if k in v]
            return [str(named[0])] if named else flat(v.get("@list"))
        return [] if v is None else [str(v)]

    def spelled(v):
        if isinstance(v, list):
            return "; ".join(t for t in map(spelled, v) if t)
        if isinstance(v, dict):
            named = [v[k] for k in ("@value", "@id") if k in v]
            return str(named[0]) if named else "; ".join(flat(v.get("@list")))
        return "" if v is None else str(v)

    cases = [None, "a", 5, [], {}, [[["a"]], ["b"], "c"], [[[[[["deep"], {"@list": [["x", {"@id": "y"}]]}]]]]],
             {"@list": [{"@list": [["p"], "[q"]}]}, [{"@value": "v", "@id": "i"}, {"@list": ["a", "b"]}, {"other": 1}, None, [[]]],
             {"@id": "i", "@list": ["z"]}, ["x", ["", "y"]], "[" * 100_000, ["[" * 100_000, 'say "[" \\', ["]"]]]
    rows = spark.createDataFrame([(k, json.dumps(c)) for k, c in enumerate(cases)], "k int, j string")
    got = rows.selectExpr("k", "parse_json(j) AS v").selectExpr(
        "k", f"{linked.values('v')} AS found", f"{linked.text('v')} AS shown").orderBy("k").collect()
    assert [(r.found, r.shown) for r in got] == [(flat(c), spelled(c)) for c in cases]


def test_blank_language_entries_are_dropped(spark):
    rows = spark.createDataFrame([('["\\n", {"@value": " ", "@language": "en"}, "name"]',)], "j string")
    [r] = rows.selectExpr("parse_json(j) AS v").selectExpr(f"{linked.language_entries('v')} AS e").collect()
    assert [(e.value, e.language) for e in r.e] == [("name", None)]


def test_hot_keys_change_nothing(spark):
    rows = spark.range(3000).selectExpr("id AS pos", "IF(id % 10 < 9, 'hot', concat('k', id % 7)) AS k")
    seen: set = set()
    got = {r.pos: r.is_repeat for r in ranking.first_occurrences(rows, "k", "pos").collect()}
    for pos in range(3000):
        k = "hot" if pos % 10 < 9 else f"k{pos % 7}"
        assert got[pos] == (k in seen)
        seen.add(k)


def test_of_repeated_terms_the_last_file_counts(spark):
    rows = spark.createDataFrame(
        [(f"f{k}", json.dumps({"@graph": [{"@id": "gs1:a", "n": k}, {"@id": "gs1:a", "n": k + 10}][: 2 - k % 2]})) for k in (3, 1, 2)],
        "path string, text string")
    [term] = vocabulary.own_terms(vocabulary.graph_items(rows)).collect()
    assert json.loads(term.body)["n"] == 3

"""Passports, structural checks, inventories and bulk authoring."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tradeloom.operators import authoring, inventory as inv, passport, structure
from tradeloom.sinks import writers
from tradeloom.sources import documents as docs_in


def texts(spark, *values):
    rows = [("", v if isinstance(v, str) else json.dumps(v)) for v in values]
    return spark.createDataFrame(rows, "path string, text string")


def test_products_are_read_tolerantly(spark):
    cases = [
        ({"gtin": " 123 ", "productName": [{"@value": " "}, {"value": "N", "language": "en"}],
          "brand": {"name": [{"@value": "B"}]}}, ("123", "N", "B")),
        ({"@id": "https://id.gs1.org/01/04012345678901?x", "name": "P", "brandName": " Q "},
         ("04012345678901", "P", "Q")),
        ({"gs1:gtin": {"@value": 55}, "gs1:productName": "", "schema:name": "S", "brand": 7,
          "schema:brand": {"@value": "V"}}, ("55", "S", "V")),
        ({"id": "x"}, (None, None, None)),
    ]
    for doc, wanted in cases:
        row = passport.read_products(docs_in.json_objects(texts(spark, doc))).first()
        assert (row.gtin, row.product_name, row.brand) == wanted


def test_envelope_and_validation(spark, tmp_path):
    product = {"@id": "https://id.gs1.org/01/04012345678901", "name": 'A "b"', "@type": "Product"}
    built = passport.build_passports(docs_in.json_objects(texts(spark, product, "[1]", "{")))
    rows = {r.text: r for r in built.collect()}
    envelope = json.loads(rows[json.dumps(product)].passport)
    assert list(envelope) == [
        "@context", "@type", "@id", "productPassportId", "passportType", "passportVersion",
        "status", "prototypeNotice", "defaultLanguage", "source", "validation",
        "createdByVersion", "product"]
    assert envelope["source"] == {
        "sourceType": "gs1-web-vocabulary-jsonld", "sourceFormat": "json-ld",
        "sourceGtin": "04012345678901", "sourceProductName": 'A "b"'}
    assert envelope["product"] == product
    assert rows["[1]"].error == "GS1 JSON-LD input must be a JSON object."
    assert rows["[1]"].passport is None
    checked = passport.validate_passports(built)
    assert sorted(r.validation_status for r in checked.collect()) == [
        "schema_error", "schema_error", "valid"]
    summary = passport.passport_summary(checked.filter("validation_status = 'valid'")).first()
    assert summary.errorCount == 0 and summary.sourceGtin == "04012345678901"
    options = passport.PassportOptions(
        passport_id="it's", include_source=False, generated_at="2026-01-01")
    other = json.loads(passport.build_passports(
        docs_in.json_objects(texts(spark, {"x": 1})), options).first().passport)
    assert other["productPassportId"] == "it's" and other["generatedAt"] == "2026-01-01"
    assert "product" not in other and "@id" not in other and other["source"]["sourceGtin"] is None
    writers.write_passports(checked, passport.passport_summary(checked), str(tmp_path / "p"))


def test_manifest_structure_names_the_entry(spark):
    entry = {name: "x" for name in structure.PASSPORT_SOURCE_REQUIRED} | {
        "source_type": structure.PASSPORT_SOURCE_TYPES[0], "sector": structure.PASSPORT_SECTORS[0]}
    manifest = {"schema_version": 1, "extra": 2, "sources": [
        entry, entry | {"title": 5, "source_id": "Not Ok", "sector": "moon"}, "text",
        {k: v for k, v in entry.items() if k != "title"} | {"used_by": ["a", 1], "odd": 1}]}
    docs = texts(spark, manifest, []).selectExpr("try_parse_json(text) AS doc", "monotonically_increasing_id() AS id")
    rows = structure.manifest_violations(docs, ["id"]).collect()
    first = min(r.id for r in rows)
    assert sorted((r.entry_no if r.entry_no is not None else -1, r.message) for r in rows if r.id == first) == [
        (-1, "[root] Additional properties are not allowed ('extra')"),
        (-1, "[schema_version] is not of type string"),
        (1, f"[sources.1.sector] is not one of {list(structure.PASSPORT_SECTORS)}"),
        (1, "[sources.1.source_id] does not match '^[a-z0-9_]+$'"),
        (1, "[sources.1.title] is not of type string"),
        (2, "[sources.2] is not of type object"),
        (3, "[sources.3.used_by] is not of type array of string"),
        (3, "[sources.3] 'title' is a required property"),
        (3, "[sources.3] Additional properties are not allowed ('odd')"),
    ]
    assert [r.message for r in rows if r.id != first] == ["[root] is not of type object"]


def test_structure_rules(spark):
    def errors(doc, rules=structure.PASSPORT_RULES):
        return structure.check(docs_in.json_objects(texts(spark, doc)).drop("error"), rules).first().errors

    assert errors({"@context": {}, "@type": ["a", "b"]}) == []
    assert errors({"@context": 5, "@type": ["a", 1], "@id": 3}) == [
        "[@context] is not of type string or array or object",
        "[@type] is not of type string or array of string", "[@id] is not of type string"]
    assert errors({}) == ["[root] '@context' is a required property",
                          "[root] '@type' is a required property"]
    source = {"source_id": "Bad Id", "title": "t", "source_url": "u", "source_type": "odd",
              "sector": "core", "local_path": "p", "extra": 1, "sha256": None, "used_by": ["a"]}
    assert errors(source, structure.MANIFEST_SOURCE_RULES) == [
        "[source_id] does not match '^[a-z0-9_]+$'",
        "[source_type] is not one of ['context', 'epcis_example', 'example', 'json_schema', 'shacl_shape']",
        "[root] Additional properties are not allowed ('extra')"]
    weak = structure.check_required_only(docs_in.json_objects(texts(spark, {"@type": 1}))).first()
    assert weak.errors == ["Required field '@context' is missing (minimal fallback check)."]
    assert weak.warnings[0].startswith("FALLBACK MODE") and weak.validation_status == "invalid"


def test_inventory(spark, tmp_path):
    base = {"title": "t", "source_url": "u", "source_type": "context", "sector": "core"}
    manifest = {"sources": [
        base | {"source_id": "a", "local_path": "a", "sha256": "=x"},
        base | {"source_id": "a", "local_path": "b", "sector": "moon"},
        {"source_id": "c"}, 4]}
    sources = inv.source_rows(docs_in.manifest_sources(texts(spark, manifest)))
    found = sorted(r.error for r in inv.manifest_errors(sources).collect())
    assert found[0] == "Duplicate source_id: 'a'." and "Source at index 3 is not a JSON object." in found
    assert sum("missing required field" in e for e in found) == 5
    assert any("unknown sector 'moon'" in e for e in found)
    files = spark.createDataFrame([("a", bytearray(b"1"))], "local_path string, content binary")
    rows = inv.inventory(sources.filter("is_object"), files)
    assert sorted(r.checksum_status for r in rows.collect()) == ["mismatch", "missing", "missing"]
    summary = inv.inventory_summary(rows).first()
    assert (summary.total_sources, summary.missing_count) == (3, 2)
    cells = {r.local_path: r for r in inv.inventory_csv(rows).collect()}
    assert cells["a"]._file_exists == "True" and cells["b"].sector == "moon"
    assert inv.find_manifest_entry(sources, "x/y/b").first().pos == 1
    writers.write_inventory(rows, str(tmp_path / "inv"))
    open_topics = docs_in.backlog(texts(spark, [
        {"id": "1", "status": "open", "category": "b"}, {"id": "1", "status": "huh", "category": "a"}]))
    problems = {(r.problem, r.value) for r in inv.backlog_problems(open_topics, ("open",)).collect()}
    assert problems == {("duplicate_id", "1"), ("invalid_status", "huh")}
    assert [r.category for r in inv.backlog_categories(open_topics).collect()] == ["a", "b"]
    writers.write_backlog(open_topics, str(tmp_path / "backlog"))


MANIFEST = {
    "root_classes": [], "product_categories": [{"label": "Food", "groups": ["g2"]}, {"label": "Any"}],
    "groups": [
        {"key": "g1", "label": "One", "properties": [
            {"property_id": "gs1:gtin", "input_type_override": "text"},
            {"property_id": "gs1:brand", "input_type_override": "object", "object_type": "gs1:Brand",
             "object_fields": [{"property_id": "gs1:site", "input_type": "url"},
                               {"property_id": "gs1:brandName", "input_type_override": "language_text"}]},
            {"property_id": "gs1:old", "supported_in_v0_10": False}]},
        {"key": "g2", "label": "Two", "properties": [{"property_id": "gs1:netWeight"}]}],
}
VALUES = [
    ("p", "gs1:gtin", "4006381333931", None, None), ("p", "gs1:netWeight", "1.50", None, "KGM"),
    ("p", "gs1:name", "Nom", "fr", None), ("p", "gs1:old", "x", None, None),
    ("p", "gs1:brand#gs1:brandName", "B", "en", None), ("p", "gs1:brand#gs1:site", "no", None, None),
    ("p", "gs1:count", "7", None, None), ("p", "gs1:count", "8", None, None),
    ("p", "gs1:free", " ", None, None), ("q", "gs1:gtin", "12", None, None),
    ("q", "gs1:netWeight", "much", None, ""), ("q", "gs1:site", "nowhere", None, None),
    ("q", "gs1:name", "x", None, None),
]


def authored(spark):
    properties = spark.createDataFrame(
        [("gs1:name", ["rdf:langString"]), ("gs1:count", ["xsd:integer"]), ("gs1:site", ["xsd:anyURI"]),
         ("gs1:netWeight", ["gs1:QuantitativeValue"]), ("gs1:old", ["xsd:string"])],
        "term_id string, range array<string>")
    groups, fields = docs_in.builder_tables(spark, MANIFEST)
    values = spark.createDataFrame(
        [(*v, i) for i, v in enumerate(VALUES)],
        "product_id string, property_id string, value string, language string, unit_code string, seq int")
    return groups, fields, values, authoring.metadata_index(properties, fields)


def test_authoring_documents(spark):
    _, _, values, metadata = authored(spark)
    docs = {r.product_id: json.loads(r.jsonld) for r in authoring.author_jsonld(values, metadata).collect()}
    assert json.dumps(docs["p"]) == json.dumps({
        "@context": ["https://ref.gs1.org/voc/data/gs1Voc.jsonld", {"schema": "https://schema.org/"}],
        "@type": "Product", "@id": "https://id.gs1.org/01/4006381333931",
        "count": 8, "gtin": "4006381333931", "name": [{"@language": "fr", "@value": "Nom"}],
        "netWeight": {"value": 1.5, "unitCode": "KGM"},
        "brand": {"@type": "gs1:Brand", "brandName": [{"@language": "en", "@value": "B"}]}})
    assert list(docs["q"]) == ["@context", "@type", "@id", "gtin"]


def test_every_product_has_a_document(spark):
    _, _, _, metadata = authored(spark)
    rows = [("a", "gs1:old", "x", 1), ("b", "gs1:brand#gs1:unknown", "x", 1), ("c", "gs1:name", " ", 1),
            ("d", "gs1:count", "12345678901234567890123456789012345678901234567890", 1)]
    values = spark.createDataFrame(
        [(p, k, v, None, None, n) for p, k, v, n in rows],
        "product_id string, property_id string, value string, language string, unit_code string, seq int")
    docs = {r.product_id: r.jsonld for r in authoring.author_jsonld(values, metadata).collect()}
    assert all(list(json.loads(docs[p])) == ["@context", "@type"] for p in "abc")
    assert json.loads(docs["d"])["count"] == int(rows[3][2])
    hidden = metadata.withColumn("supported", F.lit(False))
    gtin = values.limit(1).selectExpr("product_id", "'gs1:gtin' AS property_id", "'4006381333931' AS value", "language", "unit_code", "seq")
    [doc] = [json.loads(r.jsonld) for r in authoring.author_jsonld(gtin, hidden).collect()]
    assert doc["@id"].endswith("4006381333931")


def test_warnings_are_ordered(spark):
    _, _, values, metadata = authored(spark)
    rows = authoring.authoring_warnings(values, metadata).orderBy("product_id", "position").collect()
    q = [r.warning for r in rows if r.product_id == "q"]
    assert q[0].startswith("Manual JSON-LD prototype") and q[1:] == [
        "Invalid GTIN format or check digit.", "gs1:netWeight must be a valid number.",
        "gs1:netWeight has a quantity value without unitCode.", "gs1:site is not a valid HTTP(S) URL.",
        "gs1:name needs a language tag."]


def test_authoring_warnings(spark):
    _, _, values, metadata = authored(spark)
    found: dict = {}
    for r in authoring.authoring_warnings(values, metadata).collect():
        found.setdefault(r.product_id, set()).add(r.warning)
    notice = {w for w in found["p"] if w.startswith("Manual JSON-LD prototype")}
    assert found["p"] - notice == {
        "gs1:old is not supported in v0.10 and will not be emitted.",
        "gs1:brand / gs1:site is not a valid HTTP(S) URL."}
    assert found["q"] - notice == {
        "Invalid GTIN format or check digit.", "gs1:netWeight must be a valid number.",
        "gs1:netWeight has a quantity value without unitCode.",
        "gs1:site is not a valid HTTP(S) URL.", "gs1:name needs a language tag."}


def test_builder_groups_and_fields(spark):
    groups, fields, _, _ = authored(spark)

    def keys(category):
        return [r.group for r in docs_in.groups_for_category(groups, category).collect()]

    assert keys("Food") == ["g2"] and keys("Any") == ["g1", "g2"] and keys("?") == ["g1", "g2"]
    listed = [r.property_id for r in docs_in.fields_of_group(fields, "g1").collect()]
    assert listed == ["gs1:gtin", "gs1:brand", "gs1:old"]

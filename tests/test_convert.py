"""Conversion of whole messages: golden documents, faults, leftovers, edges."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tests.samples import FAULTY, FULL, FULL_JSONLD, wrap
from tradeloom.plans.convert import convert
from tradeloom.plans.workloads import xml_document_texts
from tradeloom.sources.profile import ProfileError, built_in_profile, load_profile, read_path
from tradeloom.sources.xmlnodes import explode_nodes, shred


@pytest.fixture(scope="module")
def results(spark):
    docs = {
        "full": FULL, "faulty": FAULTY, "broken": b"<a><b></a>", "empty": b"",
        "entity": b'<!DOCTYPE a [<!ENTITY x "boom">]><a><gtin>40&x;06</gtin></a>',
        "mixed": wrap("<~:brandName>a<~:b/>c</~:brandName><~:gpcCategoryCode>1<!-- n -->2"
                      "</~:gpcCategoryCode><~:descriptionShort><![CDATA[x & ]]>y</~:descriptionShort>"),
    }
    rows = spark.createDataFrame(list(docs.items()), "doc_id string, content binary")
    return {r.doc_id: r for r in convert(rows).collect()}


def leftovers(row):
    return [
        (u.element, u.parent, u["count"], {c.key: c.value for c in u.context})
        for u in row.unmapped
    ]


def test_golden_document_with_key_order(results):
    assert json.dumps(json.loads(results["full"].jsonld)) == json.dumps(FULL_JSONLD)


def test_reports_of_a_good_document(results):
    row = results["full"]
    assert row.validation.asDict() == {"valid": True, "errors": [], "warnings": []}
    report = {r.id: r for r in row.mapping_report}
    assert len(report) == 14 and all(r.found for r in report.values())
    assert report["nutrients"].message == "Mapped 2 object(s)."
    assert json.loads(report["product_name"].value)[0] == {"value": "Hafer Riegel", "language": "de"}
    assert row.product.net_content_value == "40.50"
    assert leftovers(row) == [
        ("entityIdentification", "transactionIdentification", 1, {}),
        ("fileName", "referencedFileInformation", 1,
         {"fileName": "front.png", "referencedFileTypeCode": "PRODUCT_IMAGE",
          "uniformResourceIdentifier": "https://example.org/i/front.png"}),
        ("referencedFileTypeCode", "referencedFileInformation", 1,
         {"fileName": "front.png", "referencedFileTypeCode": "PRODUCT_IMAGE",
          "uniformResourceIdentifier": "https://example.org/i/front.png"}),
    ]


def test_faults(results):
    row = results["faulty"]
    report = {r.id: (r.status, r.message) for r in row.mapping_report}
    assert report["gtin"] == ("validation_error", "'123' is not a valid GTIN")
    assert report["product_name"] == ("missing_required", "Required value was not found.")
    assert report["net_content_value"] == ("transform_error", "'much' is not a decimal")
    assert report["product_image_url"] == (
        "validation_error", "'nowhere' is not a valid HTTP(S) URL")
    assert report["nutrients"] == (
        "validation_error",
        "quantity_value: required value was not found; quantity_unit: required value was not found")
    assert report["allergens"][0] == "missing_optional"
    assert row.validation.errors == [
        "Required field 'gtin' was not found. Cannot construct product @id.",
        "Required field 'product_name' was not found.",
    ]
    assert row.validation.warnings[-3:] == [
        "Optional field 'product_page_url' was not found.",
        "Optional field 'ingredient_statement' was not found.",
        "Net content is incomplete; both value and unit are required for JSON-LD.",
    ]
    assert "Field 'product_image_url': 'nowhere' is not a valid HTTP(S) URL" in row.validation.warnings
    document = json.loads(row.jsonld)
    assert "@id" not in document and document["gs1:productImage"] == ["https://ok.example/x"]
    assert document["gs1:nutrientDetail"] == [{"gs1:nutrientTypeCode": "FAT"}]


def test_leftovers_of_the_faulty_document(results):
    found = leftovers(results["faulty"])
    assert ("hint", "storage", 1, {"languageCode": "nl"}) in found
    assert ("storage", "tradeItemDescriptionInformation", 1, {"languageCode": "nl"}) in found
    assert ("source", "nutrientDetail", 1, {"nutrientTypeCode": "FAT"}) in found
    names = [f[0] for f in found]
    # A rejected value still counts as read; its unread parent does not.
    assert "measurementValue" not in names and "netContent" in names
    assert names == sorted(names)


def test_error_isolation(results):
    for name in ("broken", "empty"):
        row = results[name]
        assert row.error_type == "XMLParseError" and row.error_message.startswith("Invalid XML: ")
        assert row.product is None and row.jsonld is None and row.unmapped is None


def test_text_node_rules(results):
    product = results["mixed"].product
    assert product.brand_name == "a"
    assert product.gpc_category_code == "1"
    assert product.product_description[0].value == "x & y"
    entity = {r.id: r for r in results["entity"].mapping_report}["gtin"]
    assert entity.message == "'40' is not a valid GTIN"


def test_profile_levels(spark):
    docs = spark.createDataFrame([("full", FULL)], "doc_id string, content binary")
    basic = convert(docs, built_in_profile("basic")).first()
    names = {u.element for u in basic.unmapped}
    assert {"ingredientStatement", "allergenRelatedInformation", "allergenTypeCode",
            "nutrientHeader", "nutrientTypeCode"} <= names
    assert not {"netContent", "tradeItem", "allergen"} & names
    food = convert(docs, built_in_profile("food")).first()
    names = {u.element for u in food.unmapped}
    assert not {"ingredientStatement", "allergenRelatedInformation", "measurementValue"} & names
    assert "certificationInformation" in names


def test_nodes_are_preordered(spark):
    docs = spark.createDataFrame([("d", bytearray(b"<a>1<b x='y'>2</b>3<b/></a>"))],
                                 "doc_id string, content binary")
    rows = explode_nodes(shred(docs)).orderBy("node_id").collect()
    assert [(r.node_id, r.parent_id, r.depth, r.path, r.text_first, r.text_all, r.attrs)
            for r in rows] == [
        (0, -1, 0, "/a", "1", "123", {}),
        (1, 0, 1, "/a/b", "2", "2", {"x": "y"}),
        (2, 0, 1, "/a/b", None, "", {}),
    ]


def test_many_documents_keep_their_order_and_keys(spark):
    docs = spark.range(3000, numPartitions=3).select(
        F.concat(F.lit("d"), "id").alias("doc_id"),
        F.expr("CAST(IF(id % 10 = 3, '<a>', concat('<a><gtin>', id, '</gtin></a>')) AS binary)")
        .alias("content"),
    )
    rows = shred(docs).select("doc_id", F.expr("get(nodes, 1).text").alias("t"), "parse_error").collect()
    assert len(rows) == 3000
    for r in rows:
        number = int(r.doc_id[1:])
        assert (r.parse_error is not None) == (number % 10 == 3)
        assert r.t == (None if number % 10 == 3 else str(number))


def test_plan_has_no_exchange(spark):
    docs = spark.createDataFrame([("full", FULL)], "doc_id string, content binary")
    plan = convert(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    filtered = convert(docs).filter("validation.valid")
    text = filtered._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("Filter") < text.index("Project")


def test_profiles_are_read_and_checked(tmp_path):
    import yaml

    good = {
        "settings": {"default_language": "fr"},
        "fields": [{"id": "gtin", "description": "d", "xpath": ".//*[local-name()='gtin']",
                    "canonical_field": "gtin", "jsonld_property": "gs1:gtin", "required": True,
                    "transform": ["trim"]}],
    }
    path = tmp_path / "p.yaml"
    path.write_text(yaml.safe_dump(good))
    profile = load_profile(path)
    assert profile.default_language == "fr" and profile.fields[0].transform == ("trim",)
    good["fields"][0]["xpath"] = "/a/b"
    path.write_text(yaml.safe_dump(good))
    with pytest.raises(ProfileError):
        load_profile(path)
    path.write_text("- a")
    with pytest.raises(ProfileError, match="YAML object"):
        load_profile(path)
    with pytest.raises(FileNotFoundError):
        load_profile(tmp_path / "none.yaml")
    for bad in (".//*[position()=1]", ".//x", ".//*[local-name()='a'][last()]"):
        with pytest.raises(ProfileError):
            read_path(bad)


def test_large_document_as_nodes(spark):
    inner = b"".join(b"<n k='%d'>t%d</n>" % (i, i) for i in range(50_000))
    docs = spark.createDataFrame([("big", b"<r>" + inner + b"</r>")], "doc_id string, content binary")
    nodes = explode_nodes(shred(docs))
    row = nodes.selectExpr("count(*) AS n", "sum(length(text_first)) AS chars", "count_if(path = '/r/n') AS paths").first()
    assert (row.n, row.paths) == (50_001, 50_000)
    plan = nodes._jdf.queryExecution().executedPlan().toString()
    [generate] = [line for line in plan.splitlines() if "Generate" in line]
    assert "body" not in generate.split("]")[-2] and "[doc_id" in generate


def test_reports_carry_the_profile_descriptions(results):
    report = {r.id: r.description for r in results["full"].mapping_report}
    assert report["gtin"] == "Global Trade Item Number" and report["nutrients"] == "Basic nutrient details"


def test_documents_without_text_or_language(spark, tmp_path):
    given = {1: (" a \n b ", "de"), 2: (" \n ", "fr"), 3: ("", "en"), 4: (None, "es"), 5: ("x < y", None), 6: (None, None)}
    rows = [(k, text, lang) for k, (text, lang) in given.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    expected = {}
    for k, (text, lang) in given.items():
        flat = None if text is None else " ".join(text.split())
        expected[k] = (lang, *((None, None) if flat is None else (hashlib.sha256(flat.encode()).hexdigest(), len(flat))))
    found = xml_document_texts(spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.lang, r.digest, r.chars) for r in found} == expected

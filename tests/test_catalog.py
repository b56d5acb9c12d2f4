"""Catalog rules, reconciliation with the full profile, revalidation."""

from __future__ import annotations

from tradeloom.fixed import CATALOG_COLUMNS
from tradeloom.operators import catalog
from tradeloom.sources.profile import built_in_profile
from tradeloom.sources.tabular import catalog_rows, read_catalog
from tradeloom.sources.vocabulary import linktypes_from_text

# canonical field, property, recommended, status, confidence, validation, action
_GOVERNED = """
gtin|gs1:gtin|gs1:gtin|mapped_official_bms_xpath|high|gs1:gtin=found|OK
product_name|gs1:productName|gs1:productName|mapped_official_bms_xpath|high|ok|OK
product_description|gs1:productDescription||mapped_official_bms_xpath|high|ok|OK
brand_name|gs1:brandName||mapped_official_bms_xpath|high|ok|OK
gpc_category_code|gs1:gpcCategoryCode||mapped_official_bms_xpath|high|ok|OK
net_content|gs1:netContent||mapped_official_bms_xpath|high|ok|OK
product_image_url|gs1:productImage|schema:image|candidate|medium|gs1:productImage=NOT FOUND|x
product_page_url|schema:url|schema:url|needs_bms_review|low|ok|OK_schema
ingredient_statement|gs1:ingredientStatement||mapped_official_bms_xpath|high|ok|OK
allergens[].allergen_type|gs1:hasAllergen/gs1:allergenType||mapped|high|ok|OK
allergens[].level_of_containment|gs1:hasAllergen/gs1:levelOfContainment||mapped|high|ok|OK
nutrients[].preparation_state|gs1:nutrientDetail/gs1:preparationStateCode||mapped|high|x=NOT FOUND|x
nutrients[].nutrient_type|gs1:nutrientDetail/gs1:nutrientTypeCode||mapped|high|ok|model_review
nutrients[].quantity_contained|gs1:nutrientDetail/gs1:quantityContained||mapped|high|ok|model_review
certifications[]|gs1:certification||candidate|medium|ok|OK
certifications[].certification_value|schema:other||candidate|high|ok|OK
certification_documents[].file_name|schema:name||mapped|high|ok|OK
referenced_documents[].file_name|schema:name||candidate|low|ok|OK
referenced_documents[].file_format|schema:encodingFormat||candidate|low|ok|OK
referenced_documents[].referenced_file_type|schema:additionalType||candidate|low|ok|OK
referenced_documents[].document_url|schema:url||candidate|low|ok|OK
"""


def row(**cells):
    base = dict.fromkeys(CATALOG_COLUMNS, "") | {
        "gdsn_bms_id": "1", "gdsn_attribute_name": "a", "gdsn_xpath": "/a",
        "canonical_field": "test_field", "jsonld_property": "schema:name",
        "technical_mapping_file": "t.yaml", "mapping_status": "mapped", "confidence": "high",
        "review_action": "OK_schema",
    }
    return base | cells


def frame(spark, rows):
    schema = ", ".join(f"{c} string" for c in CATALOG_COLUMNS)
    data = [tuple(r[c] for c in CATALOG_COLUMNS) for r in rows]
    return catalog_rows(spark.createDataFrame(data, schema).coalesce(1))


def codes(findings):
    return sorted(r.code for r in findings.collect())


def governed(spark):
    names = ("canonical_field", "jsonld_property", "recommended_jsonld_property",
             "mapping_status", "confidence", "webvoc_property_validation", "review_action")
    lines = [line.split("|") for line in _GOVERNED.strip().splitlines()]
    return frame(spark, [
        row(technical_mapping_file=f"m{i}.yaml", **dict(zip(names, cells, strict=True)))
        for i, cells in enumerate(lines)])


def test_row_rules_one_by_one(spark):
    cases = {
        "unknown_confidence": {"confidence": "certain"},
        "unknown_mapping_status": {"mapping_status": "awaiting_committee"},
        "missing_mapped_value": {"gdsn_xpath": " "},
        "missing_jsonld_property": {"jsonld_property": ""},
        "missing_official_bms_id": {"gdsn_bms_id": "", "mapping_status": "mapped_official_bms_xpath"},
        "webvoc_review_required": {"webvoc_property_validation": "gs1:x=NOT FOUND"},
    }
    for code, change in cases.items():
        found = catalog.catalog_findings(frame(spark, [row(**change)]))
        expected = [code] if code == "missing_mapped_value" else ["catalog_loaded", code]
        assert codes(found) == sorted(expected), code
    messages = [r.message for r in catalog.row_findings(
        frame(spark, [row(), row(confidence="certain")])).collect()]
    assert messages == ["Unknown confidence 'certain'."]


def test_summary_and_strict_mode(spark):
    found = catalog.catalog_findings(frame(spark, [row(confidence="certain")]))
    assert catalog.findings_summary(found).first().asDict() == {
        "errors": 0, "warnings": 1, "info": 1, "valid": True, "strict": False}
    assert catalog.findings_summary(found, strict=True).first().valid is False


def test_duplicates_and_missing_columns(spark):
    twice = catalog.catalog_findings(frame(spark, [row(), row(canonical_field=" test_field ")]))
    found = twice.first()
    assert found.code == "duplicate_critical_key" and found.blocks_release
    assert found.message == "Catalog key t.yaml / test_field occurs 2 times."
    short = frame(spark, [row()]).drop("notes", "source")
    assert [r.message for r in catalog.catalog_findings(short).collect()] == [
        "Catalog is missing required columns: notes, source"]


def test_classification(spark):
    rows = frame(spark, [
        row(canonical_field=f, webvoc_property_validation="NOT FOUND", technical_mapping_file=f)
        for f in ("nutrients[].x", "image_url", "referenced_documents[].y", "gtin")])
    found = {r.canonical_field: r.category for r in catalog.row_findings(rows).collect()}
    assert found == {"nutrients[].x": "nutrient_modelling", "image_url": "image_modelling",
                     "referenced_documents[].y": "document_dpp_modelling",
                     "gtin": "webvoc_term_missing"}


def test_needs_review_keeps_repeats(spark):
    rows = frame(spark, [row(notes="Review this"), row(notes="Review this"), row()])
    assert catalog.needs_review(rows).count() == 2


def test_reconciliation_with_the_full_profile(spark):
    report = catalog.check_mapping(built_in_profile(), governed(spark))
    found = report["findings"].collect()
    by_code: dict = {}
    for r in found:
        by_code.setdefault(r.code, set()).add(r.canonical_field)
    assert by_code["structural_parent_covered"] == {
        "allergens[]", "nutrients[]", "referenced_documents[]"}
    assert by_code["yaml_field_missing_from_catalog"] == {
        f"certifications[].{n}" for n in (
            "certification_standard", "certification_identification", "assessment_date",
            "certificate_issuance_date_time", "effective_start", "effective_end",
            "certification_organisation_identifier")}
    assert by_code["yaml_property_not_aligned"] == {"certifications[].certification_value"}
    assert by_code["catalog_field_missing_from_yaml"] == {"certification_documents[].file_name"}
    assert by_code["experimental_mapping_documented"] == {
        "nutrients[].nutrient_type_code", "nutrients[].quantity_contained.value",
        "nutrients[].quantity_contained.unit_code", "referenced_documents[]"}
    coverage = {r.canonical_field: r for r in report["coverage"].collect()}
    assert len(coverage) == 32
    assert coverage["net_content_value"].catalog_matches == 1
    assert coverage["allergens[]"].property_aligned
    assert {r.canonical_field for r in report["missing_from_catalog"].collect()} == (
        by_code["yaml_field_missing_from_catalog"])


def test_catalog_file_with_mark_quotes_and_blanks(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text('﻿a,b,c\n x ,"say ""hi"", you",\n"two\nlines",,z\n', encoding="utf-8")
    rows = read_catalog(spark, str(path)).collect()
    assert [(r.a, r.b, r.c, r.row_number) for r in rows] == [
        ("x", 'say "hi", you', "", 2), ("two\nlines", "", "z", 3)]


def test_revalidation(spark):
    rows = spark.createDataFrame(
        [(2, "gtin", "gs1:gtin", ""), (3, "dpp_url", "schema:url", "gs1:dpp"),
         (4, "cert", "schema:url", "gs1:both"), (5, "odd", "gs1:zzz gs1:gtin", ""), (6, "none", "", "")],
        "row_number bigint, canonical_field string, jsonld_property string, "
        "recommended_jsonld_property string")
    terms = spark.createDataFrame(
        [("gs1:gtin", "GTIN", "xsd:string"), ("gs1:both", "", "")],
        "term_id string, label string, range_text string")
    links = linktypes_from_text(spark.createDataFrame(
        [("", '{"dpp": {"status": "stable"}, "both": {"status": "draft"}, "bad": 3}')],
        "path string, text string"))
    checked = catalog.revalidate(rows, terms, links)
    found = {r.canonical_field: r for r in checked.collect()}
    status = {k: (v.webvoc_property_status, v.category) for k, v in found.items()}
    assert status == {
        "gtin": ("webvoc_found", "validated"),
        "dpp_url": ("webvoc_linktype_available", "webvoc_linktype_available"),
        "cert": ("webvoc_found", "webvoc_linktype_available"),
        "odd": ("needs_webvoc_review", "webvoc_term_missing"),
        "none": ("not_applicable", "validated"),
    }
    assert found["dpp_url"].webvoc_property_validation == "gs1:dpp=stable linktype; schema:url=schema.org"
    assert found["odd"].webvoc_property_validation == "gs1:gtin=found; gs1:zzz=NOT FOUND"
    assert found["gtin"].webvoc_property_range == "gs1:gtin: xsd:string"
    assert catalog.revalidation_summary(checked).first().asDict() == {
        "catalog_rows": 5, "rows_with_missing_terms": 1, "rows_with_available_linktypes": 2,
        "valid": True}

"""Candidates: hand-worked scores per signal, and pair generation against a full cross join."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import DataFrame, functions as F

from tradeloom.fixed import COMPATIBLE_TYPES
from tradeloom.operators import candidates as cand
from tradeloom.sources.documents import backlog
from tradeloom.sources.profile import ObjectRule, Profile, Rule
from tradeloom.sources.tabular import catalog_rows

WORDS = ["net", "content", "brand", "colour", "Größe", "weight", "packaging", "status", "unit",
         "method", "the", "code", "origin", "country", "energy"]
PROPERTY_COLUMNS = ("term_id", "compact_name", "label", "comment", "domain", "range")
CATALOG_COLUMNS = ("jsonld_property", "gdsn_bms_id", "gdsn_attribute_name", "mapping_status",
                   "canonical_field", "confidence")


def inputs(seed: int, n_properties: int, n_attributes: int):
    rng = random.Random(seed)

    def phrase(k):
        return " ".join(rng.choices(WORDS, k=k))

    def camel():
        first, *rest = rng.choices(WORDS, k=rng.choice([1, 2, 3]))
        return first + "".join(w.capitalize() for w in rest)

    ranges = [*COMPATIBLE_TYPES, "gs1:SomeCode", "xsd:date; xsd:string", "", "XSD:String"]
    types = ["string", "Measurement", "boolean", "Decimal", "odd", "", "date", "gtin"]
    properties = [
        (f"gs1:p{i}", camel() if rng.random() < .9 else "", phrase(2), phrase(rng.choice([0, 5])),
         "", rng.choice(ranges)) for i in range(n_properties)
    ]
    attributes = []
    for i in range(n_attributes):
        name = rng.choice([phrase(1), phrase(2), camel(), ""])
        attributes.append({
            "row_pos": i, "bms_id": rng.choice([str(rng.randrange(40)), "", "x1"]),
            "attribute_name": name, "definition": phrase(rng.choice([0, 6])),
            "xpath": rng.choice(["", "/a/" + camel(), "/a/ns:" + camel() + "[1]/"]),
            "data_type": rng.choice(types), "uom_enabled": rng.choice(["Yes", "No", ""]),
            "semantic_resource_urn": rng.choice(["", "urn:x." + camel(), "urn." + phrase(1)]),
            "code_list_name": rng.choice(["", "list"]), "is_deleted": rng.choice(["true", "false", ""]),
            "row_type": rng.choice(["Attribute", "Class", "", "attribute"]),
            "is_candidate_source": "true",
        })
        if i and rng.random() < .4:
            attributes[-1] = attributes[-2] | {"row_pos": i, "bms_id": attributes[-1]["bms_id"]}
    statuses = ["mapped", "candidate", "needs_bms_review", "mapped_official_bms_xpath", "Mapped"]
    catalog = [
        (f"gs1:p{rng.randrange(n_properties)}", rng.choice([str(rng.randrange(40)), ""]),
         rng.choice([phrase(1), ""]), rng.choice(statuses), f"c{i}", rng.choice(["high", "low"]))
        for i in range(n_properties // 2)
    ]
    fields = [Rule(f"f{i}", "", f"gs1:p{rng.randrange(n_properties)}", rng.choice(WORDS))
              for i in range(6)]
    parent = ObjectRule("o", "", "", "o", "gs1:p0", (Rule("k", "", "gs1:p1", "net_content"),))
    decisions = [("SDR-1", ["gs1:p2", "gs1:p3"]), ("SDR-2", ["gs1:p3"])]
    return properties, attributes, catalog, Profile(tuple(fields), (parent,)), decisions


ATTRIBUTE_NAMES = (
    "row_pos", "bms_id", "attribute_name", "definition", "xpath", "data_type", "uom_enabled",
    "semantic_resource_urn", "code_list_name", "is_deleted", "row_type", "is_candidate_source",
    "module",
)
EXTRA = ("message", "parent_class", "multiplicity", "bms_code_list_id")


def frames(spark, properties, attributes, catalog, decisions):
    attribute_rows = spark.createDataFrame(
        [tuple(a.get(n, "") for n in ATTRIBUTE_NAMES) + ("",) * len(EXTRA) for a in attributes],
        ", ".join(f"{n} {'bigint' if n == 'row_pos' else 'string'}" for n in [*ATTRIBUTE_NAMES, *EXTRA]),
    ).repartition(3)
    catalog_df = catalog_rows(
        spark.createDataFrame(catalog, ", ".join(f"{c} string" for c in CATALOG_COLUMNS)).coalesce(1))
    text = json.dumps([{"id": i, "affected_properties": p} for i, p in decisions])
    return (
        spark.createDataFrame(properties, ", ".join(f"{c} string" for c in PROPERTY_COLUMNS)),
        attribute_rows, catalog_df, backlog(spark.createDataFrame([("", text)], "path string, text string")),
    )


# One property and one attribute per row, what they score and why, worked out by hand from
# the weights: (property fields, attribute fields, score, reasons, warnings).
CASES = [
    ({"label": "Shelf"}, {"attribute_name": "Door"}, None, [], []),
    # The catalog row of property c1 proves id 77.
    ({"term": "gs1:c1"}, {"bms_id": "77"}, 0.9, ["existing_mapping_catalog_match"], []),
    ({"term": "gs1:c1"}, {"attribute_name": "Proved Name"}, 0.9, ["existing_mapping_catalog_match"], []),
    ({"term": "gs1:c2"}, {"bms_id": "78"}, None, [], []),  # its catalog row proves nothing
    ({"term": "gs1:y"}, {"attribute_name": "net content"}, 0.65, ["mapping_yaml_canonical_field_match"], []),
    ({"name": "someThing"}, {"semantic_resource_urn": "urn:a.b.Some-Thing"}, None, [], []),
    ({"name": "someThing"}, {"semantic_resource_urn": "urn:x.someThing2"}, 0.8, ["semantic_resource_urn_match"], []),
    # Same name: 0.7, and both tokens of two shared, 0.35 more; the sum stops at one.
    ({"label": "blue door"}, {"attribute_name": "Blue Door"}, 1.0,
     ["exact_property_name_match", "label_attribute_token_overlap"], []),
    # One of at most four words: 0.35 / 4.
    ({"label": "blue door handle left"}, {"attribute_name": "door"}, 0.0875, ["label_attribute_token_overlap"], []),
    ({"name": "doorHandle"}, {"xpath": "/a/b:handleSide[1]/"}, 0.25, ["xpath_terminal_match"], []),
    # Two words of three and four: 0.2 * 2 / 4; a single shared word does not count.
    ({"comment": "wood steel glass"}, {"definition": "steel wood paint oil"}, 0.1, ["definition_comment_overlap"], []),
    ({"comment": "wood steel glass"}, {"definition": "steel paint"}, None, [], []),
    ({"range": "xsd:boolean"}, {"data_type": "Boolean"}, 0.15, ["range_datatype_compatible"], []),
    # A mismatch alone takes the score below zero, where it stops, and no reason keeps the pair.
    ({"range": "xsd:boolean"}, {"data_type": "String"}, None, [], []),
    ({"range": "xsd:boolean", "label": "door"}, {"data_type": "String", "attribute_name": "door"}, 0.9,
     ["exact_property_name_match", "label_attribute_token_overlap"], ["datatype_mismatch_warning"]),
    ({"range": "gs1:Measurement"}, {"uom_enabled": "Yes"}, 0.2, ["quantity_uom_compatible"], []),
    ({"name": "netQuantity"}, {"uom_enabled": "No"}, None, [], []),
    ({"range": "gs1:ColourCode"}, {"code_list_name": "Colours"}, 0.15, ["code_list_signal"], []),
    ({"term": "gs1:s"}, {}, 0.1, ["standards_review_linked"], []),
    # Linked (0.1), deleted (-0.3) and a class row (-0.2): nothing is left but the reason.
    ({"term": "gs1:s"}, {"is_deleted": "true", "row_type": "Class"}, 0.0, ["standards_review_linked"],
     ["deleted_attribute_warning", "class_row_not_attribute"]),
    ({"label": "door"}, {"attribute_name": "door", "row_type": "Attribute", "is_deleted": "true"}, 0.75,
     ["exact_property_name_match", "label_attribute_token_overlap"], ["deleted_attribute_warning"]),
]


def test_hand_worked_scores(spark):
    """All cases in one run; of the pairs made, only a case's own property and attribute count."""
    kinds = [p.get("term", "") for p, *_ in CASES]
    catalog = [(f"gs1:t{k}", "77", "proved name", "mapped", "", "high") for k, t in enumerate(kinds) if t == "gs1:c1"]
    catalog += [(f"gs1:t{k}", "78", "", "needs_bms_review", "", "") for k, t in enumerate(kinds) if t == "gs1:c2"]
    fields = tuple(Rule(f"k{k}", "", f"gs1:t{k}", "net_content") for k, t in enumerate(kinds) if t == "gs1:y")
    linked = [("SDR-1", [f"gs1:t{k}" for k, t in enumerate(kinds) if t == "gs1:s"])]
    properties = [(f"gs1:t{k}", p.get("name", ""), p.get("label", ""), p.get("comment", ""), "", p.get("range", ""))
                  for k, (p, *_) in enumerate(CASES)]
    attributes = [{"bms_id": "5", "attribute_name": "zzz", "row_type": "", **a, "row_pos": k, "module": str(k)}
                  for k, (_, a, *_) in enumerate(CASES)]
    sides = frames(spark, properties, attributes, catalog, linked)
    rows = cand.candidates(*sides[:2], sides[2], Profile(fields, ()), sides[3], limit=len(CASES)).collect()
    own = {r.webvoc_property_id: (r.score, r.reasons, r.warnings) for r in rows
           if r.webvoc_property_id == f"gs1:t{r.gdsn_module}"}
    for k, (p, a, score, reasons, warnings) in enumerate(CASES):
        want = None if score is None else (pytest.approx(score, abs=1e-4), reasons, warnings)
        assert own.get(f"gs1:t{k}") == want, (p, a)


def every_pair(properties: DataFrame, attributes: DataFrame, catalog: DataFrame, profile, decisions, limit: int):
    """The best of all pairs, scored by the engine over a full cross join."""
    p, a = cand.property_side(properties, catalog, profile, decisions), cand.attribute_side(attributes)
    proofs = cand.proof_keys(catalog).groupBy("p_id").agg(F.collect_set("key").alias("proof"))
    pairs = p.join(proofs, "p_id", "left").crossJoin(a).withColumn(
        "proved", F.expr("coalesce(array_contains(proof, concat('c:', bms_id)) "
                         "OR array_contains(proof, concat('m:', name_l)), false)"))
    found: dict = {}
    for r in cand.score_pairs(pairs).collect():
        found.setdefault(r.p_id, []).append(
            ((-r.score, r.bms_sort, r.row_pos), (r.bms_id, r.attribute_name, round(r.score, 4), r.reasons, r.warnings)))
    return {k: [row for _, row in sorted(rows, key=lambda x: x[0])[:limit]] for k, rows in found.items()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_keyed_pairs_lose_nothing(spark, seed):
    properties, attributes, catalog, profile, decisions = inputs(seed, 25, 160)
    p, a, c, d = frames(spark, properties, attributes, catalog, decisions)
    rows = cand.candidates(p, a, c, profile, d, limit=6).orderBy("webvoc_property_id", "rank").collect()
    got: dict = {}
    for r in rows:
        got.setdefault(r.webvoc_property_id, []).append(
            (r.gdsn_bms_id, r.gdsn_attribute_name, r.score, r.reasons, r.warnings))
    assert got == every_pair(p, a, c, profile, d, 6)
    assert len({reason for r in rows for reason in r.reasons}) == 11
    linked = [r for r in rows if r.webvoc_property_id == "gs1:p3"]
    assert linked and all(r.linked_sdr_ids == ["SDR-1", "SDR-2"] for r in linked)
    assert all(r.standards_review_status == "open" for r in linked)


def test_bounds_leave_most_pairs_unmade(spark):
    """A word that all share pairs nothing where a rarer one decides; ties go by order, not by pair."""
    properties = [(f"gs1:p{i}", "", f"common rare{i}", "", "", "") for i in range(20)]
    attributes = [{"row_pos": i, "bms_id": str(i), "attribute_name": f"common rare{i % 20}" if i % 5 else "common",
                   "data_type": "", "row_type": "attribute"} for i in range(1000)]
    p, a, c, d = frames(spark, properties, attributes, [], [])
    sides = cand.property_side(p, c, Profile((), ()), d), cand.attribute_side(a)
    made = cand.pair_ids(*sides, cand.proof_keys(c), 3)
    assert made.count() < 20 * 30 and made.distinct().count() == made.count()
    rows = cand.candidates(p, a, c, Profile((), ()), d, limit=3).collect()
    best = every_pair(p, a, c, Profile((), ()), d, 3)
    got: dict = {}
    for r in sorted(rows, key=lambda r: r.rank):
        got.setdefault(r.webvoc_property_id, []).append((r.gdsn_bms_id, r.gdsn_attribute_name, r.score, r.reasons, r.warnings))
    assert got == best


def test_filters_and_summary(spark):
    levels = ["high", "medium", "low", "review_required", "low"]
    rows = spark.createDataFrame(
        [(f"p{i % 2}", level, "proposed") for i, level in enumerate(levels)],
        "webvoc_property_id string, confidence_level string, review_status string")

    def kept(**options):
        found = cand.filter_candidates(rows, **options).collect()
        return sorted(r.confidence_level for r in found)

    assert kept() == sorted(levels)
    assert kept(min_confidence="medium") == ["high", "medium", "review_required"]
    assert kept(min_confidence="odd", include_review_required=False) == ["high", "low", "low", "medium"]
    assert kept(include_low_confidence=False, include_review_required=False) == ["high", "medium"]
    summary = cand.candidate_summary(rows).first()
    assert (summary.total_candidates, summary.properties_covered) == (5, 2)
    assert (summary.confidence_low, summary.status_not_recommended) == (2, 0)
    assert cand.by_review_status(rows, ["already_mapped"]).count() == 0

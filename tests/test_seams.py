"""Search over joined pieces against joining them."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tradeloom.operators import explorer, ranking, seams


@pytest.mark.parametrize("seed", [1, 2])
def test_every_seam_and_nothing_else(spark, seed, monkeypatch):
    chance = random.Random(seed)
    texts = ["a b", "ab", "b  a", "a", "ba ab", "bb b b", "aba b", "abab ab"]
    pieces, joined = [], {}
    for key in range(40):
        place = sorted(chance.sample(range(-1, 500), chance.randrange(1, 400 if key == 0 else 9)))
        parts = ["".join(chance.choices("ab", k=chance.choice([0, 0, 1, 2, 5, 30]))) for _ in place]
        pieces += [(key, p, t) for p, t in zip(place, parts, strict=True)]
        joined[key] = " ".join(parts)
    rows = spark.createDataFrame(pieces, "key int, place long, words string").repartition(5)
    found = seams.seams(rows, "key", "place", "words", longest=max(map(len, texts)), blanks=3)
    near = found.collect()
    assert all(r.words in joined[r.key] for r in near)
    for text in texts:
        hit = {k for k, p, t in pieces if text in t} | {r.key for r in near if text in r.words}
        assert hit == {k for k, whole in joined.items() if text in whole}, text


def test_search_and_topics_across_rows(spark):
    fields = [f for f in explorer.EVIDENCE_FIELDS]
    rows = [("p1", 3, {"canonical_field": "one", "bms_id": "9", "jsonld_property": "x file"}),
            ("p1", 5, {"canonical_field": "two", "bms_id": "", "source_attribute_name": "n"}), ("p2", 4, {"canonical_field": "type digital"})]
    evidence = spark.createDataFrame(
        [(t, n, tuple(cells.get(f, "") for f in fields)) for t, n, cells in rows],
        "term_id string, row_number long, evidence struct<" + ",".join(f"{f}:string" for f in fields) + ">")
    properties = spark.createDataFrame(
        [("p1", "L", None, ["d"], ["r"]), ("p2", "", "", [], [])], "term_id string, label string, comment string, domain array<string>, range array<string>")
    columns = ("canonical_field", "bms_id", "gdsn_xpath", "source_attribute_name", "jsonld_property")
    own = {"p1": ["p1", "l", "", "d", "r"], "p2": ["p2", "", "", "", ""]}
    hay = {k: " ".join([*words, *(" ".join(c.get(f, "") for t, _, c in rows if t == k) for f in columns)]) for k, words in own.items()}
    searches = ["one two", "two 9", "r one", "9     n", "9    n", "n x", "file", "L  d", "p2     type", "two one", "1 l", "zz"]
    got = {(r.search, r.term_id) for r in explorer.search_properties(properties, evidence, searches).collect()}
    assert got == {(s.lower(), k) for s in searches for k, text in hay.items() if s.lower() in text}


def test_topic_words_across_rows(spark):
    columns = ["mapping_status", "confidence", "canonical_field", "gdsn_attribute_name", "gdsn_xpath", "gdsn_bms_id",
               "technical_mapping_file", "jsonld_property", "recommended_jsonld_property", "notes", "webvoc_property_status",
               "webvoc_property_validation", "review_action", "mapping_version", "scope_group", "source"]
    cells = {"jsonld_property": "gs1:zzz"}
    rows = [{**cells, "canonical_field": "q", "jsonld_property": "gs1:zzz life"}, {**cells, "canonical_field": "cycle"}]
    table = spark.createDataFrame([(n + 2, *(r.get(c, "") for c in columns)) for n, r in enumerate(rows)],
                                  "row_number long, " + ", ".join(f"{c} string" for c in columns))
    properties = spark.createDataFrame([("gs1:zzz", "", "", [], [], [], False)],
        "term_id string, label string, comment string, domain array<string>, range array<string>, sub_property_of array<string>, is_link_type boolean")
    backlog = spark.createDataFrame([], "pos int, id string, title string, category string, status string, warning_count int, "
        "affected_fields array<string>, affected_properties array<string>, issue_url string, decision_file string")
    assert explorer.explore(properties, table, backlog).first().group == "Traceability and Lifecycle"

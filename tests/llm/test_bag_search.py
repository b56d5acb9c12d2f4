"""Ranked search with bag deduplication against a plain ranking of every document."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest

from tests.oracle import compare, connect
from tradeloom.llm import bag_search, queries

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, score long, key string, n int"


def terms(text: str | None) -> list[str]:
    return [re.sub("[A-Z]", lambda c: c[0].lower(), t) for t in TERM.findall(text or "")]


def brute(docs: list[tuple], items: list[tuple], k: int) -> list[tuple]:
    held = [(doc_id, found) for doc_id, text, *_ in docs if (found := terms(text))]
    total = sum(len(found) for _, found in held)
    asked: dict = {}
    for item_id, text in items:
        asked.setdefault(item_id, set()).update(terms(text))
    df = {t: sum(t in found for _, found in held) for t in set().union(*asked.values())}
    rows = []
    for item_id, wanted in asked.items():
        scored = []
        for doc_id, found in held:
            m = 100 - 50 + (50 * len(found) * len(held)) // total
            score = sum(
                math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df[t] + 1))) * (10**9 * found.count(t) // (1000 * found.count(t) + 20 * m))
                for t in wanted if t in found
            )
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        rows += [(item_id, at, doc_id, -score) for at, (score, _, _, doc_id) in enumerate(sorted(scored, key=lambda r: r[:3])[:k], 1)]
    return rows


def corpus() -> tuple[list[tuple], list[tuple]]:
    chance = random.Random(4)
    names = [f"w{k}" for k in range(60)] + ["Été", "été", "ß", "日本", "x1", "X1"]
    docs = [(k, " ".join(chance.choices(names, k=chance.randrange(0, 40))), 1, "c", 2) for k in range(150)]
    docs += [(1000 - k, "w1, W2; w3\n" + "-" * (k % 3), 1, "c", 2) for k in range(90)]  # one large class
    docs += [(500 + k, f"w2 w1 w3 other{k}", 1, None, None) for k in range(40)]  # same counts, other words outside
    docs += [(7, "w1 w1", None, None, None), (7, "w1 w1", None, None, None), (7, "w5", 1, "c", 2), (None, "w1 w2", 1, "c", 2)]
    docs += [(900, None, 1, "c", 2), (901, "", 1, "c", 2), (902, " .,;!", 1, "c", 2), (903, "w9 " * 60_000 + "w10", 1, "c", 2)]
    items = [(k, " ".join(chance.choices(names, k=chance.randrange(1, 12)))) for k in range(25)]
    items += [(30, "w1 W2 w3 w3"), (31, None), (32, ""), (33, "unheard"), (34, "w5"), (34, "w6"), (34, "w5"), (None, "w9")]
    return docs, items


@pytest.mark.parametrize("k,postings", [(50, 250_000), (3, 70)])
def test_equals_plain_ranking(spark, k, postings):
    docs, items = corpus()
    got = bag_search.search(
        spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(items, "item_id long, text string"), k, postings
    )
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(docs, items, k), key=str)


def test_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    name = "op11_lexical_search"
    assert compare(spark, connect(sf), queries.QUERIES[name], queries.ORACLES[name], sf) == ""


def test_empty_tables(spark):
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = some.withColumnRenamed("doc_id", "item_id")
    assert bag_search.search(some.limit(0), items).count() == bag_search.search(some, items.limit(0)).count() == 0
    assert bag_search.search(some.selectExpr("doc_id", "'' AS text"), items).count() == 0
    assert [tuple(r) for r in bag_search.search(some, items).collect()] == brute([(1, "a b")], [(1, "a b")], 50)


def test_best_keeps_the_least_members_among_equals():
    best = bag_search.Best(items=2, k=2)
    for first in ([9, 3, 8], [1, 7, 2]):
        best.take(np.array([[5, 0], [5, 1], [4, 0]]), np.array(first), np.array(first))
    assert [c.tolist() for c in best.rows] == [[0, 0, 1, 1], [5, 5, 1, 1], [1, 3, 3, 7], [1, 3, 3, 7]]

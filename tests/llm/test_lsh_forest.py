"""The near-duplicate join against all pairs, and components against a plain search."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from tradeloom.llm import lsh_forest as forest
from tradeloom.llm.components import components
from tradeloom.llm.id_filter import may_hold


def windows(text: str | None) -> frozenset:
    found = [w for w in (text or "").encode().split()]
    return frozenset(tuple(found[k : k + 5]) for k in range(max(1, len(found) - 4))) if found else frozenset()


def brute(rows: list[tuple]) -> dict[int, tuple[int, int, int]]:
    """doc_id -> (class, text, links) by comparing all pairs of different sets."""
    sets = {k: windows(text) for k, text, *_ in rows if k is not None}
    text_of = {k: min([j for j, s in sets.items() if s and s == sets[k]] or [k]) for k in sets}
    texts = sorted({t for k, t in text_of.items() if sets[k]})
    links = {t: [u for u in texts if u != t and 5 * len(sets[t] & sets[u]) >= 4 * len(sets[t] | sets[u])] for t in texts}
    top = {}
    for t in texts:
        if t not in top:
            queue = [t]
            while queue:
                u = queue.pop()
                if u not in top:
                    top[u] = t
                    queue.extend(links[u])
    return {k: (top.get(t, k), t, len(links.get(t, []))) for k, t in text_of.items()}


def corpus() -> list[tuple]:
    chance = random.Random(9)
    names = [f"word{k}" for k in range(400)]
    rows, number = [], 0

    def add(text):
        nonlocal number
        rows.append((number, text, "clash"))
        number += 1

    for group in range(25):
        base = chance.choices(names, k=chance.randrange(60, 200))
        for _ in range(chance.randrange(1, 7)):
            copy = list(base)
            for at in chance.sample(range(len(copy)), chance.randrange(0, 4)):
                copy[at] = chance.choice(names)
            add(" ".join(copy))
    big = chance.choices(names, k=150)
    for _ in range(70):
        copy = list(big)
        copy[chance.randrange(150)] = chance.choice(names)
        add(" ".join(copy))
    for text in [None, "", "  \t", "one", "one", "one two three four", "a b c d e", "A b c d e", "a  b c\nd e",
                 " ".join(names * 20), " ".join(names * 20 + ["tail"])]:
        add(text)
    rows += [rows[3], (None, rows[3][1], "clash"), (None, None, "clash")]
    return rows


@pytest.mark.parametrize("block", [512, 16])
def test_equals_all_pairs(spark, block):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, class_id string").repartition(7)
    got = forest.near_duplicates(docs, block=block).collect()
    assert len(got) == len(rows)
    assert all((r.class_id, r.text_id, r.n_links) == (None, None, 0) for r in got if r.doc_id is None)
    assert {r.doc_id: (r.class_id, r.text_id, r.n_links) for r in got if r.doc_id is not None} == brute(rows)


def test_one_of_each_class_stays(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, class_id string")
    kept = forest.keep_one(docs).collect()
    want = {top for top, *_ in brute(rows).values()}
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(want)
    assert sum(r.doc_id is None for r in kept) == 2


def test_id_with_two_texts(spark):
    text = " ".join(f"w{k}" for k in range(50))
    docs = spark.createDataFrame([(1, text), (1, text.upper()), (2, text.upper())], "doc_id long, text string")
    assert {r.class_id for r in forest.near_duplicates(docs).collect()} == {1}
    assert [r.doc_id for r in forest.keep_one(docs).collect()] == [1, 1]


def test_ids_with_two_texts_keep_all_links(spark):
    words = [f"w{k}" for k in range(60)]
    a, b, near_a, near_b = (" ".join(w) for w in (words, words[::-1], [*words[:-1], "x"], [*words[:0:-1], "y"]))
    rows = [(1, a, 1), (1, b, 1), (1, b.replace(" ", "\n"), 2), (2, near_a, 1), (3, near_b, 1), (4, "", 1), (4, None, 1), (4, "", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(3)
    got = sorted((r.doc_id, r.class_id, r.text_id, r.n_links) for r in forest.near_duplicates(docs).collect())
    assert got == [(1, 1, 1, 1)] * 3 + [(2, 1, 2, 1), (3, 1, 3, 1)] + [(4, 4, 4, 0)] * 3
    kept = sorted(((r.doc_id, r.text or "", r.n) for r in forest.keep_one(docs).collect()))
    assert kept == sorted([(1, a, 1), (1, b.replace(" ", "\n"), 2), (4, "", 1)])
    assert forest.keep_one(docs).columns == docs.columns


def test_blocks_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(forest, "BLOCK_BYTES", 3000)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, class_id string").repartition(7)
    got = forest.near_duplicates(docs).collect()
    assert {r.doc_id: (r.class_id, r.text_id, r.n_links) for r in got if r.doc_id is not None} == brute(rows)


@pytest.mark.parametrize(("held", "size"), [(100_000, 1000), (100_000, 3), (2, 1), (2, 7)])
def test_nodes_of_several_groups(monkeypatch, held, size):
    monkeypatch.setattr(forest, "HELD", held)
    chance = random.Random(size)
    rows = sorted((chance.randrange(40), chance.randrange(3), k) for k in range(150))
    rows += [(50, 9, 1000 + k) for k in range(10)] + [(60, 9, 2000 + k) for k in range(9)] + [(60, 8, 2010), (60, 9, 2011)]
    batches = [forest.batch_of(pa.schema([(n, pa.int64()) for n in ("key", "group", "vertex")]), list(zip(*rows[k : k + size], strict=True)))
               for k in range(0, len(rows), size)]
    got = [row for batch in forest._mixed_nodes(iter(batches)) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
    groups = {key: {g for k, g, _ in rows if k == key} for key, *_ in rows}
    must = [(key, vertex) for key, _, vertex in rows if len(groups[key]) > 1]
    assert len(got) == len(set(got)) and set(must) <= set(got) and [k for k, _ in got] == sorted(k for k, _ in got)
    if held > len(rows):
        assert got == must


def test_labels_are_prefixes_of_tries():
    chance = np.random.default_rng(2)
    least = chance.integers(0, 2**32, 40 * 8 + 8 * 4).astype(np.uint32)
    deep, shallow = least.copy(), least.copy()
    deep[40 * 8 + 8 * 3 : 40 * 8 + 8 * 3 + 4] ^= 1  # the twelfth level of four trees
    shallow[40 * 7 :] ^= 1  # the eighth of all
    label = forest.labels_of(least, 40, 8, 8, 12)
    same = forest.labels_of(deep, 40, 8, 8, 12)
    assert (label == same).tolist() == [False] * 4 + [True] * 36 and (label >> forest.TAIL == same >> forest.TAIL).all()
    assert not (label >> forest.TAIL == forest.labels_of(shallow, 40, 8, 8, 12) >> forest.TAIL).any()


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert forest.near_duplicates(docs).count() == 0 and forest.keep_one(docs).count() == 0


def test_recall_of_prefix():
    depth = forest.prefix_length(0.8, 0.999)
    assert 1 - (1 - 0.8**depth) ** forest.TREES >= 0.999 > 1 - (1 - 0.8 ** (depth + 1)) ** forest.TREES
    with pytest.raises(ValueError):
        forest.prefix_length(0.01, 0.999999)


def test_minhash_estimates_similarity():
    chance = np.random.default_rng(1)
    a = np.unique(chance.integers(0, 2**63, 3000).astype(np.uint64))
    b = np.concatenate([a[:2700], chance.integers(0, 2**63, 300).astype(np.uint64)])
    same = (forest.minhashes(a, 2000) == forest.minhashes(b, 2000)).mean()
    assert same == pytest.approx(2700 / 3300, abs=0.04)


def test_components(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, 101), (101, 100), (50, 60), (60, 55), (30, 7)] + [(200, k) for k in range(201, 260)]
    found = {r.vertex: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {found[k] for k in range(31)} == {0} and found[101] == found[100] == 100
    assert found[60] == found[55] == found[50] == 50 and {found[k] for k in range(200, 260)} == {200}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_filter_passes_all_ids_and_few_others(spark):
    ids = spark.range(0, 60_000, 3).union(spark.range(-5, -4))
    passed = spark.range(-5, 60_000).where(may_hold(ids)(F.col("id"))).select("id")
    assert ids.join(passed, "id", "left_anti").count() == 0
    assert passed.count() < 20_001 + 0.02 * 40_000
    assert spark.range(100).where(may_hold(ids.where("false"))(F.col("id"))).count() == 0


def test_few_texts_are_shuffled(spark, monkeypatch):
    """Of many texts without a copy, hardly any go into the joins that drop copies."""
    chance = random.Random(3)
    texts = [" ".join(str(chance.randrange(10**6)) for _ in range(30)) for _ in range(400)]
    rows = [(k, text) for k, text in enumerate(texts)] + [(1000, texts[0]), (1001, texts[1] + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    moved, joined = [], DataFrame.join

    def join(left, right, on=None, how=None):
        if "text" in left.columns:
            moved.append(left.count())
        return joined(left, right, on, how)

    monkeypatch.setattr(DataFrame, "join", join)
    kept = forest.keep_one(docs).collect()
    assert sorted(r.doc_id for r in kept) == list(range(400))
    assert len(moved) == 4 and max(moved) < 40

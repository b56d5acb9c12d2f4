"""Targets against plain sharing, rounding against its bounds and expectation."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tradeloom.llm import pivotal_mix as mix, queries
from tradeloom.llm.docstats import SPACE

DOCS = "doc_id long, text string, source string, size long, target string, tree int"


def n_words(text: str | None) -> int:
    return len([w for w in "".join(" " if c in SPACE else c for c in text or "").split(" ") if w])


def plain_targets(size_of: dict) -> dict:
    order = sorted((s for s in size_of if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in size_of if s is None]
    weight = {s: (1, 2, 3)[at % 3] for at, s in enumerate(order)}
    got, open_, rest = {}, set(order), sum(size_of.values())
    while open_:
        share = {s: rest * weight[s] / sum(weight[t] for t in open_) for s in open_}
        above = [s for s in open_ if share[s] > 3 * size_of[s]]
        if not above:
            return got | share
        for s in above:
            got[s] = 3.0 * size_of[s]
            rest -= 3 * size_of[s]
            open_.remove(s)
    return got


def corpus(chance: random.Random) -> list[tuple]:
    rows = []
    for source, n in [("big", 900), ("a", 40), ("b", 3), ("é", 60), ("z", 1), (None, 25), ("empty", 4)]:
        for _ in range(n):
            words = 0 if source == "empty" else int(chance.lognormvariate(3, 1.2))
            rows.append((len(rows), " x\n" * words + " ", source, 1, "t", 2))
    rows += [(5, "same words here", "a", 1, "t", 2)] * 30
    rows += [(None, "q " * 40, "big", 1, None, 2), (None, "q " * 41, "big", 1, None, 2), (9999, None, "a", None, None, None), (9998, "", None, 1, "t", 2)]
    rows += [(7777, "w " * 60_000, "big", 1, "t", 2)]
    return rows


@pytest.mark.parametrize("block_rows", [16, 4096])
def test_sources_meet_their_targets(spark, block_rows):
    rows = corpus(random.Random(3))
    df = spark.createDataFrame(rows, DOCS)
    got = mix.mix(df.repartition(5), block_rows=block_rows)
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"]
    out = got.collect()
    assert sorted((r.doc_id, r.size) for r in out if r.doc_id is not None) == sorted((r[0], n_words(r[1])) for r in rows if r[0] is not None)
    size_of = defaultdict(int)
    for _, text, source, *_ in rows:
        size_of[source] += n_words(text)
    want = plain_targets(dict(size_of))
    by_target = defaultdict(list)
    for r in out:
        by_target[r.source_size, round(r.target, 6)].append(r)
    assert set(by_target) == {(size_of[s], round(want[s], 6)) for s in size_of}
    for (source_size, target), docs in by_target.items():
        assert all(r.taken % r.size == 0 and r.taken <= 3 * r.size if r.size else r.taken == 0 for r in docs)
        # A text longer than all else of its block together cannot be made up for there.
        near = 2 if block_rows > 16 and len(docs) > 10 else max(r.size for r in docs)
        assert abs(sum(r.taken for r in docs) - target) <= near
    again = mix.mix(df.repartition(3, "size").orderBy("text"), block_rows=block_rows)
    assert sorted(map(str, again.collect())) == sorted(map(str, out))


def test_fights_keep_words_and_expectation():
    full = [size * mix.PARTS for size in (90, 50, 50, 20, 11, 7, 3)]
    mass = [f * part // 10 for f, part in zip(full, (3, 5, 9, 1, 4, 7, 2), strict=True)]
    total, mean = sum(mass), np.zeros(len(full))
    for seed in range(4000):
        copies, left = mix.fights(full, mass, random.Random(seed))
        assert sum(m > 0 for m in left) <= 1 and all(m < f for m, f in zip(left, full, strict=True)) and set(copies) <= {0, 1}
        assert sum(f * c + m for f, c, m in zip(full, copies, left, strict=True)) == total
        mean += [c + m / f for f, c, m in zip(full, copies, left, strict=True)]
    assert np.allclose(mean / 4000, [m / f for m, f in zip(mass, full, strict=True)], atol=0.03)
    assert mix.fights([], [], random.Random(1)) == ([], [])


@pytest.mark.parametrize("rate", [0.0, 0.2, 0.86, 1.0, 1.7, 2.8, 3.0])
def test_pooled_fights_keep_words_and_expectation(rate):
    sizes = [200, 90, 50, 50, *[20] * 90, *[3] * 300, 1]
    mass, mean = round(rate * sum(sizes) * mix.PARTS), np.zeros(len(sizes))
    for seed in range(2000):
        copies, left = mix.pooled_fights(sizes, mass, 3, random.Random(seed))
        assert sum(m > 0 for m in left) <= 1 and min(copies) >= 0
        assert sum(s * c * mix.PARTS + m for s, c, m in zip(sizes, copies, left, strict=True)) == mass
        assert all(c + (m > 0) <= 3 for c, m in zip(copies, left, strict=True))
        mean += [c + m / s / mix.PARTS for s, c, m in zip(sizes, copies, left, strict=True)]
    assert np.allclose(mean[:200] / 2000, rate, atol=0.06)


def test_a_text_that_cannot_be_made_up_for_is_decided_by_the_target():
    sizes = [3000, 900, 500, *[60] * 30, 7, 2]
    for seed in range(50):
        copies, left = mix.pooled_fights(sizes, 2000 * mix.PARTS, 3, random.Random(seed))
        assert copies[0] == 0 and abs(sum(s * c for s, c in zip(sizes, copies, strict=True)) - 2000) <= 60


def test_word_counts():
    texts = [None, "", " ", "a", " a", "a ", "a\tb\x0bc\x0cd\re\nf", "é ü x y", "\x1c \x85"]
    assert mix.word_counts(pa.array([t and t.encode() for t in texts], pa.binary())) == [n_words(t) for t in texts]


def test_wordless_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert sorted(map(tuple, mix.mix(df).collect())) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    assert mix.mix(df.limit(0)).count() == 0


def test_query_meets_targets(spark):
    rows = queries.op13_source_mix(spark, "/root/testdata/sf0.001").collect()
    taken, target = defaultdict(int), {}
    for r in rows:
        taken[r.source_size, r.target] += r.taken
    assert abs(sum(t for _, t in taken) - sum(r.size for r in rows)) < 1e-3
    assert all(abs(words - target) < 60 for (_, target), words in taken.items())


def test_last_residual_goes_to_the_nearer_side(spark):
    df = spark.createDataFrame([(1, "w " * 100, "a"), (2, "w " * 65, "b")], "doc_id long, text string, source string")
    for seed in "abcd":  # targets are 55 and 110
        assert {r.doc_id: r.taken for r in mix.mix(df, seed=seed).collect()} == {1: 100, 2: 130}

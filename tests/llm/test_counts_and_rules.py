"""Token counts, text counts, quality rules and the boosted trees against plain versions."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tradeloom.llm import docstats, quality_boost, quality_rules, token_counts

TEXTS = [None, "", " \t\n", "word", "a b c\u000bd", "x " * 5000, "Ünïcode ß straße\n\nline\nline\n line", "<|>#*$%&", "a b c a b c", "a a a a", "\n\n", "  end  "]


def best_count(pretoken: str, pieces: dict[bytes, int]) -> int:
    data = pretoken.encode()
    table = [(0, 0)]
    for end in range(1, len(data) + 1):
        table.append(max((table[b][0] + pieces[data[b:end]], table[b][1] - 1) for b in range(end) if data[b:end] in pieces))
    return -table[-1][1]


@pytest.mark.parametrize("max_nodes", [30, 1_000_000])
def test_token_counts_equal_plain_lattice(spark, max_nodes):
    chance = random.Random(1)
    texts = TEXTS + [" ".join("".join(chance.choices("thinger", k=chance.randrange(1, 14))) for _ in range(80)) for _ in range(10)]
    rows = [*((k, t, "clash") for k, t in enumerate(texts)), (0, texts[3], "clash"), (None, "x y", "clash")]
    got = token_counts.token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), max_nodes=max_nodes).collect()
    pieces, split = token_counts.vocabulary(None), token_counts.pattern(None)
    want = []
    for doc_id, text, _ in rows:
        found = split.findall(text or "")
        want.append((doc_id, len(text or ""), len(found), sum(best_count(p, pieces) for p in found)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert token_counts.token_counts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def repeat_words(words: list[str]) -> int:
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    return len({k + d for k, w in enumerate(windows) if windows.count(w) > 1 for d in range(3)})


def test_text_counts():
    for text in TEXTS[:5] + TEXTS[6:] + ["a b c d a b c", "x y z " * 30]:
        of = dict(zip(docstats.COUNTS, docstats.text_counts(text), strict=True))
        words = [w for w in "".join(" " if c in docstats.SPACE else c for c in text or "").split(" ") if w]
        lines = [line for line in (text or "").split("\n") if line.strip(docstats.SPACE)]
        assert of["n_words"] == len(words) and of["word_chars"] == sum(map(len, words))
        assert of["n_repeat_words"] == repeat_words(words) and of["n_symbols"] == sum((text or "").count(c) for c in docstats.SYMBOLS)
        assert of["n_dup_lines"] == sum(lines[k] in lines[:k] for k in range(len(lines)))


def test_bound_is_exact():
    for n, p, error in [(50, 0.1, 0.05), (400, 0.02, 0.01), (10, 0.5, 0.001), (0, 0.1, 0.05)]:
        tail = lambda k: sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))  # noqa: B023, E731
        assert quality_rules.most_rejections(n, p, error) == max([k for k in range(n) if tail(k) <= error], default=-1)


def test_cutoff_is_loosest_that_works():
    levels = np.array([3, 4, 60, 70])
    assert quality_rules.choose_cutoff(levels, np.array([500, 500, 0, 0]), np.array([0, 0, 50, 50]), 0.01, 0.05, 0.98) == 59
    assert quality_rules.choose_cutoff(levels, np.array([5, 5, 0, 0]), np.array([0, 0, 50, 50]), 0.01, 0.05, 0.98) is None
    assert quality_rules.choose_cutoff(levels, np.array([500, 500, 0, 0]), np.zeros(4), 0.01, 0.05, 0.98) is None


def marked_corpus(spark):
    chance, rows, labels = random.Random(2), [], []
    names = [f"word{k}" for k in range(3000)]
    for k in range(1500):
        good = k % 5 > 0
        words = chance.sample(names, 60)
        rows.append((k, " ".join(words) if good else " ".join(w + "***" for w in words), "en" if k % 3 else None, "clash"))
        if k % 4:
            labels.append((k, int(good)))
    rows += [(9001, None, "en", "x"), (9002, "", "xx", "x"), (None, " ".join(names[:70]), "en", "x"), rows[0]]
    labels += [(3, 0), (3, None), (None, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string"), spark.createDataFrame(labels, "doc_id long, quality int"), len(rows)


def test_rules_reject_what_labels_show(spark):
    docs, labels, n = marked_corpus(spark)
    for small in (10_000, 0):
        got = quality_rules.quality_rules(docs, labels, small=small).collect()
        assert len(got) == n
        for r in got:
            if r.doc_id is not None and r.doc_id < 9000:
                assert r.kept == (r.doc_id % 5 > 0) and not r.base_failed
        assert all(r.base_failed and not r.kept for r in got if r.doc_id in (9001, 9002))
    none = quality_rules.quality_rules(docs, labels.limit(0)).collect()
    assert all(r.kept != r.base_failed for r in none)
    assert quality_rules.quality_rules(docs.limit(0), labels).count() == 0


def test_pooled_cutoff_spares_a_stratum_whose_labels_speak_against_it(spark):
    """Capitals mark bad documents of "aa", all documents of "bb" have them; "cc" has too few labels."""
    chance = random.Random(6)
    names = [f"w{a}{b}{c}" for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"]
    rows, labels = [], []
    for k in range(2750):
        lang = "aa" if k < 2600 else "bb" if k < 2730 else "cc"
        good = k % 5 > 0
        words = chance.sample(names, 60)
        capital = lang == "bb" or not good
        rows.append((k, " ".join(words).upper() if capital else " ".join(words), lang))
        labels.append((k, int(good)))
    got = quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string"),
                                      spark.createDataFrame(labels, "doc_id long, quality int"), limit=0.5).collect()
    assert all(r.kept == (2600 <= r.doc_id < 2730 or r.doc_id % 5 > 0) for r in got)


def test_trees_learn_and_hold_out(spark):
    docs, labels, n = marked_corpus(spark)
    got = quality_boost.quality_scores(docs, labels).collect()
    assert len(got) == n and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 9000]
    assert len(held) > 300 and np.mean([r.predicted == (r.doc_id % 5 > 0) for r in held]) > 0.99
    assert {round(r.score, 6) for r in quality_boost.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_boost.quality_scores(docs.limit(0), labels).count() == 0


def test_flat_walk_equals_plain_walk():
    chance = np.random.default_rng(5)
    x = chance.random((400, len(quality_boost.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    model = quality_boost.grow(x, y, quality_boost.Growth(trees=20))
    binned = model.bins(x)
    for row in range(0, 400, 37):
        total = model.base
        for feature, split, leaf in zip(model.feature, model.split, model.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if binned[row, feature[node]] > split[node] else 1)
            total += leaf[node - len(feature)]
        assert model.score(x)[row] == pytest.approx(1 / (1 + math.exp(-total)))
    assert ((model.score(x) > 0.5) == y).mean() > 0.95


def test_sample_bound_is_a_parameter(spark):
    docs, labels, _ = marked_corpus(spark)
    counts = docstats.document_counts(docs)
    small = quality_boost.fit(counts, labels, quality_boost.Growth(sample=40, trees=3))
    assert small.feature.shape[0] == 3 and Counter(map(len, small.edges)).most_common(1)[0][0] <= 40


def test_large_sample_is_the_least_hashes(spark):
    rows = spark.range(9000).selectExpr("id AS doc_id", *(f"cast(pmod(xxhash64(id, '{c}'), 50) AS long) AS {c}" for c in docstats.COUNTS)).cache()
    labels = rows.selectExpr("doc_id", f"cast({docstats.COUNTS[0]} > 20 AS int) AS quality")
    how = quality_boost.Growth(sample=1500, trees=3)
    taught = rows.where("pmod(crc32(cast(cast(doc_id AS string) AS binary)), 3) <> 1")
    least = taught.orderBy(F.xxhash64("doc_id")).limit(1500)
    a, b = quality_boost.fit(rows, labels, how), quality_boost.fit(least, labels, how, ids=least)
    assert a.base == b.base and (a.feature == b.feature).all() and (a.leaf == b.leaf).all()

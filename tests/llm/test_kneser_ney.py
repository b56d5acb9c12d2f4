"""The language model against a plain dictionary version."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tradeloom.llm import kneser_ney as kn
from tradeloom.llm.queries import QUERIES

END = b"\0end"


def tokens(text: str | None) -> list[bytes]:
    return [*(text or "").encode().lower().split(), END]


class Plain:
    """Every count in dictionaries; contexts are tuples of words, latest last."""

    def __init__(self, texts: list[str | None], order: int) -> None:
        self.order = order
        self.raw = Counter(t for text in texts for t in tokens(text))
        top = Counter()
        for text in texts:
            line = [b"\0start"] * (order - 1) + tokens(text)
            for at in range(order - 1, len(line)):
                top[tuple(line[at - order + 1 : at + 1])] += 1
        self.levels = {order: top}
        for k in range(order - 1, 0, -1):
            self.levels[k] = Counter(gram[1:] for gram in self.levels[k + 1])
        self.cut, self.followers = {}, {}
        for k, grams in self.levels.items():
            times = Counter(grams.values())
            self.cut[k] = kn.discounts(*(times[i] for i in (1, 2, 3, 4)))
            self.followers[k] = defaultdict(list)
            for gram, n in grams.items():
                self.followers[k][gram[:-1]].append(n)

    def p(self, gram: tuple) -> float:
        k = len(gram)
        lower = self.p(gram[1:]) if k > 1 else 1 / (len(self.raw) + 1)
        counts = self.followers[k].get(gram[:-1])
        if not counts:
            return lower
        cut, n, total = self.cut[k], self.levels[k][gram], sum(counts)
        return (max(n - cut[min(n, 3)], 0) + sum(cut[min(c, 3)] for c in counts) * lower) / total

    def score(self, text: str | None) -> tuple[int, int, float, float]:
        line = [b"\0start"] * (self.order - 1) + tokens(text)
        grams = [tuple(line[at - self.order + 1 : at + 1]) for at in range(self.order - 1, len(line))]
        n, v = sum(self.raw.values()), len(self.raw)
        return (
            len(grams), sum(self.raw[g[-1]] > 0 for g in grams),
            sum(math.log10((self.raw[g[-1]] + 1) / (n + v + 1)) for g in grams), sum(math.log10(self.p(g)) for g in grams),
        )


def corpus() -> list[tuple]:
    chance = random.Random(4)
    names = [f"w{k}" for k in range(12)] + ["É", "Über"]
    weights = [1 / (k + 1) for k in range(len(names))]
    rows = [(k, " ".join(chance.choices(names, weights, k=chance.randrange(1, 30))), "x") for k in range(120)]
    rows += [(k, text, "x") for k, text in enumerate(
        [None, "", " \t\n", "never seen words", "W0\u000bw1 w2", "w0 " * 3000, "w0 w1", "w0 w1"], 120)]
    return [*rows, rows[5], (None, "w1 w2", "x")]


@pytest.mark.parametrize("order", [2, 3])
def test_scores_equal_plain_version(spark, order):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(5)
    got = kn.perplexities(docs, order).collect()
    held = {r.doc_id for r in got if r.held_out}
    assert held and None not in held
    plain = Plain([text for k, text, _ in rows if k is not None and k not in held], order)
    want = sorted(((k if k is not None else -1), *plain.score(text)) for k, text, _ in rows)
    mine = sorted(((r.doc_id if r.doc_id is not None else -1), r.n_tokens, r.n_known, r.base_score, r.score) for r in got)
    for a, b in zip(mine, want, strict=True):
        assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], rel=1e-9)
    assert {r.train_tokens for r in got} == {sum(plain.raw.values())}


def test_query_has_middle_levels(spark, tmp_path):
    rows = [(k, text) for k, text, _ in corpus() if k is not None]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op4_lm_scoring"](spark, str(tmp_path)).collect()
    held = {r.doc_id for r in got if r.held_out}
    plain = Plain([text for k, text in rows if k not in held], 3)
    want = sorted((k, plain.score(text)[-1]) for k, text in rows)
    assert [x for _, x in sorted((r.doc_id, r.score) for r in got)] == pytest.approx([x for _, x in want], rel=1e-9)


def test_probabilities_sum_to_one():
    plain = Plain([text for _, text, _ in corpus()], 2)
    for context in [(b"w0",), (b"w3",), (b"unseen",)]:
        known = sum(plain.p((*context, w)) for w in plain.raw)
        assert known + plain.p((*context, b"unseen")) == pytest.approx(1)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert kn.perplexities(docs).count() == 0


def test_layout_of_frequent_contexts_changes_no_score(spark):
    docs = spark.createDataFrame([(k, text) for k, text, _ in corpus()], "doc_id long, text string")
    spread, plain = kn.train(docs, fraction=1.0, share=0.01), kn.train(docs, fraction=1.0, share=2.0)
    assert len(spread.hot) > 3 and len(plain.hot) == 1
    a, b = (sorted(((r.doc_id is None, r.doc_id, r.score) for r in kn.score(docs, m).collect()), key=str) for m in (spread, plain))
    assert [x[:2] for x in a] == [x[:2] for x in b]
    assert [x[2] for x in a] == pytest.approx([x[2] for x in b])


def test_words_and_hashes(monkeypatch):
    monkeypatch.setattr(kn, "_BLOCK", 8)
    kn.powers.cache_clear()
    texts = ["Ab ab\tc", None, "", "ab", " a\x0bb\x0cc ", "É é \u00a0x", "abcdefghijklmnopqrst ab", "end"]
    got, sizes = kn.token_stream(pa.array(["skipped", *texts])[1:], 1)
    words = [w for text in texts for w in (b"\0start", *tokens(text))]
    assert sizes.tolist() == [len(tokens(text)) for text in texts]
    assert len(set(zip(words, got.tolist(), strict=True))) == len(set(words)) == len(set(got.tolist()))
    kn.powers.cache_clear()


def test_packed_columns_and_rows():
    columns = [np.array([3, 3, 1 << 40]), np.array([1 << 62, 0, 5]), np.array([7, 255, 256])]
    assert [c.tolist() for c in kn.unpack(kn.pack(columns))] == [c.tolist() for c in columns]
    shard = np.arange(40)
    rows = kn.packed([(kind, shard, [shard, shard + kind]) for kind in (kn.WORD, kn.GRAM, kn.CONTEXT)], 10)
    assert rows.num_rows == 10  # one a partition, however many shards and kinds
    assert {n: {k: [x.tolist() for x in c] for k, c in of.items()} for n, of in kn.by_shard(iter([rows]))} == {
        n: {kind: [[n], [n + kind]] for kind in (kn.WORD, kn.GRAM, kn.CONTEXT)} for n in range(40)}


def test_n_grams_take_few_bytes_on_their_way():
    chance = random.Random(3)
    text = " ".join(chance.choices([f"w{k}" for k in range(5000)], [1 / (k + 1) for k in range(5000)], k=100_000))
    stream, sizes = kn.token_stream(pa.array([text]), 2)
    words = np.unique(stream, return_inverse=True)[1] + kn._FIRST
    context, last = kn.n_grams(words, sizes, 3)
    columns, n = kn.summed([*context, last], [np.ones(len(last), np.int64)])
    rows = kn.packed([(kn.GRAM, kn.spread(columns[:-1], columns[-1], np.array([kn.START]), 48), [*columns, *n])], 12)
    assert rows.nbytes < 9 * len(n[0])


def test_counts_meet_in_one_shard(spark):
    texts = [f"a{k} of the b{k % 7} of the" for k in range(300)]
    docs = spark.createDataFrame([(7 * k, text) for k, text in enumerate(texts)], "doc_id long, text string")
    for share in (None, 0.05, 2.0):
        model, plain = kn.train(docs, 3, share=share), Plain(texts, 3)
        got = sorted((r.doc_id, r.score) for r in kn.score(docs, model).collect())
        assert [x for _, x in got] == pytest.approx([plain.score(text)[-1] for text in texts], rel=1e-9)

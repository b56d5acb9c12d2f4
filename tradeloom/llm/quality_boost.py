"""Quality classifier: histogram gradient-boosted trees over document statistics.

Features are ratios of counts over the whole text. They are cut into bins; each tree
level is grown from per-bin sums of gradients and curvatures; all trees have the same
depth, so a model is a few arrays and scoring walks all rows of a batch one level at a
time with numpy. Trees are fitted on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tradeloom.llm.common import batch_of, chunks, fold, in_tasks, stored
from tradeloom.llm.docstats import COUNTS, document_counts, text_counts

FEATURES = (
    "log_words", "word_length", "symbols", "duplicate_lines", "repeated_words", "unique_words",
    "letters", "capitals", "digits", "bangs", "pipes", "stops", "words_per_line",
)


def features(counts: np.ndarray) -> np.ndarray:
    """Rows of ``COUNTS`` -> rows of ``FEATURES``; an empty denominator gives 0."""
    of = {name: counts[:, k].astype(float) for k, name in enumerate(COUNTS)}

    def ratio(part: str, whole: str) -> np.ndarray:
        return of[part] / np.maximum(of[whole], 1)

    return np.column_stack([
        np.log1p(of["n_words"]), ratio("word_chars", "n_words"), ratio("n_symbols", "word_chars"),
        ratio("n_dup_lines", "n_lines"), ratio("n_repeat_words", "n_words"), ratio("n_unique_words", "n_words"),
        ratio("n_letters", "word_chars"), ratio("n_upper", "n_letters"), ratio("n_digits", "word_chars"),
        ratio("n_bangs", "n_words"), ratio("n_pipes", "n_words"), ratio("n_stops", "n_words"),
        ratio("n_words", "n_lines"),
    ])


@dataclass(frozen=True)
class Growth:
    trees: int = 60
    depth: int = 4
    bins: int = 64
    rate: float = 0.15
    ridge: float = 1.0
    least: float = 5.0
    sample: int = 50_000


@dataclass
class Model:
    """``feature`` and ``split`` by tree and inner node, ``leaf`` by tree and leaf; ``edges`` by feature."""

    edges: list[np.ndarray]
    feature: np.ndarray
    split: np.ndarray
    leaf: np.ndarray
    base: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(self.edges)])

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        binned, rows = self.bins(x), np.arange(len(x))
        total = np.full(len(x), self.base)
        inner = self.feature.shape[1]
        for feature, split, leaf in zip(self.feature, self.split, self.leaf, strict=True):
            node = np.zeros(len(x), int)
            while inner and node[:1].size and node[0] < inner:
                node = 2 * node + 1 + (binned[rows, feature[node]] > split[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, how: Growth) -> Model:
    """Fit to rows ``x`` and labels ``y``; one class only, or no row, gives the smoothed prior."""
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, how.bins + 1)[1:-1])) if len(x) else np.empty(0)
             for k in range(len(FEATURES))]
    prior = (y.sum() + 1) / (len(y) + 2)
    inner, leaves = 2**how.depth - 1, 2**how.depth
    model = Model(edges, np.zeros((0, inner), int), np.zeros((0, inner), int), np.zeros((0, leaves)),
                  float(np.log(prior / (1 - prior))))
    if len(np.unique(y)) < 2:
        return model
    binned, width = model.bins(x), how.bins
    total, trees = np.full(len(y), model.base), []
    for _ in range(how.trees):
        p = 1 / (1 + np.exp(-total))
        slope, bend = y - p, p * (1 - p)
        feature, split = np.zeros(inner, int), np.full(inner, width)
        node = np.zeros(len(y), int)
        for depth in range(how.depth):
            first, nodes = 2**depth - 1, 2**depth
            best = np.full(nodes, 1e-9)
            for k in range(len(FEATURES)):
                cell = (node - first) * width + binned[:, k]
                g = np.bincount(cell, slope, nodes * width).reshape(nodes, width).cumsum(axis=1)
                h = np.bincount(cell, bend, nodes * width).reshape(nodes, width).cumsum(axis=1)
                gs, hs = g[:, -1:], h[:, -1:]
                gain = (g**2 / (h + how.ridge) + (gs - g) ** 2 / (hs - h + how.ridge) - gs**2 / (hs + how.ridge))
                gain[(h < how.least / 4) | (hs - h < how.least / 4)] = 0
                at = gain.argmax(axis=1)
                top = gain[np.arange(nodes), at]
                better = top > best
                best[better] = top[better]
                feature[first : first + nodes][better] = k
                split[first : first + nodes][better] = at[better]
            node = 2 * node + 1 + (binned[np.arange(len(y)), feature[node]] > split[node])
        g = np.bincount(node - inner, slope, leaves)
        h = np.bincount(node - inner, bend, leaves)
        leaf = how.rate * g / (h + how.ridge)
        total += leaf[node - inner]
        trees.append((feature, split, leaf))
    model.feature, model.split, model.leaf = (np.array(part) for part in zip(*trees, strict=True))
    return model


def fit(counts: DataFrame, labels: DataFrame, how: Growth = Growth(), ids: DataFrame | None = None) -> Model:
    """Fit on labelled documents outside the held-out fold, at most ``how.sample`` of them.

    A larger set is sampled by the hash of the id: labelled rows are counted once, and only
    hashes below a share of a fifth more than the sample leave their tasks. ``ids``
    (``doc_id``) are those of ``counts``, if they can be read more cheaply. A document
    labelled in several rows counts as 1 only if all say so.
    """
    marked = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(fold(F.col("doc_id"), 3) != 1)
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    )
    ids = (counts if ids is None else ids).select(F.col("doc_id").cast("long").alias("doc_id"))
    share = (1.2 * how.sample + 1000) / max(1, ids.join(marked.select("doc_id"), "doc_id").count())
    if share < 1:
        marked = marked.where(F.xxhash64("doc_id") < int((share - 0.5) * 2**64))
    rows = (
        counts.join(marked, "doc_id").orderBy(F.xxhash64("doc_id"), *COUNTS).limit(how.sample)
        .select(*COUNTS, "quality").toPandas()
    )
    return grow(features(rows[list(COUNTS)].to_numpy()), (rows["quality"].to_numpy() == 1).astype(float), how)


def score_counts(counts: DataFrame, model: Model) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.column_stack([batch.column(name).to_numpy() for name in COUNTS])
            yield batch_of(schema, [batch.column("doc_id"), model.score(features(raw))])

    return in_tasks(counts.select("doc_id", *COUNTS), run, "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, how: Growth = Growth()) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``.

    ``held_out``: crc32 of the id as text, modulo 3, is 1 (false for a null id); such
    rows teach nothing. Inputs of a score are counts over the whole text alone; a null
    text counts as empty. Without a label of each class all scores are the smoothed
    prior. Repeated rows are scored row by row; other columns are ignored.
    """
    counts = stored(document_counts(docs))
    return score_counts(counts, fit(counts, labels, how)).select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def keep_good(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """Rows of ``docs``, all columns, whose score is at least ``least``; a narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 5000, 16_000_000, "text"):
            raw = np.array([text_counts(text) for text in batch.column("text").to_pylist()])
            yield batch.filter(pa.array(model.score(features(raw)) >= least))

    return in_tasks(docs, run, docs.schema)

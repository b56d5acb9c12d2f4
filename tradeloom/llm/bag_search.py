"""Ranked lexical search with bag deduplication.

Each item of a stated query set ranks all documents by a saturating term-frequency score
in whole numbers. A document matters only through the counts of the items' terms and its
length step ``m``, so documents are first restricted to the items' vocabulary. Documents
with the same counts and the same ``m`` are one class: classes meet by a hash and are told
apart by the counts themselves. A class is scored once, and only the classes that reach
an item's list are expanded to their members, by ascending ``doc_id``.

Items go to the workers in blocks of bounded size; texts are read once a block, in a narrow
pass. What is shuffled are bags (counts of vocabulary terms), combined before the shuffle,
so a group of many copies moves as one row a task. A task keeps the ``k`` best classes of
each item, and at most ``k`` members of a class leave a task: no other member can be listed.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tradeloom.llm.common import batch_of, chunks, in_tasks, stored

_LAST = 2**63 - 1
#: ASCII capitals become small letters; ASCII that is no letter or digit parts terms; all else belongs to them.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)

_BAGS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int64()))])
_BAGS_DDL = "doc_id long, n long, terms array<int>, tfs array<long>"
_FOUND = pa.schema([("item_id", pa.int64()), ("score", pa.int64()), ("first", pa.int64()), ("class_id", pa.int64())])
_FOUND_DDL = "item_id long, score long, first long, class_id long"


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order: runs of ASCII letters and digits and of all that is not ASCII."""
    return text.translate(_FOLD).split()


def length_step(n: int, documents: int, terms: int) -> int:
    """``m`` of a document of ``n`` terms among ``documents`` that hold ``terms`` together."""
    return 50 + 50 * n * documents // terms


def term_weight(df: int, documents: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


@dataclass
class Items:
    """Items of the query set: ids, their terms by number, and for each term the items that have it."""

    ids: list[int | None]
    numbers: dict[bytes, int]
    holders: list[np.ndarray]

    @classmethod
    def of(cls, rows: list[tuple[int | None, list[bytes]]]) -> Items:
        numbers: dict[bytes, int] = {}
        holders: list[list[int]] = []
        for at, (_, terms) in enumerate(rows):
            for term in terms:
                number = numbers.setdefault(term, len(numbers))
                if number == len(holders):
                    holders.append([])
                holders[number].append(at)
        return cls([item_id for item_id, _ in rows], numbers, [np.array(h, np.int64) for h in holders])


def item_blocks(items: DataFrame, postings: int, at_most: int) -> Iterator[Items]:
    """The items in blocks of about ``postings`` distinct terms, at most ``at_most`` items each.

    Rows of one ``item_id`` are one item with the terms of all of them.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 5000, 16_000_000, "text"):
            found = [sorted(set(terms_of(text or b""))) for text in batch.column("text").to_pylist()]
            yield batch_of(pa.schema([("item_id", pa.int64()), ("terms", pa.list_(pa.binary()))]), [batch.column("item_id"), found])

    source = items.select(F.col("item_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text"))
    terms = in_tasks(source, split, "item_id long, terms array<binary>").select("item_id", F.explode("terms").alias("term"))
    gathered = terms.distinct().groupBy("item_id").agg(F.sort_array(F.collect_list("term")).alias("terms"))
    rows, held = [], 0
    for item_id, found in gathered.orderBy("item_id").toLocalIterator():
        rows.append((item_id, [bytes(t) for t in found]))
        held += len(found)
        if held >= postings or len(rows) >= at_most:
            yield Items.of(rows)
            rows, held = [], 0
    if rows:
        yield Items.of(rows)


def bags(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """``doc_id, n, terms, tfs`` of each document with a term: how many it has, and its counts of the numbered ones."""
    sent = docs.sparkSession.sparkContext.broadcast(numbers)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in chunks(batches, 5000, 16_000_000, "text"):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = terms_of(text or b"")
                if found:
                    times = Counter(found)
                    bag = sorted((known[t], times[t]) for t in known.keys() & times.keys())
                    rows.append((doc_id, len(found), [t for t, _ in bag], [c for _, c in bag]))
            yield batch_of(_BAGS, list(zip(*rows, strict=True)) or [[]] * len(_BAGS))

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text"))
    return in_tasks(source, count, _BAGS_DDL)


class Best:
    """The ``k`` best classes of each item met so far; equal scores by the least member, then by class."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.floor = np.ones(items, np.int64)
        self.rows = [np.empty(0, np.int64)] * 4

    def take(self, scores: np.ndarray, first: np.ndarray, classes: np.ndarray) -> None:
        """Classes by row, items by column."""
        if len(scores) > self.k:
            self.floor = np.maximum(self.floor, np.partition(scores, len(scores) - self.k, axis=0)[len(scores) - self.k])
        row, item = np.nonzero(scores >= self.floor)
        if not len(row):
            return
        new = [item, scores[row, item], first[row], classes[row]]
        item, score, least, number = (np.concatenate(pair) for pair in zip(self.rows, new, strict=True))
        order = np.lexsort((number, least, -score, item))
        at = np.arange(len(order)) - np.searchsorted(item[order], item[order])
        order = order[at < self.k]
        self.rows = [column[order] for column in (item, score, least, number)]
        full = at[at < self.k] == self.k - 1
        np.maximum.at(self.floor, self.rows[0][full], self.rows[1][full])


def scores_of(items: Items, weights: np.ndarray, m: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray) -> np.ndarray:
    """Scores, in 64-bit whole numbers, of classes (rows) for items (columns)."""
    row = np.repeat(np.arange(len(m)), sizes)
    part = weights[terms] * (1_000_000_000 * tfs // (1000 * tfs + 20 * m[row]))
    scores = np.zeros((len(m), len(items.ids)), np.int64)
    order = np.argsort(terms, kind="stable")
    edges = np.flatnonzero(np.diff(terms[order], prepend=-1, append=-1))
    for begin, end in zip(edges, edges[1:]):
        at = order[begin:end]
        scores[row[at][:, None], items.holders[terms[at[0]]]] += part[at][:, None]
    return scores


def _scorer(items, weights, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, weight = items.value, weights.value
        best, rows = Best(len(held.ids), k), max(1, 2_000_000 // len(held.ids))
        for batch in batches:
            for begin in range(0, len(batch), rows):
                part = batch.slice(begin, rows)
                class_id, m, first = (part.column(c).to_numpy(zero_copy_only=False) for c in ("class_id", "m", "first"))
                terms, tfs = part.column("terms"), part.column("tfs")
                sizes = terms.value_lengths().to_numpy(zero_copy_only=False)
                best.take(scores_of(held, weight, m, sizes, terms.flatten().to_numpy(), tfs.flatten().to_numpy()), first, class_id)
        item, *columns = best.rows
        yield batch_of(_FOUND, [[held.ids[at] for at in item.tolist()], *columns])

    return run


def _rank(by: list[str], *order: Column) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order))


def _search_block(docs: DataFrame, items: Items, k: int) -> DataFrame | None:
    spark, same = docs.sparkSession, ["key", "m", "terms", "tfs"]
    counted = stored(bags(docs, items.numbers), "bags")
    documents, total = counted.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not documents:
        return None
    held = counted.where(F.size("terms") > 0).select(
        "doc_id", "terms", "tfs", F.xxhash64("terms", "tfs").alias("key"),
        F.expr(f"50 + (50 * n * {documents}L) div {total}L").alias("m"),
    )
    weights = np.zeros(len(items.numbers), np.int64)
    for term, df in held.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
        weights[term] = term_weight(df, documents)

    classes = stored(
        held.groupBy(*same)
        .agg(F.coalesce(F.min("doc_id"), F.lit(_LAST)).alias("first"))
        .select(F.monotonically_increasing_id().alias("class_id"), "first", *same),
        "classes",
    )
    send = spark.sparkContext.broadcast
    scored = in_tasks(classes.select("class_id", "first", "m", "terms", "tfs"), _scorer(send(items), send(weights), k), _FOUND_DDL)
    best = stored(
        scored.select("*", _rank(["item_id"], F.desc("score"), F.asc("first"), F.asc("class_id")).alias("place")).where(F.col("place") <= k),
        "best",
    )
    # At most k classes an item of the block: bounded by the block, whatever the documents.
    chosen = classes.join(F.broadcast(best.select("class_id").distinct()), "class_id").select("class_id", *same)
    members = (
        held.join(F.broadcast(chosen.select("key").distinct()), "key", "left_semi")
        .select("doc_id", *same, _rank(same, F.asc_nulls_last("doc_id")).alias("place"))
        .where(F.col("place") <= k)
        .join(chosen, same)
        .select("class_id", "doc_id")
    )
    listed = best.select("item_id", "score", "class_id").join(members, "class_id")
    rank = _rank(["item_id"], F.desc("score"), F.asc_nulls_last("doc_id")).alias("rank")
    return listed.select("item_id", rank, "doc_id", "score").where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 50, block_postings: int = 250_000, block_items: int = 1000) -> DataFrame:
    """The ``k`` best documents of each item: ``item_id, rank, doc_id, score``.

    Scores above 0 only, highest first, equal scores by ascending ``doc_id`` (null last).
    A document's weight for an item is the sum, over the item's distinct terms, of
    ``w * ((10**9 * tf) div (1000 * tf + 20 * m))``.

    Null and empty texts have no terms: such a document is not counted, such an item lists
    nothing. Repeated rows of a document are documents of their own, each with its
    rank. Rows of one ``item_id`` are one item with the terms of all of them. Other
    columns are ignored. An empty table on either side gives no row. Texts are read
    whole, at any length.
    """
    found = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    parts = (_search_block(docs, block, k) for block in item_blocks(items, block_postings, block_items))
    for part in parts:
        found = found if part is None else found.union(part)
    return found

"""Benchmark decontamination by greedy string tiling.

Texts are sequences of lower-case words. A benchmark item and a document that share a
seed, ``match`` consecutive words found by a rolling Karp-Rabin hash, are tiled: the
longest common run of words not yet marked is marked in both, again and again, until
none has ``match`` words. The share of the item's words under tiles is its coverage, so
a passage is found in whatever order its parts come.

The benchmark is the small side. It is sent to the workers in blocks of bounded size and
each block is held against all documents in one narrow pass over whole texts; a block
holds word numbers and the places of its seeds. Nothing is shuffled, and a document of
a hot group costs no more than another.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tradeloom.llm.common import batch_of, chunks, in_tasks

_WORD = re.compile(r"\w+")
_BASE = np.uint64(0x9E3779B97F4A7C15)

SCHEMA = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("item_words", pa.int64()),
                    ("covered", pa.int64()), ("tiles", pa.int64()), ("coverage", pa.float64())])


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def rolling(ids: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hashes, modulo 2**64, of all windows of ``width`` ids."""
    if len(ids) < width:
        return np.empty(0, np.uint64)
    value, n = np.zeros(len(ids) - width + 1, np.uint64), len(ids) - width + 1
    for k in range(width):
        value = value * _BASE + ids[k : k + n].astype(np.uint64)
    return value ^ value >> np.uint64(31)


@dataclass
class Block:
    """Items of the benchmark: their words as numbers from 1, and the places of each seed."""

    match: int
    vocabulary: dict[str, int] = field(default_factory=dict)
    items: list[tuple[int, np.ndarray]] = field(default_factory=list)
    seeds: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    first: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    places: list[tuple[int, int]] = field(default_factory=list)

    @classmethod
    def of(cls, rows: list[tuple[int, str | None]], match: int) -> Block:
        block, hashes = cls(match), []
        for item_id, text in rows:
            ids = np.array([block.vocabulary.setdefault(w, len(block.vocabulary) + 1) for w in words(text)], np.int64)
            for at, value in enumerate(rolling(ids, match)):
                hashes.append(value)
                block.places.append((len(block.items), at))
            block.items.append((item_id, ids))
        value = np.array(hashes, np.uint64)
        order = np.argsort(value, kind="stable")
        block.places = [block.places[k] for k in order]
        block.seeds, block.first = np.unique(value[order], return_index=True)
        block.first = np.append(block.first, len(order))
        return block

    def leaks(self, text: str | None, least: float) -> Iterator[tuple[int, int, int, int, float]]:
        """(item_id, item words, covered words, tiles, coverage) for coverage of ``least`` or more."""
        number = self.vocabulary.get
        ids = np.array([number(w, 0) for w in words(text)], np.int64)
        known = ids > 0
        if known.sum() < self.match or not len(self.seeds):
            return
        value = rolling(ids, self.match)
        slot = np.searchsorted(self.seeds, value)
        slot[slot == len(self.seeds)] = 0
        by_item: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for at in np.flatnonzero((self.seeds[slot] == value) & known[: len(value)]):
            for item, place in self.places[self.first[slot[at]] : self.first[slot[at] + 1]]:
                by_item[item].append((int(at), place))
        for item, seeds in by_item.items():
            item_id, wanted = self.items[item]
            covered, tiles = tile(ids, wanted, seeds, self.match)
            if covered >= least * len(wanted):
                yield item_id, len(wanted), covered, tiles, covered / len(wanted)


def runs(text: np.ndarray, item: np.ndarray, seeds: list[tuple[int, int]], match: int) -> list[tuple[int, int, int]]:
    """Longest common runs (length, start in text, start in item) that the seeds belong to."""
    found, last = [], {}
    for at, place in sorted(seeds):
        if (text[at : at + match] != item[place : place + match]).any():
            continue
        begin, length = last.get(at - place, (0, 0))
        if length and at <= begin + length - match + 1:
            last[at - place] = (begin, at - begin + match)
        else:
            if length:
                found.append((length, begin, begin - (at - place)))
            last[at - place] = (at, match)
    found.extend((length, begin, begin - diagonal) for diagonal, (begin, length) in last.items())
    return found


def tile(text: np.ndarray, item: np.ndarray, seeds: list[tuple[int, int]], match: int) -> tuple[int, int]:
    """Words of the item under greedy tiles, and how many tiles.

    Ties of length go to the earlier start in the text, then in the item. A run partly
    marked when its turn comes is cut to its free stretches, which queue again.
    """
    queue = [(-length, at, place) for length, at, place in runs(text, item, seeds, match)]
    heapify(queue)
    in_text, in_item = set(), bytearray(len(item))
    covered = tiles = 0
    while queue:
        length, at, place = heappop(queue)
        free = [at + k not in in_text and not in_item[place + k] for k in range(-length)]
        if all(free):
            in_text.update(range(at, at - length))
            in_item[place : place - length] = b"\1" * -length
            covered -= length
            tiles += 1
            continue
        begin = None
        for k, is_free in enumerate([*free, False]):
            if is_free and begin is None:
                begin = k
            elif not is_free and begin is not None:
                if k - begin >= match:
                    heappush(queue, (begin - k, at + begin, place + begin))
                begin = None
    return covered, tiles


def blocks(benchmark: DataFrame, match: int, characters: int) -> Iterator[Block]:
    """The benchmark in blocks of about ``characters``; one block is held at a time."""
    rows, held = [], 0
    source = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    for item_id, text in source.toLocalIterator():
        rows.append((item_id, text))
        held += len(text or "")
        if held >= characters:
            yield Block.of(rows, match)
            rows, held = [], 0
    if rows:
        yield Block.of(rows, match)


def leaks(
    docs: DataFrame, benchmark: DataFrame, match: int = 4, least: float = 0.5, block_characters: int = 20_000_000
) -> DataFrame:
    """One row per document and benchmark item it leaks.

    ``doc_id, item_id, item_words, covered, tiles, coverage``: an item is leaked when
    tiles of ``match`` or more words cover at least ``least`` of its words. Items with
    fewer than ``match`` words, null and empty texts match nothing. Repeated rows and
    null ids are handled row by row; other columns are ignored. An empty table on
    either side gives no row.
    """
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = docs.sparkSession.createDataFrame(
        [], "doc_id long, item_id long, item_words long, covered long, tiles long, coverage double"
    )
    for number, block in enumerate(blocks(benchmark, match, block_characters)):
        part = in_tasks(source, _finder(docs.sparkSession.sparkContext.broadcast(block), least), found.schema)
        found = found.union(part) if number else part
    return found


def _finder(sent, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 5000, 16_000_000, "text"):
            rows = [
                (doc_id, *leak)
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)
                for leak in sent.value.leaks(text, least)
            ]
            yield batch_of(SCHEMA, list(zip(*rows, strict=True)) or [[]] * len(SCHEMA))

    return run


def without_leaks(
    docs: DataFrame, benchmark: DataFrame, match: int = 4, least: float = 0.5, block_characters: int = 20_000_000
) -> DataFrame:
    """Rows of ``docs``, all columns, that leak no benchmark item; a narrow pass per block."""

    def keeper(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in chunks(batches, 5000, 16_000_000, "text"):
                clean = [next(sent.value.leaks(text, least), None) is None for text in batch.column("text").to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return run

    for block in blocks(benchmark, match, block_characters):
        docs = in_tasks(docs, keeper(docs.sparkSession.sparkContext.broadcast(block)), docs.schema)
    return docs

"""Language identification with language-bitmask filters of character trigrams.

A trigram is three characters of the lower-cased text in which every run of other than
letters is one space. Spark counts trigrams by language. A language owns a trigram when
the trigram is frequent enough in it and holds a large enough share among the languages'
frequencies. Owned trigrams go into one Bloom filter whose slots hold a bit per language
(bit slices): a look-up ANDs a trigram's slots and so returns all its languages at once.
A text's hits are counted per language, the expected false positives are taken out, and
the language with the largest share of hits is the prediction.

The frequency floor bounds the filter: a language owns at most ``1 / floor`` trigrams.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tradeloom.llm.common import batch_of, chunks, fold, in_tasks, ship_package, stored

_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.frombuffer(bytes(chr(c).isalpha() for c in range(0x110000)), bool)


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams (three code points in 63 bits) of all texts in turn, and how many each text has.

    Windows over a gap between words are left out.
    """
    lower = [(text or "").lower() for text in texts]
    joined = "\0".join(f" {text} " for text in lower)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters()[code]
    code = np.where(letter, code, 32).astype(np.int64)
    mark = np.zeros(len(code), bool)  # the character between two texts
    mark[np.cumsum([len(text) + 3 for text in lower])[:-1] - 1] = True
    keep = letter | mark | np.concatenate([[True], letter[:-1] | mark[:-1]])
    code, mark = code[keep], mark[keep]
    whose = np.cumsum(mark)
    if len(code) < 3:
        return np.empty(0, np.int64), np.zeros(len(texts), np.int64)
    window = code[:-2] << 42 | code[1:-1] << 21 | code[2:]
    inside = (code[1:-1] != 32) & ~(mark[:-2] | mark[1:-1] | mark[2:])
    return window[inside], np.bincount(whose[:-2][inside], minlength=len(texts))


def bits_for(grams: int, per_gram: int) -> int:
    """Bits of a slot's number: a slice has ``per_gram`` slots or more for each of a language's trigrams."""
    return max(10, int(np.ceil(np.log2(max(1, grams) * per_gram))))


def places(grams: np.ndarray, bits: int, hashes: int) -> Iterator[np.ndarray]:
    key = grams.astype(np.uint64)
    key ^= key >> np.uint64(29)
    for k in range(hashes):
        yield (key * np.uint64(_MIX[k]) >> np.uint64(64 - bits)).astype(np.int64)


def slice_of(grams: np.ndarray, bits: int, hashes: int) -> bytes:
    """One language's slots, a bit each."""
    slots = np.zeros(1 << bits, np.uint8)
    for at in places(grams, bits, hashes):
        slots[at] = 1
    return np.packbits(slots).tobytes()


@dataclass
class Filter:
    """``slots``: one row per slot, one 64-bit word per 64 languages; ``wrong``: false-positive rate by language."""

    languages: list[str]
    slots: np.ndarray
    wrong: np.ndarray
    hashes: int

    @classmethod
    def of(cls, languages: list[str], grams: np.ndarray, owner: np.ndarray, per_gram: int = 16, hashes: int = 4) -> Filter:
        """A filter of all languages' trigrams at once."""
        bits = bits_for(int(np.bincount(owner, minlength=1).max()), per_gram)
        return cls.from_slices(languages, {k: slice_of(grams[owner == k], bits, hashes) for k in np.unique(owner)}, bits, hashes)

    @classmethod
    def from_slices(cls, languages: list[str], slices: dict[int, bytes], bits: int, hashes: int) -> Filter:
        """A filter from the packed bits of each language, by its number."""
        filter_ = cls(languages, np.zeros((1 << bits, max(1, -(-len(languages) // 64))), np.uint64), np.zeros(len(languages)), hashes)
        for k, packed in slices.items():
            slice_ = np.unpackbits(np.frombuffer(packed, np.uint8))
            filter_.slots[:, k // 64] |= slice_.astype(np.uint64) << np.uint64(k % 64)
            filter_.wrong[k] = slice_.mean() ** hashes
        return filter_

    def places(self, grams: np.ndarray) -> Iterator[np.ndarray]:
        return places(grams, int(len(self.slots)).bit_length() - 1, self.hashes)

    def languages_of(self, grams: np.ndarray) -> np.ndarray:
        """Language bits of each trigram: one row per trigram."""
        found = None
        for at in self.places(grams):
            found = self.slots[at] if found is None else found & self.slots[at]
        return found

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        grams, sizes = trigrams(texts)
        masks = self.languages_of(grams)
        starts = np.cumsum(sizes) - sizes
        share = np.zeros((len(texts), max(1, len(self.languages))))
        full = np.flatnonzero(sizes)
        for k in range(len(self.languages)):
            hit = (masks[:, k // 64] >> np.uint64(k % 64) & np.uint64(1)).astype(np.int64)
            got = np.add.reduceat(hit, starts[full]) / sizes[full] if len(full) else np.empty(0)
            share[full, k] = np.clip((got - self.wrong[k]) / max(1e-9, 1 - self.wrong[k]), 0, 1)
        best = share.argmax(axis=1)
        total = share.sum(axis=1)
        score = np.divide(share.max(axis=1), total, out=np.zeros(len(texts)), where=total > 0)
        known = (sizes > 0) & bool(self.languages)
        names = [self.languages[b] if k else "und" for b, k in zip(best, known, strict=True)]
        return names, np.where(known, score, 0.0)


def count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])
    for batch in chunks(batches, 20_000, 2_000_000, "text"):
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        texts = batch.column("text").to_pylist()
        for lang in sorted(set(langs)):
            grams, _ = trigrams([texts[k] for k in np.flatnonzero(langs == lang)])
            gram, n = np.unique(grams, return_counts=True)
            yield batch_of(schema, [[lang] * len(gram), gram, n])


def learn(docs: DataFrame, floor: float = 1e-6, share: float = 0.5, per_gram: int = 16, hashes: int = 4) -> Filter:
    """Learn from all ``docs`` with a language and a text.

    A language owns a trigram that is at least ``floor`` of its trigrams and whose
    frequency there is at least ``share`` of the highest in any language. Languages are
    in order of their names, which also settles ties. A task builds the slice of a
    language, of at most ``1 / floor`` trigrams; all slices have the size that the largest
    needs, and only they come to the driver.
    """
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").select(
        F.col("lang").cast("string"), F.col("text").cast("string")
    )
    counts = stored(
        in_tasks(known, count_trigrams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    )
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    frequent = counts.join(totals, "lang").select("lang", "gram", (F.col("n") / F.col("total")).alias("f")).where(
        F.col("f") >= floor
    )
    highest = frequent.groupBy("gram").agg(F.max("f").alias("highest"))
    owned = stored(frequent.join(highest, "gram").where(F.col("f") >= share * F.col("highest")).select("lang", "gram"), "owned")
    languages = sorted(row.lang for row in totals.collect())
    largest = owned.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    bits = bits_for(largest, per_gram)

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lang": rows["lang"].iloc[:1], "slice": [slice_of(rows["gram"].to_numpy(np.int64), bits, hashes)]})

    ship_package(docs.sparkSession)
    built = owned.groupBy("lang").applyInPandas(build, "lang string, slice binary").collect()
    number = {name: k for k, name in enumerate(languages)}
    return Filter.from_slices(languages, {number[r.lang]: bytes(r.slice) for r in built}, bits, hashes)


def identify(docs: DataFrame, known: Filter) -> DataFrame:
    """``doc_id, lang_pred, score`` by the filter alone; a narrow pass over whole texts."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 20_000, 2_000_000, "text"):
            yield batch_of(schema, [batch.column("doc_id"), *sent.value.predict(batch.column("text").to_pylist())])

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return in_tasks(source, run, "doc_id long, lang_pred string, score double")


def language_ids(docs: DataFrame, floor: float = 1e-6, share: float = 0.5) -> DataFrame:
    """One row per document: ``doc_id, held_out, lang_pred, score``.

    ``held_out``: crc32 of the id as text, modulo 4, is 2; such rows teach nothing, nor
    do rows without id, language or text. ``lang_pred`` is a learned language, or
    ``und`` with score 0 if the text is null or has no letter, or nothing was learned.
    ``score`` is the language's share of all corrected hits, 0 if there is none (the
    first language by name is then predicted). Repeated rows are judged row by row;
    other columns are ignored.
    """
    known = learn(docs.where(fold(F.col("doc_id"), 4) != 2), floor, share)
    return identify(docs, known).select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )

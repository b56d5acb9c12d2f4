"""Counts over one whole text, the raw material of the quality rules and classifier."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tradeloom.llm.common import batch_of, chunks, in_tasks

#: Fixed values of the base rules: white space that ends a word, and symbols.
SPACE = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"

COUNTS = (
    "n_chars", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
    "n_unique_words", "n_letters", "n_upper", "n_digits", "n_bangs", "n_pipes", "n_stops",
)
SCHEMA = pa.schema([("doc_id", pa.int64()), *((name, pa.int64()) for name in COUNTS)])
DDL = "doc_id long, " + ", ".join(f"{name} long" for name in COUNTS)


def _all_but(*ranges: tuple[str, str]) -> bytes:
    keep = {c for low, high in ranges for c in range(ord(low), ord(high) + 1)}
    return bytes(c for c in range(256) if c not in keep)


_LETTERS, _UPPER, _DIGITS = _all_but(("A", "Z"), ("a", "z")), _all_but(("A", "Z")), _all_but(("0", "9"))


def repeat_words(words: list) -> int:
    """Words inside three-word windows that occur twice or more, first occurrence included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    times = Counter(windows)
    covered, end = 0, 0
    for at, window in enumerate(windows):
        if times[window] > 1:
            covered += at + 3 - max(at, end)
            end = at + 3
    return covered


def text_counts(text: str | None) -> tuple[int, ...]:
    """The ``COUNTS`` of a text; null counts as empty. Letters, capitals, digits are ASCII."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    lines = [line for line in text.split("\n") if line.strip(SPACE)]
    return (
        len(text),
        len(words),
        len(text) - sum(map(text.count, SPACE)),
        sum(map(text.count, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeat_words(words),
        len(set(words)),
        len(data.translate(None, _LETTERS)),
        len(data.translate(None, _UPPER)),
        len(data.translate(None, _DIGITS)),
        text.count("!"),
        text.count("|"),
        text.count("."),
    )


def document_counts(docs: DataFrame, *carried: str) -> DataFrame:
    """One row per document: ``doc_id``, ``COUNTS``, and the ``carried`` columns (short strings).

    A narrow pass over whole texts.
    """
    schema = pa.schema([*SCHEMA, *((name, pa.string()) for name in carried)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 5000, 16_000_000, "text"):
            rows = [text_counts(text) for text in batch.column("text").to_pylist()]
            extra = [batch.column(name) for name in carried]
            yield batch_of(schema, [batch.column("doc_id"), *map(list, zip(*rows, strict=True)), *extra])

    source = docs.select(
        F.col("doc_id").cast("long"), F.col("text").cast("string"), *(F.col(c).cast("string") for c in carried)
    )
    return in_tasks(source, count, DDL + "".join(f", {name} string" for name in carried))

"""Interpolated modified Kneser-Ney language model, counted in Spark.

A first pass counts words and numbers them, frequent ones first; n-grams are then rows of
such numbers. Spark brings those of the highest order together by their last context word.
There all lower orders follow without a further shuffle: which words precede an n-gram,
and per context the total and how many n-grams have count 1, 2, 3 and more. Only the
counts of single words, and what belongs to frequent words, are summed in a second shuffle.
Shuffled rows hold compressed columns of many n-grams.

Each level is stored in shards as sorted hash arrays with their counts (of the hashes,
only the bits that tell them apart; of the counts, their number in a list of those that
occur), in the folder that all executors share, and workers memory-map the shards to score
texts: the model is on disk once, and memory holds only the pages in use.

An n-gram goes to the shard of its last context word; if that word is frequent, to that of
its last two context words, and if both are, to that of these and the next word.
"""

from __future__ import annotations

import math
import os
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tradeloom.llm.common import batch_of, chunks, fold, in_tasks, shared_folder

END, START = 2, 1  # hashes; START is its own number, 0 that of unknown words
_FIRST = 2  # the first number of a word
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
WORD, GRAM, CONTEXT, SUMMARY = 0, 1, 2, 3
PACKED = pa.schema([("part", pa.int32()), ("shards", pa.list_(pa.int32())), ("kinds", pa.list_(pa.int32())), ("data", pa.list_(pa.binary()))])
_BLOCK = 1 << 19
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
SUMS = ("a", "n1", "n2", "n3", "n4")
STATS = ("a", "n1", "n2", "n3")


def mix(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a context hash and one more word; 63 bits."""
    value = context.astype(np.uint64) * _A + word.astype(np.uint64)
    value ^= value >> np.uint64(32)
    value *= _B
    value ^= value >> np.uint64(29)
    return (value >> np.uint64(1)).astype(np.int64)


_LOWER = np.where(np.isin(np.arange(256), np.arange(65, 91)), np.arange(256) + 32, np.arange(256))
_VALUES = mix(_LOWER, _LOWER).astype(np.uint64)  # per byte, A-Z as a-z


def mixed(context: list[np.ndarray]) -> np.ndarray:
    """Hash of a context's words, the latest first."""
    value = mix(context[0], context[0])
    for word in context[1:]:
        value = mix(value, word)
    return value


def ranked(columns: list[np.ndarray]) -> np.ndarray:
    """63-bit numbers that sort as the rows of ``columns`` do, equal for equal rows."""
    key, used = columns[0], int(columns[0].max(initial=0)).bit_length()
    for column in columns[1:]:
        bits = int(column.max(initial=0)).bit_length()
        if used + bits > 63:
            key = np.unique(key, return_inverse=True)[1]
            used = len(key).bit_length()
        key, used = key << bits | column, used + bits
    return key


def summed(columns: list[np.ndarray], n: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Different rows of ``columns``, sorted, and the sums of ``n`` for each."""
    key = ranked(columns)
    by = np.argsort(key, kind="stable")
    key = key[by]
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else by
    return [c[by[begin]] for c in columns], [np.add.reduceat(c[by], begin) if len(key) else c for c in n]


def runs(columns: list[np.ndarray]) -> np.ndarray:
    """Where a run of equal rows begins."""
    changed = np.ones(len(columns[0]), bool)
    changed[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(changed)


def spread(context: list[np.ndarray], word: np.ndarray | None, hot: np.ndarray, shards: int) -> np.ndarray:
    """Shard of n-grams by their context, latest word first, and next word.

    Without ``word`` that of contexts, right where the next word does not count.
    """
    value, often = context[0], np.isin(context[0], hot)
    for other in (*context[1:2], word):
        if other is None or not often.any():
            break
        value = np.where(often, mix(value, other), value)
        often &= np.isin(other, hot)
    return (mix(value, value) >> 17) % shards


def word_shard(word: np.ndarray, shards: int) -> np.ndarray:
    return (word - _FIRST) % shards


@lru_cache(maxsize=1)
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2 to the 64th."""
    inverse = np.uint64(pow(int(_A), -1, 1 << 64))
    return tuple(np.concatenate([[np.uint64(1)], np.full(size - 1, x)]).cumprod() for x in (_A, inverse))


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of words, given as bytes from ``begin`` to ``end``: sums of a value per byte times a power per place.

    Taken from running sums, for some words at a time.
    """
    out, at = np.zeros(len(begin), np.int64), 0
    while at < len(begin):
        origin = begin[at]
        to = max(at + 1, int(np.searchsorted(end, origin + _BLOCK, "right")))
        size = int(end[to - 1] - origin)
        up, down = powers(max(_BLOCK, size))
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(_VALUES[data[origin : origin + size]] * up[:size], out=sums[1:])
        first, last = begin[at:to] - origin, end[at:to] - origin
        value = (sums[last] - sums[first]) * down[first]
        out[at:to] = np.maximum(mix(value, last - first), 3)
        at = to
    return out


def token_stream(texts: pa.Array, starts: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the texts' tokens, each text after ``starts`` start marks, and tokens per text."""
    texts = texts.fill_null("").cast(pa.binary()).cast(pa.large_binary())
    _, bounds, data = texts.buffers()
    bounds = np.frombuffer(bounds, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    letter, cut = ~_SPACE[data], np.zeros(len(data) + 1, bool)
    cut[bounds] = True
    cut[1:-1] |= ~(letter[1:] & letter[:-1])
    begin, end = np.flatnonzero(letter & cut[:-1]), np.flatnonzero(letter & cut[1:]) + 1
    counts = np.diff(np.searchsorted(begin, bounds))
    sizes = counts + 1
    stream = np.full(int(sizes.sum()) + starts * len(sizes), END, np.int64)
    base = np.cumsum(sizes + starts) - sizes - starts
    for k in range(starts):
        stream[base + k] = START
    text = np.repeat(np.arange(len(sizes)), counts)
    stream[np.arange(len(begin)) + text * (starts + 1) + starts] = word_hashes(data, begin, end)
    return stream, sizes


def n_grams(stream: np.ndarray, sizes: np.ndarray, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Per token the ``order - 1`` words before it, latest first, and its own."""
    first = np.ones(len(stream), bool)  # false on the start marks
    begins = np.cumsum(sizes + order - 1) - (sizes + order - 1)
    for k in range(order - 1):
        first[begins + k] = False
    at = np.flatnonzero(first)
    return [stream[at - k] for k in range(1, order)], stream[at]


# --- Columns in shuffled rows ----------------------------------------------------


def pack(columns: list[np.ndarray]) -> bytes:
    """Columns, each in the narrowest unsigned type, byte by byte; the first, ascending, as differences."""
    head, data = [len(columns), len(columns[0])], []
    for at, column in enumerate(columns):
        column = column if at else np.diff(column, prepend=0)
        width = next(w for w in (1, 2, 4, 8) if int(column.max(initial=0)) < 1 << 8 * w)
        head.append(width)
        data.append(column.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes())
    return np.array(head, "<i4").tobytes() + pa.compress(b"".join(data), codec="zstd", asbytes=True)


def unpack(data: bytes) -> list[np.ndarray]:
    count, size = np.frombuffer(data, "<i4", 2).tolist()
    widths = np.frombuffer(data, "<i4", count, 8).tolist()
    flat = np.frombuffer(pa.decompress(data[8 + 4 * count :], size * sum(widths), codec="zstd"), np.uint8)
    columns, at = [], 0
    for width in widths:
        planes = np.ascontiguousarray(flat[at : at + size * width].reshape(width, size).T)
        columns.append(planes.view(f"<u{width}").reshape(-1).astype(np.int64))
        at += size * width
    columns[0] = np.cumsum(columns[0])
    return columns


def packed(pieces: list[tuple[int, np.ndarray, list[np.ndarray]]], partitions: int) -> pa.RecordBatch:
    """One row per partition: by kind and shard, the packed columns; in each the first column keeps its order."""
    rows: dict[int, list[tuple[int, int, bytes]]] = {}
    for kind, shard, columns in pieces:
        by = np.argsort(shard, kind="stable")
        shard, columns = shard[by], [c[by] for c in columns]
        begin = runs([shard])
        for i, j in zip(begin, [*begin[1:], len(shard)]):
            number = int(shard[i])
            rows.setdefault(number % partitions, []).append((number, kind, pack([c[i:j] for c in columns])))
    return batch_of(PACKED, [list(rows), *([[piece[k] for piece in row] for row in rows.values()] for k in range(3))])


def by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, list[np.ndarray]]]]:
    """A partition's shards, one after the other: the columns of each kind."""
    held: dict[int, list[tuple[int, bytes]]] = {}
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
            for shard, kind, data in zip(*row, strict=True):
                held.setdefault(shard, []).append((kind, data))
    for shard in list(held):
        of: dict[int, list[list[np.ndarray]]] = {}
        for kind, data in held.pop(shard):
            of.setdefault(kind, []).append(unpack(data))
        yield shard, {kind: [np.concatenate(c) for c in zip(*parts, strict=True)] for kind, parts in of.items()}


# --- Files of sorted arrays ------------------------------------------------------


def is_local(uri: str) -> bool:
    return urlparse(uri).scheme in ("", "file")


def put(uri: str, arrays: list[np.ndarray]) -> None:
    """Write arrays one after the other, each in the narrowest unsigned type; the last writer wins."""
    data, head = [], [len(arrays)]
    for array in arrays:
        top = int(array.max()) if len(array) else 0
        width = next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w)
        head += [len(array), width]
        data.append(array.astype(f"<u{width}").tobytes() + bytes(-len(array) * width % 8))
    whole = np.array(head, np.int64).tobytes() + b"".join(data)
    if is_local(uri):
        path = urlparse(uri).path
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = tempfile.NamedTemporaryFile(dir=os.path.dirname(path), delete=False)
        with part:
            part.write(whole)
        os.replace(part.name, path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_output_stream(path) as out:
        out.write(whole)


@lru_cache(maxsize=None)
def mapped(uri: str) -> tuple[np.ndarray, ...]:
    """Memory-map a shard; a remote one is copied beside the worker first. Missing: empty."""
    path = urlparse(uri).path
    if not is_local(uri):
        from pyarrow import fs

        store, remote = fs.FileSystem.from_uri(uri)
        if store.get_file_info(remote).type == fs.FileType.NotFound:
            return ()
        path = os.path.join(tempfile.mkdtemp(prefix="lm-"), "shard")
        fs.copy_files(remote, path, source_filesystem=store)
    if not os.path.exists(path):
        return ()
    data = np.memmap(path, np.uint8, "r")
    head = data[8 : 8 + 16 * int(data[:8].view(np.int64)[0])].view(np.int64).reshape(-1, 2)
    arrays, at = [], 8 + head.nbytes
    for size, width in head.tolist():
        arrays.append(data[at : at + size * width].view(f"<u{width}"))
        at += size * width + -size * width % 8
    return tuple(arrays)


def short_keys(keys: np.ndarray) -> list[np.ndarray]:
    """Sorted 63-bit keys as starts by their first bits and the 32 bits after those.

    About four keys share a start; with the shard more than 50 bits of a key count.
    """
    bits = max(0, len(keys).bit_length() - 3)
    return [np.searchsorted(keys >> (63 - bits), np.arange((1 << bits) + 1)), keys >> (31 - bits) & 0xFFFFFFFF]


def find(arrays: tuple[np.ndarray, ...], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which sorted ``keys`` are among whole sorted keys, and where."""
    known = arrays[0]
    at = np.searchsorted(known, keys.astype(known.dtype))
    at[at == len(known)] = 0
    return known[at] == keys, at


def find_short(arrays: tuple[np.ndarray, ...], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same among ``short_keys``."""
    starts, low = arrays[:2]
    bits = (len(starts) - 1).bit_length() - 1
    first = keys >> (63 - bits)
    at, end = starts[first].astype(np.int64), starts[first + 1].astype(np.int64)
    want, top = (keys >> (31 - bits) & 0xFFFFFFFF).astype(low.dtype), end
    for _ in range(int((end - at).max(initial=0)).bit_length()):
        middle = (at + top) >> 1
        below = (low[np.minimum(middle, len(low) - 1)] < want) & (at < top)
        at, top = np.where(below, middle + 1, at), np.where(below, top, middle)
    hit = (at < end) & (low[np.minimum(at, len(low) - 1)] == want)
    return hit, np.where(hit, at, 0)


def put_table(uri: str, keys: np.ndarray, values: list[np.ndarray]) -> None:
    """Write different keys and their values: of these, the list of all that occur and each key's place in it."""
    by = np.argsort(keys)
    _, at, code = np.unique(ranked(values), return_index=True, return_inverse=True)
    put(uri, [*short_keys(keys[by]), code[by], *(v[at] for v in values)])


def look_up(folder: str, kind: str, keys: np.ndarray, shard: np.ndarray, width: int) -> np.ndarray:
    """Values of ``keys``, one row of ``width`` each; zeros where a key is unknown."""
    out = np.zeros((len(keys), width), np.int64)
    for number, rows in split(shard, keys):
        if arrays := mapped(f"{folder}/{kind}-{number:06d}"):
            hit, at = find_short(arrays, keys[rows])
            code = arrays[2][at[hit]]
            for k in range(width):
                out[rows[hit], k] = arrays[3 + k][code]
    return out


def split(shard: np.ndarray, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The rows of each shard, nearly in the order of the 63-bit keys: one sort of a number made of both."""
    bits = int(shard.max(initial=0)).bit_length()
    by = np.argsort(shard << (63 - bits) | keys >> bits)
    if len(by):
        begin = runs([shard[by]])
        for i, j in zip(begin, [*begin[1:], len(by)]):
            yield int(shard[by[i]]), by[i:j]


# --- Words -----------------------------------------------------------------------


def count_words(shards: int, partitions: int):
    """Count words by hash, within a task as far as they are few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        for batch in chunks(batches, 50_000, 6_000_000, "text"):
            found = np.unique(token_stream(batch.column("text"), 0)[0], return_counts=True)
            (word,), (n,) = summed([np.concatenate([held[0], found[0]])], [np.concatenate([held[1], found[1]])])
            held = [word, n]
            if len(word) > 2_000_000:
                yield packed([(WORD, (word >> 17) % shards, held)], partitions)
                held = [word[:0], n[:0]]
        if len(held[0]):
            yield packed([(WORD, (held[0] >> 17) % shards, held)], partitions)

    return run


def write_words(shards: int, folder: str):
    """Store a shard's words with their numbers, the most frequent first; pass on how many there are."""
    schema = pa.schema([("types", pa.int64()), ("tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, of in by_shard(batches):
            (word,), (n,) = summed(of[WORD][:1], of[WORD][1:])
            by = np.lexsort((word, -n))
            rank = np.empty(len(by), np.int64)
            rank[by] = np.arange(len(by))
            put(f"{folder}/word-{shard:06d}", [word, rank, n[by]])
            yield batch_of(schema, [[len(word)], [int(n.sum())]])

    return run


def frequent_words(folder: str, shards: int, least: float):
    """Numbers of words with ``least`` occurrences or more."""
    schema = pa.schema([("id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                if arrays := mapped(f"{folder}/word-{shard:06d}"):
                    often = int(np.searchsorted(-arrays[2].astype(np.int64), -least, "right"))
                    yield batch_of(schema, [np.arange(often) * shards + shard + _FIRST])

    return run


def numbers(folder: str, hashes: np.ndarray, shards: int) -> np.ndarray:
    """Numbers of words by their hashes; 0 for unknown ones."""
    out = np.zeros(len(hashes), np.int64)
    for shard, rows in split((hashes >> 17) % shards, hashes):
        arrays = mapped(f"{folder}/word-{shard:06d}")
        if arrays:
            hit, at = find(arrays, hashes[rows])
            out[rows[hit]] = arrays[1][at[hit]].astype(np.int64) * shards + shard + _FIRST
    out[hashes == START] = START
    return out


def of_words(folder: str, kind: str, place: int, words: np.ndarray, shards: int) -> np.ndarray:
    """Values that are stored by a word's number; 0 for unknown words."""
    out = np.zeros(len(words), np.int64)
    for shard, rows in split(word_shard(words, shards), words):
        rows = rows[words[rows] >= _FIRST]
        if len(rows) and (arrays := mapped(f"{folder}/{kind}-{shard:06d}")):
            out[rows] = arrays[place][(words[rows] - _FIRST) // shards]
    return out


# --- N-grams ---------------------------------------------------------------------


def count_tokens(order: int, shards: int, partitions: int, hot: np.ndarray, folder: str):
    """Count n-grams of the highest order within chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 50_000, 6_000_000, "text"):
            stream, sizes = token_stream(batch.column("text"), order - 1)
            hashes, stream = np.unique(stream, return_inverse=True)
            word = numbers(folder, hashes, shards)
            by = np.argsort(word)
            place = np.empty(len(by), np.int64)
            place[by] = np.arange(len(by))
            context, last = n_grams(place[stream], sizes, order)
            columns = [*context, last]
            _, at, n = np.unique(ranked(columns), return_index=True, return_counts=True)
            *context, last = (word[by[c[at]]] for c in columns)
            yield packed([(GRAM, spread(context, last, hot, shards), [*context, last, n])], partitions)

    return run


def statistics(a: np.ndarray, begin: np.ndarray) -> list[np.ndarray]:
    """``STATS`` of runs of counts."""
    return [np.add.reduceat(x.astype(np.int64), begin) if len(begin) else begin for x in (a, a == 1, a == 2, a >= 3)]


def summary(level: int, a: np.ndarray) -> list[int]:
    """``level``, no word, and ``SUMS`` of a level's counts."""
    return [level, 0, int(a.sum()), *(int((a == k).sum()) for k in (1, 2, 3, 4))]


def write_levels(order: int, shards: int, partitions: int, hot: np.ndarray, folder: str):
    """Store a shard's n-grams and contexts of all levels above words; pass on what other shards have parts of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, grams, parts, totals = [], [], [], []
        for shard, of in by_shard(batches):
            *columns, n = of.pop(GRAM)
            (*context, word), (a,) = summed(columns, [n])
            del columns, n
            for level in range(order, 1, -1):
                often = np.isin(context[0], hot)
                if level == 2 and often.any():
                    grams.append([context[0][often], word[often], a[often]])
                    context, word, a = [context[0][~often]], word[~often], a[~often]
                if not len(a):
                    break
                key, begin = mixed(context), runs(context)
                put_table(f"{folder}/gram{level}-{shard:06d}", mix(key, word), [a])
                stats, key = statistics(a, begin), key[begin]
                whole = ~(often[begin] & np.isin(context[1][begin], hot)) if level > 2 else np.ones(len(begin), bool)
                if whole.any():
                    put_table(f"{folder}/context{level}-{shard:06d}", key[whole], [s[whole] for s in stats])
                if not whole.all():
                    parts.append([key[~whole], np.full(int((~whole).sum()), level), *(s[~whole] for s in stats)])
                totals.append(summary(level, a))
                if level > 2:
                    (*context, word), (a,) = summed([*context[:-1], word], [np.ones(len(word), np.int64)])
            if len(a):
                words.append(np.unique(word, return_counts=True))
        pieces = []
        if words:
            (word,), n = summed([np.concatenate([w for w, _ in words])], [np.concatenate([n for _, n in words])])
            pieces.append((WORD, word_shard(word, shards), [word, *n]))
        if grams:
            *columns, n = (np.concatenate(c) for c in zip(*grams, strict=True))
            columns, n = summed(columns, [n])
            pieces.append((GRAM, word_shard(columns[1], shards), [*columns, *n]))
        if parts:
            key, level, *stats = (np.concatenate(c) for c in zip(*parts, strict=True))
            (level, key), stats = summed([level, key], stats)
            by = np.argsort(key, kind="stable")
            pieces.append((CONTEXT, (key[by] >> 17) % shards, [key[by], level[by], *(s[by] for s in stats)]))
        if totals:
            columns = list(np.array(sorted(totals), np.int64).T)
            pieces.append((SUMMARY, np.full(len(totals), shard), columns))
        if pieces:
            yield packed(pieces, partitions)

    return run


def write_rest(shards: int, hot: np.ndarray, folder: str):
    """Store the words' counts and what belongs to frequent words; return sums, of levels and of frequent words."""
    schema = pa.schema([(name, pa.int64()) for name in ("level", "w", *SUMS)])

    def rows(columns: list[np.ndarray]) -> pa.RecordBatch:
        return batch_of(schema, columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, of in by_shard(batches):
            if SUMMARY in of:
                yield rows(of[SUMMARY])
            if CONTEXT in of:
                key, level, *stats = of[CONTEXT]
                for k in np.unique(level):
                    here = level == k
                    (found,), sums = summed([key[here]], [s[here] for s in stats])
                    put_table(f"{folder}/context{k}-{shards + shard:06d}", found, sums)
            word, n = of.get(WORD, [np.zeros(0, np.int64)] * 2)
            if GRAM in of:
                (context, last), (a,) = summed(of[GRAM][:2], of[GRAM][2:])
                put_table(f"{folder}/gram2-{shards + shard:06d}", mix(mixed([context]), last), [a])
                begin = runs([context])
                yield rows([np.zeros(len(begin), np.int64), context[begin], *statistics(a, begin), np.zeros(len(begin), np.int64)])
                yield rows([[x] for x in summary(2, a)])
                word, n = np.concatenate([word, last]), np.concatenate([n, np.ones(len(last), np.int64)])
            if len(word):
                (word,), (n,) = summed([word], [n])
                counts = np.zeros((int(word.max()) - _FIRST) // shards + 1, np.int64)
                counts[(word - _FIRST) // shards] = n
                put(f"{folder}/count-{shard:06d}", [counts])
                yield rows([[x] for x in summary(1, n)])

    return run, schema


@dataclass
class Model:
    """Where the arrays are, and the few numbers of each level: counts of counts and totals."""

    folder: str
    order: int
    shards: int
    hot: np.ndarray
    hot_stats: np.ndarray
    tokens: int
    types: int
    total: int
    counts_of_counts: tuple[int, int, int]
    discounts: list[np.ndarray]

    def discount(self, level: int, a: np.ndarray) -> np.ndarray:
        return self.discounts[level - 1][np.minimum(a, 3)]

    def counts(self, context: list[np.ndarray], word: np.ndarray) -> np.ndarray:
        """How often ``word`` follows a context: as often as counted, or after how many different words."""
        shard, key = spread(context, word, self.hot, self.shards), mix(mixed(context), word)
        if len(context) == 1:
            shard = np.where(np.isin(context[0], self.hot), self.shards + word_shard(word, self.shards), shard)
        return look_up(self.folder, f"gram{len(context) + 1}", key, shard, 1)[:, 0]

    def stats(self, context: list[np.ndarray]) -> np.ndarray:
        """``STATS`` of contexts, in columns."""
        key = mixed(context)
        _, at, back = np.unique(key, return_index=True, return_inverse=True)
        key, context = key[at], [c[at] for c in context]
        shard, often = spread(context, None, self.hot, self.shards), np.isin(context[0], self.hot)
        if len(context) > 1:
            often &= np.isin(context[1], self.hot)
            shard = np.where(often, self.shards + (key >> 17) % self.shards, shard)
        found = look_up(self.folder, f"context{len(context) + 1}", key, shard, len(STATS))
        if len(context) == 1:
            found[often] = self.hot_stats[np.searchsorted(self.hot, context[0][often])]
        return found[back].T

    def score(self, texts: pa.Array) -> tuple[np.ndarray, ...]:
        """Per text: tokens, known tokens, base score, model score (log10)."""
        stream, sizes = token_stream(texts, self.order - 1)
        hashes, stream = np.unique(stream, return_inverse=True)
        types = numbers(self.folder, hashes, self.shards)
        raw = of_words(self.folder, "word", 2, types, self.shards)
        cont = of_words(self.folder, "count", 0, types, self.shards)
        d = self.discounts[0]
        n = [0, *self.counts_of_counts]
        spare = (d[1] * n[1] + d[2] * n[2] + d[3] * n[3]) / max(1, self.total)
        p = (np.maximum(cont - self.discount(1, cont), 0) / max(1, self.total)
             + (spare if self.total else 1.0) / (self.types + 1))
        context, back = n_grams(stream, sizes, self.order)
        after = self.stats([types])[:, context[0]]
        context, word, p, count = [types[c] for c in context], types[back], p[back], raw[back]
        for level in range(2, self.order + 1):
            a = self.counts(context[: level - 1], word)
            total, n1, n2, n3 = self.stats(context[: level - 1]) if level > 2 else after
            d = self.discounts[level - 1]
            spare = d[1] * n1 + d[2] * n2 + d[3] * n3
            upper = np.maximum(a - self.discount(level, a), 0) + spare * p
            p = np.divide(upper, total, out=p.copy(), where=total > 0)
        starts = np.cumsum(sizes) - sizes
        base = np.log10((count + 1) / (self.tokens + self.types + 1))
        return (sizes, np.add.reduceat((count > 0).astype(np.int64), starts), np.add.reduceat(base, starts),
                np.add.reduceat(np.log10(p), starts))


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Discounts for counts 0, 1, 2, 3 and more; where counts of counts are missing, halves."""
    if not min(n1, n2, n3, n4):
        return np.array([0.0, 0.5, 0.75, 1.0])
    y = n1 / (n1 + 2 * n2)
    found = np.array([0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.clip(found, [0, 0.01, 0.01, 0.01], [0, 0.99, 1.99, 2.99])


def train(docs: DataFrame, order: int = 2, fraction: float = 1.0, share: float | None = None) -> Model:
    """Count a model of ``order`` (2 or more) on all ``docs`` (column ``text``; null counts as empty).

    Words that hold ``share`` of all tokens (by default half a shard's part, 0.002 at most) are
    frequent; this decides only the layout. All words are counted for it, so ``fraction``, the
    sample's share when they were found on one, has no effect. A partition's n-grams are held
    compressed by one worker, those of one shard, a quarter of it, at some 100 bytes each: set
    ``spark.sql.shuffle.partitions`` so that they fit.
    """
    if order < 2:
        raise ValueError("the order must be 2 or more")
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards, folder = 4 * partitions, f"{shared_folder(spark)}/lm"
    source = docs.select(F.col("text").cast("string"))

    def dealt(rows: DataFrame, run) -> DataFrame:
        packed_rows = in_tasks(rows, run, "part int, shards array<int>, kinds array<int>, data array<binary>")
        return packed_rows.repartitionById(partitions, F.col("part"))

    counted = in_tasks(dealt(source, count_words(shards, partitions)), write_words(shards, folder), "types long, tokens long")
    types, tokens = (x or 0 for x in counted.agg(F.sum("types"), F.sum("tokens")).first())
    least = (min(0.002, 0.5 / shards) if share is None else share) * tokens
    numbered = spark.range(0, shards, 1, min(shards, partitions))
    often = in_tasks(numbered, frequent_words(folder, shards, least), "id long").collect() if tokens else []
    hot = np.array(sorted([START, *(r.id for r in often)]), np.int64)

    rows = dealt(dealt(source, count_tokens(order, shards, partitions, hot, folder)), write_levels(order, shards, partitions, hot, folder))
    run, schema = write_rest(shards, hot, folder)
    sums = in_tasks(rows, run, pa_ddl(schema)).groupBy("level", "w").agg(*(F.sum(c).alias(c) for c in SUMS)).collect()
    found = {r.level: r.asDict() for r in sums if r.level}
    hot_stats = np.zeros((len(hot), len(STATS)), np.int64)
    for r in sums:
        if not r.level:
            hot_stats[np.searchsorted(hot, r.w)] = [r[name] for name in STATS]
    levels = [found.get(k, dict.fromkeys(SUMS, 0)) for k in range(1, order + 1)]
    first = levels[0]
    return Model(
        folder, order, shards, hot, hot_stats, tokens, types, first["a"],
        (first["n1"], first["n2"], types - first["n1"] - first["n2"]),
        [discounts(*(x[f"n{k}"] for k in (1, 2, 3, 4))) for x in levels],
    )


def pa_ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'int' if f.type == pa.int32() else 'long'}" for f in schema)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score``; a narrow pass over whole texts."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                        ("base_score", pa.float64()), ("score", pa.float64())])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 50_000, 6_000_000, "text"):
            yield batch_of(schema, [batch.column("doc_id"), *sent.value.score(batch.column("text"))])

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return in_tasks(source, run, "doc_id long, n_tokens long, n_known long, base_score double, score double").select(
        "doc_id", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )


def perplexities(docs: DataFrame, order: int = 2) -> DataFrame:
    """One row per document: counts, ``base_score`` and ``score`` (log10), and ``perplexity``.

    Texts are lower-cased (A-Z); tokens are words without space and \\x09-\\x0D, then
    one end. Training takes all rows but the held-out ones (crc32 of the id as text,
    modulo 7, is 2) and those without id. A null or empty text is the end alone.
    Repeated rows count and are scored row by row; other columns are ignored. With
    nothing to learn from, all tokens are unknown and equally likely.
    """
    model = train(docs.where(fold(F.col("doc_id"), 7) != 2), order)
    return score(docs, model).select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), 7) == 2, F.lit(False)).alias("held_out"),
        "n_tokens", "n_known", "train_tokens", "base_score", "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )

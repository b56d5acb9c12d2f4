"""Near-duplicate join of documents with a MinHash LSH forest.

A document is the set of its five-word shingles. Documents with equal sets are one text.
Each text has a label per tree, a run of MinHash values hashed level by level into the
bits of one number: sorted labels are the tree as a prefix trie, and the texts of a node
lie side by side, with equal first bits.

Matching begins at the full depth in a few trees, which joins close copies. Then the
prefixes are shortened, in all trees, to the longest at which a pair at the threshold
meets in some tree with the target probability (closer pairs meet more surely). Only
nodes that hold texts of more than one group are read there: what is in one group
already is verified as a whole. So the copies of a large group meet in a few
trees, and pairs near the threshold in all of them.

Texts that meet are compared by small sketches first, which joins those that may be
similar into groups; within a group all pairs are verified with the exact sets. Both
comparisons work on pairs of blocks: a node or group of any size is cut into blocks by
hash, of a bounded number of rows and bytes, and a task holds two of them. It hands on one
row per text with its number of links and a link towards the least text, never the pairs.
So the rows made for m different texts in one group are m * (m / block), spread over
(m / block)**2 / 2 tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BinaryType, StructType

from tradeloom.llm.common import batch_of, chunks, in_tasks, stored
from tradeloom.llm.components import components
from tradeloom.llm.id_filter import may_hold

WIDTH, SIMILARITY = 5, 0.8
TREES, DEEPEST, TARGET = 40, 12, 0.999
SKETCH, BLOCK = 128, 512
#: Trees read at full depth first; bits of a label for the levels below the shortened prefix.
FIRST, TAIL = 8, 20
#: Bytes of a block of sets; rows of a node in one group that are held until another group shows up.
BLOCK_BYTES, HELD = 32_000_000, 100_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def prefix_length(similarity: float, target: float, trees: int = TREES, deepest: int = DEEPEST) -> int:
    """Longest prefix at which a pair of this similarity meets in some tree with the target probability."""
    for depth in range(deepest, 0, -1):
        if 1 - (1 - similarity**depth) ** trees >= target:
            return depth
    raise ValueError("the target recall needs more trees")


def mixed(value: np.ndarray) -> np.ndarray:
    value = (value ^ value >> np.uint64(32)) * _B
    return value ^ value >> np.uint64(29)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of all ``width``-word windows; a shorter text is one window.

    Words are separated by space and \\x09-\\x0D and compared as they are.
    """
    import xxhash

    found = (text or "").encode("utf-8", "surrogatepass").split()
    if not found:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    n = max(1, len(ids) - width + 1)
    value = np.zeros(n, np.uint64)
    for k in range(min(width, len(ids))):
        value = mixed(value * _A + ids[k : k + n])
    return np.unique(value)


@lru_cache(maxsize=2)
def functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and offsets of ``count`` hash functions."""
    seed = mixed(np.arange(1, 2 * count + 1, dtype=np.uint64) * _A)
    return (seed[:count] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seed[count:] >> np.uint64(32)).astype(np.uint32)


def minhashes(found: np.ndarray, count: int) -> np.ndarray:
    times, plus = functions(count)
    low = (mixed(found) >> np.uint64(32)).astype(np.uint32)
    least = np.full(count, 0xFFFFFFFF, np.uint32)
    for begin in range(0, len(low), 2048):
        value = low[begin : begin + 2048, None] * times
        value += plus
        np.minimum(least, value.min(axis=0), out=least)
    return least


def labels_of(least: np.ndarray, trees: int, depth: int, first: int, deepest: int) -> np.ndarray:
    """One 64-bit label per tree: the tree's number and ``depth`` values, then in the last bits the levels below.

    Only the ``first`` trees have levels below.
    """
    value = np.arange(trees, dtype=np.uint64)
    for k in range(depth):
        value = mixed(value * _A + least[k * trees : (k + 1) * trees].astype(np.uint64))
    tail = np.uint64(TAIL)
    label, below = value >> tail << tail, value[:first]
    for k in range(deepest - depth):
        begin = trees * depth + k * first
        below = mixed(below * _A + least[begin : begin + first].astype(np.uint64))
    label[:first] |= below >> np.uint64(64 - TAIL)
    return label.view(np.int64)


def key_of(found: np.ndarray) -> bytes:
    """Which text it is: a digest of the set."""
    import xxhash

    return xxhash.xxh3_128_digest(found.tobytes())


def _signatures(trees: int, depth: int, sketch: int, width: int):
    first, deepest = min(FIRST, trees), max(DEEPEST, depth)
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.binary()), ("n", pa.int32()),
                        ("labels", pa.list_(pa.int64())), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 5000, 8_000_000, "text"):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = shingles(text, width)
                if len(found) and doc_id is not None:
                    least = minhashes(found, trees * depth + first * (deepest - depth))
                    rows.append((doc_id, key_of(found), len(found), labels_of(least, trees, depth, first, deepest),
                                 (least[:sketch] & 0xFF).astype(np.uint8).tobytes()))
                else:
                    rows.append((doc_id, None, None, None, None))
            yield batch_of(schema, list(map(list, zip(*rows, strict=True))))

    return run


# --- Nodes of the sorted labels --------------------------------------------------


def _mixed_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, group, vertex), equal keys in a row -> (key, vertex) of keys with more than one group.

    A run in one group is held until another group shows up; one of more than ``HELD``
    rows is handed on without.
    """
    schema = pa.schema([("key", pa.int64()), ("vertex", pa.int64())])
    held, handed_on = [np.empty(0, np.int64)] * 3, None
    for batch in batches:
        key, group, vertex = (np.concatenate([old, new.to_numpy()]) for old, new in zip(held, batch.columns, strict=True))
        if not len(key):
            continue
        begin = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
        sizes = np.diff(begin, append=len(key))
        several = np.minimum.reduceat(group, begin) < np.maximum.reduceat(group, begin)
        several[0] |= key[0] == handed_on
        several[-1] |= sizes[-1] > HELD
        open_ = slice(len(key) if several[-1] else begin[-1], None)
        held, handed_on = [key[open_], group[open_], vertex[open_]], key[-1] if several[-1] else None
        out = np.repeat(several, sizes)
        if out.any():
            yield batch_of(schema, [key[out], vertex[out]])


def crowded(texts: DataFrame, label: Column, partitions: int) -> DataFrame:
    """``key, vertex`` of the nodes that hold texts (``vertex, group, labels``) of several groups.

    ``label`` gives the node from ``label``, which is sorted: a range of nodes in each task.
    """
    placed = texts.select("vertex", "group", F.explode("labels").alias("label")).select(label.alias("key"), "group", "vertex")
    return in_tasks(placed.repartitionByRange(partitions, "key").sortWithinPartitions("key"), _mixed_nodes, "key long, vertex long")


# --- Comparison in blocks --------------------------------------------------------


def sketches_agree(payloads: list[bytes], least: float) -> np.ndarray:
    rows = np.frombuffer(b"".join(payloads), np.uint8).reshape(len(payloads), -1)
    return np.concatenate([
        (rows[k : k + 32, None, :] == rows[None, :, :]).mean(axis=2) >= least for k in range(0, len(rows), 32)
    ])


def sets_agree(payloads: list[bytes], least: float) -> np.ndarray:
    """Exact Jaccard similarity of sorted hash sets, for all pairs at once."""
    sets = [np.frombuffer(p, np.uint64) for p in payloads]
    sizes = np.array([len(s) for s in sets], np.float64)
    owner = np.repeat(np.arange(len(sets)), sizes.astype(int))
    value, at = np.unique(np.concatenate(sets), return_inverse=True)
    shared = np.bincount(at) > 1
    column = np.cumsum(shared) - 1
    keep = shared[at]
    owner, at = owner[keep], column[at[keep]]
    common = np.zeros((len(sets), len(sets)), np.float64)
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    step = 4096
    bounds = np.searchsorted(at, np.arange(0, int(shared.sum()) + step, step))
    for k, (begin, end) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        part = np.zeros((len(sets), step), np.float32)
        part[owner[begin:end], at[begin:end] - k * step] = 1
        common += part @ part.T
    return common >= least * (sizes[:, None] + sizes - common) - 1e-9


def roots(linked: np.ndarray) -> np.ndarray:
    """Least index of each row's connected component."""
    label = np.arange(len(linked))
    while True:
        found = np.minimum(label, np.where(linked, label, len(label)).min(axis=1))
        found = found[found]
        if (found == label).all():
            return label
        label = found


def _compare(agree: Callable[[list[bytes], float], np.ndarray], least: float):
    """Rows (key, i, j, block, vertex, payload), sorted by the first three -> (vertex, links, root)."""
    schema = pa.schema([("vertex", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(column.to_pylist() for column in batch.columns), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for (_, i, j), members in groupby(rows(batches), key=lambda row: row[:3]):
            members = sorted({row[4]: row for row in members}.values(), key=lambda row: row[4])
            if len(members) > 1:
                block = np.array([row[3] for row in members])
                linked = agree([row[5] for row in members], least)
                linked &= (block[:, None] != block) if i != j else ~np.eye(len(members), dtype=bool)
                root = roots(linked)
                for row, links, at in zip(members, linked.sum(axis=1), root, strict=True):
                    if links:
                        out.append((row[4], int(links), members[at][4]))
            if len(out) > 10_000:
                yield batch_of(schema, list(zip(*out, strict=True)))
                out = []
        if out:
            yield batch_of(schema, list(zip(*out, strict=True)))

    return run


def compare(members: DataFrame, sizes: DataFrame, agree, least: float) -> DataFrame:
    """Compare all ``members`` (key, vertex, payload) of equal key, block by block.

    ``sizes``: key and number of ``blocks``. Returns ``vertex, links, root`` for each pair
    of blocks in which the vertex has a link.
    """
    split = (
        members.join(sizes, "key").withColumn("b", F.pmod(F.xxhash64("vertex"), F.col("blocks")).cast("int"))
        .select("key", "b", "vertex", "payload", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select("key", F.least("b", "other").alias("i"), F.greatest("b", "other").alias("j"), "b", "vertex", "payload")
    )
    partitions = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = split.repartition(partitions, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return in_tasks(dealt, _compare(agree, least), "vertex long, links long, root long")


def edges(found: DataFrame) -> DataFrame:
    return found.where("vertex <> root").select(F.col("vertex").alias("u"), F.col("root").alias("v"))


# --- The join --------------------------------------------------------------------


def _with_sets(width: int):
    schema = pa.schema([("key", pa.int64()), ("vertex", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 5000, 8_000_000, "text"):
            sets = [shingles(text, width) for text in batch.column("text").to_pylist()]
            same = [key_of(s) == key for s, key in zip(sets, batch.column("text_key").to_pylist(), strict=True)]
            full = batch_of(schema, [batch.column("key"), batch.column("vertex"), [s.tobytes() for s in sets]])
            yield full.filter(pa.array(same, pa.bool_()))

    return run


def _with_keys(width: int):
    """Rows of a table with ``text`` -> the same with the text's digest, empty without words, in the last column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 5000, 8_000_000, "text"):
            sets = [shingles(text, width) for text in batch.column("text").to_pylist()]
            keys = pa.array([key_of(s) if len(s) else b"" for s in sets], pa.binary())
            yield batch.append_column("_key", keys)

    return run


def _likely(texts: DataFrame, least: float, trees: int, block: int) -> DataFrame:
    """``vertex, group`` of the texts that meet in the forest and may be similar."""
    partitions = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    alone = texts.select("vertex", F.col("vertex").alias("group"), F.slice("labels", 1, min(FIRST, trees)).alias("labels"))
    payload, groups = texts.select("vertex", "payload"), None
    for dropped in (0, TAIL):
        placed = alone if groups is None else texts.select("vertex", "labels").join(groups, "vertex", "left").select(
            "vertex", F.coalesce("group", "vertex").alias("group"), "labels")
        nodes = stored(crowded(placed, F.shiftright("label", dropped), partitions), "nodes")
        sizes = nodes.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("blocks"))
        links = edges(compare(nodes.join(payload, "vertex").select("key", "vertex", "payload"), sizes, sketches_agree, least))
        if groups is not None:
            links = links.union(groups.where("vertex <> group").select(F.col("vertex").alias("u"), F.col("group").alias("v")))
        groups = stored(components(links).withColumnRenamed("component", "group"), "groups")
    return groups


def _decided(docs: DataFrame, similarity: float, width: int, target: float, trees: int, block: int) -> DataFrame:
    """One row per document: ``doc_id, text_key, class_id, text_id, n_links, stays``.

    A text, not an id, is what is linked: texts have numbers of their own.
    """
    depth = prefix_length(similarity, target, trees)
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    signed = stored(in_tasks(
        source, _signatures(trees, depth, SKETCH, width),
        "doc_id long, text_key binary, n int, labels array<long>, sketch binary",
    ), "signatures")
    texts = stored(
        signed.where("text_key IS NOT NULL").groupBy("text_key")
        .agg(F.min("doc_id").alias("text_id"), F.first("n").alias("n"), F.first("labels").alias("labels"), F.first("sketch").alias("payload"))
        .withColumn("vertex", F.monotonically_increasing_id()), "texts"
    )
    slack = 4 * (similarity * (1 - similarity) / SKETCH) ** 0.5
    chosen = stored(_likely(texts, similarity - slack, trees, block).join(texts, "vertex").select(
        F.col("group").alias("key"), "vertex", "text_key", "n", F.col("text_id").alias("doc_id")), "chosen")
    wanted = source.where(may_hold(chosen.select("doc_id"))(F.col("doc_id")))
    sets = in_tasks(
        wanted.join(chosen.drop("n"), "doc_id").dropDuplicates(["doc_id", "vertex", "text"]).select("key", "vertex", "text_key", "text"),
        _with_sets(width),
        "key long, vertex long, payload binary",
    )
    sizes = chosen.groupBy("key").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / F.lit(block)), F.ceil(F.sum("n") * 8 / F.lit(BLOCK_BYTES))).cast("int").alias("blocks"))
    linked = stored(compare(sets, sizes, sets_agree, similarity), "links")
    links = linked.groupBy("vertex").agg(F.sum("links").alias("links"))
    classes = components(edges(linked))
    least = classes.join(texts, "vertex").groupBy("component").agg(F.min(F.struct("text_id", "text_key")).alias("least"))
    member = classes.join(least, "component").select("vertex", "least")
    by_text = texts.select("text_key", "text_id", "vertex").join(links, "vertex", "left").join(member, "vertex", "left").select(
        "text_key", "text_id", "links", F.coalesce("least", F.struct("text_id", "text_key")).alias("least"))
    return signed.select("doc_id", "text_key").join(by_text, "text_key", "left").select(
        "doc_id", "text_key", F.coalesce("least.text_id", "doc_id").alias("class_id"),
        F.coalesce("text_id", "doc_id").alias("text_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce((F.col("least.text_id") == F.col("doc_id")) & (F.col("least.text_key") == F.col("text_key")), F.lit(True)).alias("stays"),
    )


def near_duplicates(
    docs: DataFrame,
    similarity: float = SIMILARITY,
    width: int = WIDTH,
    target: float = TARGET,
    trees: int = TREES,
    block: int = BLOCK,
) -> DataFrame:
    """One row per document: ``doc_id, class_id, text_id, n_links``.

    ``text_id`` is the least id with the same set of shingles, ``n_links`` the number of
    other texts whose Jaccard similarity is ``similarity`` or more, ``class_id`` the
    least id of all documents connected by links. A pair at the threshold is found with
    probability ``target``, closer pairs more surely; what is found is verified exactly.

    A text without words is its own class and has no link; so has a row without id
    (class and text are then null). Rows that repeat an id are rows of the result, each
    with its own text's links; classes of different texts stay apart even if the same id
    is the least of both. Other columns are ignored.
    """
    return _decided(docs, similarity, width, target, trees, block).select("doc_id", "class_id", "text_id", "n_links")


def keep_one(
    docs: DataFrame,
    similarity: float = SIMILARITY,
    width: int = WIDTH,
    target: float = TARGET,
    trees: int = TREES,
    block: int = BLOCK,
) -> DataFrame:
    """Rows of ``docs``, all columns, without near-duplicates: of each class the text with the least id stays.

    Rows without id all stay. Of rows that repeat an id with the same words one stays, the
    least; rows that repeat it with other words are judged on their own.
    """
    found = stored(_decided(docs, similarity, width, target, trees, block), "decided")
    again = found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    judged = stored(found.where("NOT stays").select("doc_id", F.lit(False).alias("again")).union(again.select("doc_id", F.lit(True))), "judged")
    doc_id, again = F.col("doc_id").cast("long"), judged.where("again").select("doc_id")
    named, twice = may_hold(judged.select("doc_id")), may_hold(again)
    once = docs.where(~named(doc_id)).union(docs.where(named(doc_id)).join(judged, "doc_id", "left_anti").select(*docs.columns))
    repeated = docs.where(twice(doc_id)).join(again, "doc_id", "left_semi").select(*docs.columns)
    keyed = in_tasks(repeated, _with_keys(width), StructType([*docs.schema.fields]).add("_key", BinaryType()))
    stays = found.where("stays").select("doc_id", F.coalesce("text_key", F.lit(b"")).alias("_key")).distinct()
    first = keyed.join(stays, ["doc_id", "_key"], "left_semi").groupBy("doc_id", "_key").agg(
        F.min(F.struct("text", *(c for c in docs.columns if c not in ("doc_id", "text")))).alias("r"))
    return once.union(first.select("doc_id", "r.*").select(*docs.columns))

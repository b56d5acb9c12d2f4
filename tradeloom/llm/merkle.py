"""Merkle manifest of a dataset, stored every few levels; proofs recompute what lies between.

Each row of ``documents`` is a leaf, a SHA-256 over its fields. Per source, leaves in the order
of ``doc_id`` form a tree of 16 branches, and the sources' roots form one above them.
Only every ``every``-th level is persisted. To build the next one, the nodes below are grouped
into aligned subtrees of ``16 ** every`` nodes at most and each subtree is reduced in a task.
To extract proofs, the same groups are read again, from the top down: a subtree's missing
interior nodes are recomputed from its stored nodes, the siblings of each of these are
emitted in front of the path that the subtree's own root has got, and the rest is dropped.

A source may hold any share of the rows: positions come from range partitions, and
the groups of all shuffles are subtrees, never sources.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tradeloom.llm.common import batch_of, fold, in_tasks, shared_folder, stored
from tradeloom.llm.positions import numbered

ARITY = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_STEP = pa.struct([("index", pa.int32()), ("siblings", pa.list_(pa.string()))])
_STEP_DDL = "array<struct<index: int, siblings: array<string>>>"
_NODES = pa.schema([("tree", pa.string()), ("height", pa.int32()), ("position", pa.int64()), ("node", pa.string())])
_NODES_DDL = "tree string, height int, position long, node string"


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf_hash(**fields: Column) -> Column:
    """Hash of a row: each field as byte count, colon and value, or a hyphen for null."""

    def spelled(name: str) -> Column:
        value = fields.get(name, F.col(name)).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*map(spelled, FIELDS)), 256)


def lower_ascii(text: Column) -> Column:
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, capitals, capitals.lower())


def levels_above(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes and the ``levels`` levels above them; a run of one is hashed too."""
    rows = [nodes]
    for _ in range(levels):
        nodes = [digest(*nodes[at : at + ARITY]) for at in range(0, len(nodes), ARITY)]
        rows.append(nodes)
    return rows


def steps_of(rows: list[list[str]], at: int) -> Iterator[tuple[int, list[str]]]:
    """For the lowest node ``at``, level by level: its place in its run, and the others of the run."""
    for level in rows[:-1]:
        begin = at - at % ARITY
        yield at - begin, level[begin:at] + level[at + 1 : begin + ARITY]
        at //= ARITY


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings along its path give."""

    def up(node: Column, step: Column) -> Column:
        left, right = F.slice(step.siblings, F.lit(1), step.index), F.slice(step.siblings, step.index + 1, F.lit(ARITY))
        return F.sha2(F.array_join(F.concat(left, F.array(node), right), ""), 256)

    return F.aggregate(path, leaf, up)


def _height(leaves: Column) -> Column:
    """Levels above the leaves: how many powers of the arity are below their number."""
    return sum((leaves > ARITY**k).cast("int") for k in range(15))


@dataclass
class Trees:
    """Trees of one shape rule: level ``k * every`` of each is stored as ``{folder}/level-{k}``.

    Columns: ``tree, height, position, node``; the leaves carry further columns.
    """

    folder: str
    every: int
    levels: list[DataFrame]

    @classmethod
    def build(cls, leaves: DataFrame, folder: str, every: int) -> Trees:
        """``leaves``: ``tree, position, group_rows, node`` and columns to carry; each level is written once."""
        spark, levels = leaves.sparkSession, []

        def keep(nodes: DataFrame) -> DataFrame:
            path = f"{folder}/level-{len(levels)}"
            nodes.write.parquet(path)
            levels.append(spark.read.schema(nodes.schema).parquet(path))
            return levels[-1]

        nodes = keep(leaves.withColumn("height", _height(F.col("group_rows"))).drop("group_rows"))
        trees = cls(folder, every, levels)
        tallest = nodes.agg(F.max("height")).first()[0] or 0
        while (len(levels) - 1) * every < tallest:
            keep(in_tasks(trees.subtrees(len(levels) - 1), _reducer((len(levels) - 1) * every, every), _NODES_DDL))
        return trees

    def rank(self) -> Column:
        """Which stored level holds a tree's root."""
        return F.expr(f"(height + {self.every - 1}) div {self.every}")

    def subtrees(self, k: int) -> DataFrame:
        """Nodes of stored level ``k`` that are no roots, by aligned subtree: ``tree, height, position`` (above), ``nodes``."""
        others = [c for c in self.levels[k].columns if c not in ("tree", "height", "position")]
        above = F.expr(f"position div {ARITY**self.every}L").alias("above")
        rows = self.levels[k].where(self.rank() > k).select("tree", "height", above, F.struct("position", *others).alias("one"))
        return rows.groupBy("tree", "height", F.col("above").alias("position")).agg(F.sort_array(F.collect_list("one")).alias("nodes"))

    def roots(self) -> DataFrame:
        """``tree, node``: each tree's root."""
        tops = [level.where(self.rank() == k).select("tree", "node") for k, level in enumerate(self.levels)]
        roots = tops[0]
        for top in tops[1:]:
            roots = roots.union(top)
        return roots

    def paths(self, above: DataFrame) -> DataFrame:
        """Leaves, with their columns, ``path`` and ``tree_root``.

        ``above``: ``tree, path, tree_root`` of each tree, the path from its root on.
        """
        path = None
        for k in reversed(range(len(self.levels))):
            carried = [c for c in self.levels[k].columns if c not in ("tree", "height")] if not k else ["position"]
            tops = self.levels[k].where(self.rank() == k).join(above, "tree").select("tree", *carried, "path", "tree_root")
            if path is None:
                path = tops
                continue
            groups = self.subtrees(k).join(path, ["tree", "position"])
            path = in_tasks(groups, _emitter(k * self.every, self.every, carried), tops.schema).union(tops)
        return path


def _raised(height: int, level: int, every: int) -> int:
    return min(every, height - level)


def _reducer(level: int, every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            above = [
                levels_above([one["node"] for one in nodes], _raised(height, level, every))[-1][0]
                for nodes, height in zip(batch.column("nodes").to_pylist(), batch.column("height").to_pylist(), strict=True)
            ]
            yield batch_of(_NODES, [batch.column("tree"), batch.column("height").cast(pa.int32()), batch.column("position"), above])

    return run


def _emitter(level: int, every: int, carried: list[str]):
    """Each node of a subtree with its siblings up to the subtree's root, then the root's own path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                group = batch.slice(at, 1)
                one = group.column("nodes").flatten()
                nodes = one.field("node").to_pylist()
                tree, height, rest, root = (group.column(c)[0].as_py() for c in ("tree", "height", "path", "tree_root"))
                rest = [(step["index"], step["siblings"]) for step in rest]
                rows = levels_above(nodes, _raised(height, level, every))
                index, siblings, ends, path_ends = [], [], [0], [0]
                for place in range(len(nodes)):
                    for step, others in (*steps_of(rows, place), *rest):
                        index.append(step)
                        siblings.extend(others)
                        ends.append(len(siblings))
                    path_ends.append(len(index))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(siblings, pa.string()))
                steps = pa.StructArray.from_arrays([pa.array(index, pa.int32()), lists], fields=list(_STEP))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([tree] * len(nodes), pa.string()), *(one.field(c) for c in carried),
                        pa.ListArray.from_arrays(pa.array(path_ends, pa.int32()), steps), pa.array([root] * len(nodes), pa.string()),
                    ],
                    names=["tree", *carried, "path", "tree_root"],
                )

    return run


@dataclass
class Manifest:
    """The trees of all sources (leaves: the documents) and the one tree of their roots."""

    sources: Trees
    whole: Trees

    def root(self) -> str | None:
        top = self.whole.roots().first()
        return top and top.node

    def proofs(self) -> DataFrame:
        """``doc_id, leaf, tampered, subroot, path`` of every document; the path goes from its run to the root.

        A step of the path is the place in a run of up to 16 and the others of the run, left to right.
        """
        empty = F.from_json(F.lit("[]"), _STEP_DDL)
        above = self.whole.roots().select("tree", empty.alias("path"), F.col("node").alias("tree_root"))
        tops = self.whole.paths(above).select(F.col("source_key").alias("tree"), "path", F.col("node").alias("tree_root"))
        found = self.sources.paths(stored(tops, "paths"))
        return found.select("doc_id", F.col("node").alias("leaf"), "tampered", F.col("tree_root").alias("subroot"), "path")


def manifest(docs: DataFrame, folder: str | None = None, every: int = 2) -> Manifest:
    """Build and store the manifest of ``docs`` below ``folder`` (none: a new one in the shared folder).

    Within a source leaves ascend by ``doc_id``, null first; rows of one id by leaf. Sources
    ascend by their bytes, null first. The tampered leaf (null where the row is not tampered) is
    that of the row with the text's A-Z lower-cased, where 5 divides the CRC-32 of the id.
    Nulls in any column are hashed as such; other columns are ignored.
    """
    folder = folder or shared_folder(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long"), "source", "lang", "n_chars", "text")
    leaves = stored(
        texts.select(
            F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("tree"), "doc_id", leaf_hash().alias("node"),
            F.when(fold(F.col("doc_id"), 5) == 0, leaf_hash(text=lower_ascii(F.col("text")))).alias("tampered"),
        ),
        "leaves",
    )
    sources = Trees.build(numbered(leaves, "tree", "doc_id", "node"), f"{folder}/sources", every)
    roots = stored(sources.roots().select(F.lit("").alias("tree"), F.col("tree").alias("source_key"), "node"), "roots")
    whole = Trees.build(numbered(roots, "tree", "source_key"), f"{folder}/whole", every)
    return Manifest(sources, whole)


def audit(docs: DataFrame, every: int = 2) -> DataFrame:
    """One row per document: its leaf, roots, a digest of its proof, and what the proof says of the row as tampered with.

    ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``. An empty table gives no row.
    """
    made = manifest(docs, every=every)
    root = F.lit(made.root()).cast("string")
    rows = made.proofs().select(
        "*",
        F.sha2(F.array_join(F.flatten(F.transform("path", lambda step: step.siblings)), ""), 256).alias("proof_sha256"),
        folded(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"),
    )
    return rows.select(
        "doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified")
    )

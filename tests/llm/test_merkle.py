"""The manifest and its proofs against a tree built by hand, and against SQL."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tests.oracle import compare, connect
from tradeloom.llm import merkle, positions, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, position long"


def h(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row: tuple) -> str:
    doc_id, text, lang, source, n_chars, *_ = row
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def lowered(text: str | None) -> str | None:
    return text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def tree(nodes: list[str]) -> tuple[str, list[list[tuple[int, list[str]]]]]:
    """The root, and each leaf's path: its place in a run and the run's others, level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, k in zip(paths, at, strict=True):
            run = nodes[k // 16 * 16 : k // 16 * 16 + 16]
            path.append((k % 16, run[: k % 16] + run[k % 16 + 1 :]))
        nodes, at = [h(*nodes[k : k + 16]) for k in range(0, len(nodes), 16)], [k // 16 for k in at]
    return nodes[0], paths


def brute(rows: list[tuple]) -> list[tuple]:
    by_source = defaultdict(list)
    for row in rows:
        by_source[row[3]].append(row)
    order = sorted(by_source, key=lambda s: b"" if s is None else b"=" + s.encode())
    trees = {}
    for source in order:
        held = sorted(by_source[source], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[source] = (held, *tree([leaf(r) for r in held]))
    root, tops = tree([trees[s][1] for s in order])
    out = []
    for source, top in zip(order, tops, strict=True):
        held, subroot, paths = trees[source]
        for row, path in zip(held, paths, strict=True):
            bad = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            node = leaf((row[0], lowered(row[1]), *row[2:])) if bad else leaf(row)
            for k, others in (*path, *top):
                node = h(*others[:k], node, *others[k:])
            out.append((row[0], leaf(row), subroot, root, h(*(s for _, others in (*path, *top) for s in others)), node, node == root))
    return out


def corpus() -> list[tuple]:
    chance = random.Random(8)
    rows = []
    for source, n in [("hot", 700), (None, 17), ("", 16), ("é", 33), ("z", 1), ("a", 257), *((f"s{k}", 1) for k in range(40))]:
        for _ in range(n):
            text = chance.choice([None, "", "no capitals", "Some Capitals", "É only", "x" * 5000])
            rows.append((chance.randrange(10**6), text, chance.choice(["en", None]), source, chance.choice([None, 3]), "n", 7))
    rows += [(5, "A", "en", "a", 1, "n", 7)] * 3 + [(5, "B", "en", "a", 1, "n", 7), (None, "A", None, "a", 1, None, None), (None, "Z", None, None, 1, None, None)]
    chance.shuffle(rows)
    return rows


@pytest.mark.parametrize("every", [1, 2, 3])
def test_equals_plain_tree(spark, every):
    rows = corpus()
    got = merkle.audit(spark.createDataFrame(rows, DOCS).repartition(7), every)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    out = got.collect()
    assert sorted(map(tuple, out), key=str) == sorted(brute(rows), key=str)
    assert {r.verified for r in out} == {True, False}


@pytest.mark.parametrize("rows", [[], corpus()[:1]])
def test_smallest_tables(spark, rows):
    assert [tuple(r) for r in merkle.audit(spark.createDataFrame(rows, DOCS)).collect()] == (brute(rows) if rows else [])


def test_only_every_other_level_is_stored(spark, tmp_path):
    made = merkle.manifest(spark.createDataFrame(corpus(), DOCS), f"file://{tmp_path}", every=2)
    counts = [level.where("tree = '=hot'").count() for level in made.sources.levels]
    assert counts == [700, 3, 1] and sorted(p.name for p in (tmp_path / "sources").iterdir()) == ["level-0", "level-1", "level-2"]
    paths = made.proofs().where("subroot is not null").select(merkle.folded(F.col("leaf"), F.col("path")).alias("r")).distinct().collect()
    assert [r.r for r in paths] == [made.root()]


def test_positions_span_ranges(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"), (F.col("id") * 7919 % 5003).alias("v"))
    got = positions.numbered(rows.repartition(9), "g", "v").collect()
    by_group = defaultdict(list)
    for r in got:
        by_group[r.g].append((r.v, r.position, r.group_rows))
    for held in by_group.values():
        assert [(p, n) for _, p, n in sorted(held)] == [(k, len(held)) for k in range(len(held))]


def test_equals_sql(spark):
    sf, name = "/root/testdata/sf0.001", "op12_merkle_manifest"
    assert compare(spark, connect(sf), queries.QUERIES[name], queries.ORACLES[name], sf) == ""

"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is the number of copies each of its documents should get, a
probability beyond the whole part. Fractional copies fight in pairs: words are moved, at
random and with unchanged expectation, from one side to the other until one has a whole number
of copies. A fight keeps the expected words of the two sides together exactly, so a source is
off its target by the rounding of its very last residual only.

Documents are dealt out by hash to blocks, each an even sample of its source. In a block the
longest open document fights all shorter ones, which share one probability and so act as one
unit; a long document is decided while there are words enough to make up for it, and what is
left in the end is the shortest. The residuals of the blocks fight each other, in blocks
of blocks, until one a source is left: a reduction tree whose nodes are bounded and of which each
level is a shuffle of its residuals alone.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tradeloom.llm.common import batch_of, chunks, in_tasks, ship_package, stored
from tradeloom.llm.positions import numbered

#: Fixed values of the contract: weights in the order of sources, and how often a source may be repeated.
WEIGHTS = (1, 2, 3)
MOST = 3

#: Probabilities are held as expected words, in whole parts of a word, so that sums and bounds are exact.
PARTS = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_CHUNK = 65_536


def word_counts(texts: pa.Array) -> list[int]:
    """Words (runs without ASCII white space) of each text in UTF-8; null has none."""
    counts = []
    for text in texts:
        data = _SPACE[np.frombuffer(text.as_buffer() or b"", np.uint8)] if text.is_valid else _SPACE[:0]
        counts.append(int(np.count_nonzero(data[:-1] & ~data[1:]) + (len(data) > 0 and not data[0])))
    return counts


def sizes(docs: DataFrame) -> DataFrame:
    """``doc_id, tree, size``: words of each whole text; ``tree`` names the source, null after all others."""
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("size", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 5000, 16_000_000, "text"):
            yield batch_of(schema, [batch.column("doc_id"), batch.column("source"), word_counts(batch.column("text"))])

    text = F.col("text").cast("string").cast("binary").alias("text")
    rows = in_tasks(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), text), count, "doc_id long, source string, size long")
    return rows.select("doc_id", F.coalesce(F.concat(F.lit("0"), "source"), F.lit("1")).alias("tree"), "size")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``tree, source_size, target`` from ``tree, source_size``.

    The words of all sources are shared by weight; a source stops at ``most`` times its words
    and what it cannot take is shared again among the others, until none is above. Each round
    is one aggregate over the sources; the driver holds its three numbers.
    """
    all_sources = sources.select(F.lit("").alias("any"), "tree", "source_size")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("position") % len(weights) + 1).cast("int"))
    rows = stored(numbered(all_sources, "any", "tree").select("tree", "source_size", weight.alias("weight")), "sources")
    share, cap, stopped = F.lit(0.0), F.lit(most) * F.col("source_size"), -1
    while True:
        above = F.col("weight") * share > cap
        total, held, open_weight, count = rows.agg(
            F.sum("source_size"), F.sum(F.when(above, cap)), F.sum(F.when(~above, F.col("weight"))), F.count(F.when(above, 1))
        ).first()
        if count == stopped or not open_weight:
            break
        stopped, share = count, F.lit(float(Fraction(int(total) - int(held or 0), int(open_weight))))
    return rows.select("tree", "source_size", F.least(F.col("weight") * share, cap.cast("double")).alias("target"))


def fight(held: int, up: int, down: int, chance: random.Random) -> int:
    """``held`` after a fight that moves it ``up`` or ``down``; its expectation stays."""
    if not up or not down:
        return held
    return held + up if chance.randrange(up + down) < down else held - down


def pooled_fights(sizes: list[int], mass: int, most: int, chance: random.Random) -> tuple[list[int], list[int]]:
    """Copies of units, longest first, that share ``mass`` words (in ``PARTS``) in proportion to their sizes.

    Each fights the unit of all behind it. Where only one outcome can make it whole, as for a text
    longer than the words the others can give or take, that one is taken: near the target
    counts for more there than the expectation. Returns the whole copies of each and the
    words of a copy still open, of one unit at most.
    """
    copies, left, pool = [], [], sum(sizes)
    for size in sizes:
        full, own = size * PARTS, mass * size // pool
        pool, mass = pool - size, mass - own
        whole, held = divmod(own, full)
        room = max(0, most * pool * PARTS - mass)
        up, down = min(full - held, mass), min(held, room)
        if (up < full - held) != (down < held):
            after = full if down < held else 0
        else:
            after = fight(held, up, down, chance)
        mass -= after - held
        copies.append(whole + after // full)
        left.append(after % full)
    return copies, left


def fights(full: list[int], mass: list[int], chance: random.Random) -> tuple[list[int], list[int]]:
    """Copies, 0 or 1, of units with ``mass`` of ``full`` words, in order: the residual so far against the next.

    Returns as ``pooled_fights``.
    """
    copies, left, last = [0] * len(full), [0] * len(full), None
    for at, other in enumerate(mass):
        if last is not None:
            held = left[last]
            after = fight(held, min(full[last] - held, other), min(held, full[at] - other), chance)
            other -= after - held
            copies[last], left[last] = divmod(after, full[last])
        copies[at], left[at] = divmod(other, full[at])
        last = at if left[at] else last if last is not None and left[last] else None
    return copies, left


def _rounds(units: DataFrame, seed: str, run) -> DataFrame:
    """Fights within each (tree, block), the longest units first, by ``run(sizes, mass, chance)``.

    Adds to ``copies``; ``mass`` becomes what is still open, above 0 for one unit a block at most.
    """

    def group(table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "descending"), ("doc_id", "ascending"), ("nth", "ascending")])
        chance = random.Random(f"{seed}|{table['block'][0].as_py()}|{table['tree'][0].as_py()}")
        copies, left = run(table["size"].to_pylist(), table["mass"].to_pylist(), chance)
        new = {"copies": pc.add(table["copies"], pa.array(copies, pa.int64())), "mass": pa.array(left, pa.int64())}
        return pa.table([new.get(c, table[c]) for c in table.column_names], table.column_names)

    ship_package(units.sparkSession)
    return stored(units.groupBy("tree", "block").applyInArrow(group, units.schema), "rounds")


def _with_sources(units: DataFrame, sources: DataFrame, rows: int) -> DataFrame:
    """Units with their source's columns. Sources of over a thousandth of all rows, so fewer than a thousand, are broadcast."""
    large = F.col("source_rows") * 1000 > rows
    hot = F.broadcast(sources.where(large))
    others = units.join(hot.select("tree"), "tree", "left_anti").join(sources.where(~large), "tree")
    return units.join(hot, "tree").unionByName(others)


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block_rows: int = 4096, seed: str = "mix"
) -> DataFrame:
    """How many words of each document a mix of its sources takes.

    ``doc_id, size, source_size, target, taken``: the words of the document and of its source,
    the source's target, and the document's words times its copies, 0 to ``most``. Sources by code
    point, null last, weigh ``weights`` in turn. The same rows give the same result, in whatever
    order and partitions they come. ``block_rows`` is the mean number of documents in a block.

    Null and empty texts have size 0 and are not taken. Repeated rows are documents of their own.
    Null ids are ids. Other columns are ignored. Without any word all targets are 0; an empty
    table gives no row.
    """
    sized = stored(sizes(docs), "sizes")
    by_source = sized.groupBy("tree").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    by_source = stored(by_source, "sources")
    rows, largest = by_source.agg(F.sum("source_rows"), F.max("source_rows")).first()
    if not rows:
        return docs.sparkSession.createDataFrame([], "doc_id long, size long, source_size long, target double, taken long")
    sources = by_source.join(targets(by_source.select("tree", "source_size"), weights, most).drop("source_size"), "tree")

    # Equal rows are told apart by a number, in steps, so that no long sequence is made at once.
    equal = sized.groupBy("tree", "doc_id", "size").agg(F.count(F.lit(1)).alias("times"))
    parts = equal.select("*", F.explode(F.expr(f"sequence(0L, (times - 1) div {_CHUNK})")).alias("part"))
    units = parts.select(
        "tree", "doc_id", "size",
        F.explode(F.expr(f"sequence(part * {_CHUNK}, least(times, (part + 1) * {_CHUNK}) - 1)")).alias("nth"),
    )
    known = _with_sources(units, sources, rows).select(
        "tree", F.expr(f"pmod(xxhash64(doc_id, size, nth), (source_rows + {block_rows - 1}) div {block_rows})").alias("block"),
        "doc_id", "size", "nth", "source_size", "target", F.lit(0).cast("long").alias("copies"),
        F.round(F.col("target") / F.col("source_size") * F.col("size") * PARTS).cast("long").alias("mass"),
    )
    known = stored(known.where("size > 0").unionByName(known.where("size = 0").withColumn("mass", F.lit(0).cast("long"))), "units")

    def pooled(size: list[int], mass: list[int], chance: random.Random):
        return pooled_fights(size, min(sum(mass), most * sum(size) * PARTS), most, chance)

    def paired(size: list[int], mass: list[int], chance: random.Random):
        return fights([s * PARTS for s in size], mass, chance)

    decided = known.where("size = 0")
    fought, blocks, level = _rounds(known.where("size > 0"), f"{seed}|0", pooled), -(-largest // block_rows), 0
    while blocks > 1:
        decided = decided.union(fought.where("mass = 0"))
        blocks, level = -(-blocks // block_rows), level + 1
        residuals = fought.where("mass > 0").withColumn("block", F.expr(f"block div {block_rows}"))
        fought = _rounds(residuals, f"{seed}|{level}", paired)
    # A source's very last residual goes to the nearer side: one draw has no others to make up for it.
    last = fought.withColumn("copies", F.col("copies") + (F.col("mass") * 2 >= F.col("size") * PARTS).cast("long"))
    return decided.union(last).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))

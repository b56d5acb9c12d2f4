"""Per-group choices and numbering that survive hot groups.

Best-of and first-of are aggregates over a comparable struct, so they combine
before the shuffle. Top-k uses ``row_number() <= k``, which Spark turns into a
local limit before and after the shuffle. Full numbering of a group goes through
bounded chunks, so no task ever sorts a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tradeloom.staging import staged


def top_k(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """At most ``k`` rows per group; adds ``rank``."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


def best_row(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row with the smallest ``order`` tuple per group, as one aggregate."""
    others = [c for c in rows.columns if c not in keys]
    order_key = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    best = F.min_by(F.struct(*others), order_key).alias("best")
    return rows.groupBy(*keys).agg(best).select(*keys, "best.*")


def number_rows(
    rows: DataFrame, keys: list[str], position: str, *, chunk_rows: int = 1_000_000
) -> DataFrame:
    """Add ``number``: 1, 2, 3… per group in order of an integer ``position``.

    Positions are cut into fixed-width chunks. Each (group, chunk) holds at most
    ``chunk_rows`` rows when positions are unique; only the chunk totals, one row
    per chunk, are summed along a group.
    """
    chunked = rows.withColumn("_chunk", F.floor(F.col(position) / chunk_rows))
    totals = chunked.groupBy(*keys, "_chunk").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = totals.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*keys, "_chunk").orderBy(position)
    numbered = chunked.withColumn("_inside", F.row_number().over(inside))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "_chunk"]]
    return (
        numbered.alias("a")
        .join(offsets.alias("b"), same)
        .select(
            *[F.col(f"a.{c}") for c in rows.columns],
            (F.col("_inside") + F.col("_before")).alias("number"),
        )
    )


def number_lines(rows: DataFrame, name: str, first: int = 0) -> DataFrame:
    """Add consecutive numbers in the order of partitions and of rows in them.

    Two narrow passes over a deterministic scan: only one count per partition is
    gathered, no row moves.
    """
    return _number_ids(rows.withColumn("_id", F.monotonically_increasing_id()), name, first)


def number_sorted(rows: DataFrame, order: list[Column], name: str, first: int = 1) -> DataFrame:
    """Add the position of each row in the given order, as data: it survives writing in many files.

    Rows are dealt out by ranges of the order, whose bounds Spark samples, and sorted there; the
    ranges' counts give each its offset. Rows equal in all of ``order`` come in any order.
    """
    ranged = rows.orderBy(*order).withColumn("_id", F.monotonically_increasing_id())
    return _number_ids(staged(ranged, "ranges"), name, first)


def _number_ids(tagged: DataFrame, name: str, first: int) -> DataFrame:
    """Consecutive numbers from generated ids ``_id``, whose partitions follow each other."""
    bits = 33  # where the generated id keeps its partition number
    partition = F.shiftright("_id", bits)
    sizes = tagged.groupBy(partition.alias("_p")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    # One row per input partition.
    joined = tagged.withColumn("_p", partition).join(F.broadcast(starts), "_p")
    inside = F.col("_id").bitwiseAND((1 << bits) - 1)
    return joined.withColumn(name, inside + F.col("_start") + first).drop("_id", "_p", "_start")


def numbered_names(rows: DataFrame, base: str, position: str, **options: int) -> DataFrame:
    """Add ``unique_name``: the base name, then ``_2``, ``_3``… on repeats.

    For bases that never look like another base's numbered form; archives, where
    that may happen, use ``batch.output_names``.
    """
    numbered = number_rows(rows, [base], position, **options)
    suffix = F.when(F.col("number") == 1, "").otherwise(F.concat(F.lit("_"), "number"))
    return numbered.withColumn("unique_name", F.concat(base, suffix)).drop("number")


def first_occurrences(rows: DataFrame, key: str, position: str, *, salts: int = 16) -> DataFrame:
    """Add ``is_repeat``: true on every occurrence of a key after its first.

    The first positions combine before the shuffle; a key's rows meet theirs in as
    many tasks as there are salts.
    """
    firsts = rows.groupBy(key).agg(F.min(position).alias("_first")).withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    )
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(position), F.lit(salts)).cast("int"))
    return (
        salted.join(firsts, [key, "_salt"])
        .withColumn("is_repeat", F.col(position) > F.col("_first"))
        .drop("_first", "_salt")
    )


def duplicate_values(rows: DataFrame, column: str, limit: int | None = 25) -> DataFrame:
    """Non-empty values that occur more than once, most frequent first."""
    counts = (
        rows.select(F.trim(column).alias("value"))
        .filter("value <> ''")
        .groupBy("value")
        .agg(F.count("*").alias("count"))
        .filter("count > 1")
    )
    if limit is None:
        return counts
    return counts.orderBy(F.desc("count"), "value").limit(limit)

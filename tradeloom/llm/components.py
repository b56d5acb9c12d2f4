"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tradeloom.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``vertex, component`` (the least vertex) for every vertex of ``edges`` (long ``u``, ``v``, u <> v).

    Each round is equi-joins and partial minima, so a vertex with many edges costs rows,
    not a group in memory; rounds end when the edges stay the same.
    """
    state, before = stored(edges.select("u", "v").distinct(), "edges"), None
    while True:
        now = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
        state = stored(_small_star(_large_star(state)), "edges")
    return state.select(F.col("u").alias("vertex"), F.col("v").alias("component")).union(
        state.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct()
    )

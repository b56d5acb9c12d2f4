"""Differences between two keyed snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def diff(local: DataFrame, remote: DataFrame, key: str, content: str) -> DataFrame:
    """``key`` and ``change``: new, removed or changed; equal keys are dropped.

    Only a 256-bit digest of the content travels through the join.
    """
    def digest(side: DataFrame, name: str) -> DataFrame:
        return side.select(key, F.sha2(F.col(content).cast("string"), 256).alias(name))

    both = digest(local, "_old").join(digest(remote, "_new"), key, "full_outer")
    change = (
        F.when(F.col("_old").isNull(), "new")
        .when(F.col("_new").isNull(), "removed")
        .when(F.col("_old") != F.col("_new"), "changed")
    )
    return both.select(key, change.alias("change")).filter("change IS NOT NULL")


def sorted_json(column: str) -> str:
    """JSON text with sorted object keys, so equal content compares equal."""
    return f"to_json(parse_json({column}))"


def diff_terms(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Vocabulary terms (``term_id``, ``body``) compared by canonical JSON."""
    def canonical(side: DataFrame) -> DataFrame:
        return side.select("term_id", F.expr(sorted_json("body")).alias("body"))

    return diff(canonical(local), canonical(remote), "term_id", "body")


def source_changes(local: DataFrame, remote: DataFrame | None) -> DataFrame:
    """Byte-level change per source file (``source``, ``content``)."""
    old = local.select("source", F.sha2("content", 256).alias("local_hash"))
    if remote is None:
        return old.withColumns(
            {"remote_hash": F.lit(None).cast("string"), "changed": F.lit(False)}
        )
    new = remote.select("source", F.sha2("content", 256).alias("remote_hash"))
    return old.join(new, "source", "left").withColumn(
        "changed", F.coalesce(F.col("remote_hash") != F.col("local_hash"), F.lit(False))
    )


def term_counts(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Terms per source on both sides; inputs have a ``source`` column."""
    both = local.select("source", F.lit("local").alias("side")).unionByName(
        remote.select("source", F.lit("remote").alias("side"))
    )
    return both.groupBy("source").agg(
        F.count_if(F.col("side") == "local").alias("term_count_local"),
        F.count_if(F.col("side") == "remote").alias("term_count_remote"),
    )


def recommended_actions(changes: DataFrame) -> DataFrame:
    """Follow-up texts, depending on whether any source changed."""
    # Action texts.
    review = [
        "Review new, removed, and changed terms before updating mappings.",
        "Run revalidate-mapping-catalog against the refreshed snapshot.",
    ]
    nothing = ["No snapshot refresh action is required."]
    any_change = F.coalesce(F.bool_or("changed"), F.lit(False))
    return changes.agg(any_change.alias("c")).select(
        F.posexplode(
            F.when(F.col("c"), F.array(*map(F.lit, review))).otherwise(
                F.array(*map(F.lit, nothing))
            )
        ).alias("pos", "action")
    )



"""Positions of rows in their groups, by range partitions and offsets; no group is gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tradeloom.llm.common import stored


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """``rows`` with ``position`` (from 0, by ``order``, nulls first) and ``group_rows``, per value of ``group``.

    ``group`` must not be null. Rows are dealt out in ranges of (group, order), so one group may
    span any number of tasks; a position is the place in the range plus the group's rows in
    the ranges before. The range bounds are sampled, so ``rows`` should be cheap to read twice.
    Rows equal in all of ``order`` come in any order.
    """
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    ranged = stored(
        rows.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().alias("_at")),
        "ranges",
    )
    runs = ranged.groupBy(group, "_range").agg(F.min("_at").alias("_begin"), F.count(F.lit(1)).alias("_rows"))
    of_group = Window.partitionBy(group)
    before = F.sum("_rows").over(of_group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    shifts = runs.select(
        group, "_range", (F.coalesce(before, F.lit(0)) - F.col("_begin")).alias("_shift"),
        F.sum("_rows").over(of_group).alias("group_rows"),
    )
    return ranged.join(shifts, [group, "_range"]).select(
        *rows.columns, (F.col("_at") + F.col("_shift")).alias("position"), "group_rows"
    )

"""Ids as a Bloom filter: rows that cannot join are told apart in the tasks that read them.

Where few of many long rows meet a table of ids, a join would shuffle them all. With the
filter, only those that may meet one go into the join, which stays exact. It takes 12 to 24
bits an id, made in tasks; four hashes let less than 1 % of other ids pass.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType

from tradeloom.llm.common import ship_package

BITS, HASHES = 12, 4


def may_hold(ids: DataFrame) -> Callable[[Column], Column]:
    """Test for a long column: false only if its value is not in ``ids`` (one long column, read twice)."""
    spark, (name,) = ids.sparkSession, ids.columns
    size = 1 << max(6, (ids.count() * BITS - 1).bit_length())
    low, high = "h & 4294967295L", "(shiftrightunsigned(h, 32) | 1L)"
    at = f"explode(transform(sequence(0L, {HASHES - 1}L), k -> ({low}) + k * {high} & {size - 1}L)) AS at"
    words = ids.select(F.xxhash64(name).alias("h")).selectExpr(at).groupBy(
        F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(at & 63 AS int)))").alias("bits")).toArrow()
    bits = np.zeros(size >> 6, np.uint64)
    bits[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    ship_package(spark)
    sent = spark.sparkContext.broadcast(bits)

    def passes(hashes: pd.Series) -> pd.Series:
        known, value = sent.value, hashes.to_numpy().view(np.uint64)
        low, high = value & np.uint64(0xFFFFFFFF), value >> np.uint64(32) | np.uint64(1)
        found = np.ones(len(value), bool)
        for k in range(HASHES):
            place = low + np.uint64(k) * high & np.uint64(size - 1)
            found &= (known[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
        return pd.Series(found)

    test = F.pandas_udf(passes, BooleanType())
    return lambda column: test(F.xxhash64(column))

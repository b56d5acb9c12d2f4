"""Exports of several parts that become visible together.

Parts are written below a run of their own. The run counts when a row that names its parts has been
added to the list of commits, which is the last thing done and one file. Readers go by that
list, so a run that fails leaves the last complete export in place, and a repeated run does not
touch what others are reading.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, functions as F

_COMMITS = "sequence bigint, run string, parts map<string,string>"


class Export:
    """One run of an export below ``path``: write its parts, then ``commit``."""

    def __init__(self, spark: SparkSession, path: str, run: str | None = None) -> None:
        self.spark, self.path = spark, path
        self.run = run or uuid.uuid4().hex
        self.parts: dict[str, str] = {}

    def _part(self, name: str) -> str:
        self.parts[name] = f"{self.path}/runs/{self.run}/{name}"
        return self.parts[name]

    def rows(self, df: DataFrame, name: str) -> DataFrame:
        """Rows that several parts are made of, written once and read back."""
        target = f"{self.path}/runs/{self.run}/{name}"
        df.write.parquet(target)
        return df.sparkSession.read.schema(df.schema).parquet(target)

    def json(self, df: DataFrame, name: str, *partitions: str) -> None:
        writer = df.write.partitionBy(*partitions) if partitions else df.write
        writer.option("ignoreNullFields", False).json(self._part(name))

    def csv(self, df: DataFrame, name: str) -> None:
        options = {"header": True, "escape": '"', "emptyValue": ""}
        df.write.options(**options).csv(self._part(name))

    def text(self, df: DataFrame, name: str) -> None:
        df.write.text(self._part(name))

    def commit(self) -> dict[str, str]:
        """Make the run the current one; returns its parts."""
        last = _last(self.spark, self.path)
        row = (last.sequence + 1 if last else 1, self.run, self.parts)
        commits = self.spark.createDataFrame([row], _COMMITS)
        commits.coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
        return dict(self.parts)


def _last(spark: SparkSession, path: str) -> Row | None:
    try:
        commits = spark.read.schema(_COMMITS).parquet(f"{path}/commits")
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return commits.orderBy(F.desc("sequence"), F.desc("run")).first()


def current(spark: SparkSession, path: str) -> dict[str, str]:
    """Parts of the last complete run of an export."""
    last = _last(spark, path)
    if last is None:
        raise ValueError(f"No complete export in: {path}")
    return dict(last.parts)

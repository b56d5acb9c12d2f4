"""The conversion over a directory that keeps receiving files.

Conversion is row-wise and stateless, so the batch plan applies to a stream
unchanged: no watermark, no state, exactly-once through the file sink.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tradeloom.plans.convert import convert
from tradeloom.sources.profile import Profile

_FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def landing_documents(
    spark: SparkSession, path: str, *, max_files_per_trigger: int = 10_000
) -> DataFrame:
    return (
        spark.readStream.format("binaryFile")
        .schema(_FILE_SCHEMA)
        .option("pathGlobFilter", "*.xml")
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .load(path)
        .selectExpr("path AS doc_id", "content")
    )


def convert_landing(
    docs: DataFrame, output: str, checkpoint: str, profile: Profile | None = None
) -> StreamingQuery:
    """Convert everything that has landed, then stop; run again for what follows."""
    converted = convert(docs, profile)
    return (
        converted.selectExpr("doc_id", "product.gtin AS gtin", "jsonld", "error_message")
        .writeStream.format("parquet")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )

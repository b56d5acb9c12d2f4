"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Let the executors import this package, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="tradeloom-")) / "tradeloom_tasks.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def in_tasks(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` with a function that may use this package's modules."""
    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one all executors share (``spark.checkpoint.dir``).

    Where the session has none, as in tests, a local one is set.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    base = configured or spark.sparkContext.getCheckpointDir()
    if base is None:
        base = tempfile.mkdtemp(prefix="tradeloom-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "rows") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage is cut there."""
    path = f"{shared_folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(doc_id: Column, modulus: int) -> Column:
    """The fold of a document: crc32 of its id as text, modulo ``modulus``."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus)).cast("int")


def chunks(batches: Iterator[pa.RecordBatch], rows: int, characters: int, column: str) -> Iterator[pa.RecordBatch]:
    """Cut batches into pieces of at most ``rows`` rows and about ``characters`` bytes of a column."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
        begin = held = 0
        for at, size in enumerate(sizes):
            if at > begin and (at - begin >= rows or held + size > characters):
                yield batch.slice(begin, at - begin)
                begin, held = at, 0
            held += size
        if begin < len(sizes):
            yield batch.slice(begin)


def batch_of(schema: pa.Schema, columns: Sequence) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)],
        schema=schema,
    )

"""CSV with quoted line breaks, read by byte ranges of a file instead of one task a file.

A range cannot tell whether it begins inside a quoted cell. So each range first says where it would
end from either state, outside or inside quotes; composing these along the file, a prefix over
one row a range, gives every range its true state. In a second pass each range cuts its lines into
records; what lies over a border is put together from the parts of the ranges it crosses.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tradeloom import ship_with_tasks
from tradeloom.staging import staged

ship_with_tasks(__name__)

_OPTIONS = {"escape": '"', "multiLine": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
_STATES = pa.schema([("file", pa.string()), ("block", pa.int64()), ("from_outside", pa.bool_()), ("from_inside", pa.bool_())])
_PARTS = pa.schema([("file", pa.string()), ("block", pa.int64()), ("seq", pa.int64()), ("kind", pa.int32()), ("record", pa.string())])
#: Kinds of parts: the rest of an earlier range's record, a whole record, and one that goes on.
_REST, _WHOLE, _OPEN = 0, 1, 2
#: The rest of a quoted cell up to its closing quote; two quotes stand for one.
_CLOSING = re.compile(r'(?:[^"]++|"")*+"')
_FEW_RANGES = 100_000


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a line ends inside a quoted cell. Quotes open a cell only at its beginning."""
    at = 0
    while True:
        if inside or line.startswith('"', at):
            closing = _CLOSING.match(line, at + (not inside))
            if not closing:
                return True
            at, inside = closing.end(), False
        at = line.find(",", at) + 1
        if not at:
            return False


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per range of a file the states at its end from either state at its beginning."""
    current, ends = None, (False, True)
    for batch in batches:
        quoted = pc.match_substring(batch.column("value"), '"').to_pylist()
        keys = zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), strict=True)
        for at, key in enumerate(keys):
            if key != current:
                if current:
                    yield _batch([(*current, *ends)], _STATES)
                current, ends = key, (False, True)
            if quoted[at]:
                line = batch.column("value")[at].as_py()
                ends = ends_inside(line, ends[0]), ends_inside(line, ends[1])
    if current:
        yield _batch([(*current, *ends)], _STATES)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of each range, with the rest of one before and the beginning of one after."""
    current, seq, rest, inside, held = None, 0, False, False, []

    def left() -> list[tuple]:
        return [(*current, seq, _REST if rest else _OPEN, "\n".join(held))] if held else []

    for batch in batches:
        rows = []
        columns = (batch.column(c).to_pylist() for c in ("file", "block", "starts_inside", "value"))
        for file, block, starts_inside, line in zip(*columns, strict=True):
            if (file, block) != current:
                rows += left()
                current, seq, rest, inside, held = (file, block), 0, starts_inside, starts_inside, []
            if '"' in line:
                inside = ends_inside(line, inside)
            held.append(line)
            if inside:
                continue
            if rest:
                rows.append((file, block, -1, _REST, "\n".join(held)))
            elif len(held) > 1 or line.strip("\r"):
                rows.append((file, block, seq, _WHOLE, "\n".join(held)))
                seq += 1
            rest, held = False, []
        yield _batch(rows, _PARTS)
    yield _batch(left(), _PARTS)


def range_states(lines: DataFrame) -> DataFrame:
    """``file, block, starts_inside`` of every range."""
    ends = lines.mapInArrow(_states, "file string, block bigint, from_outside boolean, from_inside boolean")
    along = Window.partitionBy("file").orderBy("block")
    # A range keeps the state, swaps it, or forgets it; after the last that forgets, swaps count.
    swaps = F.count_if(F.col("from_outside") & ~F.col("from_inside")).over(along) % 2
    forgot = F.when(F.col("from_outside") == F.col("from_inside"), F.col("from_outside").cast("int").bitwiseXOR(F.col("swaps").cast("int")))
    known = ends.withColumn("swaps", swaps).withColumn("forgot", forgot)
    last = F.coalesce(F.last("forgot", ignorenulls=True).over(along), F.lit(0))
    after = known.withColumn("after", last.bitwiseXOR(F.col("swaps").cast("int")))
    return after.select("file", "block", (F.lag("after", 1, 0).over(along) == 1).alias("starts_inside"))


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, seq, record``: the text of every record, blank lines left out, in order of the three.

    ``block`` is where the range begins that the record begins in.
    """
    text = spark.read.option("lineSep", "\n").text(path)
    lines = text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    odd = staged(range_states(lines).where("starts_inside"), "ranges")
    numbered = lines.withColumn("line", F.monotonically_increasing_id())
    if odd.count() <= _FEW_RANGES:  # few ranges begin inside quotes: their list is sent to all tasks
        cut = numbered.join(F.broadcast(odd), ["file", "block"], "left")
    else:
        cut = numbered.join(odd, ["file", "block"], "left").repartition("file", "block").sortWithinPartitions("file", "block", "line")
    cut = cut.select("file", "block", F.coalesce("starts_inside", F.lit(False)).alias("starts_inside"), "value")
    parts = staged(cut.mapInArrow(_parts, "file string, block bigint, seq bigint, kind int, record string"), "records")
    crossing = parts.where(F.col("kind") != _WHOLE)
    order = Window.partitionBy("file").orderBy("block", "kind")
    named = crossing.withColumn("nth", F.count_if(F.col("kind") == _OPEN).over(order))
    joined = named.groupBy("file", "nth").agg(
        F.min("block").alias("block"), F.max("seq").alias("seq"),
        F.array_sort(F.collect_list(F.struct("block", "kind", "record"))).alias("texts"),
    ).select("file", "block", "seq", F.array_join(F.transform("texts", lambda t: t.record), "\n").alias("record"))
    return parts.where(F.col("kind") == _WHOLE).select("file", "block", "seq", "record").union(joined)


def csv_table(spark: SparkSession, path: str, *, number: str | None = None, first: int = 0) -> DataFrame:
    """CSV files with a header as text cells, as Spark's ``multiLine`` reader has them.

    Line breaks inside cells stay as they are; that reader makes CR LF one LF in files whose
    lines end so.
    ``number`` names a column that counts the rows from ``first``, files in the order of their
    paths. The header is the first record of every file; quotes inside a cell are doubled.
    """
    sample = spark.read.options(header=True, **_OPTIONS).csv(path)
    ddl = ", ".join("`" + c.replace("`", "``") + "` string" for c in sample.columns)
    records = csv_records(spark, path)
    if number:
        records = staged(records, "numbered")
        sizes = records.groupBy("file", "block").agg(F.count("*").alias("rows"), F.min("seq").alias("least"))
        files = sizes.groupBy("file").agg(F.sum("rows").alias("rows"), F.lit(1).alias("one"))
        by_file = Window.partitionBy("one").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
        by_block = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        file_starts = files.select("file", F.coalesce(F.sum(F.col("rows") - 1).over(by_file), F.lit(0)).alias("file_start"))
        starts = sizes.select("file", "block", (F.coalesce(F.sum("rows").over(by_block), F.lit(0)) - F.col("least")).alias("block_start"))
        records = records.join(starts.join(file_starts, "file"), ["file", "block"])
        records = records.withColumn(number, F.col("file_start") + F.col("block_start") + F.col("seq") - 1 + first)
    body = records.where("NOT (block = 0 AND seq = 0)").select(F.regexp_replace("record", r"\r\z", "").alias("record"), *([number] if number else []))
    cells = body.withColumn("cells", F.from_csv("record", ddl, _OPTIONS))
    return cells.select("cells.*", *([number] if number else []))

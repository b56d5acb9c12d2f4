"""XML documents from directories and archives."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from tradeloom import ship_with_tasks
from tradeloom.fixed import MAX_FILE_BYTES, MAX_FILES, MAX_TOTAL_BYTES
from tradeloom.functions.text import safe_archive_path
from tradeloom.operators.extract import with_columns
from tradeloom.staging import staged

ship_with_tasks(__name__)


def xml_directory(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id`` (file path), ``file_name`` and ``content`` of every ``*.xml``.

    A directory without any is an error.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").load(path)
    if found.select("path").isEmpty():
        raise ValueError(f"No XML sample files found in: {path}")
    files = found.select(F.col("path").alias("doc_id"), "content")
    return files.withColumn("file_name", F.element_at(F.split("doc_id", "/"), -1))


@dataclass(frozen=True)
class ArchiveLimits:
    max_files: int = MAX_FILES
    max_file_bytes: int = MAX_FILE_BYTES
    max_total_bytes: int = MAX_TOTAL_BYTES

    def __post_init__(self) -> None:
        # Option names in the messages.
        for name, value in (
            ("max_files", self.max_files),
            ("max_uncompressed_file_size", self.max_file_bytes),
            ("max_total_uncompressed_size", self.max_total_bytes),
        ):
            if value < 1:
                raise ValueError(f"{name} must be at least 1.")


#: One row per XML entry, or one for an archive that is refused as a whole or has none.
#: ``part`` numbers the runs of entries that one task reads.
_DIRECTORY = pa.schema([
    ("archive", pa.string()), ("archive_error", pa.string()), ("xml_files", pa.int32()),
    ("xml_bytes", pa.int64()), ("entry_no", pa.int32()), ("entry", pa.string()), ("size", pa.int64()),
    ("raw_name", pa.string()), ("header_offset", pa.int64()), ("compressed", pa.int64()),
    ("method", pa.int32()), ("crc", pa.int64()), ("flags", pa.int32()), ("part", pa.int64()),
])
_DIRECTORY_DDL = (
    "archive string, archive_error string, xml_files int, xml_bytes bigint, entry_no int, entry string, "
    "size bigint, raw_name string, header_offset bigint, compressed bigint, method int, crc bigint, "
    "flags int, part bigint"
)
_READ = ("archive", "archive_error", "xml_files", "xml_bytes", "entry_no", "entry", "size")
_PART_BYTES, _PART_ENTRIES, _BATCH_ROWS = 16 << 20, 2000, 5000
#: An archive without entries, for readers that know the directory already.
_NO_ENTRIES = b"PK\x05\x06" + bytes(18)


def store_of(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The store behind an address, as tasks reach it directly, and the path in it."""
    scheme, _, rest = uri.partition(":")
    if scheme == "file":
        uri = "/" + rest.lstrip("/")
    elif scheme == "s3a":
        uri = f"s3:{rest}"
    return pa.fs.FileSystem.from_uri(uri)


def opened(uri: str) -> pa.NativeFile:
    """A file to be read by ranges."""
    store, path = store_of(uri)
    return store.open_input_file(path)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def _directories(batches: Iterator[pa.RecordBatch], limits: ArchiveLimits) -> Iterator[pa.RecordBatch]:
    """The central directory of every archive; no entry is read."""
    for source in batches:
        for path in source.column("path").to_pylist():
            try:
                with opened(path) as file, zipfile.ZipFile(file) as archive:
                    infos = [
                        i for i in archive.infolist()
                        if not i.is_dir() and i.filename.lower().endswith(".xml")
                    ]
            except (OSError, pa.ArrowInvalid, zipfile.BadZipFile) as exc:
                # A file shorter than a directory's end: the store refuses to seek before its start.
                why = "File is not a zip file" if isinstance(exc, pa.ArrowInvalid) else exc
                yield _batch([(path, f"Cannot read ZIP file: {why}", 0, 0, *[None] * 9, 0)], _DIRECTORY)
                continue
            total = sum(max(0, i.file_size) for i in infos)
            head = (path, None, len(infos), total)
            if not infos or len(infos) > limits.max_files or total > limits.max_total_bytes:
                yield _batch([(*head, *[None] * 9, 0)], _DIRECTORY)
                continue
            rows, part, held, begin = [], 0, 0, 0
            for number, i in enumerate(infos):
                if held and (held + i.compress_size > _PART_BYTES or number - begin >= _PART_ENTRIES):
                    part, held, begin = part + 1, 0, number
                held += i.compress_size
                rows.append((*head, number, i.filename, i.file_size, i.orig_filename, i.header_offset,
                             i.compress_size, i.compress_type, i.CRC, i.flag_bits, part))
                if len(rows) == _BATCH_ROWS:
                    yield _batch(rows, _DIRECTORY)
                    rows = []
            if rows:
                yield _batch(rows, _DIRECTORY)


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Read the wanted entries where the directory says they are; one file is open at a time."""
    schema = pa.schema([*(_DIRECTORY.field(c) for c in _READ), ("error_type", pa.string()),
                        ("error_message", pa.string()), ("content", pa.binary())])
    archive, path, file = None, None, None
    for source in batches:
        rows, held = [], 0
        for r in source.to_pylist():
            data, kind, message = None, r["error_type"], r["error_message"]
            if r["entry"] is not None and kind is None:
                try:
                    if r["archive"] != path:
                        path, file = r["archive"], opened(r["archive"])
                        archive = zipfile.ZipFile(io.BytesIO(_NO_ENTRIES))
                        archive.fp = file
                    info = zipfile.ZipInfo(r["entry"])
                    info.orig_filename, info.header_offset = r["raw_name"], r["header_offset"]
                    info.compress_size, info.file_size = r["compressed"], r["size"]
                    info.compress_type, info.CRC, info.flag_bits = r["method"], r["crc"], r["flags"]
                    data = archive.read(info)
                except (OSError, RuntimeError, EOFError, zlib.error, zipfile.BadZipFile) as exc:
                    kind, message = type(exc).__name__, str(exc)
            rows.append((*(r[c] for c in _READ), kind, message, data))
            held += len(data or b"")
            if held > _PART_BYTES:
                yield _batch(rows, schema)
                rows, held = [], 0
        yield _batch(rows, schema)


def zip_entries(
    spark: SparkSession, path: str, limits: ArchiveLimits | None = None
) -> DataFrame:
    """XML entries of ZIP archives with the verdict of the archive limits.

    The central directory of an archive is read once and stored; it says where entries lie, so
    runs of entries of some megabytes are read by different tasks, however
    large the archive. ``archive_error`` marks archives refused as a whole;
    ``error_type`` marks single entries that must not be converted: these are not read. Unsafe
    entries count towards the archive limits and sort first. Stores are read by
    ranges (local, ``s3``, ``gs``, ``hdfs``).
    """
    limits = limits or ArchiveLimits()
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path)
    listed = files.select("path").mapInArrow(lambda batches: _directories(batches, limits), _DIRECTORY_DDL)
    # Message texts and error types.
    directory = staged(with_columns(
        listed,
        {
            "archive_error": f"""CASE
                WHEN archive_error IS NOT NULL THEN archive_error
                WHEN xml_files = 0 THEN 'No XML files found in ZIP.'
                WHEN xml_files > {limits.max_files} THEN concat('ZIP contains ', xml_files,
                    ' XML files; max_files is {limits.max_files}.')
                WHEN xml_bytes > {limits.max_total_bytes} THEN concat(
                    'ZIP XML payload exceeds max_total_uncompressed_size: ', xml_bytes,
                    ' > {limits.max_total_bytes}.') END""",
            "error_type": f"""CASE
                WHEN entry IS NULL THEN NULL
                WHEN NOT {safe_archive_path('entry')} THEN 'UnsafeZipPath'
                WHEN size > {limits.max_file_bytes} THEN 'FileTooLarge' END""",
            "error_message": f"""CASE
                WHEN entry IS NULL THEN NULL
                WHEN NOT {safe_archive_path('entry')}
                    THEN 'ZIP entry path is unsafe and was not read.'
                WHEN size > {limits.max_file_bytes} THEN concat(
                    'Uncompressed XML file size exceeds limit: ', size,
                    ' > {limits.max_file_bytes}.') END""",
        },
    ), "directory")
    parts = directory.select("archive", "part").distinct().count()
    runs = directory.repartition(max(1, min(parts, 10_000)), "archive", "part")
    return runs.sortWithinPartitions("archive", "entry_no").mapInArrow(
        _contents,
        "archive string, archive_error string, xml_files int, xml_bytes bigint, entry_no int, "
        "entry string, size bigint, error_type string, error_message string, content binary",
    )

"""Inventory of passport sources and checks of their manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tradeloom.fixed import (
    INVENTORY_CSV_COLUMNS, PASSPORT_SECTORS, PASSPORT_SOURCE_REQUIRED,
    PASSPORT_SOURCE_TYPES, PLACEHOLDER_SHA256,
)
from tradeloom.functions import in_list, q, strings
from tradeloom.functions.linked import member
from tradeloom.functions.text import formula_safe
from tradeloom.operators.extract import with_columns
from tradeloom.operators.ranking import first_occurrences

_SOURCE_COLUMNS = (
    "source_id", "title", "source_url", "source_type", "version", "sector", "local_path", "sha256",
)


def source_rows(entries: DataFrame) -> DataFrame:
    """Manifest entries (``pos``, ``entry`` VARIANT) as columns."""
    return entries.selectExpr(
        "pos", *[f"{member('entry', c, 'string')} AS {c}" for c in _SOURCE_COLUMNS],
        "map_keys(try_variant_get(entry, '$', 'map<string,variant>')) AS members",
        "startswith(schema_of_variant(entry), 'OBJECT') AS is_object",
    )


def manifest_errors(sources: DataFrame) -> DataFrame:
    """``pos`` and ``error``: missing fields, repeated ids, unknown enum values."""
    label = "coalesce(source_id, concat('<index ', pos, '>'))"
    flagged = first_occurrences(sources.withColumn("label", F.expr(label)), "label", "pos")
    lacking = f"array_except({strings(PASSPORT_SOURCE_REQUIRED)}, members)"

    def unknown(column: str, allowed: tuple[str, ...]) -> str:
        listed = q(str(list(allowed)))
        return (
            f"CASE WHEN {column} <> '' AND NOT {in_list(column, allowed)} THEN "
            f"concat('Source ', chr(39), label, chr(39), ' has unknown {column} ', chr(39), "
            f"{column}, chr(39), '. Expected one of: ', {listed}, '.') END"
        )

    # Message texts.
    messages = (
        f"concat(transform({lacking}, f -> concat('Source ', chr(39), label, chr(39), "
        "' is missing required field ', chr(39), f, chr(39), '.')), "
        "array_compact(array("
        "CASE WHEN is_repeat THEN concat('Duplicate source_id: ', chr(39), label, chr(39), '.') END, "
        f"{unknown('source_type', PASSPORT_SOURCE_TYPES)}, {unknown('sector', PASSPORT_SECTORS)})))"
    )
    not_object = "array(concat('Source at index ', pos, ' is not a JSON object.'))"
    return flagged.selectExpr("pos", f"explode(IF(is_object, {messages}, {not_object})) AS error")


def inventory(sources: DataFrame, files: DataFrame) -> DataFrame:
    """Sources with file presence and checksum status.

    ``files``: local_path and content of what is on disk; null content means the
    file is there but could not be read.
    """
    digests = files.select(
        "local_path", F.sha2("content", 256).alias("actual_sha256"), F.lit(True).alias("present")
    )
    joined = sources.join(digests, "local_path", "left")
    # Status names.
    return with_columns(
        joined,
        {
            "file_exists": "coalesce(present, false)",
            "checksum_status": f"""CASE
                WHEN present IS NULL THEN 'missing'
                WHEN coalesce(sha256, '') IN ('', {q(PLACEHOLDER_SHA256)}) THEN 'placeholder'
                WHEN actual_sha256 IS NULL THEN 'not_computed'
                WHEN actual_sha256 = sha256 THEN 'ok' ELSE 'mismatch' END""",
        },
    ).drop("present")


def inventory_counts(rows: DataFrame) -> DataFrame:
    """Sources by type and by sector in one pass over grouping sets."""
    kind, sector = "coalesce(source_type, 'unknown')", "coalesce(sector, 'unknown')"
    named = rows.selectExpr(f"{kind} AS source_type", f"{sector} AS sector")
    grouped = named.groupingSets(
        [[F.col("source_type")], [F.col("sector")]], "source_type", "sector"
    ).agg(F.count("*").alias("count"), F.grouping("source_type").alias("by_sector"))
    return grouped.selectExpr(
        "IF(by_sector = 1, 'sector', 'source_type') AS dimension",
        "IF(by_sector = 1, sector, source_type) AS value", "count",
    )


def inventory_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count("*").alias("total_sources"),
        F.count_if(~F.col("file_exists")).alias("missing_count"),
        F.count_if(F.col("checksum_status") == "ok").alias("checksum_ok_count"),
        F.count_if(F.col("checksum_status") == "placeholder").alias("checksum_placeholder_count"),
    )


def missing_files(rows: DataFrame) -> DataFrame:
    return rows.filter(~F.col("file_exists")).select("source_id").orderBy("source_id")


def inventory_csv(rows: DataFrame) -> DataFrame:
    """Export columns with formula-like text neutralised."""
    named = rows.selectExpr(
        "source_id", "title", "source_type", "sector", "version", "local_path",
        "IF(file_exists, 'True', 'False') AS _file_exists",
        "checksum_status AS _checksum_status", "actual_sha256 AS _actual_sha256",
    )
    return named.selectExpr(
        *[f"{formula_safe(f'coalesce({c}, {q(str())})')} AS {c}" for c in INVENTORY_CSV_COLUMNS]
    )


def find_manifest_entry(sources: DataFrame, schema_path: str) -> DataFrame:
    """First source whose path equals the schema path or just its file name."""
    name = schema_path.rsplit("/", 1)[-1]
    return (
        sources.filter(F.col("local_path").isin(schema_path, name)).orderBy("pos").limit(1)
    )


# --- Decision backlog -------------------------------------------------------------


def backlog_problems(backlog: DataFrame, valid_statuses: tuple[str, ...]) -> DataFrame:
    """Repeated ids and unknown statuses."""
    repeated = backlog.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")
    invalid = backlog.filter(~F.col("status").isin(*valid_statuses)).select("status").distinct()
    return repeated.selectExpr("'duplicate_id' AS problem", "id AS value").unionByName(
        invalid.selectExpr("'invalid_status' AS problem", "status AS value")
    )


def backlog_summary(backlog: DataFrame) -> DataFrame:
    is_open = F.col("status") == "open"
    return backlog.agg(
        F.count_if(is_open).alias("open_topics"),
        F.sum(F.when(is_open, F.col("warning_count")).otherwise(0)).alias("open_warnings"),
    )


def backlog_categories(backlog: DataFrame) -> DataFrame:
    return backlog.select("category").filter("category <> ''").distinct().orderBy("category")

"""CSV catalogs, reference tables and workbook-sheet exports."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tradeloom.fixed import ATTRIBUTE_HEADERS, ATTRIBUTE_LINEAGE, DELETED_SHEET
from tradeloom.functions import replace
from tradeloom.functions.text import strip
from tradeloom.operators.ranking import number_lines
from tradeloom.sources.csvranges import csv_table


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Raw CSV, all text, header row, byte-order mark tolerated; large files are read by ranges."""
    return csv_table(spark, path)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Mapping catalog: cells trimmed, missing cells empty, rows numbered.

    ``row_number`` is the line a reader of the file would count (header = 1); rows come in that order.
    """
    raw = csv_table(spark, path, number="row_number", first=2)
    cells = [trimmed(c) for c in raw.columns if c != "row_number"]
    return raw.selectExpr(*cells, "row_number").orderBy("row_number")


def trimmed(column: str) -> str:
    return f"coalesce({strip(f'`{column}`')}, '') AS `{column}`"


def catalog_rows(raw: DataFrame) -> DataFrame:
    return number_lines(raw.selectExpr(*map(trimmed, raw.columns)), "row_number", first=2)


# --- Source-attribute sheets ------------------------------------------------------


def field_for_header(header: str) -> str | None:
    """Field behind a column heading, ignoring case, blanks and punctuation."""
    return ATTRIBUTE_HEADERS.get(re.sub(r"[^a-z0-9]+", "", header.lower()))


def cell_text(column: str, kind: T.DataType) -> str:
    """A typed cell as normalised text (SQL expression text)."""
    cell = f"`{column}`"
    if isinstance(kind, T.BooleanType):
        return f"CASE WHEN {cell} THEN 'Yes' WHEN NOT {cell} THEN 'No' ELSE '' END"
    if isinstance(kind, T.DateType):
        return f"coalesce(date_format({cell}, 'yyyy-MM-dd'), '')"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        day = f"date_format({cell}, 'yyyy-MM-dd')"
        clock = f"date_format({cell}, 'HH:mm:ss.SSSSSS')"
        time = replace(clock, r"\.000000\z")
        return (
            f"coalesce(CASE WHEN {clock} = '00:00:00.000000' THEN {day} "
            f"ELSE concat({day}, 'T', {time}) END, '')"
        )
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        whole = f"{cell} = floor({cell})"
        return (
            f"coalesce(CASE WHEN {whole} THEN CAST(CAST({cell} AS decimal(38,0)) AS string) "
            f"ELSE CAST({cell} AS string) END, '')"
        )
    if isinstance(kind, T.StringType):
        unified = f"replace({cell}, concat(chr(13), chr(10)), chr(10))"
        return f"coalesce({strip(unified)}, '')"
    return f"coalesce(CAST({cell} AS string), '')"


def normalize_attributes(
    sheet: DataFrame, *, sheet_name: str, source_version: str, is_deleted: bool
) -> DataFrame:
    """Project one sheet to the fixed attribute schema and drop empty rows."""
    kinds = {f.name: f.dataType for f in sheet.schema.fields}
    found = {field_for_header(c): c for c in sheet.columns if field_for_header(c)}
    fields = list(ATTRIBUTE_HEADERS.values())
    rows = sheet.selectExpr(
        *[
            f"{cell_text(found[f], kinds[found[f]])} AS {f}" if f in found else f"'' AS {f}"
            for f in fields
        ]
    )
    rows = rows.filter(" OR ".join(f"{f} <> ''" for f in fields))
    rows = rows.withColumns(
        {
            "source_sheet": F.lit(sheet_name),
            "source_version": F.lit(source_version),
            "is_deleted": F.lit(is_deleted),
        }
    )
    if is_deleted:
        rows = rows.withColumn(
            "change_type",
            F.expr("CASE WHEN change_type = '' THEN 'D' ELSE change_type END"),
        )
    candidate = (
        f"lower({strip('row_type')}) = 'attribute' AND NOT is_deleted "
        "AND bms_id <> '' AND xpath <> '' AND attribute_name <> ''"
    )
    return rows.withColumn("is_candidate_source", F.expr(candidate)).select(
        *fields, *ATTRIBUTE_LINEAGE
    )


def attribute_sheets(sheets: dict[str, DataFrame], source_version: str) -> DataFrame:
    """Active rows of the version's sheet plus the deleted ones.

    The sheet named like the version wins, else the first one starting with it.
    """
    selected = selected_sheet(list(sheets), source_version)
    rows = normalize_attributes(
        sheets[selected], sheet_name=selected, source_version=source_version, is_deleted=False
    )
    if DELETED_SHEET in sheets:
        rows = rows.unionByName(
            normalize_attributes(
                sheets[DELETED_SHEET], sheet_name=DELETED_SHEET,
                source_version=source_version, is_deleted=True,
            )
        )
    return rows


def selected_sheet(names: list[str], source_version: str) -> str:
    if source_version in names:
        return source_version
    for name in names:
        if name.strip().startswith(source_version):
            return name
    raise ValueError(
        f"Workbook does not contain expected version sheet {source_version!r}."
    )

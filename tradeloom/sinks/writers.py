"""Partitioned outputs. Files are written by the tasks; nothing passes the driver.

A result with several parts is computed once: its rows are written first, and the parts
are read from there. All parts become visible in one commit (``commits.current`` has the last
complete export). Only reports a person reads are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tradeloom.fixed import BACKLOG_CSV_COLUMNS
from tradeloom.functions.text import safe_filename, safe_stem
from tradeloom.operators.batch import batch_totals, corpus_totals, output_names, report_rows
from tradeloom.operators.candidates import candidate_summary, flat_candidates
from tradeloom.operators.explorer import display_rows, explorer_summary
from tradeloom.operators.inventory import inventory_csv, inventory_summary
from tradeloom.operators.profiles import csv_cells
from tradeloom.operators.ranking import number_sorted
from tradeloom.sinks.commits import Export, current


def safe_names(name: str) -> Column:
    return F.expr(safe_stem(safe_filename(name)))


def write_csv(df: DataFrame, path: str) -> str:
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("escape", '"')
        .option("emptyValue", "")
        .csv(path)
    )
    return path


def write_conversion(converted: DataFrame, path: str, keys: list[str]) -> dict[str, str]:
    """Products, mapping report, validation, leftovers and errors of a conversion.

    Rows are keyed by document, so two documents with one GTIN do not overwrite
    each other. Every document is parsed once: all parts are read from what is written first.
    """
    out = Export(converted.sparkSession, path)
    converted = out.rows(converted, "converted")
    good = converted.filter("error_type IS NULL")
    gtin = F.coalesce("product.gtin", F.lit("unknown")).alias("gtin")
    out.json(good.select(*keys, gtin, "jsonld"), "products")
    out.json(good.select(*keys, gtin, "validation.*"), "validation")
    unmapped = good.select(*keys, gtin, F.explode("unmapped").alias("u"))
    out.json(unmapped.select(*keys, "gtin", "u.*"), "unmapped")
    out.json(report_rows(converted, keys), "mapping_report")
    failed = converted.filter("error_type IS NOT NULL")
    out.json(failed.select(*keys, "error_type", "error_message"), "errors")
    return out.commit()


def write_batch(
    results: DataFrame, path: str, converted: DataFrame | None = None
) -> dict[str, str]:
    """Per-file results partitioned by outcome, the totals, and the parts of the export.

    With ``converted`` (keys ``archive``, ``entry_no``): products, three reports and
    errors, each row under its archive and unique output name.
    """
    out = Export(results.sparkSession, path)
    results = out.rows(results, "results")
    out.json(results, "files", "status")
    out.json(batch_totals(results), "summary")
    if converted is None:
        return out.commit()
    keys = ["archive", "entry_no"]
    failed = results.filter("status = 'error'").select(
        *keys, "filename", safe_names("filename").alias("base_name"), F.lit("success").alias("status"),
        "error_type", "error_message",
    )
    errors = output_names(failed).select(
        "archive", F.concat("output_name", F.lit("_error")).alias("output_name"),
        "filename", "error_type", "error_message",
    )
    named = results.filter("status = 'success'").select(*keys, "output_name").join(converted, keys)
    named = out.rows(named, "converted")
    who = ["archive", "output_name"]
    out.json(named.select(*who, "jsonld"), "products")
    out.json(report_rows(named, who), "mapping_report")
    out.json(named.select(*who, "validation.*"), "validation_report")
    unmapped = named.select(*who, F.explode("unmapped").alias("u"))
    out.json(unmapped.select(*who, "u.*"), "unmapped_fields")
    out.json(errors, "errors")
    return out.commit()


def write_corpus(rows: DataFrame, path: str) -> dict[str, str]:
    out = Export(rows.sparkSession, path)
    rows = out.rows(rows, "rows")
    out.json(number_sorted(rows, [F.col("sample_file")], "position"), "samples")
    out.json(corpus_totals(rows), "summary")
    return out.commit()


def write_sections(sections: dict[str, DataFrame], path: str) -> dict[str, str]:
    """Named tables of one report."""
    out = Export(next(iter(sections.values())).sparkSession, path)
    for name, df in sections.items():
        out.json(df, name)
    return out.commit()


def write_quality(report: dict[str, DataFrame], path: str) -> dict[str, str]:
    """Findings and coverage sections of a catalog or mapping check."""
    return write_sections(report, path)


def write_catalog(rows: DataFrame, columns: list[str], path: str) -> str:
    """Catalog CSV with its original columns, in row order."""
    return write_csv(rows.orderBy("row_number").select(*columns), path)


def write_reference(datasets: dict[str, DataFrame], path: str) -> dict[str, str]:
    """Normalised reference datasets as JSON and as CSV cells."""
    out = Export(next(iter(datasets.values())).sparkSession, path)
    for name, df in datasets.items():
        df = out.rows(df, f"{name}_rows")
        out.json(df, f"{name}_json")
        out.csv(csv_cells(df), f"{name}_csv")
    return out.commit()


def write_candidates(rows: DataFrame, path: str) -> dict[str, str]:
    out = Export(rows.sparkSession, path)
    rows = out.rows(rows, "candidates")
    ordered = number_sorted(rows, [F.col("webvoc_property_id"), F.col("rank")], "position").drop("rank")
    ordered = out.rows(ordered, "ordered")
    out.json(ordered, "json")
    out.csv(flat_candidates(ordered), "csv")
    out.json(candidate_summary(rows), "summary")
    return out.commit()


def write_explorer(
    properties: DataFrame, evidence: DataFrame, path: str
) -> dict[str, str]:
    out = Export(properties.sparkSession, path)
    properties = out.rows(properties, "properties")
    out.json(evidence, "evidence_json")
    out.json(properties, "properties_json")
    out.csv(display_rows(properties), "properties_csv")
    out.json(explorer_summary(properties), "summary")
    return out.commit()


def write_snapshot(
    sources: dict[str, DataFrame], metadata: DataFrame, path: str, version: str
) -> dict[str, str]:
    """A new snapshot version in its own folder, complete or not visible; a version is written once."""
    out = Export(metadata.sparkSession, path, version)
    for name, df in sources.items():
        out.text(df, name)
    out.json(metadata, "metadata")
    return out.commit()


def current_snapshot(spark: SparkSession, path: str) -> str:
    """Folder of the last complete version."""
    return current(spark, path)["metadata"].rpartition("/")[0]


def write_update_report(report: dict[str, DataFrame], path: str) -> dict[str, str]:
    """Sections of a vocabulary update check."""
    return write_sections(report, path)


def write_inventory(rows: DataFrame, path: str) -> dict[str, str]:
    out = Export(rows.sparkSession, path)
    rows = out.rows(rows, "inventory")
    out.json(rows, "json")
    out.csv(inventory_csv(rows), "csv")
    out.json(inventory_summary(rows), "summary")
    return out.commit()


def write_passports(validated: DataFrame, summary: DataFrame, path: str) -> dict[str, str]:
    out = Export(validated.sparkSession, path)
    out.json(validated.select("passport_id", "passport"), "passports")
    out.json(validated.select("passport_id", "validation_status", "errors", "warnings"), "validation")
    out.json(summary, "summary")
    return out.commit()


def write_backlog(backlog: DataFrame, path: str, output_format: str = "all") -> dict[str, str]:
    if output_format not in ("all", "json", "csv"):
        raise ValueError("--format must be one of: all, json, csv")
    out = Export(backlog.sparkSession, path)
    if output_format in ("all", "json"):
        out.json(backlog.drop("pos"), "json")
    if output_format in ("all", "csv"):
        out.csv(csv_cells(backlog.orderBy("pos").select(*BACKLOG_CSV_COLUMNS)), "csv")
    return out.commit()

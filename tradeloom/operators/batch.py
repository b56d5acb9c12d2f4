"""Archive batches and directory corpora: per-file results and totals."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tradeloom.functions import keep, q
from tradeloom.functions.text import safe_filename, safe_stem
from tradeloom.operators.extract import with_columns
from tradeloom.operators.ranking import number_rows
from tradeloom.operators.validate import validation_status
from tradeloom.plans.convert import convert
from tradeloom.sources.profile import Profile
from tradeloom.staging import staged

_FOUND = f"size({keep('mapping_report', lambda r: f'{r}.found')})"


def file_results(converted: DataFrame, name: str) -> DataFrame:
    """One summary row per converted document; ``name`` holds the file name.

    "success" means converted, even if the product is invalid. ``unmapped_count``
    is the number of leftover groups.
    """
    ok = "error_type IS NULL"
    keys = [c for c in converted.columns if c not in (
        "product", "jsonld", "mapping_report", "validation", "unmapped",
        "error_type", "error_message", name,
    )]
    gtin = "coalesce(product.gtin, '')"
    base = f"IF({gtin} <> '', concat('product_', {gtin}), {name})"
    return converted.selectExpr(
        *keys,
        f"{name} AS filename",
        f"{safe_filename(name)} AS safe_filename",
        f"IF({ok}, 'success', 'error') AS status",
        f"IF({ok}, {gtin}, '') AS gtin",
        f"IF({ok}, {safe_stem(base)}, '') AS base_name",
        f"IF({ok}, {_FOUND}, 0) AS mapped_count",
        f"IF({ok}, size(unmapped), 0) AS unmapped_count",
        f"IF({ok}, {validation_status('validation')}, '') AS validation_status",
        f"IF({ok}, size(validation.errors), 0) AS validation_error_count",
        f"IF({ok}, size(validation.warnings), 0) AS validation_warning_count",
        "coalesce(error_type, '') AS error_type",
        "coalesce(error_message, '') AS error_message",
    )


def output_names(results: DataFrame) -> DataFrame:
    """Add ``output_name``: unique per archive, ``x``, ``x_2``… in entry order.

    A suffixed name may itself be another file's base name. A base that is no other's numbered
    form, and has none among the others, is numbered in chunks, however often it repeats. Only
    bases linked in that way are settled one after the other, each family of them in one
    task; a base remembers its last suffix there. The rows are staged, as several steps read them.
    """
    schema = T.StructType(results.schema.fields + [T.StructField("output_name", T.StringType())])
    results = staged(results, "results")  # what they come from, often a conversion, runs once
    named = results.where("status = 'success'")
    bases = named.select("archive", "base_name").distinct()
    plain = F.regexp_replace("base_name", r"_(?:[2-9]|[1-9][0-9]+)\z", "")
    numbered_form = bases.withColumn("plain", plain).where("plain <> base_name")
    links = numbered_form.join(bases.withColumnRenamed("base_name", "plain"), ["archive", "plain"])
    linked = links.select("archive", "base_name").union(links.select("archive", "plain")).distinct()
    key = ["archive", "base_name"]

    def settle(table: pa.Table) -> pa.Table:
        table = table.sort_by("entry_no")
        used, last, names = set(), {}, []
        for base in table["base_name"].to_pylist():
            name = base
            while name in used:
                last[base] = last.get(base, 1) + 1
                name = f"{base}_{last[base]}"
            used.add(name)
            names.append(name)
        return table.drop_columns(["_family"]).append_column("output_name", pa.array(names, pa.string()))

    alone = number_rows(named.join(linked, key, "left_anti"), key, "entry_no")
    suffix = F.when(F.col("number") == 1, "").otherwise(F.concat(F.lit("_"), "number"))
    numbered = alone.withColumn("output_name", F.concat("base_name", suffix)).select(*schema.names)
    together = named.join(linked, key, "left_semi").select(*results.columns).withColumn(
        "_family", F.regexp_replace("base_name", r"(?:_[0-9]+)+\z", "")
    )
    settled = together.groupBy("archive", "_family").applyInArrow(settle, schema)
    others = results.where("status <> 'success' OR status IS NULL").withColumn("output_name", F.lit(""))
    return numbered.union(settled).union(others.select(*schema.names))


def convert_archives(
    entries: DataFrame, profile: Profile | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(results, converted, refused)`` for the rows of ``zip_entries``.

    Refused archives never reach conversion. Entry errors found while reading and
    parse errors appear side by side in ``results``.
    """
    refused = entries.filter("archive_error IS NOT NULL").select(
        "archive", F.col("archive_error").alias("error_message")
    )
    usable = entries.filter("archive_error IS NULL")
    docs = usable.filter("error_type IS NULL").select("archive", "entry_no", "entry", "content")
    converted = convert(docs, profile)
    names = output_names(file_results(converted, "entry"))
    unread = usable.filter("error_type IS NOT NULL").selectExpr(
        "archive", "entry_no", "entry AS filename", f"{safe_filename('entry')} AS safe_filename",
        "'error' AS status", "'' AS gtin", "'' AS base_name", "0 AS mapped_count",
        "0 AS unmapped_count", "'' AS validation_status", "0 AS validation_error_count",
        "0 AS validation_warning_count", "error_type", "error_message", "'' AS output_name",
    )
    results = names.unionByName(unread).withColumn(
        "batch_order",
        F.struct(F.col("error_type") != "UnsafeZipPath", F.col("entry_no")),
    )
    return results, converted, refused


def batch_totals(results: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return results.groupBy(*keys).agg(
        F.count("*").alias("xml_files_found"),
        F.count_if(F.col("status") == "success").alias("successful_conversions"),
        F.count_if(F.col("status") == "error").alias("failed_conversions"),
        F.sum("unmapped_count").alias("total_unmapped_fields"),
        F.sum("validation_error_count").alias("validation_error_count"),
        F.sum("validation_warning_count").alias("validation_warning_count"),
    )


def preview_rows(results: DataFrame) -> DataFrame:
    return results.selectExpr(
        "filename", "status",
        "coalesce(nullif(gtin, ''), output_name) AS gtin_or_output_name",
        "mapped_count", "unmapped_count", "validation_status",
        "IF(error_type <> '' AND error_message <> '', "
        "concat(error_type, ': ', error_message), error_message) AS error_summary",
    )


def corpus_rows(converted: DataFrame, name: str, output_dir: str = "") -> DataFrame:
    """One row per document of a directory run.

    Unlike a batch, success here means a valid product, and the leftover count is
    the number of elements rather than of groups.
    """
    parsed, valid = "error_type IS NULL", "coalesce(validation.valid, false)"
    gtin = "coalesce(product.gtin, '')"
    file_name = f"concat({q(output_dir)}, 'product_', coalesce(nullif({gtin}, ''), 'unknown'), '.jsonld')"
    elements = "aggregate(unmapped, 0L, (s, u) -> s + u.count)"
    # Stage names and note texts.
    return converted.selectExpr(
        f"{name} AS sample_file",
        f"IF({parsed}, {gtin}, '') AS detected_gtin",
        f"{valid} AS conversion_success",
        f"IF({parsed}, {file_name}, '') AS jsonld_output_file",
        f"{valid} AS validation_valid",
        f"IF({parsed}, size(validation.errors), 0) AS validation_error_count",
        f"IF({parsed}, size(validation.warnings), 0) AS validation_warning_count",
        f"IF({parsed}, {elements}, 0L) AS unmapped_element_count",
        f"IF({parsed}, size(unmapped), 0) AS unmapped_unique_element_count",
        f"IF({parsed}, {_FOUND}, 0) AS mapped_field_count",
        f"CASE WHEN NOT {parsed} THEN 'xml_parsing' WHEN {valid} THEN '' "
        "ELSE 'validation' END AS failure_stage",
        f"CASE WHEN NOT {parsed} THEN error_message WHEN {valid} THEN '' "
        "ELSE array_join(validation.errors, '; ') END AS exception_message",
        f"CASE WHEN NOT {parsed} THEN 'Failed during xml_parsing.' "
        f"WHEN NOT {valid} THEN 'Conversion completed, but validation failed.' "
        "WHEN size(validation.warnings) > 0 THEN concat('Converted successfully with ', "
        "size(validation.warnings), ' validation warning(s).') "
        "ELSE 'Converted successfully.' END AS notes",
    )


def unusable_profile_rows(docs: DataFrame, name: str, problem: str) -> DataFrame:
    """Corpus rows when the profile itself cannot be loaded: every file fails."""
    return docs.selectExpr(
        f"{name} AS sample_file", "'' AS detected_gtin", "false AS conversion_success",
        "'' AS jsonld_output_file", "false AS validation_valid",
        "0 AS validation_error_count", "0 AS validation_warning_count",
        "0L AS unmapped_element_count", "0 AS unmapped_unique_element_count",
        "0 AS mapped_field_count", "'mapping' AS failure_stage",
        f"{q(problem)} AS exception_message", "'Failed during mapping.' AS notes",
    )


def corpus_totals(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count("*").alias("sample_count"),
        F.count_if("conversion_success").alias("successful_count"),
        F.count_if(~F.col("conversion_success")).alias("failed_count"),
        F.coalesce(F.every("conversion_success"), F.lit(True)).alias("successful"),
    )


def report_rows(converted: DataFrame, keys: list[str]) -> DataFrame:
    """Mapping report in long form: one row per document and rule."""
    return converted.filter("error_type IS NULL").select(
        *keys, F.posexplode("mapping_report").alias("rule_no", "r")
    ).select(*keys, "rule_no", "r.*")


def with_context_map(leftovers: DataFrame) -> DataFrame:
    """Turn the sorted context pairs into a map for output."""
    return with_columns(leftovers, {"context": "map_from_entries(context)"})

"""Profiles of normalised reference data and source checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from tradeloom.functions.text import has_items, has_value, squeeze, strip


def _filled(df: DataFrame, column: str) -> str:
    is_list = isinstance(df.schema[column].dataType, T.ArrayType)
    return has_items(column) if is_list else has_value(column)


def attribute_profile(rows: DataFrame) -> DataFrame:
    """Counts over source attributes in a single pass."""
    kind = f"lower({strip('row_type')})"
    attribute, klass = f"{kind} = 'attribute'", f"{kind} = 'class'"
    counts = {
        "total_rows": "true",
        "active_rows": "NOT is_deleted",
        "deleted_rows": "is_deleted",
        "attribute_rows": attribute,
        "class_rows": klass,
        "candidate_source_rows": "is_candidate_source",
        **{
            f"rows_with_{name}": has_value(name)
            for name in ("bms_id", "xpath", "definition", "data_type")
        },
        "rows_with_code_list": "code_list_enumeration <> '' OR code_list_name <> '' "
        "OR bms_code_list_id <> ''",
        "missing_bms_id": f"NOT {has_value('bms_id')}",
        "missing_xpath": f"{attribute} AND NOT {has_value('xpath')}",
        "missing_attribute_name": f"{attribute} AND NOT {has_value('attribute_name')}",
        "missing_row_type": f"NOT {has_value('row_type')}",
    }
    return rows.agg(*[F.expr(f"count_if({test})").alias(name) for name, test in counts.items()])


def vocabulary_profile(properties: DataFrame, classes: DataFrame) -> DataFrame:
    counts = {
        "property_count": "true",
        "link_type_property_count": "is_link_type",
        "stable_property_count": "term_status = 'stable'",
        "properties_with_domain": _filled(properties, "domain"),
        "properties_with_range": _filled(properties, "range"),
        **{
            f"missing_{name}": f"NOT {_filled(properties, name)}"
            for name in ("label", "comment", "domain", "range")
        },
    }
    flags = properties.selectExpr(*[f"{test} AS {name}" for name, test in counts.items()])
    both = flags.unionByName(classes.selectExpr("true AS class_count"), allowMissingColumns=True)
    return both.agg(*[F.count_if(name).alias(name) for name in (*counts, "class_count")])


def checksum_checks(sources: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest entries against file digests.

    ``sources``: source_id, local_path, sha256. ``files``: local_path, content.
    """
    digests = files.select("local_path", F.sha2("content", 256).alias("actual"))
    return sources.join(digests, "local_path", "left").selectExpr(
        "source_id", "local_path", "lower(sha256) AS expected_sha256",
        "coalesce(actual, '') AS actual_sha256", "actual IS NOT NULL AS exists",
        "coalesce(actual = lower(sha256), false) AS matches",
    )


def require_matching(checks: DataFrame) -> DataFrame:
    """The same rows; running the plan fails if an existing file mismatches."""
    message = F.concat(F.lit("Source manifest checksum mismatch: "), F.col("source_id"))
    fine = ~F.col("exists") | F.col("matches")
    return checks.filter(F.assert_true(fine, message).isNull())


def find_source(sources: DataFrame, local_path: str, id_part: str) -> DataFrame:
    """The source with exactly this path, else the first whose id contains a part."""
    path = F.replace(F.col("local_path"), F.lit("\\"), F.lit("/"))
    exact = path == local_path
    similar = F.col("source_id").contains(id_part)
    return (
        sources.filter(exact | similar)
        .orderBy(F.when(exact, 0).otherwise(1), "pos")
        .limit(1)
    )


def csv_cells(df: DataFrame) -> DataFrame:
    """Cells as exported: booleans lower-case, lists joined, text white space collapsed."""
    def cell(f: T.StructField) -> str:
        name = f"`{f.name}`"
        if isinstance(f.dataType, T.BooleanType):
            text = f"CASE WHEN {name} THEN 'true' WHEN NOT {name} THEN 'false' END"
        elif isinstance(f.dataType, T.ArrayType):
            text = f"array_join({name}, '; ')"
        elif isinstance(f.dataType, T.StringType):
            text = squeeze(name)
        elif isinstance(f.dataType, (T.StructType, T.MapType)):
            text = f"to_json({name})"
        else:
            text = f"CAST({name} AS string)"
        return f"coalesce({text}, '') AS {name}"

    return df.selectExpr(*[cell(f) for f in df.schema.fields])

"""Small JSON inputs: backlogs, manifests, passports; YAML authoring manifests."""

from __future__ import annotations

from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession, functions as F

from tradeloom.fixed import MANIFEST_REQUIRED
from tradeloom.functions import strings
from tradeloom.functions.linked import member
from tradeloom.sources.vocabulary import whole_files

BACKLOG_FIELDS = {
    "id": "string", "title": "string", "status": "string", "category": "string",
    "affected_fields": "array<string>", "affected_properties": "array<string>",
    "warning_count": "int", "blocks_release": "boolean",
    "standards_review_required": "boolean", "recommended_owner": "string",
    "target_release": "string", "decision_file": "string", "issue_number": "int",
    "issue_url": "string",
}


def _entries(texts: DataFrame, where: str) -> DataFrame:
    listed = F.expr(f"try_variant_get(try_parse_json(text), '{where}', 'array<variant>')")
    return texts.select(F.posexplode(listed).alias("pos", "entry"))


def backlog(texts: DataFrame, *, only_open: bool = False) -> DataFrame:
    """Decision backlog. Text that is not a JSON list yields no rows."""
    rows = _entries(texts, "$").filter("startswith(schema_of_variant(entry), 'OBJECT')")
    rows = rows.selectExpr(
        "pos", *[f"{member('entry', name, kind)} AS {name}" for name, kind in BACKLOG_FIELDS.items()]
    )
    return rows.filter("status = 'open'") if only_open else rows


def backlog_from_file(spark: SparkSession, path: str, **options: bool) -> DataFrame:
    """A missing file counts as an empty backlog."""
    if "://" not in path and not Path(path).is_file():
        return backlog(spark.createDataFrame([], "path string, text string"), **options)
    return backlog(whole_files(spark, path), **options)


def json_objects(texts: DataFrame) -> DataFrame:
    """``doc`` VARIANT per text, or an ``error`` for what is not a JSON object."""
    parsed = texts.withColumn("doc", F.expr("try_parse_json(text)"))
    # Message texts.
    error = F.expr(
        "CASE WHEN doc IS NULL THEN 'Input is not valid JSON' "
        "WHEN NOT startswith(schema_of_variant(doc), 'OBJECT') "
        "THEN 'GS1 JSON-LD input must be a JSON object.' END"
    )
    return parsed.withColumn("error", error).withColumn(
        "doc", F.expr("IF(error IS NULL, doc, NULL)")
    )


def manifest_sources(texts: DataFrame) -> DataFrame:
    """``pos`` and ``entry`` VARIANT per source of a manifest."""
    return _entries(texts, "$.sources")


def manifest_problems(texts: DataFrame) -> DataFrame:
    """Structural complaints about a source manifest; no rows means usable."""
    doc = texts.select(F.expr("try_parse_json(text)").alias("doc"))
    # Message texts.
    shape = doc.selectExpr(
        "CASE WHEN doc IS NULL OR NOT startswith(schema_of_variant(doc), 'OBJECT') "
        "THEN 'Source manifest must be a JSON object.' "
        "WHEN coalesce(size(try_variant_get(doc, '$.sources', 'array<variant>')), 0) = 0 "
        "THEN 'Source manifest must contain a non-empty sources list.' END AS problem"
    )
    present = "map_keys(try_variant_get(entry, '$', 'map<string,variant>'))"
    lacking = f"array_except({strings(MANIFEST_REQUIRED)}, {present})"
    name = f"coalesce({member('entry', 'source_id', 'string')}, CAST(pos + 1 AS string))"
    entries = manifest_sources(texts).selectExpr(
        "CASE WHEN NOT startswith(schema_of_variant(entry), 'OBJECT') "
        "THEN concat('Manifest source ', pos + 1, ' must be an object.') "
        f"WHEN size({lacking}) > 0 THEN concat('Manifest source ', chr(39), {name}, chr(39), "
        f"' is missing required field(s): ', array_join({lacking}, ', ')) END AS problem"
    )
    return shape.unionByName(entries).filter("problem IS NOT NULL")


def builder_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Authoring manifest as ``(groups, fields)``.

    ``groups``: category, group key, label, position. A category that names no
    groups, or an unknown one, gets every group. ``fields``: group, property,
    position, requirement, type override, support flag and nested object fields.
    """
    data = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    return builder_tables(spark, data)


def builder_tables(spark: SparkSession, data: object) -> tuple[DataFrame, DataFrame]:
    if not isinstance(data, dict):
        raise ValueError("Builder manifest must be a YAML object.")
    for key in ("root_classes", "product_categories", "groups"):
        if key not in data:
            raise ValueError(f"Builder manifest missing required key: {key}")
    groups = [g for g in data["groups"] if isinstance(g, dict)]
    category_rows = []
    for category in data["product_categories"]:
        wanted = set(category.get("groups") or ())
        category_rows += [
            (category.get("label"), g.get("key"), g.get("label"), i)
            for i, g in enumerate(groups)
            if not wanted or g.get("key") in wanted
        ]
    category_rows += [(None, g.get("key"), g.get("label"), i) for i, g in enumerate(groups)]
    field_rows = []
    for group in groups:
        for i, f in enumerate(group.get("properties", [])):
            if not isinstance(f, dict):
                continue
            nested = [
                (s.get("property_id"), s.get("input_type_override") or s.get("input_type") or "text")
                for s in f.get("object_fields") or ()
                if s.get("property_id")
            ]
            field_rows.append(
                (
                    group.get("key"), f.get("property_id"), i, f.get("requirement", "optional"),
                    f.get("input_type_override"), f.get("supported_in_v0_10", True),
                    f.get("object_type"), nested or None, len(field_rows),
                )
            )
    return (
        spark.createDataFrame(
            category_rows, "category string, group string, label string, pos int"
        ),
        spark.createDataFrame(
            field_rows,
            "group string, property_id string, pos int, requirement string, "
            "input_type_override string, supported boolean, object_type string, "
            "object_fields array<struct<property_id:string,input_type:string>>, field_pos int",
        ),
    )


def groups_for_category(groups: DataFrame, category: str) -> DataFrame:
    """Groups in manifest order; an unknown category sees all of them."""
    known = groups.filter(F.col("category") == category)
    every = groups.filter("category IS NULL").join(
        known.select(F.lit(1).alias("one")).limit(1), F.lit(True), "left_anti"
    )
    return known.unionByName(every).select("group", "label", "pos").orderBy("pos")


def fields_of_group(fields: DataFrame, group: str) -> DataFrame:
    return fields.filter(F.col("group") == group).orderBy("pos")

"""Queries that compare results column by column where others compare counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tradeloom.fixed import BLOCKING_NOTES, CANDIDATE_VERSION, FALLBACK_WARNING, MANIFEST_REQUIRED

from tradeloom.functions.jsontext import json_object, json_string
from tradeloom.operators import explorer, inventory as inv, structure
from tradeloom.plans import workloads
from tradeloom.plans.messages import deal
from tradeloom.plans.roundtrips import ORACLES, WORKLOADS
from tradeloom.plans.workloads import table, workload
from tradeloom.sinks import commits, writers
from tradeloom.sources import documents as docs_in, vocabulary
from tradeloom.staging import shared_folder

__all__ = ["ORACLES", "WORKLOADS"]


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# --- Candidates ----------------------------------------------------------------------

_SQL_NOTES = "concat_ws('; ', " + ", ".join(
    f"CASE WHEN contains(warnings, '{name}') THEN {_sql(text)} END" for name, text in BLOCKING_NOTES.items()
) + ")"


@workload(f"""WITH e AS ({workloads._SQL_EVIDENCED.replace("{limit}", "4")}),
    t AS (SELECT *, split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2 FROM part),
    p AS (SELECT DISTINCT p_name AS label, length(p_name) % 4 AS r, w1 || upper(w2[1]) || w2[2:] AS compact FROM t),
    m AS (SELECT w1 || upper(w2[1]) || w2[2:] AS compact, arg_min(CASE WHEN p_partkey % 120 = 0 THEN 'needs_bms_review'
        WHEN p_partkey % 80 = 0 THEN 'mapped' ELSE 'candidate' END,
        p_partkey + CASE WHEN p_partkey % 120 <> 0 AND p_partkey % 80 = 0 THEN 0 ELSE 1e12 END) AS status
      FROM t WHERE p_partkey % 40 = 0 GROUP BY 1)
    SELECT 'cand_' || replace(property, ':', '_') || '__' || attribute AS candidate_id, property AS webvoc_property_id,
      compact AS webvoc_compact_name, label AS webvoc_label, label || ' wood steel' AS webvoc_comment, '' AS webvoc_domain,
      CASE r WHEN 0 THEN 'xsd:decimal' WHEN 1 THEN 'gs1:QuantitativeValue' WHEN 2 THEN 'xsd:boolean' ELSE 'gs1:ColourCode' END AS webvoc_range,
      attribute || '' AS gdsn_bms_id, CASE p_size % 5 WHEN 0 THEN p_name WHEN 1 THEN w1 || '_' || w2
        ELSE p_name || ' ' || lower(p_type) END AS gdsn_attribute_name,
      CASE WHEN p_size % 3 = 0 THEN '/a/b:' || w2 || 'Side[1]' ELSE '' END AS gdsn_xpath, '' AS gdsn_module, '' AS gdsn_parent_class,
      CASE p_size % 4 WHEN 0 THEN 'Measurement' WHEN 1 THEN 'Boolean' WHEN 2 THEN 'String' ELSE 'Other' END AS gdsn_data_type,
      '' AS gdsn_multiplicity, CASE WHEN p_size % 6 = 0 THEN 'list' ELSE '' END AS gdsn_code_list_name, '' AS gdsn_bms_code_list_id,
      CASE WHEN p_size % 7 = 0 THEN 'urn:x.' || w1 || w2 ELSE '' END AS gdsn_semantic_resource_urn,
      CASE WHEN p_size % 2 = 0 THEN 'steel wood ' ELSE '' END || lower(p_type) AS gdsn_definition, '' AS source_message,
      p_size % 10 = 0 AS is_deleted, true AS is_candidate_source, coalesce(status, '') AS existing_mapping_status,
      '' AS existing_mapping_field, CASE WHEN status IS NULL THEN '' ELSE 'high' END AS existing_mapping_confidence,
      CASE WHEN r = 0 THEN 'open' ELSE '' END AS standards_review_status, decisions AS linked_sdr_ids, score, level AS confidence_level,
      review AS review_status, reasons, warnings, {_SQL_NOTES} AS blocking_notes, {_sql(CANDIDATE_VERSION)} AS created_by_version, rank
    FROM e JOIN p ON property = 'gs1:' || compact JOIN t ON p_partkey = attribute LEFT JOIN m USING (compact)""")
def candidate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole candidate rows: texts of both sides, mapping, decisions, signals, notes that block."""
    rows = workloads.evidenced_candidates(spark, sf_dir, 4)
    lists = {"reasons": ";", "warnings": ";", "linked_sdr_ids": ";", "blocking_notes": "; "}
    joined = {name: F.array_join(name, mark) for name, mark in lists.items()}
    return rows.withColumns(joined | {"rank": F.col("rank").cast("bigint")})


# --- Vocabulary ----------------------------------------------------------------------


@workload("""SELECT 'gs1:Part' || p_partkey AS term_id, 'Part' || p_partkey AS compact_name, p_name || '; ' || p_brand AS label,
    '' AS comment, CASE WHEN p_size % 2 = 0 THEN 'rdfs:Class' ELSE 'x:y|owl:Class' END AS type, 'stable' AS term_status,
    CASE WHEN p_size % 5 = 0 THEN '' ELSE 'gs1:Thing|gs1:' || replace(p_type, ' ', '') END AS sub_class_of,
    'https://gs1.org/voc/Part' || p_partkey AS full_iri FROM part WHERE p_size % 3 <> 0""")
def vocabulary_class_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of a graph that holds properties too, with every column."""
    item = json_object([
        ("@id", json_string("concat('gs1:Part', p_partkey)")),
        ("@type", "CASE WHEN p_size % 3 = 0 THEN '\"rdf:Property\"' WHEN p_size % 2 = 0 THEN '\"rdfs:Class\"' "
                  "ELSE '[\"x:y\",\"owl:Class\"]' END"),
        ("rdfs:label", "concat('[', " + json_object([("@value", json_string("p_name"))]) + ", ',', " + json_string("p_brand") + ", ']')"),
        ("rdfs:subClassOf", "IF(p_size % 5 = 0, NULL, concat('[{\"@id\":\"gs1:Thing\"},{\"@list\":[', "
         + json_object([("@id", json_string("concat('gs1:', replace(p_type, ' ', ''))"))]) + ", ']}]'))"),
        ("sw:term_status", "'\"stable\"'"),
    ])
    graph = deal(table(spark, sf_dir, "part")).selectExpr("'' AS path", f"concat('{{\"@graph\":[', {item}, ']}}') AS text")
    return vocabulary.vocabulary_classes(vocabulary.graph_items(graph)).withColumns(
        {"type": F.array_join("type", "|"), "sub_class_of": F.array_join("sub_class_of", "|")}
    )


@workload("""SELECT DISTINCT 'term-' || (p_size // 2) AS name FROM part WHERE p_partkey % 4 < 2""")
def turtle_term_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms at the start of Turtle lines; indented ones, other prefixes and longer names do not count."""
    folder = shared_folder(spark, "turtle")
    table(spark, sf_dir, "part").selectExpr(
        "concat(CASE p_partkey % 4 WHEN 0 THEN concat('gs1:term-', p_size div 2, ' a owl:Class ;') "
        "WHEN 1 THEN concat('gs1:term-', p_size div 2) WHEN 2 THEN concat('  gs1:inner', p_size, ' .') "
        "ELSE concat('x:other', p_size, ' gs1:late .') END) AS value"
    ).write.text(folder)
    return vocabulary.turtle_terms(spark, folder)


# --- Explorer ------------------------------------------------------------------------


@workload("""WITH e AS (SELECT *, unnest(list_filter([CASE WHEN c_custkey % 8 <> 0 THEN 'gs1:prop' || c_nationkey END,
        CASE WHEN c_custkey % 9 = 0 THEN 'schema:name' || c_nationkey END, CASE WHEN c_custkey % 10 = 0 THEN 'gs1:x' END],
        lambda x: x IS NOT NULL)) AS term_id FROM customer)
    SELECT term_id, c_custkey + 2 AS row_number, 'field_' || c_nationkey || CASE WHEN c_custkey % 3 = 0 THEN '_image' ELSE '' END AS canonical_field,
      CASE WHEN c_custkey % 8 = 0 THEN '' ELSE 'gs1:prop' || c_nationkey END AS jsonld_property,
      CASE c_mktsegment WHEN 'FURNITURE' THEN 'mapped_official_bms_xpath' WHEN 'HOUSEHOLD' THEN 'candidate'
        WHEN 'MACHINERY' THEN 'needs_webvoc_review' WHEN 'BUILDING' THEN 'mapped' ELSE 'odd_status' END AS mapping_status,
      CASE c_custkey % 4 WHEN 0 THEN 'certain' WHEN 1 THEN 'low' ELSE 'high' END AS confidence, 'v1' AS mapping_version,
      'file_' || c_custkey AS mapping_profile, 'scope' AS scope_group, CASE WHEN c_custkey % 6 = 0 THEN '' ELSE c_custkey || '' END AS bms_id,
      '/x' AS gdsn_xpath, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'attr' END AS source_attribute_name, 'src' AS source FROM e""")
def evidence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every evidence row of every term, all fields."""
    return explorer.evidence_by_term(workloads.customer_catalog(spark, sf_dir)).select("term_id", "row_number", "evidence.*")


# --- Checks --------------------------------------------------------------------------


@workload(f"""SELECT p_partkey, CASE WHEN p_size % 9 = 0 THEN 'invalid' ELSE 'valid' END AS validation_status,
    CASE WHEN p_size % 9 = 0 THEN 'Required field ''@context'' is missing (minimal fallback check).' ELSE '' END AS errors,
    {_sql(FALLBACK_WARNING)} AS warnings, 'minimal_fallback' AS validator_mode FROM part WHERE p_partkey % 100 <> 1
    UNION ALL SELECT p_partkey, 'invalid', 'Required field ''@context'' is missing (minimal fallback check).|'
      || 'Required field ''@type'' is missing (minimal fallback check).', {_sql(FALLBACK_WARNING)}, 'minimal_fallback' FROM part
    WHERE p_partkey % 100 = 1""")
def fallback_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The check of required members alone, with its warning."""
    checked = structure.check_required_only(workloads.part_products(spark, sf_dir).drop("error"))
    return checked.selectExpr(
        "p_partkey", "validation_status", "array_join(errors, '|') AS errors", "array_join(warnings, '|') AS warnings", "validator_mode"
    )


@workload("""WITH s AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n FROM supplier)
    SELECT 'Manifest source ' || n || ' must be an object.' AS problem, CAST(count(*) AS BIGINT) AS manifests FROM s
      WHERE s_suppkey % 5 = 0 GROUP BY n
    UNION ALL SELECT 'Manifest source ''' || CASE WHEN s_suppkey % 3 = 0 THEN n || '' ELSE 's_' || s_suppkey END
      || ''' is missing required field(s): ' || concat_ws(', ', CASE WHEN s_suppkey % 3 = 0 THEN 'source_id' END,
        CASE WHEN s_suppkey % 4 = 0 THEN 'version' END), CAST(count(*) AS BIGINT) FROM s
      WHERE s_suppkey % 5 <> 0 AND (s_suppkey % 3 = 0 OR s_suppkey % 4 = 0) GROUP BY 1""")
def manifest_load_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What loading a source manifest complains about."""
    fixed = [(name, "'\"x\"'") for name in MANIFEST_REQUIRED if name not in ("source_id", "version")]
    entry = json_object([
        ("source_id", "IF(s_suppkey % 3 = 0, NULL, concat('\"s_', s_suppkey, '\"'))"),
        ("version", "IF(s_suppkey % 4 = 0, NULL, '1')"), *fixed,
    ])
    entries = table(spark, sf_dir, "supplier").selectExpr("s_nationkey", "s_suppkey", f"IF(s_suppkey % 5 = 0, '7', {entry}) AS entry")
    listed = entries.groupBy("s_nationkey").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", "entry"))).alias("l"))
    texts = listed.selectExpr("'' AS path", "concat('{\"sources\":[', array_join(transform(l, x -> x.entry), ','), ']}') AS text")
    return docs_in.manifest_problems(texts).groupBy("problem").agg(F.count("*").alias("manifests"))


@workload("""SELECT doc_id || '' AS source_id, CASE WHEN doc_id % 5 = 0 THEN 'False' ELSE 'True' END AS file_exists,
    CASE WHEN doc_id % 5 = 0 THEN 'missing' WHEN doc_id % 4 = 0 THEN 'placeholder' WHEN doc_id % 3 = 0 THEN 'mismatch' ELSE 'ok' END AS checksum_status,
    CASE WHEN doc_id % 5 = 0 THEN '' ELSE sha256(text) END AS actual_sha256, coalesce(source, '') AS title FROM documents""")
def export_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An inventory export, its CSV part read back from the current commit."""
    texts = table(spark, sf_dir, "documents")
    sources = texts.selectExpr(
        "CAST(doc_id AS string) AS source_id", "source AS title", "'json_schema' AS source_type", "'core' AS sector", "'1' AS version",
        "concat('f/', doc_id) AS local_path",
        "CASE WHEN doc_id % 4 = 0 THEN '' WHEN doc_id % 3 = 0 THEN 'x' ELSE sha2(text, 256) END AS sha256",
    )
    files = texts.filter("doc_id % 5 <> 0").selectExpr("concat('f/', doc_id) AS local_path", "CAST(text AS binary) AS content")
    folder = shared_folder(spark, "inventory")
    writers.write_inventory(inv.inventory(sources, files), folder)
    cells = spark.read.option("header", True).csv(commits.current(spark, folder)["csv"])
    return cells.selectExpr(
        "source_id", "_file_exists AS file_exists", "_checksum_status AS checksum_status",
        "coalesce(_actual_sha256, '') AS actual_sha256", "coalesce(title, '') AS title",
    )

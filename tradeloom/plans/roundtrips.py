"""Queries that write files from the benchmark tables and read them back, and document checks.

Files go to the folder that all executors share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tradeloom.fixed import PASSPORT_SECTORS, PASSPORT_SOURCE_TYPES
from tradeloom.functions import q
from tradeloom.functions.jsontext import json_object, json_string
from tradeloom.operators import batch, explorer, structure
from tradeloom.plans import workloads
from tradeloom.plans.convert import convert
from tradeloom.plans.messages import deal
from tradeloom.plans.reports import ORACLES, WORKLOADS
from tradeloom.plans.workloads import table, workload
from tradeloom.sinks import commits, writers
from tradeloom.sinks.archives import write_archives
from tradeloom.sources.files import ArchiveLimits, zip_entries
from tradeloom.sources.tabular import read_catalog, read_csv
from tradeloom.staging import shared_folder

__all__ = ["ORACLES", "WORKLOADS"]

# --- Archives ----------------------------------------------------------------------


@workload("""WITH e AS (SELECT p_partkey, p_partkey // 150 AS a, p_size, 7 + p_size AS size, CASE p_partkey % 7 WHEN 0 THEN p_partkey || '.XML'
        WHEN 1 THEN p_partkey || '.txt' WHEN 2 THEN '../' || p_partkey || '.xml' WHEN 3 THEN 'a//b/' || p_partkey || '.xml'
        WHEN 4 THEN 'c:' || p_partkey || '.xml' ELSE 'docs/' || p_partkey || '.xml' END AS entry FROM part
      WHERE (p_partkey // 150) % 2 = 0 OR p_size <= 25),
    x AS (SELECT *, count(*) OVER (PARTITION BY a) AS files, sum(size) OVER (PARTITION BY a) AS bytes,
        row_number() OVER (PARTITION BY a ORDER BY p_partkey) - 1 AS entry_no FROM e WHERE NOT entry LIKE '%.txt'),
    v AS (SELECT *, CASE WHEN files > 110 THEN 'ZIP contains ' || files || ' XML files; max_files is 110.'
        WHEN bytes > 3000 THEN 'ZIP XML payload exceeds max_total_uncompressed_size: ' || bytes || ' > 3000.' END AS refused FROM x)
    SELECT DISTINCT 'a' || a || '.zip' AS archive, refused AS archive_error, CAST(files AS INT) AS xml_files,
      CASE WHEN refused IS NULL THEN CAST(entry_no AS INT) END AS entry_no, CASE WHEN refused IS NULL THEN entry END AS entry,
      CASE WHEN refused IS NOT NULL THEN NULL WHEN entry LIKE '../%' OR entry LIKE 'c:%' THEN 'UnsafeZipPath'
        WHEN size > 50 THEN 'FileTooLarge' END AS error_type,
      CASE WHEN refused IS NULL AND NOT (entry LIKE '../%' OR entry LIKE 'c:%') AND size <= 50
        THEN '<a>' || repeat('x', p_size) || '</a>' END AS content FROM v""")
def archive_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of up to 150 entries of every kind under three limits; some are refused as a whole."""
    rows = deal(table(spark, sf_dir, "part")).filter("(p_partkey div 150) % 2 = 0 OR p_size <= 25").selectExpr(
        "concat('a', p_partkey div 150, '.zip') AS archive", "p_partkey AS entry_no",
        "CASE p_partkey % 7 WHEN 0 THEN concat(p_partkey, '.XML') WHEN 1 THEN concat(p_partkey, '.txt') "
        "WHEN 2 THEN concat('../', p_partkey, '.xml') WHEN 3 THEN concat('a//b/', p_partkey, '.xml') "
        "WHEN 4 THEN concat('c:', p_partkey, '.xml') ELSE concat('docs/', p_partkey, '.xml') END AS entry",
        "CAST(concat('<a>', repeat('x', p_size), '</a>') AS binary) AS content",
    )
    folder = shared_folder(spark, "archives")
    write_archives(rows, folder).write.format("noop").mode("overwrite").save()
    limits = ArchiveLimits(max_files=110, max_file_bytes=50, max_total_bytes=3000)
    return zip_entries(spark, folder, limits).selectExpr(
        "element_at(split(archive, '/'), -1) AS archive", "archive_error", "xml_files", "entry_no", "entry",
        "error_type", "CAST(content AS string) AS content",
    )


# --- Tables as files -----------------------------------------------------------------


def _part_cells() -> list[str]:
    return [
        "CAST(p_partkey AS string) AS id", "concat('  ', p_name, '\\n', p_brand, ', \"', p_type, '\"  ') AS name",
        "CASE p_size % 3 WHEN 0 THEN NULL WHEN 1 THEN 'a\"\"b' ELSE concat('\\n', p_type, '\\r\\n') END AS note",
    ]


@workload("""SELECT p_partkey || '' AS id, '  ' || p_name || chr(10) || p_brand || ', "' || p_type || '"  ' AS name,
    CASE p_size % 3 WHEN 0 THEN NULL WHEN 1 THEN 'a""b' ELSE chr(10) || p_type || chr(13) || chr(10) END AS note FROM part""")
def csv_cells_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with line breaks, quotes and blanks at their ends, written as CSV and read by ranges."""
    rows = table(spark, sf_dir, "part").selectExpr(*_part_cells())
    return read_csv(spark, _written_csv(rows, "cells"))


@workload("""SELECT CAST(row_number() OVER (ORDER BY p_partkey) + 1 AS BIGINT) AS row_number, p_partkey || '' AS id,
    p_name || chr(10) || p_brand || ', "' || p_type || '"' AS name,
    CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN 'a""b' ELSE p_type END AS note FROM part""")
def csv_catalog_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a catalog: cells trimmed, missing ones empty, rows numbered in the order of the files."""
    ordered = table(spark, sf_dir, "part").repartitionByRange(8, "p_partkey").sortWithinPartitions("p_partkey")
    return read_catalog(spark, _written_csv(ordered.selectExpr(*_part_cells()), "catalog"))


def _written_csv(rows: DataFrame, name: str) -> str:
    folder = shared_folder(rows.sparkSession, name)
    options = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    rows.write.options(**options).csv(folder)
    return folder


# --- Exports -------------------------------------------------------------------------


@workload("""SELECT p_partkey, 'errors' AS part, 'XMLParseError' AS text FROM part WHERE p_partkey % 50 = 3
    UNION ALL SELECT p_partkey, 'validation', CASE WHEN p_partkey % 11 <> 0 AND p_partkey % 7 <> 0 AND p_size % 5 <> 0
      THEN 'true' ELSE 'false' END FROM part WHERE p_partkey % 50 <> 3
    UNION ALL SELECT p_partkey, 'products', 'gs1:Product' FROM part WHERE p_partkey % 50 <> 3""")
def export_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversion export, written twice in one place, read back from the current commit."""
    folder = shared_folder(spark, "export")
    sent = workloads.faulty_messages(spark, sf_dir).select("p_partkey", "content")
    writers.write_conversion(convert(sent.filter("p_partkey % 97 = 0")), folder, ["p_partkey"])
    writers.write_conversion(convert(sent), folder, ["p_partkey"])
    parts = commits.current(spark, folder)
    kinds = {
        "errors": ("error_type string", "error_type"),
        "validation": ("errors array<struct<code:string>>", "IF(size(errors) = 0, 'true', 'false')"),
        "products": ("jsonld string", "get_json_object(jsonld, \"$['@type']\")"),
    }
    found = None
    for part, (schema, text) in kinds.items():
        rows = spark.read.schema(f"p_partkey bigint, {schema}").json(parts[part])
        rows = rows.selectExpr("p_partkey", f"'{part}' AS part", f"{text} AS text")
        found = rows if found is None else found.unionByName(rows)
    return found


@workload("""SELECT p_partkey || '.xml' AS file, CAST(row_number() OVER (ORDER BY p_partkey || '.xml') AS BIGINT) AS position FROM part""")
def export_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of a corpus report, written in many files, read back as data."""
    folder = shared_folder(spark, "corpus")
    sent = workloads.faulty_messages(spark, sf_dir).selectExpr("concat(p_partkey, '.xml') AS file_name", "content")
    writers.write_corpus(batch.corpus_rows(convert(sent), "file_name"), folder)
    rows = spark.read.schema("sample_file string, position bigint").json(commits.current(spark, folder)["samples"])
    return rows.select(F.col("sample_file").alias("file"), "position")


@workload("""SELECT archive, CAST(entry_no AS INTEGER) AS entry_no, CASE WHEN r = 1 AND NOT (k = 2 AND coalesce(first_of_x_2 > second_of_x, false)) THEN base
      WHEN k = 0 THEN base || '_' || r WHEN k = 1 THEN base || '_' || (r + CASE WHEN first_of_x_2 < second_of_x THEN 1 ELSE 0 END)
      ELSE base || '_' || (r + CASE WHEN first_of_x_2 > second_of_x THEN 1 ELSE 0 END) END AS output_name
    FROM (SELECT *, row_number() OVER (PARTITION BY archive, base ORDER BY entry_no) AS r,
        min(CASE WHEN k = 2 THEN entry_no END) OVER (PARTITION BY archive) AS first_of_x_2,
        min(CASE WHEN k = 1 AND n = 2 THEN entry_no END) OVER (PARTITION BY archive) AS second_of_x
      FROM (SELECT *, row_number() OVER (PARTITION BY archive, base ORDER BY entry_no) AS n FROM (
        SELECT p_brand AS archive, p_partkey AS entry_no, CASE p_size % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS k,
          CASE p_size % 5 WHEN 0 THEN 'x' WHEN 1 THEN 'x_2' ELSE p_type END AS base FROM part)))""")
def archive_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entry names where one base looks like another's second copy."""
    rows = table(spark, sf_dir, "part").selectExpr(
        "p_brand AS archive", "CAST(p_partkey AS int) AS entry_no",
        "CASE p_size % 5 WHEN 0 THEN 'x' WHEN 1 THEN 'x_2' ELSE p_type END AS base_name", "'success' AS status",
    )
    return batch.output_names(rows).select("archive", "entry_no", "output_name")


# --- Manifests -----------------------------------------------------------------------

_GOOD = PASSPORT_SOURCE_TYPES[0], PASSPORT_SECTORS[0]


@workload(f"""WITH e AS (SELECT s_nationkey AS manifest, s_suppkey AS k,
      CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS INT) AS entry_no FROM supplier)
    SELECT manifest, entry_no, '[sources.' || entry_no || '] ''title'' is a required property' AS message FROM e WHERE k % 3 = 0
    UNION ALL SELECT manifest, entry_no, '[sources.' || entry_no || '.title] is not of type string' FROM e WHERE k % 3 = 1 AND k % 5 = 0
    UNION ALL SELECT manifest, entry_no, '[sources.' || entry_no || '.source_id] does not match ''^[a-z0-9_]+$''' FROM e WHERE k % 4 = 0
    UNION ALL SELECT manifest, entry_no, '[sources.' || entry_no || '.sector] is not one of {str(list(PASSPORT_SECTORS)).replace("'", "''")}'
      FROM e WHERE k % 7 = 0
    UNION ALL SELECT manifest, entry_no, '[sources.' || entry_no || '] Additional properties are not allowed (''odd'')' FROM e WHERE k % 6 = 0
    UNION ALL SELECT DISTINCT manifest, NULL::INT, '[root] ''schema_version'' is a required property' FROM e WHERE manifest % 2 = 0
    UNION ALL SELECT DISTINCT manifest, NULL::INT, '[schema_version] is not of type string' FROM e WHERE manifest % 4 = 1""")
def manifest_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests of sources, one a nation, with every kind of broken rule, and where it is."""
    entry = json_object([
        ("source_id", "IF(s_suppkey % 4 = 0, '\"Not Ok\"', concat('\"s_', s_suppkey, '\"'))"),
        ("title", "CASE WHEN s_suppkey % 3 = 0 THEN NULL WHEN s_suppkey % 3 = 1 AND s_suppkey % 5 = 0 THEN '5' ELSE "
         + json_string("s_name") + " END"),
        ("source_url", "'\"https://x\"'"), ("source_type", q(f'"{_GOOD[0]}"')),
        ("sector", f"IF(s_suppkey % 7 = 0, '\"moon\"', {q(chr(34) + _GOOD[1] + chr(34))})"),
        ("local_path", "'\"a/b\"'"), ("odd", "IF(s_suppkey % 6 = 0, '1', NULL)"),
    ])
    entries = table(spark, sf_dir, "supplier").selectExpr("s_nationkey", "s_suppkey", f"{entry} AS entry")
    listed = entries.groupBy("s_nationkey").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", "entry"))).alias("l"))
    docs = listed.selectExpr(
        "s_nationkey AS manifest",
        "try_parse_json(concat('{', IF(s_nationkey % 2 = 0, '', IF(s_nationkey % 4 = 1, '\"schema_version\":1,', '\"schema_version\":\"1\",')), "
        "'\"sources\":[', array_join(transform(l, x -> x.entry), ','), ']}')) AS doc",
    )
    return structure.manifest_violations(docs, ["manifest"])


# --- Explorer ------------------------------------------------------------------------

_SEARCHES = ("_image field_1", "attr attr", "/x /x", "prop3 gs1", "7 attr", "field_2", "in field", " 5", "image  ")
_SQL_HAY = """SELECT 'gs1:prop' || n_nationkey AS term_id, lower(concat_ws(' ', 'gs1:prop' || n_nationkey, n_name,
      CASE n_nationkey % 4 WHEN 0 THEN 'Energy per serving' WHEN 1 THEN 'Price of an offer' ELSE '' END, '', 'xsd:string',
      coalesce(f, ''), coalesce(b, ''), coalesce(x, ''), coalesce(a, ''), coalesce(j, ''))) AS hay
    FROM nation LEFT JOIN (SELECT c_nationkey, string_agg('field_' || c_nationkey || CASE WHEN c_custkey % 3 = 0 THEN '_image' ELSE '' END, ' ' ORDER BY c_custkey) AS f,
      string_agg(CASE WHEN c_custkey % 6 = 0 THEN '' ELSE c_custkey || '' END, ' ' ORDER BY c_custkey) AS b, string_agg('/x', ' ') AS x,
      string_agg(CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'attr' END, ' ' ORDER BY c_custkey) AS a,
      string_agg('gs1:prop' || c_nationkey, ' ') AS j
      FROM customer WHERE c_custkey % 8 <> 0 GROUP BY c_nationkey) ON c_nationkey = n_nationkey"""


@workload("SELECT s AS search, term_id FROM (" + _SQL_HAY + "), (SELECT unnest(["
          + ", ".join(f"'{s.strip()}'" for s in _SEARCHES) + "]) AS s) WHERE contains(hay, s)")
def explorer_seams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches that are found only across evidence rows and columns, over hot terms."""
    evidence = explorer.evidence_by_term(workloads.customer_catalog(spark, sf_dir))
    found = explorer.search_properties(workloads.nation_properties(spark, sf_dir), evidence, list(_SEARCHES))
    return found.select("search", "term_id")

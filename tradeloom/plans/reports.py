"""More queries over the benchmark tables: whole reports, documents and summaries.

They register beside those of ``workloads``, whose tables and messages they share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tradeloom.fixed import (
    CANDIDATE_VERSION, COVERAGE_STATUSES, DESCRIPTIONS, PASSPORT_ID_PREFIX, SCHEMA_CONTEXT_JSON, TOPIC_SUMMARY_ORDER,
    VOCABULARY_CONTEXT,
)
from tradeloom.functions import q
from tradeloom.operators import authoring, batch, catalog, explorer, passport, snapshots
from tradeloom.plans import workloads as base
from tradeloom.plans.convert import convert
from tradeloom.plans.messages import deal, element, escape, gtin14, join, message
from tradeloom.plans.workloads import ORACLES, WORKLOADS, table, workload
from tradeloom.sources.profile import built_in_profile

__all__ = ["ORACLES", "WORKLOADS"]


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# --- Conversion ------------------------------------------------------------------


def file_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with two brand names, an image, a document of two kinds and a certificate."""

    def file(*parts: str) -> str:
        return element("referencedFileInformation", join(*parts))

    item = message(
        element("gtin", gtin14("p_partkey")),
        element("brandName", escape("p_brand")), element("brandName", "'second'"),
        file(element("referencedFileTypeCode", "'PRODUCT_IMAGE'"),
             element("uniformResourceIdentifier", "concat('https://img/', p_partkey)")),
        file(element("fileName", escape("p_name")), element("fileFormatName", "'pdf'"),
             element("referencedFileTypeCode", "IF(p_size % 2 = 0, 'DPP_DOCUMENT', 'OTHER')"),
             element("uniformResourceIdentifier",
                     "IF(p_size % 5 = 0, 'no address', concat('https://doc/', p_partkey))")),
        element("certificationInformation", join(
            element("certificationStandard", "'ISO'"),
            element("certification", join(
                element("certificationValue", "IF(p_size % 7 = 0, ' ', p_type)"),
                element("certificationEffectiveStartDateTime", "'2024-01-02T03:04:05Z'"))))),
    )
    return deal(table(spark, sf_dir, "part")).selectExpr("p_partkey", f"{item} AS content")


_SQL_CERTIFICATE = """',"gs1:certification":[{"@type":"gs1:CertificationDetails","gs1:certificationStandard":"ISO",'
    || CASE WHEN p_size % 7 = 0 THEN '' ELSE '"gs1:certificationValue":"' || p_type || '",' END
    || '"gs1:certificationStartDate":"2024-01-02"}]'"""


@workload(f"""SELECT p_partkey, '{{"@context":["{VOCABULARY_CONTEXT}",{SCHEMA_CONTEXT_JSON}],"@type":"gs1:Product",'
    || '"@id":"https://id.gs1.org/01/' || g || '","gs1:gtin":"' || g || '","gs1:brandName":"' || p_brand
    || '","gs1:productImage":["https://img/' || p_partkey || '"]' || {_SQL_CERTIFICATE}
    || CASE WHEN p_size % 2 = 0 THEN ',"gs1:referencedDocument":[{{"@type":"schema:DigitalDocument",'
      || '"schema:name":"' || p_name || '","schema:encodingFormat":"PDF","schema:additionalType":"DPP_DOCUMENT"'
      || CASE WHEN p_size % 5 = 0 THEN '' ELSE ',"schema:url":"https://doc/' || p_partkey || '"' END || '}}]' ELSE '' END || '}}' AS jsonld
    FROM (SELECT *, {base._SQL_GTIN} AS g FROM part)""")
def xml_object_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects, images and first values as JSON-LD; a value that fails leaves a gap in its object."""
    return convert(file_messages(spark, sf_dir), leftovers=False).select("p_partkey", "jsonld")


_PROFILE = built_in_profile()
_REPORTED = [
    (r.id, DESCRIPTIONS[r.id], r.xpath, r.canonical_field, r.jsonld_property, r.required) for r in _PROFILE.fields
] + [(r.id, DESCRIPTIONS[r.id], r.parent_xpath, r.canonical_field, r.jsonld_property, True) for r in _PROFILE.objects]
_LISTS = ("product_name", "product_description", "product_image_url", "ingredient_statement")
# Values of a full message by rule; all other rules find nothing.
_SQL_VALUES = {
    "gtin": "'\"' || g || '\"'",
    "product_name": "'[{\"value\":\"' || p_name || '\",\"language\":\"en\"},{\"value\":\"' || upper(p_name)"
                    " || '\",\"language\":\"en\"}]'",
    "product_description": "'[{\"value\":\"' || p_type || '\",\"language\":\"nl\"}]'",
    "brand_name": "'\"' || p_brand || '\"'",
    "net_content_value": "regexp_replace(CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR), '\\.?0+$', '')",
    "net_content_unit": "'\"GRM\"'",
}


def _reported_row(number: int, row: tuple) -> str:
    name, description, xpath, canonical, target, required = row
    found = name in _SQL_VALUES
    value = _SQL_VALUES.get(name, "'[]'" if name in _LISTS or number >= len(_PROFILE.fields) else "NULL")
    message_text = "Value mapped successfully." if found else (
        "Optional object mapping was not found." if number >= len(_PROFILE.fields) else "Optional value was not found.")
    return (
        f"SELECT p_partkey, {number} AS rule_no, {_sql(name)} AS id, {_sql(description)} AS description, "
        f"{_sql(xpath)} AS xpath, {_sql(canonical)} AS canonical_field, {_sql(target)} AS jsonld_property, "
        f"{str(required).lower()} AS required, {str(found).lower()} AS found, {value} AS value, "
        f"{_sql('mapped' if found else 'missing_optional')} AS status, {_sql(message_text)} AS message FROM p"
    )


@workload(f"WITH p AS (SELECT *, {base._SQL_GTIN} AS g FROM part) "
          + " UNION ALL ".join(_reported_row(k, row) for k, row in enumerate(_REPORTED)))
def xml_report_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column of the mapping report of full messages."""
    converted = convert(base.part_messages(spark, sf_dir), leftovers=False)
    return batch.report_rows(converted, ["p_partkey"])


@workload("""SELECT rule, status, message, CAST(count(*) AS BIGINT) AS documents FROM (
    SELECT 'certifications' AS rule, CASE WHEN p_size % 7 = 0 THEN 'validation_error' ELSE 'mapped' END AS status,
      CASE WHEN p_size % 7 = 0 THEN '' ELSE 'Mapped 1 object(s).' END AS message FROM part
    UNION ALL SELECT 'referenced_documents', CASE WHEN p_size % 2 = 1 THEN 'missing_optional'
        WHEN p_size % 5 = 0 THEN 'validation_error' ELSE 'mapped' END,
      CASE WHEN p_size % 2 = 1 THEN 'Optional object mapping was not found.' WHEN p_size % 5 = 0 THEN ''
        ELSE 'Mapped 1 object(s).' END FROM part) GROUP BY ALL""")
def xml_object_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of object rules: mapped, missing, and with values that fail."""
    rows = batch.report_rows(convert(file_messages(spark, sf_dir), leftovers=False), ["p_partkey"])
    # The text of a failed rule lists its parts' messages, which xml_mapping_report compares.
    return rows.filter("id IN ('certifications', 'referenced_documents')").groupBy(
        F.col("id").alias("rule"), "status",
        F.expr("IF(status IN ('mapped', 'missing_optional'), message, '')").alias("message"),
    ).agg(F.count("*").alias("documents"))


@workload("""SELECT CAST(count(*) AS BIGINT) AS sample_count, CAST(count(*) FILTER (ok) AS BIGINT) AS successful_count,
    CAST(count(*) FILTER (NOT ok) AS BIGINT) AS failed_count, bool_and(ok) AS successful
    FROM (SELECT p_partkey % 50 <> 3 AND p_partkey % 11 <> 0 AND p_partkey % 7 <> 0 AND p_size % 5 <> 0 AS ok FROM part)""")
def xml_corpus_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = base.faulty_messages(spark, sf_dir).selectExpr("concat(p_partkey, '.xml') AS file_name", "content")
    return batch.corpus_totals(batch.corpus_rows(convert(sent), "file_name"))


@workload("""SELECT archive, CAST(entry_no AS INTEGER) AS entry_no, CASE WHEN n = 1 THEN base ELSE base || '_' || n END AS output_name
    FROM (SELECT p_brand AS archive, p_partkey AS entry_no, p_type AS base,
      row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS n FROM part)""")
def archive_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the entries of one archive per brand, however many repeat a base name."""
    rows = table(spark, sf_dir, "part").selectExpr(
        "p_brand AS archive", "CAST(p_partkey AS int) AS entry_no", "p_type AS base_name", "'success' AS status"
    )
    return batch.output_names(rows).select("archive", "entry_no", "output_name")


@workload("""SELECT p_partkey, 'a|' || p_name || '|' || p_brand || '|' || p_type || '|z' AS found,
    'a; ' || p_name || '; ' || p_brand || '; ' || p_type || '; z' AS shown FROM part""")
def nested_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists four deep, mixed with list objects, ids and literals."""
    from tradeloom.functions.jsontext import json_object, json_string
    from tradeloom.functions.linked import text, values

    inner = f"concat('[[', {json_string('p_name')}, '],[[', {json_string('p_brand')}, ']]]')"
    node = json_object([("@id", json_string("p_type"))])
    deep = f"""concat('["a",[[', {inner}, ']],[[', {node}, ']],[[["z"]]]]')"""
    rows = deal(table(spark, sf_dir, "part")).selectExpr("p_partkey", f"parse_json({deep}) AS v")
    return rows.selectExpr("p_partkey", f"array_join({values('v')}, '|') AS found", f"{text('v')} AS shown")


@workload("""SELECT p_partkey, CASE p_size % 4
    WHEN 0 THEN CAST(12345678901234567890 + p_partkey AS VARCHAR) || repeat('0', 10)
    WHEN 1 THEN CAST(12345678901234567890 + p_partkey AS VARCHAR) || '12345'
    WHEN 2 THEN CAST(p_size AS VARCHAR) || '.' || CAST(p_partkey * 10 + 1 AS VARCHAR) ELSE NULL END AS spelled FROM part""")
def long_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integers of 25 and more digits, exponents, fractions with closing zeros, and no numbers."""
    from tradeloom.functions.numbers import number_text, to_decimal

    big = "CAST(12345678901234567890BD + p_partkey AS string)"
    written = (
        f"CASE p_size % 4 WHEN 0 THEN concat({big}, 'e+10') WHEN 1 THEN concat(' ', {big}, '12345.000') "
        "WHEN 2 THEN concat(p_size, '.', p_partkey * 10 + 1, '00') ELSE concat(p_size, ',5') END"
    )
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{written} AS w")
    return rows.selectExpr("p_partkey", f"{number_text(to_decimal('w'))} AS spelled")


# --- Catalog and explorer --------------------------------------------------------


@workload(f"""WITH f AS (SELECT severity, CAST(findings AS BIGINT) AS n FROM ({{rules}}))
    SELECT CAST(coalesce(sum(n) FILTER (severity = 'error'), 0) AS BIGINT) AS errors,
      CAST(coalesce(sum(n) FILTER (severity = 'warning'), 0) AS BIGINT) AS warnings, CAST(0 AS BIGINT) AS info,
      false AS valid, true AS strict FROM f""".replace("{rules}", """
        SELECT 'warning' AS severity, count(*) AS findings FROM r WHERE s = 'odd_status'
        UNION ALL SELECT 'warning', count(*) FROM r WHERE c = 0
        UNION ALL SELECT 'error', count(*) FROM r WHERE s IN ('mapped_official_bms_xpath', 'candidate', 'mapped') AND c_custkey % 5 = 0
        UNION ALL SELECT 'warning', count(*) FROM r WHERE s IN ('mapped_official_bms_xpath', 'candidate', 'mapped')
          AND c_custkey % 8 = 0 AND c_custkey % 9 <> 0
        UNION ALL SELECT 'warning', count(*) FROM r WHERE s = 'mapped_official_bms_xpath' AND c IN (2, 3) AND c_custkey % 6 = 0
        UNION ALL SELECT 'warning', count(*) FROM r WHERE s = 'needs_webvoc_review' OR c_custkey % 10 = 0""")
    .replace("WITH f AS", f"WITH r AS ({base._SQL_CATALOG}), f AS"))
def catalog_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings about the whole catalog, counted by severity, and the strict verdict."""
    rows = base.customer_catalog(spark, sf_dir)
    rows = rows.withColumns({c: F.lit("") for c in catalog.missing_columns(rows)})
    return catalog.findings_summary(catalog.catalog_findings(rows), strict=True)


def explored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explorer.explore(
        base.nation_properties(spark, sf_dir),
        base.customer_catalog(spark, sf_dir).withColumn("scope_group", F.lit("brand")),
        base.nation_backlog(spark, sf_dir),
    )


def _listed(values) -> str:
    return "[" + ", ".join(_sql(v) for v in values) + "]"


@workload(f"""WITH x AS ({base._SQL_EXPLORED}),
    s AS (SELECT unnest({_listed(COVERAGE_STATUSES)}) AS name), t AS (SELECT unnest({_listed(TOPIC_SUMMARY_ORDER)}) AS name)
    SELECT 'coverage' AS kind, name, (SELECT count(*) FROM x WHERE coverage_status = name) AS count FROM s
    UNION ALL SELECT 'topic', name, (SELECT count(*) FROM x WHERE topic = name) FROM t""")
def explorer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties per coverage status and per topic, absent ones zero."""
    coverage, topics = explorer.explorer_counts(explored(spark, sf_dir))
    return coverage.selectExpr("'coverage' AS kind", "coverage_status AS name", "count").unionByName(
        topics.selectExpr("'topic' AS kind", "`group` AS name", "count")
    )


@workload(f"""SELECT x.term_id AS property, topic, n_name AS label, 'xsd:string' AS ranges, coverage_status AS coverage,
    evidence_count, n_nationkey % 7 = 0 AS is_link FROM ({base._SQL_EXPLORED}) x
    JOIN nation ON x.term_id = 'gs1:prop' || n_nationkey""")
def explorer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat rows as shown and exported."""
    return explorer.display_rows(explored(spark, sf_dir)).selectExpr(
        "`Property` AS property", "`Group` AS topic", "`Label` AS label", "`Range` AS ranges",
        "`Coverage` AS coverage", "`Evidence count` AS evidence_count", "`Link type` AS is_link",
    )


@workload("""SELECT source, CAST(count(*) FILTER (side = 1) AS BIGINT) AS term_count_local,
    CAST(count(*) FILTER (side = 2) AS BIGINT) AS term_count_remote FROM (
      SELECT p_type AS source, 1 AS side FROM part WHERE p_size % 5 <> 0
      UNION ALL SELECT p_type, 2 FROM part WHERE p_size % 3 <> 0) GROUP BY source""")
def snapshot_term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumn("source", F.col("p_type"))
    return snapshots.term_counts(part.filter("p_size % 5 <> 0"), part.filter("p_size % 3 <> 0"))


@workload(base._SQL_EVIDENCED.replace("{limit}", "3").replace(
    "SELECT term AS property, p_partkey AS attribute, rank,",
    f"SELECT 'cand_' || replace(term, ':', '_') || '__' || p_partkey AS id, {_sql(CANDIDATE_VERSION)} AS version, rank,"
).replace("{", "{").split(" round(score, 4)")[0].rstrip(",") + " FROM l WHERE rank <= 3")
def candidate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.evidenced_candidates(spark, sf_dir, 3).selectExpr(
        "candidate_id AS id", "created_by_version AS version", "CAST(rank AS bigint) AS rank"
    )


# --- Passports -------------------------------------------------------------------

_OPTIONS = passport.PassportOptions()


def _constant(built: dict[str, str]) -> str:
    return ",".join(f'"{k}":"{v}"' for k, v in built.items())


_SQL_ENVELOPE = (
    "'{" + _constant({"@context": VOCABULARY_CONTEXT, "@type": "Product"}).replace("'", "''") + ",'"
    " || CASE WHEN p_size % 2 = 0 OR p_size % 3 = 0 THEN '\"@id\":\"https://id.gs1.org/01/' || g || '\",' ELSE '' END"
    f" || '\"productPassportId\":\"{PASSPORT_ID_PREFIX}' ||"
    " CASE WHEN p_size % 2 = 0 OR p_size % 3 = 0 THEN g ELSE 'unidentified' END || '\",' || '"
    + _constant({
        "passportType": _OPTIONS.passport_type, "passportVersion": _OPTIONS.passport_version, "status": _OPTIONS.status,
        "prototypeNotice": _OPTIONS.notice, "defaultLanguage": _OPTIONS.default_language,
    }).replace("'", "''")
    + ",\"source\":{\"sourceType\":\"gs1-web-vocabulary-jsonld\",\"sourceFormat\":\"json-ld\",\"sourceGtin\":'"
    " || CASE WHEN p_size % 2 = 0 OR p_size % 3 = 0 THEN '\"' || g || '\"' ELSE 'null' END"
    " || ',\"sourceProductName\":\"' || p_name || '\"}'"
)


@workload(f"""SELECT p_partkey, {_SQL_ENVELOPE} AS envelope
    FROM (SELECT *, {base._SQL_GTIN} AS g FROM part) WHERE p_partkey % 100 <> 1""")
def passport_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelope text up to the validation part, whose texts are constant; broken input has none."""
    built = passport.build_passports(base.part_products(spark, sf_dir))
    return built.filter("passport IS NOT NULL").selectExpr(
        "p_partkey", f"substring_index(passport, {q(',' + chr(34) + 'validation' + chr(34))}, 1) AS envelope"
    )


@workload(f"""SELECT CASE WHEN NOT broken THEN {_sql(_OPTIONS.status)} END AS status,
    CASE WHEN broken THEN 'schema_error' ELSE 'valid' END AS verdict,
    CAST(count(*) AS BIGINT) AS documents, CAST(count(*) FILTER (NOT broken AND (p_size % 2 = 0 OR p_size % 3 = 0)) AS BIGINT) AS with_gtin
    FROM (SELECT *, p_partkey % 100 = 1 AS broken FROM part) GROUP BY ALL""")
def passport_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = passport.validate_passports(passport.build_passports(base.part_products(spark, sf_dir)))
    return passport.passport_summary(checked).groupBy(
        "status", F.col("structuralValidationStatus").alias("verdict")
    ).agg(F.count("*").alias("documents"), F.count("sourceGtin").alias("with_gtin"))


# --- Revalidation and nested authoring -------------------------------------------


@workload("""SELECT CAST(count(*) AS BIGINT) AS catalog_rows,
    CAST(count(*) FILTER (own AND c_nationkey >= 12 AND c_nationkey % 5 <> 0) AS BIGINT) AS rows_with_missing_terms,
    CAST(count(*) FILTER (own AND c_nationkey % 5 = 0) AS BIGINT) AS rows_with_available_linktypes, true AS valid
    FROM (SELECT *, c_custkey % 8 <> 0 AS own FROM customer)""")
def revalidation_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    terms = nation.filter("n_nationkey < 12").selectExpr(
        "concat('gs1:prop', n_nationkey) AS term_id", "n_name AS label", "'' AS range_text"
    )
    links = nation.filter("n_nationkey % 5 = 0").selectExpr(
        "concat('prop', n_nationkey) AS name", "'stable' AS status"
    )
    return catalog.revalidation_summary(catalog.revalidate(base.customer_catalog(spark, sf_dir), terms, links))


@workload(f"""SELECT user_id AS product_id, '{{"@context":["{VOCABULARY_CONTEXT}",{SCHEMA_CONTEXT_JSON}],"@type":"Product"'
    || CASE WHEN count(*) FILTER (event_type IN ('click', 'purchase', 'view')) > 0 THEN ',"act":{{"@type":"gs1:Act",'
      || string_agg(CASE event_type WHEN 'view' THEN '"view":[{{"@language":"nl","@value":"' || v || '"}}]'
        WHEN 'click' THEN '"click":"' || v || '"' WHEN 'purchase' THEN '"purchase":' || v END, ','
        ORDER BY CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END)
        FILTER (event_type IN ('click', 'purchase', 'view')) || '}}' ELSE '' END || '}}' AS jsonld
    FROM ({base._SQL_LAST}) GROUP BY user_id""")
def nested_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as parts of one nested object; a product without a known part has no object."""
    values = base.event_values(spark, sf_dir).withColumn(
        "property_id", F.expr("concat('gs1:act#', property_id)")
    ).withColumn("unit_code", F.lit(""))
    parts = [("gs1:view", "language_text"), ("gs1:click", "text"), ("gs1:purchase", "number")]
    metadata = spark.createDataFrame(
        [("gs1:act", ["gs1:Act"], "object", True, "gs1:Act", parts)],
        "property_id string, range array<string>, override string, supported boolean, "
        "object_type string, object_fields array<struct<property_id:string,input_type:string>>",
    )
    return authoring.author_jsonld(values, metadata)

"""Queries over the benchmark tables, one or more per operator family.

Each workload pairs a Spark plan, made of library operators, with the SQL that a
second engine answers on the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tradeloom.fixed import AUTHORING_NOTICE, PASSPORT_ID_PREFIX, SCHEMA_CONTEXT_JSON, TOPIC_GROUPS, VOCABULARY_CONTEXT
from tradeloom.functions import q
from tradeloom.functions.checks import is_gtin, is_http_url
from tradeloom.functions.dates import iso_date
from tradeloom.functions.jsontext import json_array, json_object, json_string
from tradeloom.functions.linked import language_entries, member
from tradeloom.functions.numbers import number_text
from tradeloom.functions.text import (
    ascii_fold, formula_safe, has_value, name_tokens, safe_archive_path, safe_filename,
    squeeze, strip, word_tokens, xpath_terminal,
)
from tradeloom.functions.transforms import apply_transform
from tradeloom.operators import authoring, batch, candidates as cand, catalog, explorer
from tradeloom.operators import inventory as inv, passport, profiles, ranking, snapshots
from tradeloom.operators import structure
from tradeloom.operators.leftovers import leftover_profile
from tradeloom.plans.convert import convert
from tradeloom.plans.messages import deal, element, escape, gtin14, join, message, spread
from tradeloom.sources import documents as docs_in, tabular, vocabulary
from tradeloom.sources.profile import Profile, Rule
from tradeloom.sources.xmlnodes import explode_nodes, shred

Query = Callable[[SparkSession, str], DataFrame]
WORKLOADS: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def workload(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with its SQL twin."""

    def register(fn: Query) -> Query:
        WORKLOADS[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- Conversion ------------------------------------------------------------------

_SQL_GTIN = """lpad(CAST(p_partkey AS VARCHAR), 13, '0') || CAST((10 - list_sum(
    list_transform(range(1, 14), lambda i: CAST(substr(lpad(CAST(p_partkey AS VARCHAR), 13, '0'),
    CAST(i AS INTEGER), 1) AS INTEGER) * CASE WHEN i % 2 = 1 THEN 3 ELSE 1 END)) % 10) % 10 AS VARCHAR)"""


def part_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full message per part."""
    part = deal(table(spark, sf_dir, "part"))
    trade_item = message(
        element("gtin", gtin14("p_partkey")),
        element("brandNameInformation", element("brandName", f"concat(' ', {escape('p_brand')})")),
        element(
            "tradeItemDescriptionInformation",
            join(
                element("tradeItemDescription", f"concat('  ', {escape('p_name')}, ' ')",
                        languageCode="'en'"),
                element("tradeItemDescription", f"upper({escape('p_name')})", languageCode="''"),
                element("descriptionShort", escape("p_type"), languageCode="'nl'"),
            ),
        ),
        element(
            "tradeItemMeasurements",
            element("netContent", join(
                element("measurementValue", "CAST(p_retailprice AS decimal(12,2))"),
                element("measurementUnitCode", "'grm'"))),
        ),
    )
    return part.selectExpr("p_partkey", f"{trade_item} AS content")


@workload(f"""SELECT p_partkey, {_SQL_GTIN} AS gtin, p_name AS name, 'en' AS language,
    upper(p_name) AS second_name, p_brand AS brand, p_type AS description, 'GRM' AS unit,
    CAST(round(p_retailprice * 100) AS BIGINT) AS cents FROM part""")
def xml_convert_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convert(part_messages(spark, sf_dir), leftovers=False).selectExpr(
        "p_partkey", "product.gtin AS gtin", "product.product_name[0].value AS name",
        "product.product_name[0].language AS language",
        "product.product_name[1].value AS second_name", "product.brand_name AS brand",
        "product.product_description[0].value AS description",
        "product.net_content_unit AS unit",
        "CAST(CAST(product.net_content_value AS decimal(38,18)) * 100 AS bigint) AS cents",
    )


_SQL_PRICE = ("CASE WHEN p_retailprice = floor(p_retailprice) THEN "
              "CAST(CAST(p_retailprice AS BIGINT) AS VARCHAR) ELSE CAST(p_retailprice AS VARCHAR) END")


@workload(f"""SELECT p_partkey, '{{"@context":["{VOCABULARY_CONTEXT}",{SCHEMA_CONTEXT_JSON}],'
    || '"@type":"gs1:Product","@id":"https://id.gs1.org/01/' || g || '","gs1:gtin":"' || g
    || '","gs1:productName":[{{"@value":"' || p_name || '","@language":"en"}},{{"@value":"'
    || upper(p_name) || '","@language":"en"}}],"gs1:productDescription":[{{"@value":"' || p_type
    || '","@language":"nl"}}],"gs1:brandName":"' || p_brand || '","gs1:netContent":{{"value":'
    || {_SQL_PRICE} || ',"unitCode":"GRM"}}}}' AS jsonld
    FROM (SELECT *, {_SQL_GTIN} AS g FROM part)""")
def xml_jsonld_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convert(part_messages(spark, sf_dir), leftovers=False).select("p_partkey", "jsonld")


_ROOT = "/catalogueItemNotificationMessage"
_ITEM = f"{_ROOT}/transaction/catalogueItem/tradeItem"
# Path, depth and characters of text of every element of a part's message.
_SQL_PRICE_CHARS = "length(CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR))"
_SQL_NAME_CHARS = "(3 + 2 * length(p_name) + length(p_type))"
_SQL_ALL_CHARS = f"(14 + 1 + length(p_brand) + {_SQL_NAME_CHARS} + {_SQL_PRICE_CHARS} + 3)"
_SQL_NODES = ", ".join(
    f"{{'path': '{path}', 'chars': {chars}}}" for path, chars in [
        (_ROOT, _SQL_ALL_CHARS), (f"{_ROOT}/transaction", _SQL_ALL_CHARS),
        (f"{_ROOT}/transaction/catalogueItem", _SQL_ALL_CHARS), (_ITEM, _SQL_ALL_CHARS),
        (f"{_ITEM}/gtin", "14"), (f"{_ITEM}/brandNameInformation", "1 + length(p_brand)"),
        (f"{_ITEM}/brandNameInformation/brandName", "1 + length(p_brand)"),
        (f"{_ITEM}/tradeItemDescriptionInformation", _SQL_NAME_CHARS),
        (f"{_ITEM}/tradeItemDescriptionInformation/tradeItemDescription", "3 + length(p_name)"),
        (f"{_ITEM}/tradeItemDescriptionInformation/tradeItemDescription", "length(p_name)"),
        (f"{_ITEM}/tradeItemDescriptionInformation/descriptionShort", "length(p_type)"),
        (f"{_ITEM}/tradeItemMeasurements", f"{_SQL_PRICE_CHARS} + 3"),
        (f"{_ITEM}/tradeItemMeasurements/netContent", f"{_SQL_PRICE_CHARS} + 3"),
        (f"{_ITEM}/tradeItemMeasurements/netContent/measurementValue", _SQL_PRICE_CHARS),
        (f"{_ITEM}/tradeItemMeasurements/netContent/measurementUnitCode", "3"),
    ]
)


@workload(f"""SELECT list_last(string_split(path, '/')) AS local_name,
    CAST(len(string_split(path, '/')) - 2 AS INTEGER) AS depth, path,
    CAST(count(*) AS BIGINT) AS nodes, CAST(sum(chars) AS BIGINT) AS chars
    FROM (SELECT unnest([{_SQL_NODES}], recursive := true) FROM part) GROUP BY path""")
def xml_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every element of every message."""
    return (
        explode_nodes(shred(part_messages(spark, sf_dir)))
        .groupBy("local_name", "depth", "path")
        .agg(F.count("*").alias("nodes"), F.sum(F.length("text_all").cast("long")).alias("chars"))
        .withColumn("depth", F.col("depth").cast("int"))
    )


@workload("""SELECT doc_id, lang, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS digest,
    CAST(length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS BIGINT) AS chars FROM documents""")
def xml_document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole document texts through a message and back, normalised.

    A blank text gives the product no name: normalised it is empty. What a document lacks
    (its text, its language) stays out of the message and is null in the result.
    """
    texts = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    name = "tradeItemDescription"
    item = message(f"coalesce({element(name, escape('text'), languageCode='lang')}, {element(name, escape('text'))})")
    sent = texts.selectExpr("doc_id", "lang AS sent_lang", "text IS NOT NULL AS has_text", f"{item} AS content")
    read = convert(sent, leftovers=False).selectExpr(
        "doc_id", "sent_lang", "has_text AND error_type IS NULL AS has_value",
        "sent_lang IS NOT NULL AND error_type IS NULL AS has_lang", "get(product.product_name, 0) AS name",
    )
    value = "IF(has_value, coalesce(name.value, ''), NULL)"
    return read.selectExpr(
        "doc_id", "IF(has_lang, coalesce(name.language, sent_lang), NULL) AS lang",
        f"sha2({value}, 256) AS digest", f"CAST(length({value}) AS bigint) AS chars",
    )


def faulty_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part messages with missing, wrong and half-filled fields, and broken ones."""
    part = deal(table(spark, sf_dir, "part"))
    wrong = f"IF(p_partkey % 7 = 0, concat('9', {gtin14('p_partkey')}), {gtin14('p_partkey')})"
    item = message(
        f"IF(p_partkey % 11 = 0, '', {element('gtin', wrong)})",
        f"IF(p_size % 5 = 0, '', {element('tradeItemDescription', 'p_name', languageCode=q('en'))})",
        element("brandName", "IF(p_size % 3 = 0, ' ', p_brand)"),
        element("netContent", join(
            element("measurementValue", "IF(p_size % 4 = 0, 'a lot', CAST(p_size AS string))"),
            f"IF(p_size % 6 = 1, '', {element('measurementUnitCode', q('kgm'))})")),
        element("marketingInformation", element(
            "uniformResourceIdentifier",
            "IF(p_size % 2 = 0, concat('https://example.com/', p_partkey), 'not a link')")),
    )
    broken = f"IF(p_partkey % 50 = 3, substring({item}, 1, 120), {item})"
    return part.selectExpr("p_partkey", "p_size", f"{broken} AS content")


_SQL_FAULTS = """SELECT *, p_partkey % 11 <> 0 AND p_partkey % 7 <> 0 AS has_gtin,
    p_partkey % 11 <> 0 AND p_partkey % 7 = 0 AS bad_gtin, p_size % 5 <> 0 AS has_name,
    p_size % 3 <> 0 AS has_brand, p_size % 4 <> 0 AS has_value, p_size % 6 <> 1 AS has_unit,
    p_size % 2 = 0 AS has_page FROM part WHERE p_partkey % 50 <> 3"""


@workload(f"""SELECT id, status, CAST(count(*) AS BIGINT) AS documents FROM (
    SELECT unnest([
      {{'id': 'gtin', 'status': CASE WHEN bad_gtin THEN 'validation_error' WHEN has_gtin
         THEN 'mapped' ELSE 'missing_required' END}},
      {{'id': 'product_name', 'status': CASE WHEN has_name THEN 'mapped' ELSE 'missing_required' END}},
      {{'id': 'brand_name', 'status': CASE WHEN has_brand THEN 'mapped' ELSE 'missing_optional' END}},
      {{'id': 'net_content_value', 'status': CASE WHEN has_value THEN 'mapped' ELSE 'transform_error' END}},
      {{'id': 'net_content_unit', 'status': CASE WHEN has_unit THEN 'mapped' ELSE 'missing_optional' END}},
      {{'id': 'product_page_url', 'status': CASE WHEN has_page THEN 'mapped' ELSE 'validation_error' END}},
      {{'id': 'allergens', 'status': 'missing_optional'}},
      {{'id': 'product_description', 'status': 'missing_optional'}},
      {{'id': 'gpc_category_code', 'status': 'missing_optional'}},
      {{'id': 'product_image_url', 'status': 'missing_optional'}},
      {{'id': 'ingredient_statement', 'status': 'missing_optional'}},
      {{'id': 'nutrients', 'status': 'missing_optional'}},
      {{'id': 'certifications', 'status': 'missing_optional'}},
      {{'id': 'referenced_documents', 'status': 'missing_optional'}}
    ], recursive := true) FROM ({_SQL_FAULTS})) GROUP BY ALL""")
def xml_mapping_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = batch.report_rows(convert(faulty_messages(spark, sf_dir), leftovers=False), ["p_partkey"])
    return rows.groupBy("id", "status").agg(F.count("*").alias("documents"))


@workload(f"""SELECT p_partkey, has_gtin AND has_name AS valid,
    CASE WHEN NOT (has_gtin AND has_name) THEN 'invalid' ELSE 'warnings' END AS status,
    concat_ws('|', CASE WHEN NOT has_gtin THEN
       'Required field ''gtin'' was not found. Cannot construct product @id.' END,
      CASE WHEN NOT has_name THEN 'Required field ''product_name'' was not found.' END) AS errors,
    concat_ws('|', 'Optional field ''product_description'' was not found.',
      CASE WHEN NOT has_brand THEN 'Optional field ''brand_name'' was not found.' END,
      'Optional field ''gpc_category_code'' was not found.',
      CASE WHEN NOT has_value THEN 'Optional field ''net_content_value'' was not found.' END,
      CASE WHEN NOT has_unit THEN 'Optional field ''net_content_unit'' was not found.' END,
      'Optional field ''product_image_url'' was not found.',
      CASE WHEN NOT has_page THEN 'Optional field ''product_page_url'' was not found.' END,
      'Optional field ''ingredient_statement'' was not found.',
      CASE WHEN has_value <> has_unit THEN
       'Net content is incomplete; both value and unit are required for JSON-LD.' END) AS warnings
    FROM ({_SQL_FAULTS})""")
def xml_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = convert(faulty_messages(spark, sf_dir), leftovers=False).filter("error_type IS NULL")
    from tradeloom.operators.validate import validation_status

    return rows.selectExpr(
        "p_partkey", "validation.valid AS valid", f"{validation_status('validation')} AS status",
        "array_join(validation.errors, '|') AS errors",
        "array_join(validation.warnings, '|') AS warnings",
    )


_SQL_TOTALS = f"""SELECT CAST(count(*) AS BIGINT) AS xml_files_found,
    CAST(count(*) FILTER (p_partkey % 50 <> 3) AS BIGINT) AS successful_conversions,
    CAST(count(*) FILTER (p_partkey % 50 = 3) AS BIGINT) AS failed_conversions,
    CAST(count(*) FILTER (p_partkey % 50 <> 3 AND (p_size % 4 = 0 OR p_size % 6 = 1)) AS BIGINT)
      AS total_unmapped_fields,
    CAST(sum(CASE WHEN p_partkey % 50 <> 3 THEN
      CAST(NOT (p_partkey % 11 <> 0 AND p_partkey % 7 <> 0) AS INT) + CAST(p_size % 5 = 0 AS INT)
      ELSE 0 END) AS BIGINT) AS validation_error_count,
    CAST(sum(CASE WHEN p_partkey % 50 <> 3 THEN 4 + CAST(p_size % 3 = 0 AS INT)
      + CAST(p_size % 4 = 0 AS INT) + CAST(p_size % 6 = 1 AS INT) + CAST(p_size % 2 = 1 AS INT)
      + CAST((p_size % 4 = 0) <> (p_size % 6 = 1) AS INT) ELSE 0 END) AS BIGINT)
      AS validation_warning_count FROM part"""


@workload(_SQL_TOTALS)
def xml_batch_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = faulty_messages(spark, sf_dir).selectExpr(
        "concat('in/part ', p_partkey, '.xml') AS entry", "content"
    )
    return batch.batch_totals(batch.file_results(convert(sent), "entry"))


@workload("""SELECT failure_stage, notes, CAST(count(*) AS BIGINT) AS files,
    CAST(sum(mapped) AS BIGINT) AS mapped_fields FROM (
      SELECT CASE WHEN p_partkey % 50 = 3 THEN 'xml_parsing' WHEN ok THEN '' ELSE 'validation' END
        AS failure_stage,
      CASE WHEN p_partkey % 50 = 3 THEN 'Failed during xml_parsing.'
        WHEN NOT ok THEN 'Conversion completed, but validation failed.'
        ELSE 'Converted successfully with ' || CAST(4 + CAST(p_size % 3 = 0 AS INT)
          + CAST(p_size % 4 = 0 AS INT) + CAST(p_size % 6 = 1 AS INT) + CAST(p_size % 2 = 1 AS INT)
          + CAST((p_size % 4 = 0) <> (p_size % 6 = 1) AS INT) AS VARCHAR)
          || ' validation warning(s).' END AS notes,
      CASE WHEN p_partkey % 50 = 3 THEN 0 ELSE
        CAST(p_partkey % 11 <> 0 AND p_partkey % 7 <> 0 AS INT) + CAST(p_size % 5 <> 0 AS INT)
        + CAST(p_size % 3 <> 0 AS INT) + CAST(p_size % 4 <> 0 AS INT)
        + CAST(p_size % 6 <> 1 AS INT) + CAST(p_size % 2 = 0 AS INT) END AS mapped
      FROM (SELECT *, p_partkey % 11 <> 0 AND p_partkey % 7 <> 0 AND p_size % 5 <> 0 AS ok
            FROM part)) GROUP BY ALL""")
def xml_corpus_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = faulty_messages(spark, sf_dir).selectExpr(
        "concat(p_partkey, '.xml') AS file_name", "content"
    )
    rows = batch.corpus_rows(convert(sent), "file_name")
    return rows.groupBy("failure_stage", "notes").agg(
        F.count("*").alias("files"), F.sum("mapped_field_count").alias("mapped_fields")
    )


@workload("""SELECT p_partkey, CAST(pos AS INTEGER) AS pos, code, value, unit, allergen, containment
    FROM (SELECT p_partkey, unnest([
      {'pos': 0, 'code': 'FAT', 'value': CAST(p_size AS VARCHAR), 'unit': 'GRM'},
      {'pos': 1, 'code': 'ENER-', 'value': CAST(p_size AS VARCHAR) || '.5', 'unit': 'KJO'}],
      recursive := true),
      upper(p_type) AS allergen,
      CASE WHEN p_size % 2 = 0 THEN 'CONTAINS' ELSE 'FREE_FROM' END AS containment FROM part)""")
def xml_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    def nutrient(code: str, amount: str, unit: str) -> str:
        return element("nutrientDetail", join(
            element("nutrientTypeCode", q(code)),
            element("quantityContained", join(
                element("measurementValue", amount), element("measurementUnitCode", q(unit))))))

    item = message(
        element("allergenRelatedInformation", element("allergen", join(
            element("allergenTypeCode", "lower(p_type)"),
            element("levelOfContainmentCode",
                    "IF(p_size % 2 = 0, 'contains', 'free_from')")))),
        element("nutrientHeader", join(
            element("preparationStateCode", "'prepared'"),
            nutrient("fat", "p_size", "grm"), nutrient("ENER-", "concat(p_size, '.50')", "kjo"))),
    )
    sent = deal(table(spark, sf_dir, "part")).selectExpr("p_partkey", f"{item} AS content")
    products = convert(sent, leftovers=False).select(
        "p_partkey", "product.allergens", F.posexplode("product.nutrients").alias("pos", "n")
    )
    return products.selectExpr(
        "p_partkey", "pos", "n.nutrient_type_code AS code",
        f"{number_text('n.quantity_contained.value')} AS value",
        "n.quantity_contained.unit_code AS unit", "allergens[0].allergen_type AS allergen",
        "allergens[0].level_of_containment AS containment",
    )


@workload("""WITH d AS (SELECT *, '/catalogueItemNotificationMessage/transaction/catalogueItem/tradeItem/' AS t
      FROM part),
    u AS (
      SELECT 'internalStatus' AS element, 'tradeItem' AS parent, t || 'internalStatus' AS path,
        '' AS context FROM d WHERE p_size % 3 = 0
      UNION ALL SELECT 'storageHint', 'tradeItem', t || 'storageHint', 'languageCode=nl' FROM d
        WHERE p_size % 3 = 1
      UNION ALL SELECT 'storageHint', 'tradeItem', t || 'storageHint', 'languageCode=nl' FROM d
        WHERE p_size % 3 = 1
      UNION ALL SELECT 'nutrientSource', 'nutrientDetail', t || 'nutrientHeader/nutrientDetail/nutrientSource',
        'nutrientTypeCode=' || p_type FROM d
      UNION ALL SELECT f, 'referencedFileInformation', t || 'referencedFileInformation/' || f,
        'fileName=' || p_brand || ',referencedFileTypeCode=SHEET'
        FROM d, (SELECT unnest(['fileName', 'referencedFileTypeCode']) AS f))
    SELECT element, parent, path, context, CAST(count(*) AS BIGINT) AS count FROM u GROUP BY ALL""")
def xml_leftovers(spark: SparkSession, sf_dir: str) -> DataFrame:
    hint = element("storageHint", "'keep dry'", languageCode=q("nl"))
    item = message(
        element("gtin", gtin14("p_partkey")),
        f"IF(p_size % 3 = 0, {element('internalStatus', q('x'))}, '')",
        f"IF(p_size % 3 = 1, concat({hint}, {hint}), '')",
        element("nutrientHeader", join(
            element("preparationStateCode", "'U'"),
            element("nutrientDetail", join(
                element("nutrientTypeCode", "p_type"), element("nutrientSource", "'calc'"))))),
        element("referencedFileInformation", join(
            element("fileName", "p_brand"), element("referencedFileTypeCode", "'SHEET'"))),
    )
    sent = deal(table(spark, sf_dir, "part")).selectExpr("p_partkey", f"{item} AS content")
    profile = leftover_profile(convert(sent))
    return profile.selectExpr(
        "element", "parent", "path",
        "array_join(transform(context, c -> concat(c.key, '=', c.value)), ',') AS context", "count",
    )


# --- Scalars ---------------------------------------------------------------------


@workload("""SELECT p_brand, CAST(count(*) FILTER (p_partkey % 7 <> 0) AS BIGINT) AS valid,
    CAST(count(*) FILTER (p_partkey % 7 = 0) AS BIGINT) AS invalid FROM part GROUP BY p_brand""")
def gtin_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 7th check digit is off by one."""
    good = gtin14("p_partkey")
    spoiled = f"concat(left({good}, 13), (CAST(right({good}, 1) AS int) + 1) % 10)"
    keys = table(spark, sf_dir, "part").selectExpr(
        "p_brand", f"IF(p_partkey % 7 = 0, {spoiled}, {good}) AS gtin"
    ).selectExpr("p_brand", f"{is_gtin('gtin')} AS ok")
    return keys.groupBy("p_brand").agg(
        F.count_if("ok").alias("valid"), F.count_if(~F.col("ok")).alias("invalid")
    )


@workload("""SELECT page_id, regexp_matches(u, '^https?://[^/?#]+') AS ok,
    CASE WHEN regexp_matches(u, '^https?://[^/?#]+') THEN '' ELSE '''' || u ||
      ''' is not a valid HTTP(S) URL' END AS complaint
    FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN 'ftp://' || url
      WHEN 2 THEN replace(url, 'http', 'HTTP') ELSE 'http:///' || url END AS u0,
      CASE page_id % 4 WHEN 2 THEN url ELSE u0 END AS u FROM pages)""")
def url_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = table(spark, sf_dir, "pages").selectExpr(
        "page_id", "CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN concat('ftp://', url) "
        "WHEN 2 THEN url ELSE concat('http:///', url) END AS u"
    )
    return urls.selectExpr(
        "page_id", f"{is_http_url('u')} AS ok",
        f"coalesce({apply_transform('u', 'validate_url')}.error, '') AS complaint",
    )


@workload("""SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 5 THEN NULL
    ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders""")
def date_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates in six spellings; the last one is not a date."""
    d = "date_format(o_orderdate, {})".format
    spelled = (
        f"CASE o_orderkey % 6 WHEN 0 THEN {d(q('yyyy-MM-dd'))} "
        f"WHEN 1 THEN concat({d(q('yyyy-MM-dd'))}, 'T10:30:00Z') "
        f"WHEN 2 THEN {d(q('yyyyMMdd'))} "
        f"WHEN 3 THEN concat({d(q('yyyy-MM-dd'))}, ' 23:59:59.5+02:00') "
        "WHEN 4 THEN concat(extract(YEAROFWEEK FROM o_orderdate), '-W', "
        "lpad(extract(WEEK FROM o_orderdate), 2, '0'), '-', extract(DAYOFWEEK_ISO FROM o_orderdate)) "
        f"ELSE {d(q('yyyy-13-dd'))} END"
    )
    orders = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{spelled} AS s")
    return orders.selectExpr("o_orderkey", f"{iso_date('s')} AS day")


@workload("""SELECT l_returnflag, CAST(count(DISTINCT t) AS BIGINT) AS spellings, min(t) AS first,
    max(t) AS last, CAST(sum(length(t)) AS BIGINT) AS chars FROM (
      SELECT l_returnflag, CASE WHEN l_extendedprice = floor(l_extendedprice)
        THEN CAST(CAST(l_extendedprice AS BIGINT) AS VARCHAR)
        ELSE CAST(l_extendedprice AS VARCHAR) END AS t FROM lineitem) GROUP BY l_returnflag""")
def number_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").selectExpr(
        "l_returnflag", f"{number_text('CAST(l_extendedprice AS decimal(38,18))')} AS t"
    )
    # Repeats collapse by hash first; extremes of text would sort every row.
    spelled = lines.groupBy("l_returnflag", "t").agg(F.count("*").alias("n"))
    return spelled.groupBy("l_returnflag").agg(
        F.count("*").alias("spellings"), F.min("t").alias("first"), F.max("t").alias("last"),
        F.sum(F.col("n") * F.length("t")).alias("chars"),
    )


@workload("""SELECT lang, CAST(sum(length(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS BIGINT) AS squeezed,
    CAST(sum(length(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))) AS BIGINT) AS stripped,
    CAST(count(*) FILTER (regexp_matches(text, '\\S')) AS BIGINT) AS filled FROM documents GROUP BY lang""")
def ws_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = spread(table(spark, sf_dir, "documents").select("lang", "text")).selectExpr(
        "lang", f"length({squeeze('text')}) AS a", f"length({strip('text')}) AS b",
        f"{has_value('text')} AS filled",
    )
    return texts.groupBy("lang").agg(
        F.sum("a").alias("squeezed"), F.sum("b").alias("stripped"),
        F.count_if("filled").alias("filled"),
    )


_SQL_STOP = """['a','an','the','of','in','for','to','and','or','is','are','be','with','that','this',
    'as','at','by','has','have','it','its','not','on','from','which','when','where','type','code',
    'value','number','name','data','item','product','gdsn','gs1','urn','gdd','bie','']"""


@workload(f"""SELECT conv_id, turn, array_to_string(list_sort(list_filter(list_distinct(string_split(trim(
      regexp_replace(lower(regexp_replace(strip_accents(text), '[^\\x00-\\x7F]', '', 'g')),
      '[^a-z0-9]+', ' ', 'g')), ' ')), lambda w: NOT list_contains({_SQL_STOP}, w))), ' ') AS tokens
    FROM conversations""")
def word_token_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", ascii_fold(F.col("text")).alias("folded")
    )
    return texts.selectExpr(
        "conv_id", "turn", f"array_join(array_sort({word_tokens('folded')}), ' ') AS tokens"
    )


@workload("""SELECT p_partkey, first || second AS camel,
    array_to_string(list_sort(list_distinct([lower(first), lower(second)])), ' ') AS tokens,
    first || second AS terminal FROM (
      SELECT p_partkey, split_part(p_name, ' ', 1) AS first,
        upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2) AS second
      FROM part)""")
def name_token_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    camel = ("concat(split_part(p_name, ' ', 1), "
             "initcap(split_part(p_name, ' ', 2)))")
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{camel} AS camel")
    return rows.selectExpr(
        "p_partkey", "camel", f"array_join(array_sort({name_tokens('camel')}), ' ') AS tokens",
        f"{xpath_terminal(f'concat({q('/x/y:')}, camel, {q('[@a=1]/')})')} AS terminal",
    )


@workload("""SELECT lang, CAST(count(*) FILTER (regexp_matches(text, '^[=+@-]')) AS BIGINT) AS quoted,
    CAST(sum(length(text)) + count(*) FILTER (regexp_matches(text, '^[=+@-]')) AS BIGINT) AS chars
    FROM (SELECT lang, CASE doc_id % 3 WHEN 0 THEN '=' WHEN 1 THEN '-' ELSE '' END || text AS text
          FROM documents) GROUP BY lang""")
def formula_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    lead = "CASE doc_id % 3 WHEN 0 THEN '=' WHEN 1 THEN '-' ELSE '' END"
    cells = table(spark, sf_dir, "documents").selectExpr(
        "lang", f"concat({lead}, text) AS text"
    ).selectExpr("lang", "text", f"{formula_safe('text')} AS cell")
    return cells.groupBy("lang").agg(
        F.count_if(F.col("cell") != F.col("text")).alias("quoted"),
        F.sum(F.length("cell")).alias("chars"),
    )


@workload("""SELECT page_id, regexp_replace(regexp_replace(b, '[^A-Za-z0-9._-]+', '_', 'g'),
      '^[._-]+|[._-]+$', '', 'g') AS file_name,
    NOT (page_id % 3 = 1 OR page_id % 5 = 2) AS safe FROM (
      SELECT page_id, list_extract(string_split(rtrim(url, '/'), '/'), -1) AS b FROM pages)""")
def archive_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = ("concat(CASE WHEN page_id % 3 = 1 THEN '../' ELSE 'in//./' END, "
             "IF(page_id % 5 = 2, 'c:x', 'x'), '.xml')")
    return table(spark, sf_dir, "pages").selectExpr(
        "page_id", f"{safe_filename('url')} AS file_name", f"{safe_archive_path(entry)} AS safe"
    )


# --- Duplicates, numbering, choices ----------------------------------------------


@workload("""SELECT value, CAST(n AS BIGINT) AS count FROM (SELECT sha256(text) AS value, count(*) AS n
    FROM documents GROUP BY 1 HAVING count(*) > 1) ORDER BY n DESC, value LIMIT 25""")
def doc_dupes_top25(spark: SparkSession, sf_dir: str) -> DataFrame:
    digests = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("digest"))
    return ranking.duplicate_values(digests, "digest")


@workload("""SELECT p_brand || ' / ' || p_type AS key, 'Catalog key ' || p_brand || ' / ' || p_type
    || ' occurs ' || count(*) || ' times.' AS message FROM part GROUP BY p_brand, p_type
    HAVING count(*) > 1""")
def critical_key_dupes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr(
        "p_brand AS technical_mapping_file", "p_type AS canonical_field"
    )
    return catalog.duplicate_keys(rows).selectExpr(
        "concat(source, ' / ', canonical_field) AS key", "message"
    )


@workload("""SELECT o_orderkey, 'cust_' || o_custkey || CASE WHEN n = 1 THEN '' ELSE '_' || n END
    AS unique_name FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n
    FROM orders)""")
def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "concat('cust_', o_custkey) AS base"
    )
    named = ranking.numbered_names(files, "base", "o_orderkey", chunk_rows=4096)
    return named.select("o_orderkey", "unique_name")


@workload("""SELECT event_type, CAST(count(*) FILTER (event_id > f) AS BIGINT) AS repeats,
    CAST(count(*) AS BIGINT) AS events FROM (SELECT *, min(event_id) OVER (PARTITION BY user_id) AS f
    FROM events) GROUP BY event_type""")
def repeat_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    flagged = ranking.first_occurrences(events, "user_id", "event_id")
    return flagged.groupBy("event_type").agg(
        F.count_if("is_repeat").alias("repeats"), F.count("*").alias("events")
    )


@workload("""SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM (
    SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderpriority = '1-URGENT') DESC,
      (o_orderstatus = 'F') DESC, o_orderkey) AS n FROM orders) WHERE n = 1""")
def best_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"
    )
    order = [F.expr("o_orderpriority <> '1-URGENT'"), F.expr("o_orderstatus <> 'F'"),
             F.col("o_orderkey")]
    return ranking.best_row(orders, ["o_custkey"], order).drop("o_orderpriority")


@workload("""SELECT change, CAST(count(*) AS BIGINT) AS orders, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM (
    SELECT o_orderkey, 'removed' AS change FROM orders WHERE o_orderkey % 10 = 1
    UNION ALL SELECT -1 - o_orderkey, 'new' FROM orders WHERE o_orderkey % 9 = 4
    UNION ALL SELECT o_orderkey, 'changed' FROM orders WHERE o_orderkey % 7 = 2 AND o_orderkey % 10 <> 1)
    GROUP BY change""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    body = F.to_json(F.struct("o_orderstatus", "o_totalprice", "o_orderpriority"))
    local = orders.select("o_orderkey", body.alias("body"))
    kept = local.filter("o_orderkey % 10 <> 1").withColumn(
        "body", F.expr("IF(o_orderkey % 7 = 2, concat(body, ' '), body)")
    )
    added = local.filter("o_orderkey % 9 = 4").selectExpr("-1 - o_orderkey AS o_orderkey", "body")
    changes = snapshots.diff(local, kept.unionByName(added), "o_orderkey", "body")
    return changes.groupBy("change").agg(
        F.count("*").alias("orders"), F.sum("o_orderkey").alias("keys")
    )


# --- Catalog ---------------------------------------------------------------------


def customer_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as catalog rows: the segment decides the status."""
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey + 2 AS row_number",
        """CASE c_mktsegment WHEN 'FURNITURE' THEN 'mapped_official_bms_xpath'
             WHEN 'HOUSEHOLD' THEN 'candidate' WHEN 'MACHINERY' THEN 'needs_webvoc_review'
             WHEN 'BUILDING' THEN 'mapped' ELSE 'odd_status' END AS mapping_status""",
        "CASE c_custkey % 4 WHEN 0 THEN 'certain' WHEN 1 THEN 'low' ELSE 'high' END AS confidence",
        "concat('field_', c_nationkey, IF(c_custkey % 3 = 0, '_image', '')) AS canonical_field",
        "IF(c_custkey % 5 = 0, '', 'attr') AS gdsn_attribute_name", "'/x' AS gdsn_xpath",
        "IF(c_custkey % 6 = 0, '', CAST(c_custkey AS string)) AS gdsn_bms_id",
        "concat('file_', c_custkey) AS technical_mapping_file",
        "IF(c_custkey % 8 = 0, '', concat('gs1:prop', c_nationkey)) AS jsonld_property",
        "IF(c_custkey % 9 = 0, concat('schema:name', c_nationkey), '') AS recommended_jsonld_property",
        "'' AS notes", "'' AS webvoc_property_status",
        "IF(c_custkey % 10 = 0, 'gs1:x=NOT FOUND', '') AS webvoc_property_validation",
        "IF(c_custkey % 12 = 0, 'OK_schema', 'ok') AS review_action",
        "'v1' AS mapping_version", "'scope' AS scope_group", "'src' AS source",
    )


_SQL_CATALOG = """SELECT c_custkey, c_nationkey, CASE c_mktsegment WHEN 'FURNITURE' THEN 'mapped_official_bms_xpath'
      WHEN 'HOUSEHOLD' THEN 'candidate' WHEN 'MACHINERY' THEN 'needs_webvoc_review'
      WHEN 'BUILDING' THEN 'mapped' ELSE 'odd_status' END AS s, c_custkey % 4 AS c,
      c_custkey % 3 = 0 AS img FROM customer"""


@workload(f"""WITH r AS ({_SQL_CATALOG}), f AS (
    SELECT 'unknown_mapping_status' AS code, 'warning' AS severity, s, img FROM r WHERE s = 'odd_status'
    UNION ALL SELECT 'unknown_confidence', 'warning', s, img FROM r WHERE c = 0
    UNION ALL SELECT 'missing_mapped_value', 'error', s, img FROM r
      WHERE s IN ('mapped_official_bms_xpath', 'candidate', 'mapped') AND c_custkey % 5 = 0
    UNION ALL SELECT 'missing_jsonld_property', 'warning', s, img FROM r
      WHERE s IN ('mapped_official_bms_xpath', 'candidate', 'mapped') AND c_custkey % 8 = 0
        AND c_custkey % 9 <> 0
    UNION ALL SELECT 'missing_official_bms_id', 'warning', s, img FROM r
      WHERE s = 'mapped_official_bms_xpath' AND c IN (2, 3) AND c_custkey % 6 = 0
    UNION ALL SELECT 'webvoc_review_required', 'warning', s, img FROM r
      WHERE s = 'needs_webvoc_review' OR c_custkey % 10 = 0)
    SELECT code, severity, CASE WHEN code = 'webvoc_review_required' THEN
        CASE WHEN img THEN 'image_modelling' ELSE 'webvoc_term_missing' END
      WHEN code = 'missing_official_bms_id' OR contains(s, 'bms') THEN 'needs_bms_review'
      ELSE 'governance_review' END AS category,
      CAST(count(*) AS BIGINT) AS findings FROM f GROUP BY ALL""")
def catalog_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalog.row_findings(customer_catalog(spark, sf_dir))
    return found.groupBy("code", "severity", "category").agg(F.count("*").alias("findings"))


_SQL_COVERAGE = f"""SELECT c_nationkey, c_custkey, CASE
      WHEN c_custkey % 9 = 0 AND c_custkey % 8 = 0 THEN 'schema_org_fallback'
      WHEN s = 'needs_webvoc_review' OR c_custkey % 10 = 0 OR c_custkey % 12 = 0
        THEN 'standards_review_required'
      WHEN s = 'candidate' THEN 'candidate'
      WHEN s LIKE 'mapped%' AND c IN (2, 3) THEN 'high_confidence'
      WHEN s LIKE 'mapped%' THEN 'mapped' ELSE 'unknown' END AS coverage FROM ({_SQL_CATALOG})"""


@workload(f"""SELECT 'field_' || c_nationkey || CASE WHEN c_custkey % 3 = 0 THEN '_image' ELSE '' END AS field,
    arg_max(coverage, list_position(['unmapped', 'unknown', 'mapped', 'high_confidence', 'candidate',
      'experimental', 'schema_org_fallback', 'standards_review_required'], coverage)) AS coverage,
    CAST(count(*) AS BIGINT) AS rows FROM ({_SQL_COVERAGE}) GROUP BY 1""")
def coverage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = customer_catalog(spark, sf_dir).selectExpr(
        "canonical_field AS field", f"{explorer.coverage_of_row()} AS coverage"
    )
    return rows.groupBy("field").agg(
        explorer.strongest_coverage("coverage").alias("coverage"), F.count("*").alias("rows")
    )


@workload(f"""WITH e AS (SELECT c_custkey, coverage, t.term FROM ({_SQL_COVERAGE}) c,
      LATERAL (SELECT unnest(list_filter([
        CASE WHEN c.c_custkey % 8 <> 0 THEN 'gs1:prop' || c.c_nationkey END,
        CASE WHEN c.c_custkey % 9 = 0 THEN 'schema:name' || c.c_nationkey END,
        CASE WHEN c.c_custkey % 10 = 0 THEN 'gs1:x' END], lambda x: x IS NOT NULL)) AS term) t)
    SELECT term AS term_id, CAST(count(*) AS BIGINT) AS evidence, arg_max(coverage, list_position(
      ['unmapped', 'unknown', 'mapped', 'high_confidence', 'candidate', 'experimental',
       'schema_org_fallback', 'standards_review_required'], coverage)) AS coverage
    FROM e GROUP BY term""")
def term_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence = explorer.evidence_by_term(customer_catalog(spark, sf_dir))
    return evidence.groupBy("term_id").agg(
        F.count("*").alias("evidence"), explorer.strongest_coverage("coverage").alias("coverage")
    )


_SQL_TOPIC = "CASE " + " ".join(
    f"WHEN {' OR '.join(f'contains(t, {q(w)})' for w in words)} THEN {q(topic)}"
    for topic, words in TOPIC_GROUPS
) + " ELSE 'Other Web Vocabulary Properties' END"


@workload(f"""SELECT topic, CAST(count(*) AS BIGINT) AS documents, CAST(sum(length(t)) AS BIGINT) AS chars
    FROM (SELECT t, {_SQL_TOPIC} AS topic FROM (SELECT lower(text) AS t FROM documents)) GROUP BY topic""")
def keyword_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic of whole document texts."""
    texts = spread(table(spark, sf_dir, "documents").select("text")).select(
        F.lower("text").alias("t")
    )
    topics = texts.select("t", F.expr(explorer.topic_of("t")).alias("topic"))
    return topics.groupBy("topic").agg(
        F.count("*").alias("documents"), F.sum(F.length("t")).alias("chars")
    )


@workload("""SELECT n_nationkey, CAST(count(*) AS BIGINT) AS suppliers FROM nation JOIN supplier
    ON n_nationkey = s_nationkey WHERE n_nationkey % 3 <> 2 AND s_suppkey % 4 <> 3
    GROUP BY n_nationkey""")
def variant_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "nation").selectExpr(
        "n_nationkey", "concat('f', n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN '_value' "
        "WHEN 1 THEN '_code' ELSE '_other' END) AS canonical_field"
    )
    right = table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey", "concat('f', s_nationkey, CASE s_suppkey % 4 WHEN 0 THEN '' "
        "WHEN 1 THEN '_unit' WHEN 2 THEN '.unit_code' ELSE '_rest' END) AS canonical_field"
    )
    pairs = catalog.variant_pairs(left, right, "n_nationkey", "s_suppkey")
    return pairs.groupBy("n_nationkey").agg(F.count("*").alias("suppliers"))


@workload("""SELECT l_orderkey, bool_and(l_returnflag <> 'N') AS all_match FROM lineitem GROUP BY l_orderkey""")
def children_all_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag")
    return catalog.every_child(lines, "l_orderkey", "l_returnflag <> 'N'")


@workload("""WITH m AS (SELECT n_nationkey, count(s_suppkey) AS n, bool_or(s_suppkey % 2 = 0) AS aligned,
      bool_or(s_suppkey % 5 = 0) AS experimental
      FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey AND s_suppkey % 4 <> 3 GROUP BY 1),
    f AS (SELECT CASE WHEN n = 0 THEN 'yaml_field_missing_from_catalog' WHEN NOT aligned
        THEN 'yaml_property_not_aligned' ELSE 'mapping_aligned' END AS code FROM m
      UNION ALL SELECT 'experimental_mapping_documented' FROM m WHERE experimental
      UNION ALL SELECT 'catalog_field_missing_from_yaml' FROM supplier WHERE s_suppkey % 4 = 3)
    SELECT code, CAST(count(*) AS BIGINT) AS findings FROM f GROUP BY code""")
def reconcile_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "nation").selectExpr(
        "n_nationkey AS pos", "n_name AS id", "'field' AS kind",
        "concat('f', n_nationkey, '_value') AS canonical_field",
        "concat('gs1:p', n_nationkey) AS jsonld_property", "'' AS xpath", "'m.yaml' AS mapping_file",
    )
    rows = table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS row_number",
        "concat('f', s_nationkey, IF(s_suppkey % 4 = 3, '_rest', '_unit')) AS canonical_field",
        "IF(s_suppkey % 2 = 0, concat('gs1:p', s_nationkey), 'gs1:other') AS jsonld_property",
        "'' AS recommended_jsonld_property", "'mapped' AS mapping_status", "'high' AS confidence",
        "IF(s_suppkey % 5 = 0, 'experimental term', '') AS notes", "'' AS webvoc_property_status",
        "'' AS webvoc_property_validation", "'' AS review_action",
        "concat('file_', s_suppkey) AS technical_mapping_file",
    )
    found = catalog.reconcile(records, rows)["findings"]
    return found.groupBy("code").agg(F.count("*").alias("findings"))


@workload("""WITH r AS (SELECT c_custkey, c_custkey % 8 <> 0 AS own, c_custkey % 9 = 0 AS org,
      c_nationkey < 12 AS is_term, c_nationkey % 5 = 0 AS is_link, c_nationkey FROM customer)
    SELECT c_custkey, CASE WHEN own AND NOT is_term AND NOT is_link THEN 'needs_webvoc_review'
        WHEN own AND is_link AND NOT is_term THEN 'webvoc_linktype_available'
        WHEN own THEN 'webvoc_found' WHEN org THEN 'schema_org_only' ELSE 'not_applicable' END AS status,
      CASE WHEN own AND NOT is_term AND NOT is_link THEN 'webvoc_term_missing'
        WHEN own AND is_link THEN 'webvoc_linktype_available'
        WHEN org AND NOT own THEN 'schema_org_fallback' ELSE 'validated' END AS category,
      concat_ws('; ', CASE WHEN own AND is_term THEN 'gs1:prop' || c_nationkey || '=found' END,
        CASE WHEN own AND is_link AND c_nationkey % 2 = 0 THEN 'gs1:prop' || c_nationkey
          || '=stable linktype' END,
        CASE WHEN own AND NOT is_term AND NOT is_link THEN 'gs1:prop' || c_nationkey || '=NOT FOUND' END,
        CASE WHEN org THEN 'schema:name' || c_nationkey || '=schema.org' END) AS validation,
      CASE WHEN own AND is_term THEN 'gs1:prop' || c_nationkey || ': NATION_' || c_nationkey
        ELSE '' END AS label FROM r""")
def revalidate_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    terms = nation.filter("n_nationkey < 12").selectExpr(
        "concat('gs1:prop', n_nationkey) AS term_id", "n_name AS label", "'' AS range_text"
    )
    links = nation.filter("n_nationkey % 5 = 0").selectExpr(
        "concat('prop', n_nationkey) AS name", "IF(n_nationkey % 2 = 0, 'stable', 'draft') AS status"
    )
    checked = catalog.revalidate(customer_catalog(spark, sf_dir), terms, links)
    return checked.selectExpr(
        "row_number - 2 AS c_custkey", "webvoc_property_status AS status", "category",
        "webvoc_property_validation AS validation", "webvoc_property_label AS label",
    )


# --- Candidates ------------------------------------------------------------------


def part_candidates(spark: SparkSession, sf_dir: str, limit: int = 5) -> DataFrame:
    """Distinct part names as properties, all parts as source attributes."""
    part = table(spark, sf_dir, "part")
    properties = part.groupBy("p_name").agg(F.min("p_size").alias("k")).selectExpr(
        "concat('gs1:', replace(p_name, ' ', '_')) AS term_id", "'' AS compact_name",
        "p_name AS label", "'' AS comment", "'' AS domain",
        "CASE length(p_name) % 3 WHEN 0 THEN 'xsd:decimal' WHEN 1 THEN 'gs1:QuantitativeValue' "
        "ELSE 'xsd:boolean' END AS range",
    )
    attributes = deal(part).selectExpr(
        "p_partkey AS row_pos", "CAST(p_partkey AS string) AS bms_id",
        "concat(p_name, ' ', lower(p_type)) AS attribute_name", "'' AS xpath", "'' AS definition",
        "CASE p_size % 3 WHEN 0 THEN 'Measurement' WHEN 1 THEN 'Boolean' ELSE 'Other' END AS data_type",
        "IF(p_size % 2 = 0, 'Yes', 'No') AS uom_enabled", "'Attribute' AS row_type",
        "IF(p_size % 10 = 0, 'true', 'false') AS is_deleted", "'true' AS is_candidate_source",
        *[f"'' AS {c}" for c in ("message", "module", "parent_class", "multiplicity",
                                 "code_list_name", "bms_code_list_id", "semantic_resource_urn")],
    )
    rows = customer_catalog(spark, sf_dir).filter("false")
    backlog = docs_in.backlog(
        part.selectExpr("'' AS path", "'' AS text").filter("false")
    )
    return cand.candidates(
        properties, attributes, rows, Profile(fields=()), backlog, limit=limit
    )


_SQL_CANDIDATES = """WITH p AS (SELECT DISTINCT p_name, string_split(p_name, ' ') AS pt,
      CASE length(p_name) % 3 WHEN 0 THEN 'dec' WHEN 1 THEN 'qty' ELSE 'bool' END AS r FROM part),
    a AS (SELECT p_partkey, list_distinct(string_split(p_name || ' ' || lower(p_type), ' ')) AS words,
      p_size % 3 AS dt, p_size % 2 = 0 AS uom, p_size % 10 = 0 AS del FROM part),
    o AS (SELECT p_name, p_partkey, del, r, dt, uom, len(list_intersect(pt, words)) AS n,
      CAST(len(list_intersect(pt, words)) AS DOUBLE) / greatest(len(pt), len(words)) AS f FROM p, a),
    s AS (SELECT *, (r IN ('dec', 'qty') AND dt = 0) OR (r = 'bool' AND dt = 1) AS fits,
      r = 'bool' AND dt = 0 AS clash, r = 'qty' AND uom AS q FROM o),
    w AS (SELECT *, greatest(0::DOUBLE, least(1::DOUBLE, 0::DOUBLE
      + CASE WHEN del THEN -0.3::DOUBLE ELSE 0 END
      + CASE WHEN n >= 1 THEN 0.35::DOUBLE * f ELSE 0 END
      + CASE WHEN fits THEN 0.15::DOUBLE WHEN clash THEN -0.15::DOUBLE ELSE 0 END
      + CASE WHEN q THEN 0.2::DOUBLE ELSE 0 END)) AS score FROM s),
    k AS (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY score DESC, p_partkey) AS rank
      FROM w WHERE score > 0 OR n >= 1 OR fits OR q)
    SELECT 'gs1:' || replace(p_name, ' ', '_') AS property, p_partkey AS attribute, rank,
      round(score, 4) AS score, CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.4 THEN 'medium'
        WHEN score >= 0.15 THEN 'low' ELSE 'review_required' END AS level,
      concat_ws(';', CASE WHEN n >= 1 THEN 'label_attribute_token_overlap' END,
        CASE WHEN fits THEN 'range_datatype_compatible' END,
        CASE WHEN q THEN 'quantity_uom_compatible' END) AS reasons,
      concat_ws(';', CASE WHEN del THEN 'deleted_attribute_warning' END,
        CASE WHEN clash AND NOT fits THEN 'datatype_mismatch_warning' END) AS warnings
    FROM k WHERE rank <= 5"""


@workload(_SQL_CANDIDATES)
def candidates_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_candidates(spark, sf_dir).selectExpr(
        "webvoc_property_id AS property", "CAST(gdsn_bms_id AS bigint) AS attribute",
        "CAST(rank AS bigint) AS rank", "score", "confidence_level AS level",
        "array_join(reasons, ';') AS reasons", "array_join(warnings, ';') AS warnings",
    )


@workload(f"""SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(DISTINCT property) AS BIGINT) AS covered,
    CAST(count(*) FILTER (level = 'medium') AS BIGINT) AS medium,
    CAST(count(*) FILTER (level = 'low') AS BIGINT) AS low,
    CAST(count(*) FILTER (level = 'review_required') AS BIGINT) AS review
    FROM ({_SQL_CANDIDATES}) WHERE level <> 'high'""")
def candidate_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cand.filter_candidates(part_candidates(spark, sf_dir)).filter("confidence_level <> 'high'")
    return cand.candidate_summary(rows).selectExpr(
        "total_candidates AS total", "properties_covered AS covered",
        "confidence_medium AS medium", "confidence_low AS low",
        "confidence_review_required AS review",
    )


def evidenced_candidates(spark: SparkSession, sf_dir: str, limit: int = 5) -> DataFrame:
    """Part names as properties, parts as attributes, with every kind of evidence.

    Catalog rows and decisions come from parts as well; the profile names two properties.
    """
    part = table(spark, sf_dir, "part").withColumns({
        "w1": F.split("p_name", " ")[0], "w2": F.split("p_name", " ")[1],
    }).withColumn("compact", F.expr("concat(w1, initcap(w2))"))
    names = part.select("p_name", "w1", "w2", "compact").distinct()
    properties = names.selectExpr(
        "concat('gs1:', compact) AS term_id", "compact AS compact_name", "p_name AS label",
        "concat(p_name, ' wood steel') AS comment", "'' AS domain",
        "CASE length(p_name) % 4 WHEN 0 THEN 'xsd:decimal' WHEN 1 THEN 'gs1:QuantitativeValue' "
        "WHEN 2 THEN 'xsd:boolean' ELSE 'gs1:ColourCode' END AS range",
    )
    attributes = deal(part).selectExpr(
        "p_partkey AS row_pos", "CAST(p_partkey AS string) AS bms_id",
        "CASE p_size % 5 WHEN 0 THEN p_name WHEN 1 THEN concat(w1, '_', w2) "
        "ELSE concat(p_name, ' ', lower(p_type)) END AS attribute_name",
        "IF(p_size % 3 = 0, concat('/a/b:', w2, 'Side[1]'), '') AS xpath",
        "concat(IF(p_size % 2 = 0, 'steel wood ', ''), lower(p_type)) AS definition",
        "CASE p_size % 4 WHEN 0 THEN 'Measurement' WHEN 1 THEN 'Boolean' WHEN 2 THEN 'String' "
        "ELSE 'Other' END AS data_type",
        "IF(p_size % 2 = 0, 'Yes', 'No') AS uom_enabled",
        "IF(p_size % 9 = 0, 'Class', 'Attribute') AS row_type",
        "IF(p_size % 10 = 0, 'true', 'false') AS is_deleted", "'true' AS is_candidate_source",
        "IF(p_size % 6 = 0, 'list', '') AS code_list_name",
        "IF(p_size % 7 = 0, concat('urn:x.', w1, w2), '') AS semantic_resource_urn",
        *[f"'' AS {c}" for c in ("message", "module", "parent_class", "multiplicity", "bms_code_list_id")],
    )
    rows = part.filter("p_partkey % 40 = 0").selectExpr(
        "p_partkey AS row_number", "concat('gs1:', compact) AS jsonld_property",
        "CAST(p_partkey AS string) AS gdsn_bms_id", "'-' AS gdsn_attribute_name",
        "CASE WHEN p_partkey % 120 = 0 THEN 'needs_bms_review' WHEN p_partkey % 80 = 0 THEN 'mapped' "
        "ELSE 'candidate' END AS mapping_status", "'' AS canonical_field", "'high' AS confidence",
    )
    profile = Profile(fields=(
        Rule("a", "", "gs1:blueAnvil", "blue_anvil"), Rule("b", "", "gs1:redRod", "red_rod"),
    ))
    decision = json_object([
        ("id", json_string("concat('SDR-', w1)")), ("affected_properties", json_array(
            "array(" + json_string("concat('gs1:', compact)") + ")")),
    ])
    backlog = docs_in.backlog(names.filter("length(p_name) % 4 = 0").selectExpr(
        "compact AS path", f"concat('[', {decision}, ']') AS text"
    ))
    return cand.candidates(properties, attributes, rows, profile, backlog, limit=limit)


_SQL_EVIDENCED = """WITH parts AS (SELECT *, split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2,
      split_part(p_name, ' ', 1) || split_part(p_name, ' ', 2) AS joined FROM part),
    p AS (SELECT DISTINCT p_name, w1, w2, joined, 'gs1:' || w1 || upper(w2[1]) || w2[2:] AS term,
      length(p_name) % 4 AS r FROM parts),
    m AS (SELECT joined, arg_min(CASE WHEN p_partkey % 120 = 0 THEN 'needs_bms_review' WHEN p_partkey % 80 = 0
        THEN 'mapped' ELSE 'candidate' END,
        p_partkey + CASE WHEN p_partkey % 120 <> 0 AND p_partkey % 80 = 0 THEN 0 ELSE 1e12 END) AS status
      FROM parts WHERE p_partkey % 40 = 0 GROUP BY joined),
    a AS (SELECT p_partkey, joined AS a_joined, w2 AS side, p_size AS z, lower(p_type) AS kind,
      CASE p_size % 5 WHEN 0 THEN p_name WHEN 1 THEN w1 || '_' || w2 ELSE p_name || ' ' || lower(p_type) END AS name,
      list_distinct(CASE WHEN p_size % 5 < 2 THEN [w1, w2] ELSE [w1, w2, lower(p_type)] END) AS words,
      CASE WHEN p_size % 2 = 0 THEN ['steel', 'wood', lower(p_type)] ELSE [lower(p_type)] END AS said FROM parts),
    o AS (SELECT term, p_partkey, z, r, coalesce(m.status, '') AS status, z % 10 = 0 AS del, z % 9 = 0 AS cls,
        p_partkey % 40 = 0 AND p_partkey % 120 <> 0 AND p.joined = a_joined AS cat,
        term IN ('gs1:blueAnvil', 'gs1:redRod') AND replace(name, ' ', '_') = p.w1 || '_' || p.w2 AS yaml,
        z % 7 = 0 AND contains('urn:x.' || a_joined, p.joined) AS urn, name = p_name AS exact,
        len(list_intersect([p.w1, p.w2], words)) AS n,
        CAST(len(list_intersect([p.w1, p.w2], words)) AS DOUBLE) / greatest(2, len(words)) AS f,
        z % 3 = 0 AND side IN (p.w1, p.w2) AS xp, len(list_intersect([p.w1, p.w2, 'wood', 'steel'], said)) AS d,
        CAST(len(list_intersect([p.w1, p.w2, 'wood', 'steel'], said)) AS DOUBLE) / 4 AS df,
        (r IN (0, 1) AND z % 4 = 0) OR (r = 2 AND z % 4 = 1) AS fits, r = 2 AND z % 4 IN (0, 2) AS clash,
        r = 1 AND z % 2 = 0 AS uom, r = 3 AND z % 6 = 0 AS code, r = 0 AS linked
      FROM p CROSS JOIN a LEFT JOIN m ON m.joined = p.joined),
    s AS (SELECT *, n >= 1 AND (f >= 0.3::DOUBLE OR NOT exact) AS lab, greatest(0::DOUBLE, least(1::DOUBLE, 0::DOUBLE
        + CASE WHEN del THEN -0.3::DOUBLE ELSE 0 END + CASE WHEN cls THEN -0.2::DOUBLE ELSE 0 END
        + CASE WHEN cat THEN 0.9::DOUBLE ELSE 0 END + CASE WHEN yaml THEN 0.65::DOUBLE ELSE 0 END
        + CASE WHEN urn THEN 0.8::DOUBLE ELSE 0 END + CASE WHEN exact THEN 0.7::DOUBLE ELSE 0 END
        + CASE WHEN n >= 1 AND (f >= 0.3::DOUBLE OR NOT exact) THEN 0.35::DOUBLE * f ELSE 0 END
        + CASE WHEN xp THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN d >= 2 THEN 0.2::DOUBLE * df ELSE 0 END
        + CASE WHEN fits THEN 0.15::DOUBLE WHEN clash THEN -0.15::DOUBLE ELSE 0 END
        + CASE WHEN uom THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN code THEN 0.15::DOUBLE ELSE 0 END
        + CASE WHEN linked THEN 0.1::DOUBLE ELSE 0 END)) AS score FROM o),
    k AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY score DESC, p_partkey) AS rank FROM s
      WHERE score > 0 OR cat OR yaml OR urn OR exact OR lab OR xp OR d >= 2 OR fits OR uom OR code OR linked),
    l AS (SELECT *, CASE WHEN linked AND score < 0.15 THEN 'review_required' WHEN score >= 0.7 THEN 'high'
      WHEN score >= 0.4 THEN 'medium' WHEN score >= 0.15 THEN 'low' ELSE 'review_required' END AS level FROM k)
    SELECT term AS property, p_partkey AS attribute, rank, round(score, 4) AS score, level,
      CASE WHEN status = 'mapped' THEN 'already_mapped' WHEN del THEN 'not_recommended'
        WHEN level = 'review_required' OR linked THEN 'review_required' ELSE 'proposed' END AS review,
      CASE WHEN linked THEN 'SDR-' || split_part(lower(regexp_replace(substr(term, 5), '([A-Z])', ' \\1')), ' ', 1) ELSE '' END AS decisions,
      concat_ws(';', CASE WHEN cat THEN 'existing_mapping_catalog_match' END,
        CASE WHEN yaml THEN 'mapping_yaml_canonical_field_match' END, CASE WHEN urn THEN 'semantic_resource_urn_match' END,
        CASE WHEN exact THEN 'exact_property_name_match' END, CASE WHEN lab THEN 'label_attribute_token_overlap' END,
        CASE WHEN xp THEN 'xpath_terminal_match' END, CASE WHEN d >= 2 THEN 'definition_comment_overlap' END,
        CASE WHEN fits THEN 'range_datatype_compatible' END, CASE WHEN uom THEN 'quantity_uom_compatible' END,
        CASE WHEN code THEN 'code_list_signal' END, CASE WHEN linked THEN 'standards_review_linked' END) AS reasons,
      concat_ws(';', CASE WHEN del THEN 'deleted_attribute_warning' END,
        CASE WHEN cls THEN 'class_row_not_attribute' END,
        CASE WHEN clash AND NOT fits THEN 'datatype_mismatch_warning' END) AS warnings
    FROM l WHERE rank <= {limit}"""


def _evidenced_rows(rows: DataFrame) -> DataFrame:
    return rows.selectExpr(
        "webvoc_property_id AS property", "CAST(gdsn_bms_id AS bigint) AS attribute",
        "CAST(rank AS bigint) AS rank", "score", "confidence_level AS level", "review_status AS review",
        "array_join(linked_sdr_ids, ';') AS decisions", "array_join(reasons, ';') AS reasons",
        "array_join(warnings, ';') AS warnings",
    )


@workload(_SQL_EVIDENCED.replace("{limit}", "5"))
def candidates_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All signals and penalties, from catalog, profile, decisions and attribute texts."""
    return _evidenced_rows(evidenced_candidates(spark, sf_dir))


@workload("SELECT * FROM (" + _SQL_EVIDENCED.replace("{limit}", "40")
          + ") WHERE level IN ('high', 'medium') AND review IN ('proposed', 'review_required')")
def candidates_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence and review-status filters over a longer list."""
    rows = cand.filter_candidates(
        evidenced_candidates(spark, sf_dir, 40), min_confidence="medium", include_review_required=False
    )
    return _evidenced_rows(cand.by_review_status(rows, ["proposed", "review_required"]))


# --- Vocabulary and reference data -----------------------------------------------


def part_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One small vocabulary graph per part, in varying value shapes."""
    item = json_object([
        ("@id", json_string("concat('gs1:part', p_partkey)")),
        ("@type", "IF(p_size % 2 = 0, '\"owl:DatatypeProperty\"', "
                  "'[\"rdf:Property\",\"owl:ObjectProperty\"]')"),
        ("rdfs:label", "CASE p_size % 3 WHEN 0 THEN " + json_string("p_name") + " WHEN 1 THEN "
         + json_object([("@value", json_string("p_name"))]) + " ELSE concat('[', "
         + json_object([("@value", json_string("p_name"))]) + ", ',', " + json_string("p_brand")
         + ", ']') END"),
        ("rdfs:range", "CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 2 = 0 THEN "
         + json_object([("@id", json_string("concat('xsd:', p_type)"))])
         + " ELSE concat('{\"@list\":[', " + json_object([("@id", json_string("p_type"))])
         + ", ',', " + json_string("p_brand") + ", ']}') END"),
        ("rdfs:subPropertyOf", "IF(p_size % 7 = 0, '{\"@id\":\"gs1:linkType\"}', NULL)"),
        ("sw:term_status", "'\"stable\"'"),
    ])
    return deal(table(spark, sf_dir, "part")).selectExpr(
        "'' AS path", f"concat('{{\"@graph\":[', {item}, ',5,{{\"@id\":\"gs1:\"}}]}}') AS text"
    )


@workload("""SELECT 'gs1:part' || p_partkey AS term_id, 'part' || p_partkey AS compact_name,
    CASE WHEN p_size % 3 = 2 THEN p_name || '; ' || p_brand ELSE p_name END AS label,
    CASE WHEN p_size % 5 = 0 THEN '' WHEN p_size % 2 = 0 THEN 'xsd:' || p_type
      ELSE p_type || '|' || p_brand END AS ranges,
    CASE WHEN p_size % 2 = 0 THEN 'owl:DatatypeProperty' ELSE 'rdf:Property|owl:ObjectProperty' END AS types,
    p_size % 7 = 0 OR p_partkey % 13 = 0 AS is_link_type,
    'https://gs1.org/voc/part' || p_partkey AS full_iri FROM part""")
def vocabulary_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = vocabulary.graph_items(part_graph(spark, sf_dir))
    links = table(spark, sf_dir, "part").filter("p_partkey % 13 = 0").selectExpr(
        "'' AS path", "concat('{\"part', p_partkey, '\": {\"title\": \"t\", \"status\": \"stable\"}, "
        "\"x\": 1}') AS text"
    )
    found = vocabulary.vocabulary_properties(items, vocabulary.linktypes_from_text(links))
    return found.selectExpr(
        "term_id", "compact_name", "label", "array_join(range, '|') AS ranges",
        "array_join(type, '|') AS types", "is_link_type", "full_iri",
    )


@workload("""SELECT CAST(count(*) AS BIGINT) AS property_count,
    CAST(count(*) FILTER (p_size % 7 = 0) AS BIGINT) AS link_type_property_count,
    CAST(count(*) AS BIGINT) AS stable_property_count,
    CAST(count(*) FILTER (p_size % 5 <> 0) AS BIGINT) AS properties_with_range,
    CAST(count(*) AS BIGINT) AS missing_comment, CAST(0 AS BIGINT) AS missing_label FROM part""")
def vocabulary_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = vocabulary.graph_items(part_graph(spark, sf_dir))
    profile = profiles.vocabulary_profile(
        vocabulary.vocabulary_properties(items), vocabulary.vocabulary_classes(items)
    )
    return profile.select(
        "property_count", "link_type_property_count", "stable_property_count",
        "properties_with_range", "missing_comment", "missing_label",
    )


def supplier_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier")
    active = supplier.selectExpr(
        "s_suppkey AS `BMS ID`", "concat(' ', s_name, ' ') AS `Name`",
        "IF(s_suppkey % 3 = 0, 'Class', 'Attribute') AS `Type`",
        "concat('/x/', s_suppkey % 40) AS `XPath`", "s_acctbal AS `Length`",
        "s_suppkey % 2 = 0 AS `UOM-Enabled`", "'ignored' AS `Other column`",
    )
    deleted = supplier.filter("s_suppkey % 10 = 0").selectExpr(
        "concat('D', s_suppkey) AS `BmsId`", "s_name AS `NAME`", "'Attribute' AS `type`",
        "IF(s_suppkey % 4 = 0, '', 'M') AS `Change Type`",
    )
    sheets = {"Changes": supplier, "3.1.36 final": active, "Deleted Attributes": deleted}
    return tabular.attribute_sheets(sheets, "3.1.36")


@workload("""SELECT CAST(s_suppkey AS VARCHAR) AS bms_id, s_name AS attribute_name, '' AS change_type,
      CASE WHEN s_acctbal = floor(s_acctbal) THEN CAST(CAST(s_acctbal AS BIGINT) AS VARCHAR)
        ELSE CAST(s_acctbal AS VARCHAR) END AS length,
      CASE WHEN s_suppkey % 2 = 0 THEN 'Yes' ELSE 'No' END AS uom_enabled, '3.1.36 final' AS source_sheet,
      s_suppkey % 3 <> 0 AS is_candidate_source FROM supplier
    UNION ALL SELECT 'D' || s_suppkey, s_name, CASE WHEN s_suppkey % 4 = 0 THEN 'D' ELSE 'M' END, '',
      '', 'Deleted Attributes', false FROM supplier WHERE s_suppkey % 10 = 0""")
def attribute_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supplier_sheets(spark, sf_dir).select(
        "bms_id", "attribute_name", "change_type", "length", "uom_enabled", "source_sheet",
        "is_candidate_source",
    )


@workload("""WITH r AS (SELECT s_suppkey, false AS del FROM supplier
      UNION ALL SELECT s_suppkey, true FROM supplier WHERE s_suppkey % 10 = 0)
    SELECT CAST(count(*) AS BIGINT) AS total_rows, CAST(count(*) FILTER (del) AS BIGINT) AS deleted_rows,
      CAST(count(*) FILTER (del OR s_suppkey % 3 <> 0) AS BIGINT) AS attribute_rows,
      CAST(count(*) FILTER (NOT del AND s_suppkey % 3 = 0) AS BIGINT) AS class_rows,
      CAST(count(*) FILTER (NOT del AND s_suppkey % 3 <> 0) AS BIGINT) AS candidate_source_rows,
      CAST(count(*) FILTER (NOT del) AS BIGINT) AS rows_with_xpath,
      CAST(count(*) FILTER (del) AS BIGINT) AS missing_xpath FROM r""")
def attribute_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.attribute_profile(supplier_sheets(spark, sf_dir)).select(
        "total_rows", "deleted_rows", "attribute_rows", "class_rows", "candidate_source_rows",
        "rows_with_xpath", "missing_xpath",
    )


@workload("""SELECT sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS text, CAST(doc_id AS VARCHAR) AS doc_id,
    CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE 'false' END AS flag, lang || '; ' || source AS tags
    FROM documents""")
def export_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "text", "doc_id % 2 = 0 AS flag", "array(lang, source) AS tags"
    )
    return profiles.csv_cells(rows).withColumn("text", F.sha2("text", 256))


@workload("""SELECT exists, matches, CAST(count(*) AS BIGINT) AS sources FROM (
    SELECT d.doc_id % 5 <> 0 AS exists, d.doc_id % 5 <> 0 AND d.doc_id % 3 <> 0 AS matches
    FROM documents d) GROUP BY ALL""")
def checksum_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents")
    sources = texts.selectExpr(
        "concat('s', doc_id) AS source_id", "concat('f/', doc_id) AS local_path",
        "IF(doc_id % 3 = 0, 'x', upper(sha2(text, 256))) AS sha256",
    )
    files = texts.filter("doc_id % 5 <> 0").selectExpr(
        "concat('f/', doc_id) AS local_path", "CAST(text AS binary) AS content"
    )
    checks = profiles.checksum_checks(sources, files)
    return checks.groupBy("exists", "matches").agg(F.count("*").alias("sources"))


# --- Passports, inventories, authoring -------------------------------------------


@workload("""SELECT 'source_type' AS dimension, lang AS value, CAST(count(*) AS BIGINT) AS count FROM documents
    GROUP BY lang UNION ALL SELECT 'sector', source, CAST(count(*) AS BIGINT) FROM documents GROUP BY source""")
def inventory_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").selectExpr("lang AS source_type", "source AS sector")
    return inv.inventory_counts(rows)


@workload("""SELECT CASE WHEN doc_id % 5 = 0 THEN 'missing' WHEN doc_id % 4 = 0 THEN 'placeholder'
      WHEN doc_id % 3 = 0 THEN 'mismatch' ELSE 'ok' END AS checksum_status,
    CAST(count(*) AS BIGINT) AS sources FROM documents GROUP BY 1""")
def inventory_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents")
    sources = texts.selectExpr(
        "CAST(doc_id AS string) AS source_id", "concat('f/', doc_id) AS local_path",
        "CASE WHEN doc_id % 4 = 0 THEN '' WHEN doc_id % 3 = 0 THEN 'x' ELSE sha2(text, 256) END AS sha256",
    )
    files = texts.filter("doc_id % 5 <> 0").selectExpr(
        "concat('f/', doc_id) AS local_path", "CAST(text AS binary) AS content"
    )
    rows = inv.inventory(sources, files)
    return rows.groupBy("checksum_status").agg(F.count("*").alias("sources"))


@workload("""WITH s AS (SELECT s_suppkey, s_nationkey, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS f
      FROM supplier)
    SELECT kind, CAST(count(*) AS BIGINT) AS errors FROM (
      SELECT 'duplicate' AS kind FROM s WHERE s_suppkey > f
      UNION ALL SELECT 'missing' FROM s WHERE s_suppkey % 4 = 1
      UNION ALL SELECT 'source_type' FROM s WHERE s_suppkey % 3 = 0
      UNION ALL SELECT 'sector' FROM s WHERE s_suppkey % 7 = 0) GROUP BY kind""")
def manifest_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = json_object([
        ("source_id", json_string("concat('n', s_nationkey)")), ("title", json_string("s_name")),
        ("source_url", "'\"u\"'"),
        ("source_type", "IF(s_suppkey % 3 = 0, '\"odd\"', '\"context\"')"),
        ("sector", "IF(s_suppkey % 7 = 0, '\"moon\"', '\"core\"')"),
        ("local_path", "IF(s_suppkey % 4 = 1, NULL, '\"p\"')"),
    ])
    entries = table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS pos", f"parse_json({entry}) AS entry"
    )
    kind = F.expr(
        "CASE WHEN startswith(error, 'Duplicate') THEN 'duplicate' "
        "WHEN contains(error, 'missing required') THEN 'missing' "
        "WHEN contains(error, 'unknown source_type') THEN 'source_type' ELSE 'sector' END"
    )
    found = inv.manifest_errors(inv.source_rows(entries))
    return found.groupBy(kind.alias("kind")).agg(F.count("*").alias("errors"))


@workload("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
    CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN event_type || '|en' ELSE event_type || ',' || 'x|nl' END
    AS entries FROM events""")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = json_object([("@value", json_string("event_type")), ("@language", "'\"en\"'")])
    listed = f"concat('[', {json_string('event_type')}, ',{{\"value\":\"x\",\"language\":\"nl\"}},\"  \"]')"
    rows = table(spark, sf_dir, "events").selectExpr(
        "event_id", "try_parse_json(props) AS doc",
        f"parse_json(CASE event_id % 3 WHEN 0 THEN {json_string('event_type')} WHEN 1 THEN {tagged} "
        f"ELSE {listed} END) AS name",
    )
    entries = language_entries("name")
    return rows.selectExpr(
        "event_id", f"{member('doc', 'k', 'bigint')} AS k",
        f"array_join(transform({entries}, e -> concat_ws('|', e.value, e.language)), ',') AS entries",
    )


def part_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product documents in the shapes passports must tolerate."""
    brand = json_object([("name", json_object([("@value", json_string("p_brand"))]))])
    doc = json_object([
        ("@context", "IF(p_size % 9 = 0, NULL, '\"c\"')"),
        ("@type", "IF(p_size % 8 = 0, '5', '\"Product\"')"),
        ("@id", f"IF(p_size % 2 = 0, concat('\"https://id.gs1.org/01/', {gtin14('p_partkey')}, '\"'), NULL)"),
        ("gs1:gtin", f"IF(p_size % 3 = 0, {json_string(gtin14('p_partkey'))}, NULL)"),
        ("name", json_string("p_name")),
        ("brand", f"IF(p_size % 5 = 0, {brand}, {json_string('p_brand')})"),
        ("gs1:brand", "IF(p_size % 4 = 0, '7', NULL)"),
    ])
    texts = deal(table(spark, sf_dir, "part")).selectExpr(
        "p_partkey", f"IF(p_partkey % 100 = 1, 'no json', {doc}) AS text"
    )
    return docs_in.json_objects(texts)


@workload(f"""SELECT p_partkey, CASE WHEN broken THEN NULL WHEN p_size % 2 = 0 OR p_size % 3 = 0 THEN g END AS gtin,
    CASE WHEN NOT broken THEN p_name END AS name, CASE WHEN NOT broken THEN p_brand END AS brand,
    CASE WHEN NOT broken THEN '{PASSPORT_ID_PREFIX}' ||
      CASE WHEN p_size % 2 = 0 OR p_size % 3 = 0 THEN g ELSE 'unidentified' END END AS passport_id,
    CASE WHEN broken THEN 'schema_error' ELSE 'valid' END AS validation_status,
    CASE WHEN broken THEN 'Input is not valid JSON' ELSE '' END AS error
    FROM (SELECT *, p_partkey % 100 = 1 AS broken, {_SQL_GTIN} AS g FROM part)""")
def passports(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = passport.build_passports(part_products(spark, sf_dir))
    checked = passport.validate_passports(built)
    return checked.selectExpr(
        "p_partkey", "gtin", "product_name AS name", "brand",
        "IF(passport IS NULL, NULL, passport_id) AS passport_id", "validation_status",
        "coalesce(error, '') AS error",
    )


@workload("""SELECT message, CAST(count(*) AS BIGINT) AS documents FROM (
    SELECT '[root] ''@context'' is a required property' AS message FROM part
      WHERE p_size % 9 = 0 AND p_partkey % 100 <> 1
    UNION ALL SELECT '[@type] is not of type string or array of string' FROM part
      WHERE p_size % 8 = 0 AND p_partkey % 100 <> 1
    UNION ALL SELECT '[gs1:brand] is not of type string or array' FROM part
      WHERE p_size % 4 = 0 AND p_partkey % 100 <> 1
    UNION ALL SELECT 'Instance is not valid JSON' FROM part WHERE p_partkey % 100 = 1) GROUP BY message""")
def structure_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = structure.check(part_products(spark, sf_dir).drop("error"))
    return checked.select(F.explode("errors").alias("message")).groupBy("message").agg(
        F.count("*").alias("documents")
    )


def event_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as authored values: the user is the product, the type the property."""
    return table(spark, sf_dir, "events").selectExpr(
        "user_id AS product_id", "concat('gs1:', event_type) AS property_id",
        f"IF(event_type = 'error', 'text \"x\"', {number_text('CAST(value AS decimal(38,18))')}) AS value",
        "IF(event_type = 'view', 'nl', '') AS language",
        "IF(event_type = 'click', 'KGM', '') AS unit_code", "event_id AS seq",
    )


def event_metadata(spark: SparkSession) -> DataFrame:
    rows = [
        ("gs1:click", ["gs1:QuantitativeValue"], None), ("gs1:error", ["xsd:string"], None),
        ("gs1:purchase", ["xsd:decimal"], None), ("gs1:signup", ["gs1:Other"], None),
        ("gs1:view", ["rdf:langString"], None),
    ]
    return spark.createDataFrame(
        [(*r, True, None, None) for r in rows],
        "property_id string, range array<string>, override string, supported boolean, "
        "object_type string, object_fields array<struct<property_id:string,input_type:string>>",
    )


_SQL_LAST = """SELECT user_id, event_type, arg_max(CASE WHEN value = floor(value)
      THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE CAST(value AS VARCHAR) END, event_id) AS v
    FROM events GROUP BY user_id, event_type"""


@workload(f"""SELECT user_id AS product_id, '{{"@context":["{VOCABULARY_CONTEXT}",{SCHEMA_CONTEXT_JSON}],'
    || '"@type":"Product"' || coalesce(string_agg(CASE event_type
      WHEN 'click' THEN ',"click":{{"value":' || v || ',"unitCode":"KGM"}}'
      WHEN 'error' THEN ',"error":"text \\"x\\""' WHEN 'purchase' THEN ',"purchase":' || v
      WHEN 'view' THEN ',"view":[{{"@language":"nl","@value":"' || v || '"}}]' END, ''
      ORDER BY event_type), '') || '}}' AS jsonld FROM ({_SQL_LAST}) GROUP BY user_id""")
def eav_to_jsonld(spark: SparkSession, sf_dir: str) -> DataFrame:
    return authoring.author_jsonld(event_values(spark, sf_dir), event_metadata(spark))


@workload(f"""SELECT warning, CAST(count(*) AS BIGINT) AS products FROM (
    SELECT DISTINCT user_id, 'Missing GTIN. The generated JSON-LD will not include a GS1 Digital Link-style @id.'
      AS warning FROM events
    UNION ALL SELECT DISTINCT user_id, '{AUTHORING_NOTICE}' FROM events
    UNION ALL SELECT user_id, 'gs1:signup has unsupported nested or complex range (gs1:Other) and will not be emitted.'
      FROM ({_SQL_LAST}) WHERE event_type = 'signup'
    UNION ALL SELECT user_id, 'gs1:purchase has a quantity value without unitCode.' FROM ({_SQL_LAST})
      WHERE event_type = 'purchase'
    UNION ALL SELECT user_id, 'gs1:error must be a valid number.' FROM ({_SQL_LAST})
      WHERE event_type = 'error') GROUP BY warning""")
def authoring_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    metadata = event_metadata(spark).withColumn(
        "override", F.expr("CASE property_id WHEN 'gs1:purchase' THEN 'quantity' "
                           "WHEN 'gs1:error' THEN 'number' END")
    )
    found = authoring.authoring_warnings(event_values(spark, sf_dir), metadata)
    return found.groupBy("warning").agg(F.count("*").alias("products"))


@workload("""SELECT kind, CAST(count(*) AS BIGINT) AS parts FROM (SELECT CASE
    WHEN p_size % 11 = 0 THEN 'code'
    WHEN p_type IN ('SMALL') THEN 'quantity' WHEN p_size % 6 = 0 THEN 'language_text'
    WHEN p_size % 6 = 1 THEN 'checkbox' WHEN p_size % 6 = 2 THEN 'number' WHEN p_size % 6 = 3 THEN 'url'
    WHEN p_size % 6 = 4 THEN 'text' ELSE 'unsupported' END AS kind FROM part) GROUP BY kind""")
def input_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr(
        "concat('gs1:', IF(p_type = 'SMALL', 'netWeight', 'other')) AS property_id",
        "IF(p_size % 11 = 0, 'code', '') AS override",
        "CASE p_size % 6 WHEN 0 THEN array('x', 'rdf:langString') WHEN 1 THEN array('xsd:boolean') "
        "WHEN 2 THEN array('xsd:double') WHEN 3 THEN array('xsd:anyURI') "
        "WHEN 4 THEN CAST(array() AS array<string>) ELSE array('gs1:Thing') END AS range",
    )
    return rows.groupBy(F.expr(authoring.input_type()).alias("kind")).agg(
        F.count("*").alias("parts")
    )


# --- Explorer, governance, further reports ---------------------------------------


def nation_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One decision per nation about a property, every second one about a field too."""
    decision = json_object([
        ("id", json_string("concat('S', n_nationkey)")), ("title", json_string("n_name")),
        ("status", "IF(n_nationkey % 4 = 0, '\"done\"', '\"open\"')"),
        ("category", json_string("concat('cat', n_regionkey)")), ("warning_count", "n_nationkey"),
        ("affected_properties", "concat('[', " + json_string("concat('gs1:prop', n_nationkey)") + ", ']')"),
        ("affected_fields", "IF(n_nationkey % 2 = 0, concat('[', "
         + json_string("concat('field_', (n_nationkey + 1) % 25)") + ", ']'), '[]')"),
        ("decision_file", "'\"f.md\"'"),
    ])
    nation = table(spark, sf_dir, "nation").selectExpr(
        "'' AS path", f"concat('[', {decision}, ']') AS text", "n_nationkey"
    )
    # Every row is its own one-entry list, so positions come from the table.
    return docs_in.backlog(nation.select("path", "text")).withColumn(
        "pos", F.regexp_extract("id", "[0-9]+", 0).cast("int")
    )


@workload("""SELECT CAST(count(*) FILTER (n_nationkey % 4 <> 0) AS BIGINT) AS open_topics,
    CAST(sum(CASE WHEN n_nationkey % 4 <> 0 THEN n_nationkey ELSE 0 END) AS BIGINT) AS open_warnings
    FROM nation""")
def backlog_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.backlog_summary(nation_backlog(spark, sf_dir))


_SQL_GOVERNED = f"""SELECT DISTINCT 'gs1:prop' || n_nationkey AS term_id, n_nationkey AS d FROM nation
    UNION SELECT 'gs1:prop' || c_nationkey, n_nationkey FROM nation JOIN customer
      ON c_nationkey = (n_nationkey + 1) % 25 WHERE n_nationkey % 2 = 0 AND c_custkey % 3 <> 0
        AND c_custkey % 8 <> 0
    UNION SELECT 'schema:name' || c_nationkey, n_nationkey FROM nation JOIN customer
      ON c_nationkey = (n_nationkey + 1) % 25 WHERE n_nationkey % 2 = 0 AND c_custkey % 3 <> 0
        AND c_custkey % 9 = 0
    UNION SELECT 'gs1:x', n_nationkey FROM nation JOIN customer
      ON c_nationkey = (n_nationkey + 1) % 25 WHERE n_nationkey % 2 = 0 AND c_custkey % 3 <> 0
        AND c_custkey % 10 = 0"""


@workload(f"""SELECT term_id, string_agg('S' || d, ',' ORDER BY 'S' || d) AS decisions
    FROM ({_SQL_GOVERNED}) GROUP BY term_id""")
def governance_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence = explorer.evidence_by_term(customer_catalog(spark, sf_dir))
    linked = explorer.governance_by_term(evidence, nation_backlog(spark, sf_dir))
    return linked.selectExpr(
        "term_id", "array_join(array_sort(transform(governance, g -> g.sdr_id)), ',') AS decisions"
    )


def nation_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").selectExpr(
        "concat('gs1:prop', n_nationkey) AS term_id", "concat('prop', n_nationkey) AS compact_name",
        "n_name AS label", "CASE n_nationkey % 4 WHEN 0 THEN 'Energy per serving' WHEN 1 THEN "
        "'Price of an offer' ELSE '' END AS comment", "array('gs1:Product') AS type",
        "'stable' AS term_status", "CAST(array() AS array<string>) AS domain",
        "array('xsd:string') AS range", "CAST(array() AS array<string>) AS sub_property_of",
        "'' AS full_iri", "n_nationkey % 7 = 0 AS is_link_type",
    )


_SQL_EXPLORED = f"""WITH e AS (SELECT 'gs1:prop' || c_nationkey AS term_id, count(*) AS n,
      arg_max(coverage, list_position(['unmapped', 'unknown', 'mapped', 'high_confidence', 'candidate',
        'experimental', 'schema_org_fallback', 'standards_review_required'], coverage)) AS coverage
      FROM ({_SQL_COVERAGE}) WHERE c_custkey % 8 <> 0 GROUP BY 1),
    g AS (SELECT term_id, count(*) AS decisions FROM ({_SQL_GOVERNED}) GROUP BY 1)
    SELECT 'gs1:prop' || n_nationkey AS term_id, coalesce(coverage, 'unmapped') AS coverage_status,
      CASE WHEN n_nationkey % 4 = 0 THEN 'Nutritional Information'
        WHEN n_nationkey % 4 = 1 THEN 'Offer and Sales Information'
        WHEN n_nationkey % 7 = 0 THEN 'Digital Links & Services'
        ELSE 'Core Product Information' END AS topic,
      CAST(coalesce(n, 0) AS BIGINT) AS evidence_count, CAST(coalesce(decisions, 0) AS BIGINT) AS decisions
    FROM nation LEFT JOIN e ON e.term_id = 'gs1:prop' || n_nationkey
      LEFT JOIN g ON g.term_id = 'gs1:prop' || n_nationkey"""


@workload(_SQL_EXPLORED)
def explorer_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = explorer.explore(
        nation_properties(spark, sf_dir),
        customer_catalog(spark, sf_dir).withColumn("scope_group", F.lit("brand")),
        nation_backlog(spark, sf_dir),
    )
    return built.selectExpr(
        "term_id", "coverage_status", "group AS topic", "evidence_count",
        "CAST(coalesce(size(governance), 0) AS bigint) AS decisions",
    )


@workload("""SELECT 'gs1:prop' || n_nationkey AS term_id FROM nation WHERE n_nationkey % 4 = 1
    OR n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_custkey % 8 <> 0
      AND (c_nationkey IN (1, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19))
      AND c_custkey % 3 = 0)""")
def explorer_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve searches at once: one hits property text, the others evidence."""
    rows = customer_catalog(spark, sf_dir)
    evidence = explorer.evidence_by_term(rows)
    built = explorer.explore(nation_properties(spark, sf_dir), rows, nation_backlog(spark, sf_dir))
    texts = [" AN OFFER ", "field_1_image", *[f"field_{i}_image" for i in range(10, 20)]]
    return explorer.search_properties(built, evidence, texts).select("term_id").distinct()


@workload("""SELECT change, CAST(count(*) AS BIGINT) AS terms FROM (
    SELECT CASE WHEN p_size % 5 = 0 THEN 'removed' WHEN p_size % 3 = 0 THEN 'changed' END AS change FROM part
    UNION ALL SELECT 'new' FROM part WHERE p_size % 11 = 0) WHERE change IS NOT NULL GROUP BY change""")
def vocabulary_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms compared as canonical JSON: key order and repeats do not count."""
    part = table(spark, sf_dir, "part")

    def graph(*items: str) -> DataFrame:
        return part.selectExpr(
            "'' AS path", f"concat('{{\"@graph\":[', concat_ws(',', {', '.join(items)}), ']}}') AS text"
        )

    term = json_string("concat('gs1:t', p_partkey)")
    name, brand = json_string("p_name"), json_string("p_brand")
    old = json_object([("@id", term), ("a", name), ("b", brand)])
    stale = json_object([("@id", term), ("a", "1")])
    edited = json_object([("b", f"IF(p_size % 3 = 0, '\"x\"', {brand})"), ("a", name), ("@id", term)])
    added = json_object([("@id", json_string("concat('gs1:n', p_partkey)"))])
    local = vocabulary.own_terms(vocabulary.graph_items(graph(stale, old)))
    remote = vocabulary.own_terms(vocabulary.graph_items(
        graph(f"IF(p_size % 5 = 0, NULL, {edited})", f"IF(p_size % 11 = 0, {added}, NULL)")))
    changes = snapshots.diff_terms(local, remote)
    return changes.groupBy("change").agg(F.count("*").alias("terms"))


@workload("""SELECT CAST(doc_id AS VARCHAR) AS source, sha256(text) AS local_hash,
    CASE WHEN doc_id % 6 = 0 THEN NULL WHEN doc_id % 4 = 0 THEN sha256(text || ' ') ELSE sha256(text) END
      AS remote_hash, doc_id % 6 <> 0 AND doc_id % 4 = 0 AS changed FROM documents""")
def source_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents")
    local = texts.selectExpr("CAST(doc_id AS string) AS source", "CAST(text AS binary) AS content")
    remote = texts.filter("doc_id % 6 <> 0").selectExpr(
        "CAST(doc_id AS string) AS source",
        "CAST(IF(doc_id % 4 = 0, concat(text, ' '), text) AS binary) AS content",
    )
    return snapshots.source_changes(local, remote)


@workload(f"""SELECT status, gtin_or_output_name, CAST(mapped AS BIGINT) AS mapped_count, error_summary FROM (
    SELECT CASE WHEN b THEN 'error' ELSE 'success' END AS status,
      CASE WHEN b THEN '' WHEN p_partkey % 11 <> 0 AND p_partkey % 7 <> 0 THEN g
        ELSE 'part_' || p_partkey END AS gtin_or_output_name,
      CASE WHEN b THEN 0 ELSE CAST(p_partkey % 11 <> 0 AND p_partkey % 7 <> 0 AS INT)
        + CAST(p_size % 5 <> 0 AS INT) + CAST(p_size % 3 <> 0 AS INT) + CAST(p_size % 4 <> 0 AS INT)
        + CAST(p_size % 6 <> 1 AS INT) + CAST(p_size % 2 = 0 AS INT) END AS mapped,
      CASE WHEN b THEN 'XMLParseError' ELSE '' END AS error_summary
    FROM (SELECT *, p_partkey % 50 = 3 AS b, {_SQL_GTIN} AS g FROM part))""")
def batch_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of ten entries; preview rows after unique naming."""
    sent = faulty_messages(spark, sf_dir).selectExpr(
        "CAST(p_partkey div 10 AS string) AS archive", "CAST(p_partkey % 10 AS int) AS entry_no",
        "concat('in/part ', p_partkey, '.xml') AS entry", "content",
    )
    named = batch.output_names(batch.file_results(convert(sent), "entry"))
    return batch.preview_rows(named).selectExpr(
        "status", "gtin_or_output_name", "CAST(mapped_count AS bigint) AS mapped_count",
        "split_part(error_summary, ':', 1) AS error_summary",
    )


@workload("""SELECT property_id, override, supported, CAST(n AS BIGINT) AS nested FROM (
    SELECT 'gs1:' || p_partkey AS property_id,
      CASE WHEN p_partkey % 2 = 0 THEN CASE WHEN p_size % 3 = 0 THEN 'object' ELSE 'text' END END AS override,
      NOT (p_partkey % 2 = 0 AND p_size % 4 = 0) AS supported,
      CASE WHEN p_partkey % 2 = 0 AND p_size % 3 = 0 THEN 1 ELSE 0 END AS n FROM part WHERE p_partkey % 3 <> 1
    UNION ALL SELECT 'gs1:' || p_partkey, CASE WHEN p_size % 3 = 0 THEN 'object' ELSE 'text' END,
      p_size % 4 <> 0, CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END
      FROM part WHERE p_partkey % 3 = 1 AND p_partkey % 2 = 0)""")
def authoring_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    properties = part.filter("p_partkey % 3 <> 1").selectExpr(
        "concat('gs1:', p_partkey) AS term_id", "array('xsd:string') AS range"
    )
    stated = part.filter("p_partkey % 2 = 0")
    fields = stated.selectExpr(
        "concat('gs1:', p_partkey) AS property_id", "1 AS field_pos",
        "IF(p_size % 3 = 0, 'object', 'text') AS input_type_override",
        "IF(p_size % 4 = 0, false, NULL) AS supported", "'gs1:T' AS object_type",
        "IF(p_size % 3 = 0, array(named_struct('property_id', 'gs1:c', 'input_type', 'text')), NULL) "
        "AS object_fields",
    )
    first_version = fields.withColumns(
        {"field_pos": F.lit(0), "input_type_override": F.lit("url"), "supported": F.lit(True)}
    )
    index = authoring.metadata_index(properties, fields.unionByName(first_version))
    return index.selectExpr(
        "property_id", "override", "supported",
        "CAST(coalesce(size(object_fields), 0) AS bigint) AS nested",
    )

"""Bulk authoring: (product, property, value) rows to JSON-LD documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tradeloom.fixed import (
    AUTHORING_NOTICE, DIGITAL_LINK_PREFIX, QUANTITY_WORDS, SCHEMA_CONTEXT_JSON,
    VOCABULARY_CONTEXT,
)
from tradeloom.functions import any_of, first_match, q, strings
from tradeloom.functions.checks import is_gtin_lenient, is_http_url
from tradeloom.functions.jsontext import json_object, json_string
from tradeloom.functions.numbers import number_text, to_decimal
from tradeloom.functions.text import compact_name, has_value, strip
from tradeloom.operators.extract import with_columns


def input_type(term: str = "property_id", ranges: str = "range", override: str = "override") -> str:
    """Input type of a property: override, else the first rule its range meets."""
    name = f"lower({compact_name(term)})"
    listed = f"coalesce({ranges}, CAST(array() AS array<string>))"

    def has(*names: str) -> str:
        return f"arrays_overlap({listed}, {strings(names)})"

    quantity = any_of([has("gs1:QuantitativeValue"),
                       *[f"contains({name}, {q(w)})" for w in QUANTITY_WORDS]])
    # Range names and input types.
    inferred = first_match(
        [
            (quantity, q("quantity")),
            (has("rdf:langString"), q("language_text")),
            (has("xsd:boolean"), q("checkbox")),
            (has("xsd:integer"), q("integer")),
            (has("xsd:float", "xsd:decimal", "xsd:double"), q("number")),
            (has("xsd:dateTime"), q("datetime")),
            (has("xsd:date"), q("date")),
            (has("xsd:anyURI"), q("url")),
            (f"{has('xsd:string')} OR size({listed}) = 0", q("text")),
        ],
        q("unsupported"),
    )
    return f"coalesce(nullif({override}, ''), {inferred})"


def metadata_index(properties: DataFrame, fields: DataFrame) -> DataFrame:
    """Vocabulary properties overlaid by manifest fields; the last field wins."""
    vocabulary = properties.select(F.col("term_id").alias("property_id"), "range")
    manifest = fields.groupBy("property_id").agg(
        F.max_by(
            F.struct("input_type_override", "supported", "object_type", "object_fields"),
            "field_pos",
        ).alias("m")
    )
    return vocabulary.join(manifest, "property_id", "full_outer").selectExpr(
        "property_id", "range", "m.input_type_override AS override",
        "coalesce(m.supported, true) AS supported", "m.object_type AS object_type",
        "m.object_fields AS object_fields",
    )


def latest_values(eav: DataFrame) -> DataFrame:
    """One value per product and property: the last by ``seq``.

    The maximum combines before the shuffle, so a product with a huge number of
    rows costs one row per distinct property.
    """
    cells = F.struct("value", "language", "unit_code")
    return (
        eav.groupBy("product_id", "property_id")
        .agg(F.max_by(cells, "seq").alias("c"), F.min("seq").alias("place"))
        .select("product_id", "property_id", "c.*", "place")
    )



def emitted(kind: str = "kind") -> str:
    """JSON fragment of one value by input type; null when it is left out."""
    number = number_text(to_decimal("value"))
    integral = f"CASE WHEN {strip('value')} RLIKE '^[+-]?[0-9]+$' THEN {number} END"
    tagged = json_object([("@language", json_string("language")), ("@value", json_string("value"))])
    quantity = json_object([("value", number), ("unitCode", json_string("unit_code"))])
    node = json_object([("@id", json_string("value"))])
    shaped = first_match(
        [
            (f"{kind} = 'language_text'",
             f"CASE WHEN language <> '' THEN concat('[', {tagged}, ']') END"),
            (f"{kind} = 'quantity'",
             f"CASE WHEN unit_code <> '' AND {number} IS NOT NULL THEN {quantity} END"),
            (f"{kind} = 'url'", f"CASE WHEN {is_http_url('value')} THEN {json_string('value')} END"),
            (f"{kind} = 'code'", node),
            (f"{kind} = 'integer'", integral),
            (f"{kind} = 'number'", number),
            (f"{kind} = 'checkbox'", "CASE WHEN lower(value) IN ('false', '0') THEN 'false' ELSE 'true' END"),
        ],
        json_string("value"),
    )
    return f"CASE WHEN {has_value('value')} THEN {shaped} END"


def author_jsonld(eav: DataFrame, metadata: DataFrame, root_class: str = "Product") -> DataFrame:
    """One JSON-LD document per product (``product_id``, ``jsonld``).

    ``eav``: product_id, property_id (``parent#child`` for nested values), value,
    language, unit_code, seq. Simple properties are sorted by id, nested objects
    follow, sorted as well. A product none of whose values can be emitted has a
    document with context and type; its identifier counts even if it is not emitted.
    """
    values = latest_values(eav).withColumns(
        {
            "parent": F.expr("IF(contains(property_id, '#'), "
                             "substring_index(property_id, '#', 1), NULL)"),
            "child": F.expr("IF(contains(property_id, '#'), "
                            "substring(property_id, instr(property_id, '#') + 1), NULL)"),
        }
    )
    known = metadata.withColumn("kind", F.expr(input_type()))
    simple_meta = known.select("property_id", "kind", "supported")
    simple = (
        values.filter("parent IS NULL")
        .join(simple_meta, "property_id", "left")
        .withColumn("kind", F.expr(f"coalesce(kind, {input_type('property_id', 'NULL', 'NULL')})"))
        .selectExpr("product_id", "0 AS part", "property_id",
                    f"{compact_name('property_id')} AS name",
                    "CASE WHEN coalesce(supported, true) AND kind NOT IN ('unsupported', 'object') "
                    f"THEN {emitted()} END AS fragment",
                    "IF(property_id = 'gs1:gtin', value, NULL) AS gtin")
    )
    children = known.filter("override = 'object' AND supported").select(
        F.col("property_id").alias("parent"), "object_type",
        F.posexplode("object_fields").alias("child_pos", "f"),
    ).selectExpr("parent", "object_type", "child_pos", "f.property_id AS child",
                 "f.input_type AS kind")
    nested_values = (
        values.filter("parent IS NOT NULL")
        .join(children, ["parent", "child"], "left")
        .selectExpr("product_id", "parent", "object_type", "child_pos",
                    f"{compact_name('child')} AS name",
                    f"CASE WHEN child_pos IS NOT NULL THEN {emitted()} END AS fragment")
    )
    typed = f"CASE WHEN object_type <> '' THEN concat('\"@type\":', {json_string('object_type')}) END"
    nested = (
        nested_values.groupBy("product_id", "parent", "object_type")
        .agg(F.array_sort(F.collect_list(F.when(
            F.col("fragment").isNotNull(), F.struct("child_pos", "name", "fragment")))).alias("c"))
        .selectExpr(
            "product_id", "1 AS part", "parent AS property_id",
            f"{compact_name('parent')} AS name",
            f"CASE WHEN size(c) > 0 THEN concat('{{', concat_ws(',', {typed}, transform(c, x -> concat("
            f"{json_string('x.name')}, ':', x.fragment))), '}}') END AS fragment",
            "CAST(NULL AS string) AS gtin",
        )
    )
    grouped = simple.unionByName(nested).groupBy("product_id").agg(
        F.max("gtin").alias("gtin"),
        F.array_sort(
            F.collect_list(
                F.when(F.col("fragment").isNotNull(),
                       F.struct("part", "property_id", "name", "fragment"))
            )
        ).alias("m"),
    )
    context = f'["{VOCABULARY_CONTEXT}",{SCHEMA_CONTEXT_JSON}]'
    head = json_object([
        ("@context", q(context)), ("@type", json_string(q(root_class))),
        ("@id", f"CASE WHEN {has_value('gtin')} THEN "
                + json_string(f"concat({q(DIGITAL_LINK_PREFIX)}, {strip('gtin')})") + " END"),
    ])
    # A later member of the same name replaces the earlier one but keeps its place.
    last = "filter(m, (x, i) -> NOT exists(slice(m, i + 2, size(m)), y -> y.name = x.name))"
    body = f"transform({last}, x -> concat({json_string('x.name')}, ':', x.fragment))"
    return grouped.selectExpr(
        "product_id",
        f"concat(left({head}, length({head}) - 1), IF(size(m) > 0, concat(',', "
        f"array_join({body}, ',')), ''), '}}') AS jsonld",
    )


def authoring_warnings(eav: DataFrame, metadata: DataFrame) -> DataFrame:
    """Distinct warnings per product: ``product_id``, ``position``, ``warning``.

    Positions order a product's warnings: the notice and the identifier, then simple
    properties as first entered, then nested ones in the order of their object.
    """
    values = latest_values(eav)
    known = metadata.withColumn("kind", F.expr(input_type()))
    simple = values.filter("NOT contains(property_id, '#')").join(
        known.select("property_id", "kind", "supported", "range"), "property_id", "left"
    )
    simple = with_columns(
        simple,
        {
            "kind": f"coalesce(kind, {input_type('property_id', 'NULL', 'NULL')})",
            "supported": "coalesce(supported, true)",
        },
    )
    kept = (f"{has_value('value')} OR kind = 'checkbox' "
            "OR (kind = 'quantity' AND coalesce(unit_code, '') <> '')")
    number = f"{to_decimal('value')} IS NOT NULL"
    integral = f"{strip('value')} RLIKE '^[+-]?[0-9]+$'"
    some_value = "coalesce(value, '') <> ''"
    unit = "coalesce(unit_code, '') <> ''"
    # Warning texts.
    rules = [
        ("NOT supported", "concat(property_id, ' is not supported in v0.10 and will not be emitted.')"),
        ("kind = 'unsupported'",
         "concat(property_id, ' has unsupported nested or complex range (', "
         "coalesce(nullif(array_join(range, ', '), ''), 'unknown range'), "
         "') and will not be emitted.')"),
        (f"kind = 'url' AND {some_value} AND NOT {is_http_url('value')}",
         "concat(property_id, ' is not a valid HTTP(S) URL.')"),
        (f"kind = 'language_text' AND {some_value} AND coalesce(language, '') = ''",
         "concat(property_id, ' needs a language tag.')"),
        (f"{some_value} AND ((kind IN ('number', 'quantity') AND NOT coalesce({number}, false)) "
         f"OR (kind = 'integer' AND NOT {integral}))",
         "concat(property_id, ' must be a valid number.')"),
        (f"kind = 'quantity' AND {some_value} AND NOT {unit}",
         "concat(property_id, ' has a quantity value without unitCode.')"),
        (f"kind = 'quantity' AND {unit} AND NOT {some_value}",
         "concat(property_id, ' has unitCode without a quantity value.')"),
    ]

    def numbered(cases: list[str], section: str, place: str) -> str:
        rows = ", ".join(
            f"named_struct('position', named_struct('section', {section}, 'place', CAST({place} AS bigint), "
            f"'rule', {k}), 'warning', {case})" for k, case in enumerate(cases)
        )
        return f"inline(filter(array({rows}), x -> x.warning IS NOT NULL))"

    cases = [f"CASE WHEN {t} THEN {m} END" for t, m in rules]
    per_value = simple.filter(kept).selectExpr("product_id", numbered(cases, "1", "place"))
    gtins = values.groupBy("product_id").agg(
        F.max(F.expr("IF(property_id = 'gs1:gtin', value, NULL)")).alias("gtin")
    )
    absent = ("Missing GTIN. The generated JSON-LD will not include a GS1 Digital "
              "Link-style @id.")
    gtin_case = (
        f"CASE WHEN NOT {has_value('gtin')} THEN {q(absent)} "
        f"WHEN NOT {is_gtin_lenient('gtin')} THEN 'Invalid GTIN format or check digit.' END"
    )
    per_product = gtins.selectExpr("product_id", numbered([q(AUTHORING_NOTICE), gtin_case], "0", "0"))
    children = known.filter("override = 'object'").select(
        F.col("property_id").alias("parent"), F.posexplode("object_fields").alias("child_pos", "f")
    ).selectExpr("concat(parent, '#', f.property_id) AS property_id", "child_pos",
                 "concat(parent, ' / ', f.property_id) AS label", "f.input_type AS kind")
    nested_cases = [
        f"CASE WHEN kind = 'url' AND NOT {is_http_url('value')} "
        "THEN concat(label, ' is not a valid HTTP(S) URL.') END",
        "CASE WHEN kind = 'language_text' AND coalesce(language, '') = '' "
        "THEN concat(label, ' needs a language tag.') END",
    ]
    nested = values.join(children, "property_id").filter(has_value("value")).selectExpr(
        "product_id", numbered(nested_cases, "2", "child_pos")
    )
    every = per_product.unionByName(per_value).unionByName(nested)
    return every.groupBy("product_id", "warning").agg(F.min("position").alias("position"))

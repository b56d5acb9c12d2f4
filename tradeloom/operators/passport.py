"""Product passports: tolerant reading of product JSON-LD and the envelope."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tradeloom.fixed import (
    DIGITAL_LINK_PREFIX, PASSPORT_BUILDER, PASSPORT_ID_PREFIX, PASSPORT_MODE,
    PASSPORT_NOTICE, PASSPORT_SCHEMA, PASSPORT_STATUS, PASSPORT_TYPE,
    PASSPORT_VALIDATION_NOTE, PASSPORT_VERSION, VOCABULARY_CONTEXT,
)
from tradeloom.functions import extract, let, q
from tradeloom.functions.jsontext import json_object, json_string
from tradeloom.functions.linked import is_object, language_entries, member, scalar
from tradeloom.functions.text import has_value, strip
from tradeloom.operators.extract import with_columns
from tradeloom.operators.structure import PASSPORT_RULES, CheckRule, check

# Spellings under which a product may carry a property.
_NAME_KEYS = ("productName", "gs1:productName", "name", "schema:name")
_DESCRIPTION_KEYS = (
    "productDescription", "gs1:productDescription", "description", "schema:description",
)
_BRAND_KEYS = ("brand", "brandName", "gs1:brand", "gs1:brandName", "schema:brand")


def _first_entry(value: str) -> str:
    return f"get({language_entries(value)}, 0).value"


def first_text(doc: str, keys: tuple[str, ...]) -> str:
    """First usable value of the first key that has one."""
    return f"coalesce({', '.join(_first_entry(member(doc, k)) for k in keys)})"


def identifier(doc: str) -> str:
    """``@id``, else ``id``; an empty one counts as none."""
    at, plain = member(doc, "@id"), member(doc, "id")
    return f"nullif({scalar(f'coalesce({at}, {plain})')}, '')"


def gtin(doc: str) -> str:
    """GTIN from a direct field, else from a digital-link identifier."""
    direct = []
    for key in ("gtin", "gs1:gtin"):
        value = member(doc, key)
        text = f"CASE WHEN schema_of_variant({value}) = 'STRING' THEN CAST({value} AS string) END"
        direct.append(f"CASE WHEN {has_value(text)} THEN {strip(text)} END")
        direct.append(f"nullif({strip(scalar(member(value, '@value')))}, '')")
    linked = f"nullif({extract(identifier(doc), r'/01/([0-9]{8,14})')}, '')"
    return f"coalesce({', '.join(direct)}, {linked})"


def brand(doc: str) -> str:
    """Brand text; a nested brand object gives its name."""

    def of(value: str) -> str:
        text = f"CASE WHEN schema_of_variant({value}) = 'STRING' THEN CAST({value} AS string) END"
        inner = f"coalesce({member(value, 'name')}, {value})"
        return (
            f"coalesce(CASE WHEN {has_value(text)} THEN {strip(text)} END, "
            f"CASE WHEN {is_object(value)} THEN {_first_entry(inner)} END, {_first_entry(value)})"
        )

    return f"coalesce({', '.join(let(member(doc, k), of) for k in _BRAND_KEYS)})"


def read_products(objects: DataFrame) -> DataFrame:
    """Add identifier, GTIN, name, description and brand to a ``doc`` column."""
    return with_columns(
        objects,
        {
            "product_id": identifier("doc"),
            "gtin": gtin("doc"),
            "product_name": first_text("doc", _NAME_KEYS),
            "product_description": first_text("doc", _DESCRIPTION_KEYS),
            "brand": brand("doc"),
        },
    )


@dataclass(frozen=True)
class PassportOptions:
    passport_id: str | None = None
    passport_type: str = PASSPORT_TYPE
    passport_version: str = PASSPORT_VERSION
    status: str = PASSPORT_STATUS
    default_language: str = "en"
    include_source: bool = True
    schema_name: str = PASSPORT_SCHEMA
    notice: str = PASSPORT_NOTICE
    generated_at: str | None = None


def build_passports(objects: DataFrame, options: PassportOptions | None = None) -> DataFrame:
    """Wrap products (``doc`` VARIANT, ``text`` JSON) in passport envelopes.

    Deterministic: a timestamp appears only if the options bring one. Adds
    ``passport_id`` and ``passport`` (JSON text).
    """
    o = options or PassportOptions()
    rows = read_products(objects)
    fallback = f"concat({q(PASSPORT_ID_PREFIX)}, coalesce(gtin, 'unidentified'))"
    rows = with_columns(
        rows, {"passport_id": q(o.passport_id) if o.passport_id else fallback}
    )
    node_id = f"coalesce(product_id, concat({q(DIGITAL_LINK_PREFIX)}, gtin))"

    def text(value: str) -> str:
        return json_string(q(value))

    def nullable(value: str) -> str:
        return f"coalesce({json_string(value)}, 'null')"

    # Member names and their order.
    members = [
        ("@context", text(VOCABULARY_CONTEXT)),
        ("@type", text("Product")),
        ("@id", json_string(node_id)),
        ("productPassportId", json_string("passport_id")),
        ("passportType", text(o.passport_type)),
        ("passportVersion", text(o.passport_version)),
        ("status", text(o.status)),
        ("prototypeNotice", text(o.notice)),
        ("defaultLanguage", text(o.default_language)),
        ("source", json_object([
            ("sourceType", text("gs1-web-vocabulary-jsonld")),
            ("sourceFormat", text("json-ld")),
            ("sourceGtin", nullable("gtin")),
            ("sourceProductName", nullable("product_name")),
        ])),
        ("validation", json_object([
            ("validationMode", text(PASSPORT_MODE)),
            ("schema", text(o.schema_name)),
            ("note", text(PASSPORT_VALIDATION_NOTE)),
        ])),
        ("createdByVersion", text(PASSPORT_BUILDER)),
    ]
    if o.generated_at:
        members.append(("generatedAt", text(o.generated_at)))
    if o.include_source:
        members.append(("product", "text"))
    return with_columns(
        rows, {"passport": f"CASE WHEN doc IS NOT NULL THEN {json_object(members)} END"}
    )


def validate_passports(
    passports: DataFrame, rules: tuple[CheckRule, ...] = PASSPORT_RULES
) -> DataFrame:
    """Structural report of built passports; the product columns stay."""
    parsed = passports.withColumn("doc", F.expr("try_parse_json(passport)"))
    return check(parsed, rules)


def passport_summary(validated: DataFrame) -> DataFrame:
    doc = "doc"
    source, validation = member(doc, "source"), member(doc, "validation")
    # Column names.
    return validated.selectExpr(
        "passport_id AS productPassportId",
        *[f"{member(doc, k, 'string')} AS {k}"
          for k in ("passportType", "passportVersion", "status")],
        f"{member(source, 'sourceGtin', 'string')} AS sourceGtin",
        f"{member(source, 'sourceProductName', 'string')} AS sourceProductName",
        f"{q(PASSPORT_MODE)} AS validationMode",
        f"{member(validation, 'schema', 'string')} AS schema",
        "validation_status AS structuralValidationStatus",
        "validator_mode AS validatorMode", "size(errors) AS errorCount",
        f"{member(doc, 'prototypeNotice', 'string')} AS prototypeNotice",
        f"{q(PASSPORT_BUILDER)} AS builderVersion",
    )

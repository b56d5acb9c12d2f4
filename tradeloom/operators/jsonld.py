"""JSON-LD text of a canonical product (SQL expression text)."""

from __future__ import annotations

import json

from tradeloom.fixed import DIGITAL_LINK_PREFIX, PRODUCT_TYPE
from tradeloom.functions import keep, q, transform
from tradeloom.functions.jsontext import (
    json_array, json_object, json_string, json_string_array,
)
from tradeloom.functions.numbers import number_text
from tradeloom.operators.extract import object_json
from tradeloom.sources.profile import Profile

# Output order of the simple properties.
_SIMPLE_ORDER = (
    ("gtin", "text"), ("product_name", "language"), ("product_description", "language"),
    ("brand_name", "text"), ("gpc_category_code", "text"), ("product_image_url", "list"),
    ("product_page_url", "text"), ("ingredient_statement", "language"),
)


def language_values(values: str) -> str:
    """Distinct non-empty (value, language) pairs, first one kept."""
    return f"array_distinct({keep(values, lambda v: f'{v}.value <> {q(str())}')})"


def language_json(values: str) -> str:
    """JSON array of language values; null when none is left."""
    pairs = transform(
        language_values(values),
        lambda v: json_object(
            [("@value", json_string(f"{v}.value")), ("@language", json_string(f"{v}.language"))]
        ),
    )
    return f"nullif({json_array(pairs)}, '[]')"


def _list_json(values: str) -> str:
    return f"nullif({json_string_array(f'array_distinct({values})')}, '[]')"


def product_jsonld(profile: Profile, product: str = "product") -> str:
    """One compact JSON document; members without a value are left out."""
    targets = {rule.canonical_field: rule.jsonld_property for rule in profile.fields}
    context = json.dumps(list(profile.context), ensure_ascii=False, separators=(",", ":"))
    members = [("@context", q(context)), ("@type", q(json.dumps(PRODUCT_TYPE)))]
    if "gtin" in targets:
        link = f"concat({q(DIGITAL_LINK_PREFIX)}, {product}.gtin)"
        members.append(("@id", json_string(link)))
    spell = {
        "text": lambda v: json_string(f"nullif({v}, '')"),
        "language": language_json,
        "list": _list_json,
    }
    for name, shape in _SIMPLE_ORDER:
        if name in targets:
            members.append((targets[name], spell[shape](f"{product}.{name}")))
    if {"net_content_value", "net_content_unit"} <= set(targets):
        amount, unit = f"{product}.net_content_value", f"{product}.net_content_unit"
        measure = json_object([("value", number_text(amount)), ("unitCode", json_string(unit))])
        complete = f"{amount} IS NOT NULL AND {unit} IS NOT NULL"
        members.append((targets["net_content_value"], f"CASE WHEN {complete} THEN {measure} END"))
    for j, rule in enumerate(profile.objects):
        fragments = object_json(j)
        value = f"nullif({json_array(fragments)}, '[]')" if rule.multiple else f"get({fragments}, 0)"
        members.append((rule.jsonld_property, value))
    return json_object(members)

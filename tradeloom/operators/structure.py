"""Structural document checks as a table of rules over VARIANT documents.

The two shipped schemas are expressed as rules ``(path, kind, argument)``. This is
not a general schema engine.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tradeloom.fixed import (
    FALLBACK_WARNING, PASSPORT_SECTORS, PASSPORT_SOURCE_REQUIRED, PASSPORT_SOURCE_TYPES,
)
from tradeloom.functions import all_of, any_of, in_list, keep, matches, q, strings, transform
from tradeloom.functions.linked import member
from tradeloom.operators.extract import NO_TEXTS, SEAL, with_columns


@dataclass(frozen=True)
class CheckRule:
    """``kind``: required, type, enum, pattern or closed (no other members)."""

    path: str
    kind: str
    argument: tuple[str, ...] = ()


# The rules of the two shipped schemas.
PASSPORT_RULES = (
    CheckRule("@context", "required"),
    CheckRule("@type", "required"),
    CheckRule("@context", "type", ("string", "array", "object")),
    CheckRule("@type", "type", ("string", "array of string")),
    CheckRule("@id", "type", ("string",)),
    CheckRule("gs1:gtin", "type", ("string",)),
    CheckRule("gs1:productName", "type", ("string", "array")),
    CheckRule("gs1:description", "type", ("string", "array")),
    CheckRule("gs1:brand", "type", ("string", "array")),
    CheckRule("_prototype_note", "type", ("string",)),
)
MANIFEST_RULES = (
    CheckRule("schema_version", "required"),
    CheckRule("sources", "required"),
    CheckRule("schema_version", "type", ("string",)),
    CheckRule("generated_for", "type", ("string",)),
    CheckRule("prototype_note", "type", ("string",)),
    CheckRule("sources", "type", ("array",)),
    CheckRule("", "closed", ("schema_version", "generated_for", "prototype_note", "sources")),
)
MANIFEST_SOURCE_RULES = (
    *[CheckRule(name, "required") for name in PASSPORT_SOURCE_REQUIRED],
    *[
        CheckRule(name, "type", ("string",))
        for name in (
            "source_id", "title", "source_url", "source_type", "sector", "local_path",
            "license_or_rights_note", "proof_of_concept_note", "usage_note",
        )
    ],
    *[
        CheckRule(name, "type", ("string", "null"))
        for name in ("version", "sha256", "retrieved_at", "normalized_output")
    ],
    CheckRule("public_accessible", "type", ("boolean", "null")),
    CheckRule("used_by", "type", ("array of string",)),
    CheckRule("source_id", "pattern", ("^[a-z0-9_]+$",)),
    CheckRule("source_type", "enum", PASSPORT_SOURCE_TYPES),
    CheckRule("sector", "enum", PASSPORT_SECTORS),
    CheckRule(
        "", "closed",
        ("source_id", "title", "source_url", "source_type", "version", "sector", "local_path",
         "sha256", "retrieved_at", "public_accessible", "license_or_rights_note",
         "proof_of_concept_note", "usage_note", "used_by", "normalized_output"),
    ),
)


def _is_type(value: str, name: str) -> str:
    kind = f"schema_of_variant({value})"
    if name == "array of string":
        entries = f"try_cast({value} AS array<variant>)"
        odd = keep(entries, lambda e: f"schema_of_variant({e}) <> 'STRING'")
        return f"(startswith({kind}, 'ARRAY') AND size({odd}) = 0)"
    return {
        "string": f"{kind} = 'STRING'",
        "boolean": f"{kind} = 'BOOLEAN'",
        "null": f"is_variant_null({value})",
        "array": f"startswith({kind}, 'ARRAY')",
        "object": f"startswith({kind}, 'OBJECT')",
    }[name]


def _place(member_name: str, within: str | None) -> str:
    """SQL text of the place that a message names; ``within`` is the path to the document."""
    if within is None:
        return q(f"[{member_name or 'root'}] ")
    return f"concat('[', {within}, {q('.' + member_name if member_name else '')}, '] ')"


def _violation(document: str, rule: CheckRule, within: str | None = None) -> str:
    """Message text, or null if the rule holds."""
    value = member(document, rule.path)
    place = _place("" if rule.kind in ("required", "closed") else rule.path, within)
    names = f"map_keys(try_variant_get({document}, '$', 'map<string,variant>'))"
    if rule.kind == "required":
        bad = f"NOT coalesce(array_contains({names}, {q(rule.path)}), false)"
        text = q(f"'{rule.path}' is a required property")
    elif rule.kind == "type":
        fits = any_of(_is_type(value, t) for t in rule.argument)
        bad = f"{value} IS NOT NULL AND NOT {fits}"
        text = q(f"is not of type {' or '.join(rule.argument)}")
    elif rule.kind == "enum":
        text_value = member(document, rule.path, "string")
        bad = f"{value} IS NOT NULL AND NOT coalesce({in_list(text_value, rule.argument)}, false)"
        text = q(f"is not one of {list(rule.argument)}")
    elif rule.kind == "pattern":
        text_value = member(document, rule.path, "string")
        bad = all_of([f"schema_of_variant({value}) = 'STRING'",
                      f"NOT {matches(text_value, rule.argument[0])}"])
        text = q(f"does not match '{rule.argument[0]}'")
    elif rule.kind == "closed":
        extra = f"array_sort(array_except({names}, {strings(rule.argument)}))"
        bad = f"size({extra}) > 0"
        text = (
            f"concat('Additional properties are not allowed (', "
            f"array_join({transform(extra, lambda e: f'concat(chr(39), {e}, chr(39))')}, ', '), ')')"
        )
    else:
        raise ValueError(f"Unknown rule kind: {rule.kind}")
    return f"CASE WHEN {bad} THEN concat({place}, {text}) END"


def violations(document: str, rules: tuple[CheckRule, ...], within: str | None = None) -> str:
    """All messages of a VARIANT document, as an array; ``within`` is SQL text of the path to it."""
    cases = ", ".join(_violation(document, r, within) for r in rules)
    whole = f"CASE WHEN NOT startswith(schema_of_variant({document}), 'OBJECT') " \
            f"THEN array(concat({_place('', within)}, 'is not of type object')) " \
            f"ELSE array_compact(array({cases})) END"
    return whole


def check(docs: DataFrame, rules: tuple[CheckRule, ...] = PASSPORT_RULES) -> DataFrame:
    """Validation report columns for a ``doc`` VARIANT column.

    A null ``doc`` (unreadable input) is a ``schema_error``.
    """
    # Status names and texts.
    return with_columns(
        docs,
        {
            "errors": f"CASE WHEN doc IS NULL AND {SEAL} THEN array('Instance is not valid JSON') "
            f"ELSE {violations('doc', rules)} END",
        },
    ).withColumns(
        {
            "validation_status": F.expr(
                "CASE WHEN doc IS NULL THEN 'schema_error' "
                "WHEN size(errors) = 0 THEN 'valid' ELSE 'invalid' END"
            ),
            "warnings": F.expr(NO_TEXTS),
            "validator_mode": F.lit("rules"),
        }
    )


def manifest_violations(docs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, entry_no, message`` of source manifests (``doc`` VARIANT): every broken rule with its place.

    ``entry_no`` is null for rules of the manifest itself. Entries of ``sources`` are rows of their
    own, so a manifest of any length is checked entry by entry.
    """
    own = docs.selectExpr(
        *keys, "CAST(NULL AS int) AS entry_no", f"explode({violations('doc', MANIFEST_RULES)}) AS message"
    )
    listed = docs.selectExpr(*keys, "posexplode(try_variant_get(doc, '$.sources', 'array<variant>')) AS (entry_no, entry)")
    place = "concat('sources.', entry_no)"
    entries = listed.selectExpr(
        *keys, "entry_no", f"explode({violations('entry', MANIFEST_SOURCE_RULES, place)}) AS message"
    )
    unread = docs.filter("doc IS NULL").selectExpr(*keys, "CAST(NULL AS int) AS entry_no", "'Instance is not valid JSON' AS message")
    return own.unionByName(entries).unionByName(unread)


def check_required_only(docs: DataFrame, rules: tuple[CheckRule, ...] = PASSPORT_RULES) -> DataFrame:
    """The weaker check: presence of required members only, with its warning."""
    names = "map_keys(try_variant_get(doc, '$', 'map<string,variant>'))"
    required = [r.path for r in rules if r.kind == "required"]
    # Message texts.
    cases = ", ".join(
        f"CASE WHEN NOT coalesce(array_contains({names}, {q(name)}), false) THEN "
        f"{q(f"Required field '{name}' is missing (minimal fallback check).")} END"
        for name in required
    )
    return with_columns(
        docs,
        {
            "errors": f"array_compact(array({cases}))",
            "warnings": f"array({q(FALLBACK_WARNING)})",
            "validator_mode": q("minimal_fallback"),
        },
    ).withColumn("validation_status", F.expr("IF(size(errors) = 0, 'valid', 'invalid')"))

"""Reading loosely typed JSON-LD values held as VARIANT (SQL expression text).

A value may be a scalar, a list, ``{"@id"}``, ``{"@value"}`` or ``{"@list"}``.
Lists are followed as deep as they go: each pass opens one level, and there are as many
passes as lists are nested. Values that are no lists and hold none skip all that.
"""

from __future__ import annotations

from tradeloom.functions import fresh, keep, let, q, some, transform
from tradeloom.functions.text import has_value

_NO_TEXTS = "CAST(array() AS array<string>)"
_NO_ITEMS = "CAST(array() AS array<variant>)"


def member(v: str, key: str, kind: str = "variant") -> str:
    """Member of an object by exact name; null when absent."""
    return f"try_variant_get({v}, {q(f'$["{key}"]')}, {q(kind)})"


def is_array(v: str) -> str:
    return f"startswith(schema_of_variant({v}), 'ARRAY')"


def is_object(v: str) -> str:
    return f"startswith(schema_of_variant({v}), 'OBJECT')"


def absent(v: str) -> str:
    return f"({v} IS NULL OR is_variant_null({v}))"


def items(v: str) -> str:
    """A list's entries, a single value as a list of one, nothing as none."""
    return (
        f"CASE WHEN {absent(v)} THEN {_NO_ITEMS} "
        f"WHEN {is_array(v)} THEN CAST({v} AS array<variant>) ELSE array({v}) END"
    )


def scalar(v: str) -> str:
    """A scalar as text; booleans are capitalised as the source system prints them."""
    text = f"CAST({v} AS string)"
    return f"IF(schema_of_variant({v}) = 'BOOLEAN', initcap({text}), {text})"


def _leaf(v: str) -> str:
    node_id, value = member(v, "@id"), member(v, "@value")
    return (
        f"CASE WHEN {absent(v)} THEN {_NO_TEXTS} "
        f"WHEN NOT {is_object(v)} THEN array({scalar(v)}) "
        f"WHEN {node_id} IS NOT NULL THEN array({scalar(node_id)}) "
        f"WHEN {value} IS NOT NULL THEN array({scalar(value)}) ELSE {_NO_TEXTS} END"
    )


def _listed(v: str) -> str:
    """The inner list of a list or of an object that has nothing but ``@list``; else null."""
    listed = member(v, "@list")
    plain = f"{member(v, '@id')} IS NULL AND {member(v, '@value')} IS NULL"
    return f"CASE WHEN {is_array(v)} THEN {v} WHEN {is_object(v)} AND {plain} THEN {listed} END"


def list_depth(v: str) -> str:
    """How deep lists are nested in a value; brackets inside its texts do not count. Linear in its length."""
    quoted = q(r'"[^"\\]*+(?:\\.[^"\\]*+)*+"')
    others = q(r"[^\[\]]")
    brackets = f"regexp_replace(regexp_replace(to_json({v}), {quoted}, ''), {others}, '')"
    so_far, bracket = fresh("depth"), fresh("bracket")
    now = f"{so_far}.now + IF({bracket} = '[', 1, -1)"
    return (
        f"aggregate(split({brackets}, ''), named_struct('now', 0, 'most', 0), ({so_far}, {bracket}) -> "
        f"named_struct('now', {now}, 'most', greatest({so_far}.most, {now})), {so_far} -> {so_far}.most)"
    )


def _opened(v: str, listed, inner) -> str:
    """Entries of a value after opening ``inner(entry)`` of all entries that are ``listed(entry)``, level by level."""
    found, level = fresh("found"), fresh("level")
    opened = transform(found, inner)
    return (
        f"IF({is_array(v)} OR {is_object(v)}, aggregate(sequence(0, {list_depth(v)}), {items(v)}, ({found}, {level}) -> "
        f"IF({some(found, listed)}, flatten({opened}), {found})), {items(v)})"
    )


def values(v: str) -> str:
    """All identifiers and literals of a value, as an array of text."""
    flat = _opened(
        v, lambda x: f"{_listed(x)} IS NOT NULL",
        lambda x: let(_listed(x), lambda i: f"IF({i} IS NULL, array({x}), {items(i)})"),
    )
    return f"flatten({transform(flat, _leaf)})"


def text(v: str, list_separator: str = "; ") -> str:
    """Readable text of a value; entries of lists, inner ones too, join with ``'; '``."""

    def one(e: str) -> str:
        value, node_id, listed = member(e, "@value"), member(e, "@id"), member(e, "@list")
        return (
            f"CASE WHEN {absent(e)} THEN '' WHEN NOT {is_object(e)} THEN {scalar(e)} "
            f"WHEN {value} IS NOT NULL THEN {scalar(value)} "
            f"WHEN {node_id} IS NOT NULL THEN {scalar(node_id)} "
            f"WHEN {listed} IS NOT NULL THEN array_join({values(listed)}, {q(list_separator)}) "
            "ELSE '' END"
        )

    parts = keep(transform(_opened(v, is_array, items), one), lambda t: f"{t} <> ''")
    return f"array_join({parts}, '; ')"


def types(v: str) -> str:
    """Type names, scalar or list."""
    return transform(items(v), scalar)


def language_entries(v: str) -> str:
    """``array<struct<value, language>>`` from strings and tagged objects.

    Accepts both spellings of the two keys; blank values are dropped.
    """

    def entry(e: str) -> str:
        tagged = f"coalesce({member(e, '@value')}, {member(e, 'value')})"
        language = f"coalesce({member(e, '@language')}, {member(e, 'language')})"
        return (
            f"CASE WHEN {is_object(e)} THEN named_struct('value', {scalar(tagged)}, "
            f"'language', nullif({scalar(language)}, '')) "
            f"WHEN schema_of_variant({e}) = 'STRING' THEN named_struct("
            f"'value', CAST({e} AS string), 'language', CAST(NULL AS string)) END"
        )

    return keep(transform(items(v), entry), lambda x: has_value(f"{x}.value"))

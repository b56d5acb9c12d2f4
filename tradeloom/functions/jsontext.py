"""JSON text assembly with a chosen key order (SQL expression text).

``to_json`` of a struct prints decimals with all their zeros and cannot embed
already rendered fragments, so documents are put together from text fragments.
A null fragment means "leave the member out".
"""

from __future__ import annotations

from collections.abc import Iterable

from tradeloom.functions import let, matches, q, transform


def json_string(e: str) -> str:
    """Quoted and escaped JSON string; null stays null."""

    def quote(v: str) -> str:
        special = matches(v, r'["\\\x00-\x1f]')
        encoded = f"to_json(named_struct('v', {v}))"
        escaped = f"substring({encoded}, 6, length({encoded}) - 6)"
        return f"CASE WHEN {special} THEN {escaped} ELSE concat('\"', {v}, '\"') END"

    return let(e, quote)


def json_object(members: Iterable[tuple[str, str]]) -> str:
    """Object from (key, fragment) pairs, skipping null fragments."""
    parts = [f"concat({q(chr(34) + key + chr(34) + ':')}, {fragment})" for key, fragment in members]
    return f"concat('{{', concat_ws(',', {', '.join(parts)}), '}}')"


def json_array(fragments: str) -> str:
    """Array from an array of fragments; null array stays null."""
    return f"concat('[', array_join({fragments}, ','), ']')"


def json_string_array(values: str) -> str:
    return json_array(transform(values, json_string))

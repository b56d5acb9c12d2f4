"""Decimals as exact text, and the number spelling used in JSON output (SQL text).

A decimal keeps its own digits: no precision is lost and no length is too long. Only
exponents beyond six digits are refused, as their integers could not be written out.
"""

from __future__ import annotations

from tradeloom.functions import extract, let, matches, replace
from tradeloom.functions.text import strip

_DECIMAL = r"\A[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?0*[0-9]{1,6})?\z"
_INTEGER = r"\A(?:0|-?[1-9][0-9]*)\z"
#: In at most 16 signs, and not small enough for an exponent: the digits are the float's own.
_SHORT = r"\A(?:0|-?(?:[1-9][0-9]*(?:\.[0-9]*[1-9])?|0\.(?!0000)[0-9]*[1-9]))\z"


def to_decimal(e: str) -> str:
    """Text of a decimal without spaces and underscores, or null. NaN and infinities are none."""
    return let(
        strip(replace(e, "_")), lambda t: f"CASE WHEN {matches(t, _DECIMAL)} THEN {t} END"
    )


def _float_text(t: str) -> str:
    """Shortest float form: plain from 1e-4 up to 1e16, else with an exponent of two digits."""

    def spell(d: str) -> str:
        digits = f"rtrim('0', replace(substring_index({d}, 'E', 1), '.', ''))"
        power = f"CAST(substring_index({d}, 'E', -1) AS int)"
        point = f"overlay({digits} PLACING '.' FROM 2 FOR 0)"
        sign = f"IF({power} < 0, '-', '+')"
        exponent = f"lpad(CAST(abs({power}) AS string), greatest(2, length(CAST(abs({power}) AS string))), '0')"
        return (
            f"CASE WHEN {power} < -4 OR {power} >= 16 THEN concat(IF(length({digits}) = 1, {digits}, {point}), "
            f"'e', {sign}, {exponent}) "
            f"WHEN {power} < 0 THEN concat('0.', repeat('0', -{power} - 1), {digits}) "
            f"WHEN length({digits}) <= {power} + 1 THEN concat(rpad({digits}, {power} + 1, '0'), '.0') "
            f"ELSE overlay({digits} PLACING '.' FROM {power} + 2 FOR 0) END"
        )

    size = f"abs(CAST({t} AS double))"
    scientific = let(
        f"CAST({size} AS string)",
        # Plain forms, 0.001 to 10,000,000, are brought to one digit before the point.
        lambda s: f"CASE WHEN contains({s}, 'E') THEN {s} WHEN startswith({s}, '0.') "
        f"THEN concat(overlay(ltrim('0', substring({s}, 3)) PLACING '.' FROM 2 FOR 0), 'E-', "
        f"CAST(length({s}) - 1 - length(ltrim('0', substring({s}, 3))) AS string)) "
        f"ELSE concat(overlay(replace({s}, '.', '') PLACING '.' FROM 2 FOR 0), 'E', CAST(length(substring_index({s}, '.', 1)) - 1 AS string)) END",
    )
    return f"concat(IF(startswith({t}, '-'), '-', ''), {let(scientific, spell)})"


def _long_form(t: str) -> str:
    mantissa = replace(t, r"\A[+-]|[eE].*\z")
    power = f"coalesce(CAST(nullif({extract(t, '[eE]([+-]?[0-9]+)')}, '') AS int), 0)"

    def spell(m: str) -> str:
        digits = f"replace({m}, '.', '')"
        bare = f"rtrim('0', {digits})"
        places = f"length(substring_index(concat({m}, '.'), '.', 2)) - 1 - length(substring_index({m}, '.', 1))"
        scale = f"({places} - {power} - (length({digits}) - length({bare})))"
        return (
            f"CASE WHEN {bare} = '' THEN '0' "
            f"WHEN {scale} <= 0 THEN concat(IF(startswith({t}, '-'), '-', ''), ltrim('0', {bare}), repeat('0', -{scale})) "
            f"ELSE {_float_text(t)} END"
        )

    return let(mantissa, spell)


def number_text(decimal: str) -> str:
    """Integral values as integers of any length, all others in shortest float form."""
    bare = let(
        f"CAST({decimal} AS string)",
        # Closing zeros of a plain fraction, as fixed-point decimals have them.
        lambda t: f"IF(contains({t}, '.') AND NOT contains(lower({t}), 'e'), rtrim('.', rtrim('0', {t})), {t})",
    )
    return let(
        bare,
        lambda t: f"CASE WHEN length({t}) <= 16 AND {matches(t, _SHORT)} THEN {t} "
        f"WHEN {matches(t, _INTEGER)} THEN {t} WHEN {t} IS NOT NULL THEN {_long_form(t)} END",
    )

"""Identifier and link checks (SQL expression text)."""

from __future__ import annotations

from tradeloom.functions import extract, matches, replace


def is_gtin(e: str) -> str:
    """8, 12, 13 or 14 digits with a correct mod-10 check digit; null is false.

    Positions count from the right, so length does not matter to the weights and
    the sum unrolls into long arithmetic that stays in generated code.
    """
    number = f"try_cast({e} AS bigint)"
    digits = [f"({number} div {10**p}) % 10 * {3 if p % 2 else 1}" for p in range(14)]
    shaped = matches(e, r"\A(?:[0-9]{8}|[0-9]{12,14})\z")
    return f"coalesce({shaped} AND ({' + '.join(digits)}) % 10 = 0, false)"


def is_gtin_lenient(e: str) -> str:
    """As ``is_gtin`` after dropping everything that is not a digit."""
    return is_gtin(replace(f"coalesce({e}, '')", "[^0-9]"))


def is_http_url(e: str) -> str:
    """HTTP(S) scheme and a non-empty host part (brackets must pair up)."""
    host = extract(e, r"(?i)\Ahttps?://([^/?#]+)")
    paired = f"contains({host}, '[') = contains({host}, ']')"
    return f"coalesce({host} <> '' AND {paired}, false)"

"""Named value transforms that a mapping profile may chain.

A transform maps SQL text to ``(value, error)`` SQL text. The registry is a plain
dict: a user adds an entry built from any SQL expression, including the name of a
UDF registered with Spark.
"""

from __future__ import annotations

from collections.abc import Callable

from tradeloom.functions import q, record, transform
from tradeloom.functions.checks import is_gtin, is_http_url
from tradeloom.functions.dates import iso_date
from tradeloom.functions.numbers import to_decimal
from tradeloom.functions.text import squeeze, strip

Step = Callable[[str], tuple[str, str]]

_NULL = "CAST(NULL AS string)"


def _plain(fn: Callable[[str], str]) -> Step:
    return lambda e: (fn(e), _NULL)


def _checked(test: Callable[[str], str], complaint: str) -> Step:
    def step(e: str) -> tuple[str, str]:
        return e, f"CASE WHEN NOT {test(e)} THEN concat(chr(39), {e}, {q(chr(39) + ' ' + complaint)}) END"

    return step


def _date(e: str) -> tuple[str, str]:
    _, error = _checked(lambda v: f"({iso_date(v)} IS NOT NULL)", "is not an ISO date or datetime")(e)
    return iso_date(e), error


# Transform names and complaint texts.
TRANSFORMS: dict[str, Step] = {
    "trim": _plain(strip),
    "normalize_whitespace": _plain(squeeze),
    "uppercase": _plain(lambda e: f"upper({e})"),
    "to_decimal": _checked(lambda e: f"({to_decimal(e)} IS NOT NULL)", "is not a decimal"),
    "to_date": _date,
    "validate_gtin": _checked(is_gtin, "is not a valid GTIN"),
    "validate_url": _checked(is_http_url, "is not a valid HTTP(S) URL"),
}


def apply_transform(e: str, name: str) -> str:
    """One transform as ``struct(value, error)``."""
    if name not in TRANSFORMS:
        raise ValueError(f"Unknown transform: {name}")
    value, error = TRANSFORMS[name](e)
    return record(value=value, error=error)


def apply_chain(hits: str, steps: tuple[str, ...]) -> str:
    """Run a chain over an array of ``(id, parent, lang, value, error)`` structs.

    The first failing step fixes the error and blanks the value. An unknown name
    fails every value that reaches it.
    """
    for name in steps:
        step = TRANSFORMS.get(name, lambda _: (_NULL, q(f"Unknown transform: {name}")))

        def run(h: str) -> str:
            value, error = step(f"{h}.value")
            return record(
                id=f"{h}.id", parent=f"{h}.parent", lang=f"{h}.lang",
                value=f"CASE WHEN {h}.error IS NULL THEN {value} END",
                error=f"coalesce({h}.error, {error})",
            )

        hits = transform(hits, run)
    return hits

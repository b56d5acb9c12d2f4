"""ISO date normalisation without time-zone shifts (SQL expression text)."""

from __future__ import annotations

from tradeloom.functions import extract, let, replace

_DAY = r"(?:\d{4}-\d{2}-\d{2}|\d{8}|\d{4}-W\d{2}(?:-\d)?|\d{4}W\d{2}\d?)"
_CLOCK = (
    r"(?:[01]\d|2[0-3])"
    r"(?:(?::[0-5]\d(?::[0-5]\d(?:[.,]\d+)?)?)|(?:[0-5]\d(?:[0-5]\d(?:[.,]\d+)?)?))?"
)
_ZONE = (
    r"(?:Z|[+-](?:[01]\d|2[0-3])"
    r"(?:(?::[0-5]\d(?::[0-5]\d(?:\.\d+)?)?)|(?:[0-5]\d(?:[0-5]\d(?:\.\d+)?)?))?)?"
)
_SHAPE = rf"\A({_DAY})(?:.{_CLOCK}{_ZONE})?\z"


def _week_date(day: str) -> str:
    """Calendar date of an ISO week date; null for weeks the year lacks."""
    week = f"try_cast({extract(day, r'W(\d{2})')} AS int)"
    weekday = f"coalesce(try_cast({extract(day, r'W\d{2}-?(\d)\z')} AS int), 1)"

    def in_year(month_day: str) -> str:
        return f"try_cast(concat(left({day}, 4), '-{month_day}') AS date)"

    jan4 = in_year("01-04")
    monday = f"date_sub({jan4}, weekday({jan4}))"
    fits = f"{week} BETWEEN 1 AND weekofyear({in_year('12-28')}) AND {weekday} BETWEEN 1 AND 7"
    return f"CASE WHEN {fits} THEN date_add({monday}, ({week} - 1) * 7 + {weekday} - 1) END"


def iso_date(e: str) -> str:
    """``YYYY-MM-DD`` as written in an ISO date or datetime, else null."""

    def calendar(day: str) -> str:
        plain = replace(day, r"\A(\d{4})(\d{2})(\d{2})\z", "$1-$2-$3")
        return (
            f"date_format(CASE WHEN contains({day}, 'W') THEN {_week_date(day)} "
            f"WHEN NOT startswith({day}, '0000') THEN try_cast({plain} AS date) END, "
            "'yyyy-MM-dd')"
        )

    return let(extract(e, _SHAPE), calendar)

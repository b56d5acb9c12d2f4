"""Product validation from the mapping report (SQL expression text)."""

from __future__ import annotations

from tradeloom.functions import first_match, q, record
from tradeloom.sources.profile import Profile


def _texts(cases: list[str]) -> str:
    if not cases:
        return "CAST(array() AS array<string>)"
    return f"array_compact(array({', '.join(cases)}))"


def validation(profile: Profile, report: str = "mapping_report", product: str = "product") -> str:
    """``struct(valid, errors, warnings)`` in rule order.

    Only simple fields count. A value that was found but has a failing sibling is
    reported with its error; a value that only failed is reported as not found.
    """
    errors, warnings = [], []
    for i, rule in enumerate(profile.fields):
        row = f"get({report}, {i})"
        # Message texts.
        if rule.required and rule.canonical_field == "gtin":
            absent = "Required field 'gtin' was not found. Cannot construct product @id."
        else:
            kind = "Required" if rule.required else "Optional"
            absent = f"{kind} field '{rule.id}' was not found."
        failed = f"{row}.status IN ('transform_error', 'validation_error')"
        message = first_match(
            [
                (f"NOT {row}.found", q(absent)),
                (failed, f"concat({q(f"Field '{rule.id}': ")}, {row}.message)"),
            ]
        )
        (errors if rule.required else warnings).append(message)
    names = {rule.canonical_field for rule in profile.fields}
    halves = [
        f"({product}.{name} IS NOT NULL)" if name in names else "false"
        for name in ("net_content_value", "net_content_unit")
    ]
    incomplete = "Net content is incomplete; both value and unit are required for JSON-LD."
    warnings.append(first_match([(f"{halves[0]} <> {halves[1]}", q(incomplete))]))
    return record(
        valid=f"size({_texts(errors)}) = 0", errors=_texts(errors), warnings=_texts(warnings)
    )


def validation_status(report: str) -> str:
    return first_match(
        [(f"NOT {report}.valid", q("invalid")), (f"size({report}.warnings) > 0", q("warnings"))],
        q("valid"),
    )

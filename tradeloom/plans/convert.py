"""The conversion plan: XML documents in, products and reports out.

Every step is a projection of the document's own row, so a corpus of any size is
converted in a single stage with no exchange; only reports across documents
(leftover profile, batch totals) shuffle, after partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tradeloom.operators.extract import (
    SEAL, canonical_product, mapping_report, select_elements, summarise_values,
    transform_values, with_columns,
)
from tradeloom.operators.jsonld import product_jsonld
from tradeloom.operators.leftovers import add_leftovers
from tradeloom.operators.validate import validation
from tradeloom.sources.profile import Profile, built_in_profile
from tradeloom.sources.xmlnodes import shred


def extract(docs: DataFrame, profile: Profile) -> DataFrame:
    """Shred and apply the rules; keeps the working columns."""
    transformed = transform_values(select_elements(shred(docs), profile), profile)
    return summarise_values(transformed, profile)


def convert(
    docs: DataFrame, profile: Profile | None = None, *, leftovers: bool = True,
    where: str | None = None,
) -> DataFrame:
    """Convert documents (``content`` plus any key columns).

    Adds ``product``, ``jsonld``, ``mapping_report``, ``validation``, ``unmapped``,
    ``error_type`` and ``error_message``. A malformed document keeps its row with
    the error filled in. ``leftovers=False`` skips the unread-element report.
    ``where`` is a predicate on the key columns: it holds before any document is
    parsed and reaches the scan, which a filter on the result would not.
    """
    docs = docs.filter(where) if where else docs
    profile = profile or built_in_profile()
    keys = [c for c in docs.columns if c != "content"]

    def if_parsed(expr: str) -> str:
        return f"CASE WHEN parse_error IS NULL AND {SEAL} THEN {expr} END"

    rows = with_columns(
        extract(docs, profile),
        {
            "product": if_parsed(canonical_product(profile)),
            "mapping_report": if_parsed(mapping_report(profile)),
        },
    )
    if leftovers:
        rows = add_leftovers(rows, profile)
    return rows.selectExpr(
        *keys,
        "product",
        f"{if_parsed(product_jsonld(profile))} AS jsonld",
        "mapping_report",
        f"{if_parsed(validation(profile))} AS validation",
        *([f"{if_parsed('unmapped')} AS unmapped"] if leftovers else []),
        "CASE WHEN parse_error IS NOT NULL THEN 'XMLParseError' END AS error_type",
        "parse_error AS error_message",
    )

"""Trade-item messages written from tables.

Spark derives one XML message per row, so conversion work grows with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tradeloom.functions import q


def spread(rows: DataFrame) -> DataFrame:
    """Give every core a share of narrow rows before work that is heavy per row.

    Big inputs already have at least as many splits as cores and stay untouched.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def deal(rows: DataFrame) -> DataFrame:
    """Deal narrow rows out to all cores, unless they come in as many files.

    Splits do not tell: a file with one row group is cut into many, but one task reads all its rows.
    """
    cores, splits = rows.sparkSession.sparkContext.defaultParallelism, rows.rdd.getNumPartitions()
    return rows if min(len(rows.inputFiles()), splits) >= cores else rows.repartition(max(cores, splits))


def escape(e: str) -> str:
    """Text content with XML markup characters escaped."""
    return f"replace(replace(replace({e}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def element(name: str, content: str, **attributes: str) -> str:
    """SQL text of an element; content and attribute values are SQL text."""
    opening = q(f"<m:{name}")
    for key, value in attributes.items():
        opening += f", {q(f' {key}=' + chr(34))}, {value}, {q(chr(34))}"
    return f"concat({opening}, '>', {content}, {q(f'</m:{name}>')})"


def join(*parts: str) -> str:
    return f"concat_ws('', {', '.join(parts)})"


def message(*parts: str) -> str:
    """A complete message around the given trade-item parts, as binary."""
    body = element("tradeItem", join(*parts))
    for name in ("catalogueItem", "transaction"):
        body = element(name, body)
    root = "catalogueItemNotificationMessage"
    opening = q(f'<m:{root} xmlns:m="urn:example:messages">')
    closing = q(f"</m:{root}>")
    return f"CAST(concat({opening}, {body}, {closing}) AS binary)"


def gtin14(number: str) -> str:
    """14-digit number: 13 digits from an integer and the check digit."""
    terms = [f"({number} div {10**k}) % 10 * {1 if k % 2 else 3}" for k in range(13)]
    return f"concat(lpad({number}, 13, '0'), (10 - ({' + '.join(terms)}) % 10) % 10)"

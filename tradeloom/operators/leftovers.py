"""What a profile left unread: elements with text that no rule accounts for."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tradeloom.fixed import (
    DISCRIMINATORS, FILE_CONTEXT_FIELDS, FILE_CONTEXT_PARENT, STRUCTURAL_ELEMENTS,
)
from tradeloom.functions import in_list, keep, let, q, record, transform
from tradeloom.functions.text import strip
from tradeloom.operators.extract import consumed_nodes, with_columns
from tradeloom.operators.nodesets import children, last_of, nearest, node
from tradeloom.sources.profile import Profile
from tradeloom.sources.xmlnodes import node_path, whole_text


def _context(n: str) -> str:
    """Sorted (key, value) pairs that tell apart elements sharing one path."""
    chain = f"concat({n}.anc, array({n}.id))"
    tagged = nearest(chain, lambda a: f"map_contains_key({a}.attrs, 'languageCode')")
    entries = {"languageCode": f"{tagged}.attrs['languageCode']"}

    parent = node(f"{n}.parent")
    for name in FILE_CONTEXT_FIELDS:

        def sibling(p: str) -> str:
            filled = keep(children(p, name), lambda c: f"{c}.filled")
            value = strip(let(last_of(filled), whole_text))
            return f"IF({p}.name = {q(FILE_CONTEXT_PARENT)}, {value}, NULL)"

        entries[name] = let(parent, sibling)

    for container, discriminator in DISCRIMINATORS.items():
        holder = nearest(chain, lambda a: f"{a}.name = {q(container)}")

        def code(h: str) -> str:
            texts = keep(children(h, discriminator), lambda c: f"{c}.text IS NOT NULL")
            return f"nullif({strip(f'get({texts}, 0).text')}, '')"

        entries[discriminator] = let(holder, code)

    pairs = [record(key=q(key), value=entries[key]) for key in sorted(entries)]
    return keep(f"array({', '.join(pairs)})", lambda p: f"{p}.value IS NOT NULL")


def add_leftovers(extracted: DataFrame, profile: Profile) -> DataFrame:
    """Add ``unmapped``: counted groups of unread elements, in report order.

    Counting sorts the document's own leftovers and measures run lengths, so it
    stays linear in the document apart from that sort.
    """

    def is_content(n: str) -> str:
        return f"{n}.filled AND NOT {in_list(f'{n}.name', STRUCTURAL_ELEMENTS)}"

    def key(i: str) -> str:
        return let(
            node(i),
            lambda n: record(
                element=f"{n}.name", path=node_path(n), context=_context(n),
                parent=f"{node(n + '.parent')}.name",
            ),
        )

    content = transform(keep("nodes", is_content), lambda n: f"{n}.id")
    extracted = with_columns(
        extracted, {"_open": f"array_except({content}, {consumed_nodes(profile)})"}
    )
    extracted = with_columns(extracted, {"_runs": f"array_sort({transform('_open', key)})"})
    extracted = with_columns(
        extracted,
        {
            "_heads": "filter(transform(_runs, (r, i) -> i), "
            "i -> i = 0 OR get(_runs, i) <> get(_runs, i - 1))"
        },
    )
    group = record(
        element="get(_runs, s).element", parent="get(_runs, s).parent",
        path="get(_runs, s).path",
        count="CAST(coalesce(get(_heads, j + 1), size(_runs)) - s AS bigint)",
        context="get(_runs, s).context",
    )
    return with_columns(
        extracted, {"unmapped": f"transform(_heads, (s, j) -> {group})"}
    ).drop("_open", "_runs", "_heads")


def leftover_profile(converted: DataFrame) -> DataFrame:
    """Leftovers of the whole corpus by element, parent, path and context."""
    rows = converted.select(F.explode("unmapped").alias("u")).select("u.*")
    return rows.groupBy("element", "parent", "path", "context").agg(
        F.sum("count").alias("count"), F.count("*").alias("documents")
    )

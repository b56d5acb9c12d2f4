"""Element selection over a document's node array (SQL expression text).

A path is tested bottom-up: starting from each candidate element, parents are
array look-ups. Results therefore come out in document order without duplicates,
in one pass over the candidates and without a join.
"""

from __future__ import annotations

from tradeloom.functions import all_of, in_list, keep, let, q, some
from tradeloom.functions.text import squeeze
from tradeloom.sources.profile import Condition, ElementPath, Step


def node(i: str) -> str:
    """The node with an id; null outside the document."""
    return f"get(nodes, {i})"


def below(n: str) -> str:
    """All elements inside a node: its contiguous id range."""
    return f"slice(nodes, {n}.id + 2, {n}.last - {n}.id)"


def children(n: str, name: str) -> str:
    return keep(below(n), lambda c: f"{c}.name = {q(name)} AND {c}.parent = {n}.id")


def last_of(array: str) -> str:
    """Last element or null."""
    return f"get(reverse({array}), 0)"


def nearest(chain: str, test) -> str:
    """Innermost node of an id chain (root first) that passes a test, or null."""
    return node(last_of(keep(chain, lambda i: test(node(i)))))


def _meets(n: str, condition: Condition) -> str:
    if condition.kind == "attribute":
        return f"map_contains_key({n}.attrs, {q(condition.name)})"

    def holds(d: str) -> str:
        code = squeeze(f"coalesce({d}.text, '')")
        near = [f"{d}.parent = {n}.id"] if condition.kind == "child" else []
        return all_of([f"{d}.name = {q(condition.name)}", *near, in_list(code, condition.codes)])

    return some(below(n), holds)


def _climb(n: str, steps: tuple[Step, ...]) -> tuple[list[str], str]:
    """Tests of the whole step chain, and the element matched by its first step."""
    names, conditions = [], []
    here = n
    for depth, step in enumerate(reversed(steps)):
        if depth:
            here = node(f"{here}.parent")
        names.append(f"{here}.name = {q(step.name)}")
        conditions += [_meets(here, c) for c in step.conditions]
    return names + conditions, here


def select_anywhere(path: ElementPath) -> str:
    def test(n: str) -> str:
        tests, top = _climb(n, path.steps)
        return all_of([*tests, f"{top}.parent >= 0"])

    return keep("nodes", test)


def select_from(n: str, path: ElementPath) -> str:
    """Elements selected relative to one node; null if its anchor is missing."""

    def under(anchor: str) -> str:
        def test(candidate: str) -> str:
            tests, top = _climb(candidate, path.steps)
            return all_of([*tests, f"{top}.parent = {anchor}.id"])

        return keep(below(anchor), test)

    if path.anchor == "ancestor":
        named = nearest(f"{n}.anc", lambda a: f"{a}.name = {q(path.ancestor)}")
        return let(named, under)
    return under(n)

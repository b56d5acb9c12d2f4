"""Expression helpers.

Every helper takes SQL expression text and returns SQL expression text, to be used
with ``selectExpr``/``F.expr`` or inside a larger expression. Rule-driven plans
consist of thousands of small expressions; as text they reach the JVM in one call
per column instead of one call per operator, and Catalyst sees the same tree.
"""

from __future__ import annotations

import re
from itertools import count

_counter = count()


def q(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def in_list(expr: str, values) -> str:
    return f"({expr} IN ({', '.join(q(v) for v in values)}))"


def strings(values) -> str:
    """Literal array of strings."""
    values = list(values)
    return f"array({', '.join(q(v) for v in values)})" if values else "CAST(array() AS array<string>)"


def fresh(stem: str) -> str:
    """Lambda variable name that cannot capture another one."""
    return f"{stem}_{next(_counter)}"


def transform(array: str, fn) -> str:
    x = fresh("x")
    return f"transform({array}, {x} -> {fn(x)})"


def keep(array: str, test) -> str:
    x = fresh("x")
    return f"filter({array}, {x} -> {test(x)})"


def some(array: str, test) -> str:
    x = fresh("x")
    return f"exists({array}, {x} -> {test(x)})"


def let(expr: str, fn) -> str:
    """Evaluate ``expr`` once and use it several times; plain names stay as they are."""
    if re.fullmatch(r"[\w.]+", expr):
        return fn(expr)
    x = fresh("v")
    return f"get(transform(array({expr}), {x} -> {fn(x)}), 0)"


def record(**cells: str) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in cells.items()) + ")"


def replace(expr: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({expr}, {q(pattern)}, {q(by)})"


def matches(expr: str, pattern: str) -> str:
    return f"({expr} RLIKE {q(pattern)})"


def extract(expr: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract({expr}, {q(pattern)}, {group})"


def all_of(tests) -> str:
    return "(" + " AND ".join(tests) + ")"


def any_of(tests) -> str:
    return "(" + " OR ".join(tests) + ")"


def first_match(cases, otherwise: str = "NULL") -> str:
    """Ordered ``CASE``: the first true condition decides."""
    body = " ".join(f"WHEN {test} THEN {value}" for test, value in cases)
    return f"CASE {body} ELSE {otherwise} END"

"""Profile-driven extraction from shredded documents.

All columns produced here are projections of one document row: the number of
shuffles is zero whatever the number of rules.

    h_<i>   selected elements of simple rule i (even those without a usable value)
    v_<i>   its non-blank values after the transform chain
    s_<i>   summary of v_<i>: found, errors, JSON fragments, canonical value
    o_<j>   parent elements of object rule j with the elements of each child rule
    w_<j>   the same after the transform chains
    t_<j>   per parent: canonical object, its JSON spellings, messages

Each stage reads the previous one by name, so no expression is evaluated twice and
the plan stays small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tradeloom.functions import any_of, first_match, keep, q, record, some, transform
from tradeloom.functions.jsontext import json_array, json_object, json_string
from tradeloom.functions.numbers import number_text
from tradeloom.functions.text import has_value, strip
from tradeloom.functions.transforms import apply_chain
from tradeloom.operators.nodesets import node, select_anywhere, select_from
from tradeloom.sources.profile import ObjectRule, Profile, Rule, read_value_path
from tradeloom.sources.xmlnodes import whole_text

HIT_TYPE = "array<struct<id:int,parent:int,lang:string,value:string,error:string>>"
NO_TEXTS = "CAST(array() AS array<string>)"
NO_IDS = "CAST(array() AS array<int>)"


# Always true, but not constant to the optimizer. A filter on a computed column is
# otherwise pushed below every projection it depends on, with all their expressions
# written out again, and the document would be evaluated twice.
SEAL = "rand(0) + 1 > 0"


def with_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add columns given as SQL expression text."""
    return df.withColumns({name: F.expr(text) for name, text in columns.items()})


# --- Selecting and transforming --------------------------------------------------


def _language(n: str, rule: Rule, default: str) -> str:
    fixed = q(rule.fallback_language or default)
    if not rule.language_xpath:
        return fixed
    attribute = q(read_value_path(rule.language_xpath)[1])
    return f"coalesce(nullif({n}.attrs[{attribute}], ''), {fixed})"


def _hits(elements: str, rule: Rule, default_language: str) -> str:
    kind, attribute = read_value_path(rule.value_xpath)

    def hit(n: str) -> str:
        raw = {
            "text": f"{n}.text",
            "content": whole_text(n),
            "attribute": f"{n}.attrs[{q(attribute)}]",
        }[kind]
        return record(
            id=f"{n}.id", parent=f"{n}.parent", lang=_language(n, rule, default_language),
            value=raw, error="CAST(NULL AS string)",
        )

    return f"coalesce({transform(elements, hit)}, CAST(array() AS {HIT_TYPE}))"


def _values(hits: str, rule: Rule) -> str:
    return apply_chain(keep(hits, lambda h: has_value(f"{h}.value")), rule.transform)


def select_elements(shredded: DataFrame, profile: Profile) -> DataFrame:
    """Add the ``h_``/``o_`` columns: which elements each rule picks."""
    language = profile.default_language
    columns = {
        f"h_{i}": _hits(select_anywhere(rule.path), rule, language)
        for i, rule in enumerate(profile.fields)
    }
    for j, parent_rule in enumerate(profile.objects):

        def parent(p: str) -> str:
            picks = {
                f"f{k}": _hits(select_from(p, rule.path), rule, language)
                for k, rule in enumerate(parent_rule.fields)
            }
            return record(id=f"{p}.id", parent=f"{p}.parent", **picks)

        columns[f"o_{j}"] = transform(select_anywhere(parent_rule.path), parent)
    return with_columns(shredded, columns)


def transform_values(selected: DataFrame, profile: Profile) -> DataFrame:
    """Add the ``v_``/``w_`` columns: transformed values and errors."""
    columns = {f"v_{i}": _values(f"h_{i}", rule) for i, rule in enumerate(profile.fields)}
    for j, parent_rule in enumerate(profile.objects):

        def parent(o: str) -> str:
            return record(
                **{f"f{k}": _values(f"{o}.f{k}", r) for k, r in enumerate(parent_rule.fields)}
            )

        columns[f"w_{j}"] = transform(f"o_{j}", parent)
    return with_columns(selected, columns)


# --- Summaries -------------------------------------------------------------------


def _good(values: str) -> str:
    return keep(values, lambda h: f"{h}.error IS NULL")


def _errors(values: str) -> str:
    return transform(keep(values, lambda h: f"{h}.error IS NOT NULL"), lambda h: f"{h}.error")


def _any_good(values: str) -> str:
    return some(values, lambda h: f"{h}.error IS NULL")


def _typed(h: str, rule: Rule) -> str:
    """A value in its canonical type."""
    if rule.datatype == "language_string":
        return record(value=f"{h}.value", language=f"{h}.lang")
    if "to_decimal" in rule.transform:
        return strip(f"replace({h}.value, '_', '')")  # the chain has checked it
    return f"{h}.value"


def _display(h: str, rule: Rule) -> str:
    """A value as it appears in the mapping report."""
    if rule.datatype == "language_string":
        return json_object(
            [("value", json_string(f"{h}.value")), ("language", json_string(f"{h}.lang"))]
        )
    if "to_decimal" in rule.transform:
        return number_text(_typed(h, rule))
    return json_string(f"{h}.value")


def _nest(names: list[str]) -> dict:
    """Order-keeping tree of dotted names; leaves are positions in ``names``."""
    tree: dict = {}
    for position, name in enumerate(names):
        *stems, leaf = name.split(".")
        place = tree
        for stem in stems:
            place = place.setdefault(stem, {})
        place.setdefault(leaf, []).append(position)
    return tree


def _leaf(positions: list[int], cells: list[str]) -> str:
    """A repeated name prefers its last value."""
    return f"coalesce({', '.join(cells[p] for p in reversed(positions))})"


def _present(tree: dict, cells: list[str]) -> str:
    return any_of(
        _present(value, cells) if isinstance(value, dict) else f"{_leaf(value, cells)} IS NOT NULL"
        for value in tree.values()
    )


def _struct(tree: dict, cells: list[str]) -> str:
    """Nested struct; a branch without values is null."""
    parts = {
        k: _struct(v, cells) if isinstance(v, dict) else _leaf(v, cells) for k, v in tree.items()
    }
    return f"CASE WHEN {_present(tree, cells)} THEN {record(**parts)} END"


def _json(tree: dict, cells: list[str], first: tuple = ()) -> str:
    """Nested JSON object; null without values."""
    members = [
        (k, _json(v, cells) if isinstance(v, dict) else _leaf(v, cells)) for k, v in tree.items()
    ]
    return f"CASE WHEN {_present(tree, cells)} THEN {json_object([*first, *members])} END"


def summarise_values(transformed: DataFrame, profile: Profile) -> DataFrame:
    """Add the ``s_``/``t_`` columns."""
    columns = {}
    for i, rule in enumerate(profile.fields):
        values = f"v_{i}"
        typed = transform(_good(values), lambda h: _typed(h, rule))
        columns[f"s_{i}"] = record(
            found=_any_good(values),
            errors=_errors(values),
            shown=transform(_good(values), lambda h: _display(h, rule)),
            value=typed if rule.multiple else f"get({typed}, 0)",
        )
    for j, parent_rule in enumerate(profile.objects):
        cells = transform(f"w_{j}", lambda w: _cells(w, parent_rule))
        columns[f"t_{j}"] = transform(cells, lambda c: _object(c, parent_rule))
    return with_columns(transformed, columns)


def _cells(w: str, parent_rule: ObjectRule) -> str:
    """One parent's canonical values, JSON fragments and messages."""
    parts, messages = {}, []
    for k, rule in enumerate(parent_rule.fields):
        values = f"{w}.f{k}"
        typed = transform(_good(values), lambda h: _typed(h, rule))
        shown = transform(_good(values), lambda h: _display(h, rule))
        if rule.multiple:
            parts[f"c{k}"] = f"CASE WHEN {_any_good(values)} THEN {typed} END"
            parts[f"j{k}"] = f"CASE WHEN {_any_good(values)} THEN {json_array(shown)} END"
        else:
            parts[f"c{k}"], parts[f"j{k}"] = f"get({typed}, 0)", f"get({shown}, 0)"
        label = q(f"{rule.id}: ")
        messages.append(transform(_errors(values), lambda e: f"concat({label}, {e})"))
        if rule.required:
            missing = q(f"{rule.id}: required value was not found")
            messages.append(f"IF({_any_good(values)}, {NO_TEXTS}, array({missing}))")
    return record(**parts, messages=f"concat({', '.join(messages)})")


def _object(c: str, parent_rule: ObjectRule) -> str:
    kept = [k for k, rule in enumerate(parent_rule.fields) if rule.canonical_field]
    values = [f"{c}.c{k}" for k in kept]
    fragments = [f"{c}.j{k}" for k in kept]
    by_field = _nest([parent_rule.fields[k].canonical_field for k in kept])
    by_property = _nest([parent_rule.fields[k].jsonld_property for k in kept])
    kind = parent_rule.object_type
    typed = (("@type", json_string(q(kind))),) if kind else ()
    return record(
        object=_struct(by_field, values),
        shown=_json(by_field, fragments),
        linked=_json(by_property, fragments, typed),
        messages=f"{c}.messages",
    )


def _of_parents(j: int, name: str) -> str:
    """One summary of every parent, without the empty ones."""
    return keep(transform(f"t_{j}", lambda t: f"{t}.{name}"), lambda x: f"{x} IS NOT NULL")


def object_json(j: int) -> str:
    """Distinct JSON-LD fragments of an object rule."""
    return f"array_distinct({_of_parents(j, 'linked')})"


# --- Products and mapping reports ------------------------------------------------


def canonical_product(profile: Profile) -> str:
    parts = {rule.canonical_field: f"s_{i}.value" for i, rule in enumerate(profile.fields)}
    for j, parent_rule in enumerate(profile.objects):
        parts[parent_rule.canonical_field] = _of_parents(j, "object")
    return record(**parts)


def _report_row(rule: Rule | ObjectRule, xpath: str, required: bool, **cells: str) -> str:
    return record(
        id=q(rule.id), description=q(rule.description), xpath=q(xpath),
        canonical_field=q(rule.canonical_field), jsonld_property=q(rule.jsonld_property),
        required=str(required).lower(), **cells,
    )


def _field_report(i: int, rule: Rule) -> str:
    found, problems, shown = f"s_{i}.found", f"s_{i}.errors", f"s_{i}.shown"
    checked = {"validate_gtin", "validate_url"} & set(rule.transform)
    # Status names and message texts.
    failure = q("validation_error" if checked else "transform_error")
    missing = q("missing_required" if rule.required else "missing_optional")
    absent = q(f"{'Required' if rule.required else 'Optional'} value was not found.")
    return _report_row(
        rule, rule.xpath, rule.required,
        found=found,
        value=json_array(shown) if rule.multiple else f"get({shown}, 0)",
        status=first_match(
            [(f"size({problems}) > 0", failure), (found, q("mapped"))], missing
        ),
        message=first_match(
            [
                (f"size({problems}) > 0", f"array_join({problems}, '; ')"),
                (found, q("Value mapped successfully.")),
            ],
            absent,
        ),
    )


def _object_report(j: int, parent_rule: ObjectRule) -> str:
    parents = f"t_{j}"
    problems = f"flatten({transform(parents, lambda t: f'{t}.messages')})"
    troubled = some(parents, lambda t: f"size({t}.messages) > 0")
    filled = some(parents, lambda t: f"{t}.shown IS NOT NULL")
    amount = f"size({keep(parents, lambda t: f'{t}.shown IS NOT NULL')})"
    # Status names and message texts.
    return _report_row(
        parent_rule, parent_rule.parent_xpath, any(r.required for r in parent_rule.fields),
        found=filled,
        value=json_array(_of_parents(j, "shown")),
        status=first_match(
            [(troubled, q("validation_error")), (filled, q("mapped"))], q("missing_optional")
        ),
        message=first_match(
            [
                (troubled, f"array_join({problems}, '; ')"),
                (filled, f"concat('Mapped ', {amount}, ' object(s).')"),
            ],
            q("Optional object mapping was not found."),
        ),
    )


def mapping_report(profile: Profile) -> str:
    """One row per rule, whether or not the document has a value for it."""
    rows = [_field_report(i, rule) for i, rule in enumerate(profile.fields)]
    rows += [_object_report(j, rule) for j, rule in enumerate(profile.objects)]
    return f"array({', '.join(rows)})"


# --- Consumed elements -----------------------------------------------------------


def consumed_nodes(profile: Profile) -> str:
    """Ids of the elements the rules account for.

    Selected elements count even when their value was blank or wrong. A found
    field also covers a wrapper of the same name, and the common parent of fields
    that together feed one property. Object rules cover their parents, the
    parents' parents, and whatever lies between a parent and a picked element; an
    element reached through an ancestor covers its ancestors up to the root.
    """
    parts: list[str] = []
    by_property: dict[str, list[str]] = {}
    for i, rule in enumerate(profile.fields):
        hits = f"h_{i}"
        parts.append(transform(hits, lambda h: f"{h}.id"))
        wrapped = keep(hits, lambda h: f"{node(h + '.parent')}.name = {node(h + '.id')}.name")
        wrappers = transform(wrapped, lambda h: f"{h}.parent")
        above = transform(hits, lambda h: f"{h}.parent")
        parts.append(f"IF(s_{i}.found, {wrappers}, {NO_IDS})")
        by_property.setdefault(rule.jsonld_property, []).append(
            f"IF(s_{i}.found, {above}, {NO_IDS})"
        )
    for shared in by_property.values():
        for a, one in enumerate(shared):
            parts += [f"array_intersect({one}, {other})" for other in shared[a + 1:]]
    for j, parent_rule in enumerate(profile.objects):

        def covered(o: str) -> str:
            def around(h: str) -> str:
                chain = f"{node(h + '.id')}.anc"
                inner = keep(chain, lambda a: f"{a} > {o}.id")
                return (
                    f"concat(array({h}.id), "
                    f"IF(array_contains({chain}, {o}.id), {inner}, {chain}))"
                )

            picked = [f"{o}.f{k}" for k in range(len(parent_rule.fields))]
            near = f"flatten({transform(f'concat({', '.join(picked)})', around)})"
            return f"concat(array({o}.id, {o}.parent), {near})"

        parts.append(f"flatten({transform(f'o_{j}', covered)})")
    return f"array_distinct(concat({', '.join(parts)}))"

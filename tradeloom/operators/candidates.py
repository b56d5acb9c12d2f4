"""Candidate source attributes for vocabulary properties.

Scoring every (property, attribute) pair would be a cross join. It is avoided
without losing a single result, by bounds:

* Pair-specific signals (shared tokens, equal names, catalog hits, resource names)
  need a common key. Attributes are posted under their keys; the postings of a key are
  cut into lists of one *shape*: the class (data type, unit, code list, deleted, row
  type) and rounded-down sizes of the token sets.
* A property's keys are ranked by how many attributes have them. If the rarest key that a
  pair shares is the *i*-th, all it shares are that and more frequent ones; with the shape of the
  list this bounds its score. The bound is the score's own formula with the most
  that is still possible, so it is never below the score, not even by rounding.
* A first pass scores the heads of each property's most promising lists. Its
  *k*-th score is a threshold: pairs from lists whose bound is below it are never made,
  and of lists that can only tie, just the rows that come before in tie order.
* For a pair without a common key the classes of both sides alone fix the score, and a
  common key can only raise it. Within one attribute class the first ``k`` attributes in tie
  order therefore dominate all later ones, so at most ``k`` per class are looked at.
* Joins that find pairs move ids and keys; texts join the winners.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tradeloom.fixed import (
    ALREADY_MAPPED_STATUSES, BAND_HIGH, BAND_LOW, BAND_MEDIUM, BEST_ROW_STATUSES,
    BLOCKING_NOTES, CANDIDATE_VERSION, CATALOG_SIGNAL_STATUSES, COMPATIBLE_TYPES,
    CONFIDENCE_LEVELS, INCOMPATIBLE_TYPES, PENALTIES, QUANTITY_RANGES,
    REVIEW_STATUSES, SIGNALS,
)
from tradeloom.functions import any_of, first_match, in_list, q, transform
from tradeloom.functions.text import (
    ascii_fold, candidate_key, has_value, name_tokens, strip, word_tokens, words_only,
    xpath_terminal,
)
from tradeloom.operators.extract import NO_TEXTS, SEAL, with_columns
from tradeloom.operators.ranking import best_row, number_lines, top_k
from tradeloom.sources.profile import Profile
from tradeloom.staging import staged, staged_together

_SALTS = 8
#: How many lists of a property the first pass looks into, and how many heads, per wanted row.
_PROBED_LISTS, _PROBED_ROWS = 6, 4


def _clean(name: str) -> str:
    return strip(f"coalesce(CAST({name} AS string), '')")


def _prefixed(prefix: str, tokens: str) -> str:
    return transform(tokens, lambda t: f"concat('{prefix}:', {t})")


def _contains_any(text: str, words: tuple[str, ...]) -> str:
    return any_of(f"contains({text}, {q(w)})" for w in words)


def _type_test(table: dict[str, tuple[str, ...]], kind: str, value: str) -> str:
    return any_of(f"({kind} = {q(k)} AND {in_list(value, v)})" for k, v in table.items())


def _least_size(tokens: str) -> str:
    """Size of a token set, rounded down to a power of two if above four."""
    return (f"IF(size({tokens}) <= 4, size({tokens}), "
            f"CAST(pow(2, floor(log2(size({tokens})))) AS int))")


# --- The two sides ---------------------------------------------------------------


def profile_fields(profile: Profile) -> list[tuple[str, str]]:
    """(property, canonical field) pairs; child fields also count for their parent."""
    pairs = [(r.jsonld_property, r.canonical_field) for r in profile.fields]
    for parent in profile.objects:
        for r in parent.fields:
            if r.canonical_field:
                pairs += [(r.jsonld_property, r.canonical_field),
                          (parent.jsonld_property, r.canonical_field)]
    return pairs


def proof_keys(catalog: DataFrame) -> DataFrame:
    """``p_id, key``: ids and names of attributes that a catalog row proves to be mapped."""
    proving = catalog.filter(in_list("lower(mapping_status)", CATALOG_SIGNAL_STATUSES))
    keys = (f"array(concat('c:', {_clean('gdsn_bms_id')}), "
            f"concat('m:', lower({_clean('gdsn_attribute_name')})))")
    rows = proving.selectExpr(f"{_clean('jsonld_property')} AS p_id", f"explode({keys}) AS key")
    return rows.filter("p_id <> ''").distinct()


def _best_rows(catalog: DataFrame) -> DataFrame:
    """Per property its best catalog row."""
    rows = catalog.selectExpr(
        f"{_clean('jsonld_property')} AS p_id",
        "coalesce(mapping_status, '') AS existing_mapping_status",
        "coalesce(canonical_field, '') AS existing_mapping_field",
        "coalesce(confidence, '') AS existing_mapping_confidence", "row_number",
    ).filter("p_id <> ''")
    known = in_list("existing_mapping_status", BEST_ROW_STATUSES)
    return best_row(
        rows.select("p_id", "row_number", "existing_mapping_status", "existing_mapping_field",
                    "existing_mapping_confidence"),
        ["p_id"],
        [F.expr("existing_mapping_confidence <> 'high'"), F.expr(f"NOT {known}"),
         F.col("row_number")],
    ).drop("row_number")


def _decisions(backlog: DataFrame) -> DataFrame:
    return (
        backlog.selectExpr("pos", "trim(id) AS id", "explode(affected_properties) AS p_id")
        .selectExpr("pos", "id", "trim(p_id) AS p_id")
        .filter("id <> '' AND p_id <> ''")
        .groupBy("p_id")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("l"))
        .selectExpr("p_id", "transform(l, x -> x.id) AS linked_sdr_ids")
    )


def property_side(
    properties: DataFrame, catalog: DataFrame, profile: Profile, backlog: DataFrame
) -> DataFrame:
    """Properties with tokens, look-ups, join keys and class columns."""
    spark = properties.sparkSession
    listed = spark.createDataFrame(profile_fields(profile), "p_id string, field string")
    fields = listed.groupBy("p_id").agg(F.collect_set(F.lower("field")).alias("yaml_fields"))
    rows = properties.selectExpr(
        f"{_clean('term_id')} AS p_id", f"{_clean('compact_name')} AS compact",
        f"{_clean('label')} AS label", f"{_clean('comment')} AS comment",
        f"{_clean('domain')} AS domain", f"{_clean('range')} AS range",
    ).filter("p_id <> ''")
    for side in (_best_rows(catalog), fields, _decisions(backlog)):
        rows = rows.join(side, "p_id", "left")
    rows = rows.withColumns(
        {f"{c}_f": ascii_fold(F.col(c)) for c in ("compact", "label", "comment")}
    )
    rows = with_columns(
        rows,
        {
            "compact_l": "lower(compact)",
            "label_l": "lower(label)",
            "range_l": "lower(range)",
            "compact_norm": words_only("lower(compact_f)"),
            "p_name_tokens": f"array_union({word_tokens('label_f')}, {name_tokens('compact')})",
            "p_compact_tokens": name_tokens("compact"),
            "p_comment_tokens": word_tokens("comment_f"),
            **{c: f"coalesce({c}, {NO_TEXTS})"
               for c in ("yaml_fields", "linked_sdr_ids")},
            **{c: f"coalesce({c}, '')" for c in (
                "existing_mapping_status", "existing_mapping_field",
                "existing_mapping_confidence")},
        },
    )
    # Words that mark quantities and code lists.
    rows = with_columns(
        rows,
        {
            "p_quantity": any_of([
                in_list("range_l", QUANTITY_RANGES),
                _contains_any("compact_l", ("quantity", "measurement", "content"))]),
            "p_coded": any_of([
                _contains_any("range_l", ("code", "enumeration", "type")),
                _contains_any("compact_l", ("code", "type", "status", "method"))]),
            "p_linked": "size(linked_sdr_ids) > 0",
            "p_range": f"IF({in_list('range_l', COMPATIBLE_TYPES)}, range_l, '')",
        },
    )
    underscored = transform("yaml_fields", lambda f: f"replace({f}, ' ', '_')")
    keys = [
        _prefixed("n", "p_name_tokens"), _prefixed("x", "p_compact_tokens"),
        _prefixed("d", "p_comment_tokens"), _prefixed("e", "array(compact_l, label_l)"),
        _prefixed("y", f"array_union(yaml_fields, {underscored})"),
        "IF(compact = '', " + NO_TEXTS + ", "
        + "array(concat('u:', left(compact_l, 3)), concat('v:', compact_norm)))",
    ]
    generic = [
        "IF(p_range <> '', array(concat('r:', p_range)), " + NO_TEXTS + ")",
        "IF(p_quantity, array('q'), " + NO_TEXTS + ")",
        "IF(p_coded, array('k'), " + NO_TEXTS + ")",
        "IF(p_linked, array('l'), " + NO_TEXTS + ")",
    ]
    return with_columns(
        rows,
        {
            "p_keys": f"array_distinct(concat({', '.join(keys)}))",
            "p_generic": f"concat({', '.join(generic)})",
            "p_class": "concat_ws('|', p_range, p_quantity, p_coded, p_linked)",
        },
    ).drop("compact_f", "label_f", "comment_f")


_ATTRIBUTE_TEXTS = (
    "bms_id", "message", "xpath", "module", "row_type", "parent_class", "attribute_name",
    "multiplicity", "data_type", "code_list_name", "bms_code_list_id", "uom_enabled",
    "semantic_resource_urn", "definition", "is_deleted", "is_candidate_source",
)


def attribute_side(attributes: DataFrame) -> DataFrame:
    """Attributes with tokens, join keys, class columns and tie order.

    ``row_pos`` (input order) is the last tie breaker; one is made up if absent.
    """
    if "row_pos" not in attributes.columns:
        attributes = number_lines(attributes, "row_pos")
    rows = attributes.selectExpr(
        "row_pos", "coalesce(try_cast(trim(bms_id) AS bigint), 0L) AS bms_sort",
        *[f"{_clean(c)} AS {c}" for c in _ATTRIBUTE_TEXTS],
    )
    urn_last = "element_at(split(lower(semantic_resource_urn), '[.]'), -1)"
    rows = with_columns(rows, {"urn_l": "lower(semantic_resource_urn)", "urn_last": urn_last})
    rows = rows.withColumns(
        {f"{c}_f": ascii_fold(F.col(c)) for c in ("attribute_name", "definition", "urn_last")}
    )
    known_types = sorted({t for table in (COMPATIBLE_TYPES, INCOMPATIBLE_TYPES)
                          for kinds in table.values() for t in kinds})
    kind = "lower(row_type)"
    rows = with_columns(
        rows,
        {
            "name_l": "lower(attribute_name)",
            "urn_norm": words_only("urn_last_f"),
            "a_name_tokens": word_tokens("attribute_name_f"),
            "a_terminal_tokens": name_tokens(xpath_terminal("xpath")),
            "a_definition_tokens": word_tokens("definition_f"),
            "a_type": f"IF({in_list('lower(data_type)', known_types)}, lower(data_type), '')",
            "a_uom": "lower(uom_enabled) = 'yes'",
            "a_coded": has_value("code_list_name"),
            "a_deleted": "lower(is_deleted) = 'true'",
            "a_group": f"{kind} <> '' AND {kind} <> 'attribute'",
        },
    )
    grams = "flatten(transform(sequence(1, 3), n -> transform(sequence(1, length(urn_l)), " \
            "i -> substring(urn_l, i, n))))"
    keys = [
        _prefixed("n", "a_name_tokens"), _prefixed("x", "a_terminal_tokens"),
        _prefixed("d", "a_definition_tokens"), _prefixed("c", "array(bms_id)"),
        _prefixed("m", "array(name_l)"),
        f"IF(name_l = '', {NO_TEXTS}, array(concat('e:', name_l), concat('y:', name_l), "
        "concat('y:', replace(name_l, ' ', '_'))))",
        f"IF(urn_l = '', {NO_TEXTS}, array_append({_prefixed('u', grams)}, "
        "concat('v:', urn_norm)))",
    ]
    ranges = [
        f"IF({in_list('a_type', types)}, array({q('r:' + r)}), {NO_TEXTS})"
        for r, types in COMPATIBLE_TYPES.items()
    ]
    generic = [
        *ranges, f"IF(a_uom, array('q'), {NO_TEXTS})", f"IF(a_coded, array('k'), {NO_TEXTS})",
        "array('l')",
    ]
    return with_columns(
        rows,
        {
            "a_keys": f"array_distinct(concat({', '.join(keys)}))",
            "a_generic": f"concat({', '.join(generic)})",
            "a_class": "concat_ws('|', a_type, a_uom, a_coded, a_deleted, a_group)",
            "names_least": _least_size("a_name_tokens"),
            "definition_least": _least_size("a_definition_tokens"),
        },
    ).withColumn(
        "shape", F.concat_ws("|", "a_class", "names_least", "definition_least")
    ).drop("attribute_name_f", "definition_f", "urn_last_f", "urn_last")


# --- Scoring ---------------------------------------------------------------------

_SPECIFIC = {
    "existing_mapping_catalog_match":
        "proved",
    "mapping_yaml_canonical_field_match":
        "name_l <> '' AND (array_contains(yaml_fields, name_l) OR array_contains("
        + transform("yaml_fields", lambda f: f"replace({f}, ' ', '_')")
        + ", replace(name_l, ' ', '_')))",
    "semantic_resource_urn_match":
        "urn_l <> '' AND compact_l <> '' AND "
        "(contains(urn_l, compact_l) OR urn_norm = compact_norm)",
    "exact_property_name_match":
        "name_l <> '' AND (name_l = compact_l OR name_l = label_l)",
}
_TYPE_FITS = _type_test(COMPATIBLE_TYPES, "range_l", "a_type")
_TYPE_CLASHES = _type_test(INCOMPATIBLE_TYPES, "range_l", "a_type")
_CLASS_SIGNALS = {
    "range_datatype_compatible": _TYPE_FITS,
    "quantity_uom_compatible": "p_quantity AND a_uom",
    "code_list_signal": "p_coded AND a_coded",
    "standards_review_linked": "p_linked",
}


def _weight(name: str) -> str:
    return f"{ {**SIGNALS, **PENALTIES}[name]!r}D"


def _sum(terms: list[str]) -> str:
    """Left-to-right sum: order matters for equal scores at the band limits."""
    return " + ".join(["0.0D", *terms])


def _when(test: str, value: str) -> str:
    return f"IF({test}, {value}, 0.0D)"


def _class_terms() -> list[str]:
    type_name = ("range_datatype_compatible", "datatype_mismatch_warning")
    by_type = first_match(
        [(_TYPE_FITS, _weight(type_name[0])), (_TYPE_CLASHES, _weight(type_name[1]))], "0.0D"
    )
    rest = [_when(t, _weight(n)) for n, t in list(_CLASS_SIGNALS.items())[1:]]
    return [by_type, *rest]


def _penalty_terms() -> list[str]:
    return [
        _when("a_deleted", _weight("deleted_attribute_warning")),
        _when("a_group", _weight("class_row_not_attribute")),
    ]


def _raw_score(specific: dict[str, str], label: str) -> str:
    """Score from flags of the specific signals, ``_nf``, ``_x``, ``_d``, ``_df`` and the class columns.

    Each term and sum grows with its flag or fraction, in floating point too.
    """
    terms = _sum([
        *_penalty_terms(),
        *[_when(test, _weight(name)) for name, test in specific.items()],
        _when(label, f"{_weight('label_attribute_token_overlap')} * _nf"),
        _when("_x", _weight("xpath_terminal_match")),
        _when("_d >= 2", f"{_weight('definition_comment_overlap')} * _df"),
        *_class_terms(),
    ])
    return f"greatest(0.0D, least(1.0D, {terms}))"


def score_pairs(pairs: DataFrame) -> DataFrame:
    """Add ``score``, ``reasons`` and ``warnings``; drop pairs without any signal."""
    shared = {
        "_n": "size(array_intersect(p_name_tokens, a_name_tokens))",
        "_x": "size(array_intersect(p_compact_tokens, a_terminal_tokens)) > 0",
        "_d": "size(array_intersect(p_comment_tokens, a_definition_tokens))",
    }
    flags = with_columns(pairs, {**shared, **{f"_{n}": t for n, t in _SPECIFIC.items()}})
    fractions = {
        "_nf": "_n / nullif(greatest(size(p_name_tokens), size(a_name_tokens)), 0)",
        "_df": "_d / nullif(greatest(size(p_comment_tokens), size(a_definition_tokens)), 0)",
    }
    flags = with_columns(flags, fractions)
    label = "_n >= 1 AND (_nf >= 0.3D OR NOT _exact_property_name_match)"
    raw = _raw_score({n: f"_{n}" for n in _SPECIFIC}, label)
    tests = {
        **{n: f"_{n}" for n in _SPECIFIC},
        "label_attribute_token_overlap": label,
        "xpath_terminal_match": "_x",
        "definition_comment_overlap": "_d >= 2",
        **_CLASS_SIGNALS,
    }
    warnings = {
        "deleted_attribute_warning": "a_deleted", "class_row_not_attribute": "a_group",
        "datatype_mismatch_warning": f"NOT {_TYPE_FITS} AND {_TYPE_CLASHES}",
    }

    def fired(cases: dict[str, str]) -> str:
        return ("array_compact(array("
                + ", ".join(f"CASE WHEN {t} THEN {q(n)} END" for n, t in cases.items()) + "))")

    scored = with_columns(
        flags,
        {"score": f"IF({SEAL}, {raw}, NULL)", "reasons": fired(tests),
         "warnings": fired(warnings)},
    )
    return scored.filter("score > 0 OR size(reasons) > 0").drop(
        *shared, *fractions, *[f"_{n}" for n in _SPECIFIC]
    )


# --- Pair generation -------------------------------------------------------------


# What scoring needs of either side.
_P_SCORED = ("p_id", "compact_l", "label_l", "compact_norm", "range_l", "yaml_fields",
             "p_name_tokens", "p_compact_tokens", "p_comment_tokens", "p_quantity", "p_coded",
             "p_linked")
_A_SCORED = ("row_pos", "bms_sort", "name_l", "urn_l", "urn_norm", "a_name_tokens",
             "a_terminal_tokens", "a_definition_tokens", "a_type", "a_uom", "a_coded", "a_deleted",
             "a_group")


_SHAPE = ("a_type", "a_uom", "a_coded", "a_deleted", "a_group", "names_least", "definition_least")
_POSTED = ("row_pos", "bms_sort", "shape", *_SHAPE)
_BOUND_SIDE = ("p_id", "range_l", "p_quantity", "p_coded", "p_linked")

# The kinds of keys, by their first letter, that stand for a specific signal.
_SIGNAL_KEYS = {
    "existing_mapping_catalog_match": ("c", "m"),
    "mapping_yaml_canonical_field_match": ("y",),
    "semantic_resource_urn_match": ("u", "v"),
    "exact_property_name_match": ("e",),
}


def _spread(rows: DataFrame, by: str) -> DataFrame:
    return rows.withColumn("salt", F.expr(f"CAST(pmod(xxhash64({by}), {_SALTS}) AS int)"))


def _repeated(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))


def wanted_keys(properties: DataFrame, proofs: DataFrame) -> DataFrame:
    """``p_id, key``: what a property can share with an attribute, or what proves one."""
    own = properties.select("p_id", F.explode("p_keys").alias("key"))
    return own.union(proofs.join(properties.select("p_id"), "p_id").select("p_id", "key"))


def postings(attributes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Each attribute under each of its keys that a property has, with its shape."""
    posted = attributes.select(*_POSTED, F.explode("a_keys").alias("key"))
    keys = _repeated(wanted.select("key").distinct())
    return _spread(posted, "row_pos").join(keys, ["key", "salt"], "left_semi").drop("salt")


def bounded_lists(properties: DataFrame, wanted: DataFrame, posted: DataFrame) -> DataFrame:
    """``p_id, key, shape, list_rows, bound``: the lists a property can be paired from.

    ``bound`` is the most that a pair from the list can score if ``key`` is the rarest it shares.
    """
    lists = posted.groupBy("key", "shape").agg(
        F.count("*").alias("list_rows"), *[F.first(c).alias(c) for c in _SHAPE]
    )
    totals = posted.groupBy("key").agg(F.count("*").alias("key_rows"))
    kind = F.substring("key", 1, 1)
    so_far = (Window.partitionBy("p_id").orderBy(F.desc("key_rows"), "key")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counted = wanted.join(totals, "key").withColumns({
        "_n": F.count_if(kind == "n").over(so_far), "_d": F.count_if(kind == "d").over(so_far),
        "_x": F.count_if(kind == "x").over(so_far) > 0,
        **{f"_{name}": F.count_if(kind.isin(*kinds)).over(so_far) > 0
           for name, kinds in _SIGNAL_KEYS.items()},
    })
    sizes = properties.selectExpr(
        *_BOUND_SIDE, "size(p_name_tokens) AS p_names", "size(p_comment_tokens) AS p_comments"
    )
    met = _spread(counted.join(sizes, "p_id"), "p_id").join(_repeated(lists), ["key", "salt"])
    met = with_columns(met, {
        "_nf": "_n / nullif(greatest(p_names, names_least), 0)",
        "_df": "_d / nullif(greatest(p_comments, definition_least), 0)",
    })
    bound = _raw_score({name: f"_{name}" for name in _SPECIFIC}, "_n >= 1")
    return met.selectExpr("p_id", "key", "shape", "list_rows", f"{bound} AS bound")


def class_ids(properties: DataFrame, attributes: DataFrame, k: int) -> DataFrame:
    """``p_id, row_pos``: the pairs that may reach the top ``k`` without a common key."""
    order = [F.col("bms_sort"), F.col("row_pos")]
    heads = top_k(attributes, ["a_class"], order, k).drop("rank")
    # The classes are combinations of fixed tables and flags: at most a few hundred.
    p_classes = properties.groupBy("p_class").agg(
        *[F.first(c).alias(c) for c in ("p_generic", "range_l", "p_quantity", "p_coded", "p_linked")]
    )
    met = (
        heads.withColumn("key", F.explode("a_generic"))
        .join(p_classes.withColumn("key", F.explode("p_generic")), "key")
        .filter("key = get(array_intersect(p_generic, a_generic), 0)")
    )
    generic_score = f"greatest(0.0D, least(1.0D, {_sum([*_penalty_terms(), *_class_terms()])}))"
    leaders = top_k(
        met.withColumn("class_score", F.expr(generic_score)), ["p_class"],
        [F.desc("class_score"), *order], k,
    ).select("p_class", "row_pos")
    return properties.select("p_id", "p_class").join(leaders, "p_class").select("p_id", "row_pos")


def _best_pairs(
    ids: DataFrame, properties: DataFrame, attributes: DataFrame, proofs: DataFrame, k: int
) -> DataFrame:
    """Score pairs given by ids, in full; the best ``k`` of each property."""
    pairs = (ids.join(properties.select(*_P_SCORED), "p_id")
             .join(attributes.select(*_A_SCORED, "bms_id"), "row_pos"))
    for letter, cell in (("c", "bms_id"), ("m", "name_l")):
        found = proofs.selectExpr("p_id", f"key AS {letter}_key", f"true AS {letter}_proves")
        pairs = pairs.withColumn(f"{letter}_key", F.expr(f"concat('{letter}:', {cell})")).join(
            found, ["p_id", f"{letter}_key"], "left"
        )
    scored = score_pairs(pairs.withColumn("proved", F.expr("coalesce(c_proves, m_proves, false)")))
    return top_k(
        scored.select("p_id", "row_pos", "bms_sort", "score", "reasons", "warnings"),
        ["p_id"], [F.desc("score"), F.col("bms_sort"), F.col("row_pos")], k,
    )


def pair_ids(
    properties: DataFrame, attributes: DataFrame, proofs: DataFrame, k: int
) -> DataFrame:
    """``p_id, row_pos`` of the pairs that have to be scored, each once.

    The sides should be cheap to read again: they are read by both passes.
    """
    # Staged, so that their size is known where they meet the attributes' keys: few keys go to the
    # tasks that read the attributes, and no task gets another's keys to filter.
    wanted = staged(wanted_keys(properties, proofs), "wanted")
    posted = staged(postings(attributes, wanted), "postings")
    lists, leaders = staged_together(
        lists=bounded_lists(properties, wanted, posted), leaders=class_ids(properties, attributes, k)
    )
    promising = top_k(
        lists, ["p_id"], [F.desc("bound"), F.col("list_rows"), F.col("key"), F.col("shape")], _PROBED_LISTS
    ).select("p_id", "key", "shape")
    looked_into = posted.join(promising.select("key", "shape").distinct(), ["key", "shape"], "left_semi")
    heads = top_k(looked_into, ["key", "shape"], [F.col("bms_sort"), F.col("row_pos")], _PROBED_ROWS * k)
    probed = promising.join(heads, ["key", "shape"]).select("p_id", "row_pos")
    reached = _best_pairs(probed.union(leaders).distinct(), properties, attributes, proofs, k)
    threshold = reached.filter(F.col("rank") == k).selectExpr(
        "p_id", "score AS least", "bms_sort AS least_sort", "row_pos AS least_pos"
    )
    opened = lists.join(threshold, "p_id", "left").filter("least IS NULL OR bound >= least")
    pairs = _repeated(opened).join(_spread(posted, "row_pos"), ["key", "shape", "salt"]).filter(
        "least IS NULL OR bound > least OR bms_sort < least_sort "
        "OR (bms_sort = least_sort AND row_pos <= least_pos)"
    )
    return pairs.select("p_id", "row_pos").union(leaders).distinct()


def confidence(score: str, reasons: str) -> str:
    """Band of the unrounded score."""
    return first_match(
        [
            (f"array_contains({reasons}, 'standards_review_linked') AND {score} < {BAND_LOW}D",
             q("review_required")),
            (f"{score} >= {BAND_HIGH}D", q("high")),
            (f"{score} >= {BAND_MEDIUM}D", q("medium")),
            (f"{score} >= {BAND_LOW}D", q("low")),
        ],
        q("review_required"),
    )


def review_status(level: str) -> str:
    return first_match(
        [
            (in_list("existing_mapping_status", ALREADY_MAPPED_STATUSES), q("already_mapped")),
            ("array_contains(warnings, 'deleted_attribute_warning')", q("not_recommended")),
            (f"{level} = 'review_required'", q("review_required")),
            ("array_contains(reasons, 'standards_review_linked')", q("review_required")),
        ],
        q("proposed"),
    )


def candidates(
    properties: DataFrame, attributes: DataFrame, catalog: DataFrame, profile: Profile,
    backlog: DataFrame, *, limit: int = 20, property_id: str | None = None,
) -> DataFrame:
    """The best ``limit`` attributes per property, exactly as all-pairs scoring ranks them."""
    if property_id is not None:
        properties = properties.filter(F.col("term_id") == property_id)
    p, a, proofs = staged_together(
        properties=property_side(properties, catalog, profile, backlog),
        attributes=attribute_side(attributes), proofs=proof_keys(catalog),
    )
    first = _best_pairs(pair_ids(p, a, proofs, limit), p, a, proofs, limit)
    texts = a.select("row_pos", "a_deleted", *_ATTRIBUTE_TEXTS)
    best = first.join(p, "p_id").join(texts, "row_pos")
    leveled = with_columns(best, {"confidence_level": confidence("score", "reasons")})
    notes = ", ".join(
        f"CASE WHEN array_contains(warnings, {q(n)}) THEN {q(t)} END"
        for n, t in BLOCKING_NOTES.items()
    )
    return leveled.selectExpr(
        f"{candidate_key('p_id', 'bms_id')} AS candidate_id",
        "p_id AS webvoc_property_id", "compact AS webvoc_compact_name",
        "label AS webvoc_label", "comment AS webvoc_comment", "domain AS webvoc_domain",
        "range AS webvoc_range", "bms_id AS gdsn_bms_id",
        "attribute_name AS gdsn_attribute_name", "xpath AS gdsn_xpath",
        "module AS gdsn_module", "parent_class AS gdsn_parent_class",
        "data_type AS gdsn_data_type", "multiplicity AS gdsn_multiplicity",
        "code_list_name AS gdsn_code_list_name",
        "bms_code_list_id AS gdsn_bms_code_list_id",
        "semantic_resource_urn AS gdsn_semantic_resource_urn",
        "definition AS gdsn_definition", "message AS source_message",
        "a_deleted AS is_deleted", "lower(is_candidate_source) = 'true' AS is_candidate_source",
        "existing_mapping_status", "existing_mapping_field", "existing_mapping_confidence",
        "IF(p_linked, 'open', '') AS standards_review_status", "linked_sdr_ids",
        "round(score, 4) AS score", "confidence_level",
        f"{review_status('confidence_level')} AS review_status", "reasons", "warnings",
        f"array_compact(array({notes})) AS blocking_notes",
        f"{q(CANDIDATE_VERSION)} AS created_by_version", "rank",
    )


# --- Reports ---------------------------------------------------------------------


def filter_candidates(
    rows: DataFrame, *, min_confidence: str = "low", include_low_confidence: bool = True,
    include_review_required: bool = True,
) -> DataFrame:
    """Keep levels at or above a threshold; an unknown threshold counts as low."""
    threshold = min_confidence if min_confidence in CONFIDENCE_LEVELS else "low"
    allowed = list(CONFIDENCE_LEVELS[: CONFIDENCE_LEVELS.index(threshold) + 1])
    allowed = [a for a in allowed if a != "review_required"]
    if not include_low_confidence and "low" in allowed:
        allowed.remove("low")
    if include_review_required:
        allowed.append("review_required")
    return rows.filter(in_list("confidence_level", allowed) if allowed else "false")


def by_review_status(
    rows: DataFrame, statuses: list[str], *, exclude_mapped: bool = False
) -> DataFrame:
    kept = rows.filter(F.col("review_status").isin(statuses))
    return kept.filter("review_status <> 'already_mapped'") if exclude_mapped else kept


def candidate_summary(rows: DataFrame) -> DataFrame:
    """Totals with a column for every level and status, absent ones zero."""
    return rows.agg(
        F.count("*").alias("total_candidates"),
        F.count_distinct(F.expr("nullif(webvoc_property_id, '')")).alias("properties_covered"),
        *[F.count_if(F.col("confidence_level") == c).alias(f"confidence_{c}")
          for c in CONFIDENCE_LEVELS],
        *[F.count_if(F.col("review_status") == c).alias(f"status_{c}") for c in REVIEW_STATUSES],
    ).withColumn("created_by_version", F.lit(CANDIDATE_VERSION))


def flat_candidates(rows: DataFrame) -> DataFrame:
    """List cells joined for CSV output."""
    lists = ("reasons", "warnings", "blocking_notes", "linked_sdr_ids")
    return rows.withColumns({c: F.concat_ws("; ", c) for c in lists})



"""Vocabulary explorer: coverage, topics, evidence and governance per property."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tradeloom.fixed import (
    COVERAGE_PRIORITY, COVERAGE_STATUSES, LINK_TOPIC, OTHER_TOPIC, TOPIC_GROUPS,
    TOPIC_SUMMARY_ORDER,
)
from tradeloom.functions import any_of, first_match, q, strings
from tradeloom.functions.text import strip, term_tokens
from tradeloom.operators.extract import with_columns
from tradeloom.operators.seams import seams

EVIDENCE_FIELDS = {
    "canonical_field": "canonical_field", "jsonld_property": "jsonld_property",
    "mapping_status": "mapping_status", "confidence": "confidence",
    "mapping_version": "mapping_version", "mapping_profile": "technical_mapping_file",
    "scope_group": "scope_group", "bms_id": "gdsn_bms_id", "gdsn_xpath": "gdsn_xpath",
    "source_attribute_name": "gdsn_attribute_name", "source": "source",
}
_GOVERNANCE_FIELDS = (
    "sdr_id", "title", "category", "status", "warning_count", "affected_fields",
    "issue_url", "decision_file",
)


def coverage_of_row() -> str:
    """Coverage of one catalog row: the first rule that applies."""
    def low(name: str) -> str:
        return f"lower({strip(f'coalesce({name}, {q(str())})')})"

    status, action = low("mapping_status"), low("review_action")
    mapped = f"startswith({status}, 'mapped')"
    # Statuses.
    return first_match(
        [
            ("contains(jsonld_property, 'schema:') OR (contains(recommended_jsonld_property, "
             "'schema:') AND NOT contains(jsonld_property, 'gs1:'))", q("schema_org_fallback")),
            (f"{status} = 'experimental'", q("experimental")),
            (any_of([
                f"contains({status}, 'review')", f"contains({status}, 'needs')",
                f"contains({low('webvoc_property_validation')}, 'not found')",
                f"{low('webvoc_property_status')} IN ('webvoc_missing', 'webvoc_review_required')",
                f"{action} NOT IN ('', 'ok', 'none')",
            ]), q("standards_review_required")),
            (f"startswith({status}, 'candidate')", q("candidate")),
            (f"{mapped} AND {low('confidence')} = 'high'", q("high_confidence")),
            (mapped, q("mapped")),
            (f"{status} <> ''", q("unknown")),
        ],
        q("unmapped"),
    )


def coverage_rank(status: str) -> str:
    return f"array_position({strings(COVERAGE_PRIORITY)}, {status})"


def strongest_coverage(status: str):
    """Aggregate: the status with the highest priority.

    The maximum of the numeric rank hashes; a maximum over text would sort.
    """
    strongest = f"CAST(max({coverage_rank(status)}) AS int) - 1"
    return F.expr(f"get({strings(COVERAGE_PRIORITY)}, {strongest})")


def topic_rank(text: str, is_link_type: str = "false") -> str:
    """Position of the first keyword group found in lower-case text.

    Positions can be compared, so several texts combine by taking the minimum.
    """
    cases = []
    for rank, (topic, words) in enumerate(TOPIC_GROUPS):
        tests = [f"contains({text}, {q(w)})" for w in words]
        if topic == LINK_TOPIC:
            tests.insert(0, is_link_type)
        cases.append((any_of(tests), str(rank)))
    return first_match(cases, str(len(TOPIC_GROUPS)))


def topic_name(rank: str) -> str:
    return f"get({strings([*(t for t, _ in TOPIC_GROUPS), OTHER_TOPIC])}, {rank})"


def topic_of(text: str, is_link_type: str = "false") -> str:
    """Topic by the first keyword group found in lower-case text."""
    return topic_name(topic_rank(text, is_link_type))


def evidence_by_term(rows: DataFrame) -> DataFrame:
    """Catalog rows per vocabulary term mentioned in any of three columns."""
    mentioned = term_tokens(
        "concat_ws(' ', jsonld_property, recommended_jsonld_property, "
        "webvoc_property_validation)",
        wide=True,
    )
    cells = ", ".join(f"'{k}', {v}" for k, v in EVIDENCE_FIELDS.items())
    return rows.selectExpr(
        "row_number", f"explode(array_distinct({mentioned})) AS term_id",
        f"named_struct({cells}) AS evidence", f"{coverage_of_row()} AS coverage",
    )


def _governance(backlog: DataFrame, affected: str, name: str) -> DataFrame:
    return backlog.selectExpr(
        "pos AS backlog_pos", "coalesce(id, '') AS sdr_id", "coalesce(title, '') AS title",
        "coalesce(category, '') AS category", "coalesce(status, '') AS status",
        "coalesce(warning_count, 0) AS warning_count",
        "coalesce(affected_fields, array()) AS affected_fields",
        "coalesce(issue_url, '') AS issue_url", "coalesce(decision_file, '') AS decision_file",
        f"explode({affected}) AS {name}",
    )


def governance_by_term(evidence: DataFrame, backlog: DataFrame) -> DataFrame:
    """Decisions per term, by property and by evidence field, distinct by id and file."""
    direct = _governance(backlog, "affected_properties", "term_id").withColumns(
        {"via": F.lit(0), "row_number": F.lit(0).cast("bigint")}
    )
    by_field = _governance(backlog, "affected_fields", "field")
    # One row per term and field, however many catalog rows repeat the pair.
    through = (
        evidence.groupBy("term_id", F.col("evidence.canonical_field").alias("field"))
        .agg(F.min("row_number").alias("row_number"))
        .join(by_field, "field")
        .drop("field")
        .withColumn("via", F.lit(1))
    )
    every = direct.unionByName(through)
    order = F.struct("via", "row_number", "backlog_pos")
    distinct = every.groupBy("term_id", "sdr_id", "decision_file").agg(
        F.min_by(F.struct(*_GOVERNANCE_FIELDS), order).alias("reference"),
        F.min(order).alias("o"),
    )
    return distinct.groupBy("term_id").agg(
        F.array_sort(F.collect_list(F.struct("o", "reference"))).alias("g")
    ).selectExpr("term_id", "transform(g, x -> x.reference) AS governance")


def _cells(prefix: str, *names: str) -> list[str]:
    return [f"coalesce({prefix}{name}, '')" for name in names]


def _own_words(*lists: str) -> str:
    joined = [f"coalesce(array_join({name}, ' '), '')" for name in lists]
    return f"lower(concat_ws(' ', {', '.join([*_cells('', 'term_id', 'label', 'comment'), *joined])}))"


def _words_in_order(properties: DataFrame, own: str, said: DataFrame) -> DataFrame:
    """``term_id, place, words``: a property's own words, then those of its evidence (``said``)."""
    first = properties.selectExpr("term_id", "CAST(-1 AS bigint) AS place", f"{own} AS words")
    return first.unionByName(said.join(properties.select("term_id"), "term_id", "left_semi"))


def explore(properties: DataFrame, rows: DataFrame, backlog: DataFrame) -> DataFrame:
    """Attach coverage, topic, evidence counts and governance to properties.

    Evidence itself stays in long form (``evidence_by_term``): here it is only
    aggregated, so a property named by very many catalog rows costs no more than
    any other. Topic words count across the seams of evidence rows too. Governance lists are
    distinct decisions, bounded by the backlog.
    """
    evidence = evidence_by_term(rows)
    per_term = evidence.groupBy("term_id").agg(
        F.count("*").alias("evidence_count"),
        F.expr("bool_or(evidence.bms_id <> '' OR evidence.gdsn_xpath <> '')")
        .alias("has_source_evidence"),
        strongest_coverage("coverage").alias("coverage_status"),
    )
    cells = _cells("evidence.", "canonical_field", "scope_group", "source_attribute_name", "jsonld_property")
    said = evidence.selectExpr(
        "term_id", "CAST(row_number AS bigint) AS place", f"lower(concat_ws(' ', {', '.join(cells)})) AS words"
    )
    words = _words_in_order(properties, _own_words("domain", "range", "sub_property_of"), said)
    searched = [w for _, group in TOPIC_GROUPS for w in group]
    crossing = seams(
        words, "term_id", "place", "words",
        longest=max(map(len, searched)), blanks=max(w.count(" ") for w in searched),
    )
    topics = (
        words.select("term_id", "words").union(crossing)
        .groupBy("term_id").agg(F.min(F.expr(topic_rank("words"))).alias("_said_rank"))
    )
    joined = properties
    for side in (per_term, topics, governance_by_term(evidence, backlog)):
        joined = joined.join(side, "term_id", "left")
    return with_columns(
        joined,
        {
            "coverage_status": "coalesce(coverage_status, 'unmapped')",
            "evidence_count": "coalesce(evidence_count, 0L)",
            "has_source_evidence": "coalesce(has_source_evidence, false)",
            "group": topic_name(f"least({topic_rank(q(''), 'is_link_type')}, _said_rank)"),
        },
    ).drop("_said_rank")


def explorer_counts(properties: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(by coverage, by group)`` with a zero for every absent value."""
    def counted(column: str, domain: tuple[str, ...]) -> DataFrame:
        every = properties.sparkSession.createDataFrame(
            list(enumerate(domain)), f"pos int, {column} string"
        )
        found = properties.groupBy(column).agg(F.count("*").alias("n"))
        return every.join(found, column, "left").select(
            "pos", column, F.coalesce("n", F.lit(0)).alias("count")
        )

    return counted("coverage_status", COVERAGE_STATUSES), counted("group", TOPIC_SUMMARY_ORDER)


def explorer_summary(properties: DataFrame) -> DataFrame:
    decided = "coalesce(size(governance), 0)"
    return properties.agg(
        F.count("*").alias("property_count"),
        F.expr("count_if(coverage_status IN ('mapped', 'high_confidence'))")
        .alias("mapped_property_count"),
        F.expr(f"count_if(coverage_status = 'standards_review_required' OR {decided} > 0)")
        .alias("standards_review_property_count"),
        F.count_if("is_link_type").alias("link_type_property_count"),
        F.expr(f"coalesce(sum({decided}), 0)").alias("sdr_reference_count"),
    )


def display_rows(properties: DataFrame) -> DataFrame:
    """Flat rows as shown and exported, in report order."""
    # Column headings.
    return properties.orderBy("group", F.lower("term_id")).selectExpr(
        "group AS `Group`", "term_id AS `Property`", "label AS `Label`",
        "array_join(domain, '; ') AS `Domain`", "array_join(range, '; ') AS `Range`",
        "coverage_status AS `Coverage`",
        "IF(has_source_evidence, 'yes', 'no') AS `BMS/XPath evidence`",
        "coalesce(array_join(transform(governance, g -> g.sdr_id), ', '), '') AS `SDR indicator`",
        "evidence_count AS `Evidence count`", "full_iri AS `Full IRI`",
        "comment AS `Comment`", "array_join(sub_property_of, '; ') AS `SubPropertyOf`",
        "array_join(type, '; ') AS `Type`", "is_link_type AS `Link type`",
    )


def filter_properties(
    properties: DataFrame, evidence: DataFrame, *, group: str = "", coverage_status: str = "",
    search: str = "", only_mapped: bool = False, only_standards_review: bool = False,
) -> DataFrame:
    """Explorer filter; empty options do not restrict.

    The search text may occur in the property, in its evidence, or across their seams.
    """
    tests = []
    if group not in ("", "All groups"):
        tests.append(f"group = {q(group)}")
    if coverage_status not in ("", "All statuses"):
        tests.append(f"coverage_status = {q(coverage_status)}")
    if only_mapped:
        tests.append("coverage_status IN ('mapped', 'high_confidence')")
    if only_standards_review:
        tests.append("(coverage_status = 'standards_review_required' "
                     "OR coalesce(size(governance), 0) > 0)")
    kept = properties.filter(" AND ".join(tests)) if tests else properties
    return search_properties(kept, evidence, [search]).drop("search") if search.strip() else kept


def search_properties(properties: DataFrame, evidence: DataFrame, searches: list[str]) -> DataFrame:
    """``search`` and the properties it hits, for several search texts in one evaluation.

    A text hits if it occurs in the property's own words followed by those of its evidence, one
    column after the other, rows in order, all with a blank between them. Neither
    the words of a property nor its hits are gathered beyond the texts searched for.
    """
    wanted = [t.strip().lower() for t in searches]
    texts = strings(wanted)
    cells = _cells("evidence.", "canonical_field", "bms_id", "gdsn_xpath", "source_attribute_name", "jsonld_property")
    # A column's rows come one after the other, then the next column's.
    placed = evidence.selectExpr(
        "term_id", "CAST(row_number AS bigint) AS row_number",
        f"posexplode(array({', '.join(cells)})) AS (column, words)",
    )
    last = evidence.agg(F.max("row_number").alias("last"))
    said = placed.join(F.broadcast(last)).selectExpr(
        "term_id", "column * (last + 1) + row_number AS place", "lower(words) AS words"
    )
    words = _words_in_order(properties, _own_words("domain", "range"), said)
    crossing = seams(
        words, "term_id", "place", "words",
        longest=max(map(len, wanted)), blanks=max(t.count(" ") for t in wanted),
    )
    hits = words.select("term_id", "words").union(crossing).selectExpr(
        "term_id", f"explode(filter({texts}, t -> contains(words, t))) AS search"
    )
    return properties.join(hits.distinct(), "term_id").select("search", *properties.columns)

"""Mapping-catalog governance: row rules, classification, reconciliation.

Findings are rows with the same columns everywhere, so reports are unions and
their summary is one aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tradeloom.fixed import (
    CATALOG_COLUMNS, CATALOG_CONFIDENCES, CATALOG_STATUSES, MAPPED_ROW_REQUIRED,
)
from tradeloom.functions import any_of, first_match, in_list, q, record
from tradeloom.functions.text import canonical_variants, term_tokens
from tradeloom.operators.extract import NO_TEXTS, with_columns
from tradeloom.sources.profile import Profile, mapping_records

_FINDING = ("severity", "code", "message", "canonical_field", "mapping_status", "source")


def mapped_or_candidate(status: str) -> str:
    return any_of(
        [f"{status} IN ('mapped', 'candidate')"]
        + [f"startswith({status}, '{p}')" for p in ("mapped_", "candidate_")]
    )


_REVIEW_TEXT = (
    "lower(concat_ws(' ', mapping_status, notes, webvoc_property_status, "
    "webvoc_property_validation, review_action))"
)


def _finding(severity: str, code: str, test: str, message: str) -> str:
    made = record(severity=q(severity), code=q(code), message=message)
    return f"CASE WHEN {test} THEN {made} END"


def row_findings(rows: DataFrame) -> DataFrame:
    """Rule violations of single catalog rows: a projection and an explode."""
    status, confidence = "lower(mapping_status)", "lower(confidence)"
    active = mapped_or_candidate(status)
    # Codes and message texts.
    rules = [
        _finding(
            "warning", "unknown_mapping_status", f"NOT {in_list(status, CATALOG_STATUSES)}",
            f"concat({q("Unknown mapping_status '")}, mapping_status, {q("'.")})",
        ),
        _finding(
            "warning", "unknown_confidence", f"NOT {in_list(confidence, CATALOG_CONFIDENCES)}",
            f"concat({q("Unknown confidence '")}, confidence, {q("'.")})",
        ),
        *[
            _finding(
                "error", "missing_mapped_value", f"{active} AND {name} = ''",
                q(f"Mapped/candidate row has no {name}."),
            )
            for name in MAPPED_ROW_REQUIRED
        ],
        _finding(
            "warning", "missing_jsonld_property",
            f"{active} AND jsonld_property = '' AND recommended_jsonld_property = ''",
            q("Mapped/candidate row has no JSON-LD property."),
        ),
        _finding(
            "warning", "missing_official_bms_id",
            f"{confidence} = 'high' AND contains({status}, 'official') AND gdsn_bms_id = ''",
            q("High-confidence official mapping has no GDSN BMS ID."),
        ),
        _finding(
            "warning", "webvoc_review_required", needs_vocabulary_review(),
            "concat('Web Vocabulary review required: ', "
            "IF(webvoc_property_validation <> '', webvoc_property_validation, notes))",
        ),
    ]
    found = rows.selectExpr(
        "canonical_field", "mapping_status", "concat('catalog row ', row_number) AS source",
        f"inline(array_compact(array({', '.join(rules)})))",
    )
    return classify(found.select(*_FINDING))


def needs_vocabulary_review() -> str:
    return any_of(
        f"contains({_REVIEW_TEXT}, {q(word)})"
        for word in ("not found", "needs_webvoc_review", "needs_web_vocab_review")
    )


def duplicate_keys(rows: DataFrame) -> DataFrame:
    """Repeated (mapping file, canonical field) pairs; combines before shuffling."""
    repeated = (
        rows.filter("technical_mapping_file <> '' AND canonical_field <> ''")
        .groupBy("technical_mapping_file", "canonical_field")
        .agg(F.count("*").alias("n"))
        .filter("n > 1")
    )
    # Code and message text.
    return classify(
        repeated.selectExpr(
            "'error' AS severity", "'duplicate_critical_key' AS code",
            "concat('Catalog key ', technical_mapping_file, ' / ', canonical_field, "
            "' occurs ', n, ' times.') AS message",
            "canonical_field", "'' AS mapping_status", "technical_mapping_file AS source",
        )
    )


def classify(findings: DataFrame) -> DataFrame:
    """Add category, recommended action and review flags from code and field."""
    field = "lower(canonical_field)"
    # Categories and action texts.
    vocabulary = (
        ("nutrient_modelling", f"contains({field}, 'nutrient')",
         "Review the nutrient target model against validated GS1 "
         "nutrition properties before changing the mapping."),
        ("image_modelling", f"contains({field}, 'image')",
         "Select a validated image property or link relation through standards review."),
        ("document_dpp_modelling",
         f"contains({field}, 'document') OR contains({field}, 'referenced_file')",
         "Decide the governed document/DPP relationship and file-type "
         "representation before changing the mapping."),
    )
    cases = [
        ("code IN ('yaml_field_missing_from_catalog', 'yaml_property_not_aligned', "
         "'catalog_field_missing_from_yaml')",
         "yaml_catalog_mismatch",
         "Review and document the YAML/catalog distinction before changing "
         "either representation.", True),
        ("code = 'structural_parent_covered'", "false_positive_tooling_issue",
         "No action required; child mappings provide the catalog coverage.", False),
        ("code = 'experimental_mapping_documented'", "experimental_mapping",
         "Keep the mapping experimental until standards review is complete.", True),
        *[
            (f"code = 'webvoc_review_required' AND ({test})", category, action, True)
            for category, test, action in vocabulary
        ],
        ("code = 'webvoc_review_required'", "webvoc_term_missing",
         "Review the validated replacement term before changing the semantic mapping.", True),
        ("code = 'missing_official_bms_id' OR contains(lower(mapping_status), 'bms')",
         "needs_bms_review", "Confirm the official BMS identifier and XPath evidence.", True),
        ("code = 'schema_org_fallback'", "schema_org_fallback",
         "Keep the external namespace documented and review GS1 alternatives.", True),
        ("true", "governance_review",
         "Review and document the governance decision; do not auto-fix semantics.", False),
    ]
    verdict = first_match(
        [
            (test, record(category=q(c), action=q(a), review=str(r).lower()))
            for test, c, a, r in cases
        ]
    )
    return findings.withColumn("_v", F.expr(verdict)).selectExpr(
        *_FINDING,
        "_v.category AS category",
        "canonical_field AS affected_field_property",
        "message AS reason",
        "_v.action AS recommended_action",
        "severity = 'error' AS blocks_release",
        "_v.review AS standards_review_required",
    )


def missing_columns(rows: DataFrame) -> list[str]:
    return sorted(set(CATALOG_COLUMNS) - set(rows.columns))


def _note(spark: SparkSession, severity: str, code: str, message: str, source: str) -> DataFrame:
    row = [(severity, code, message, "", "", source)]
    return classify(spark.createDataFrame(row, ", ".join(f"{c} string" for c in _FINDING)))


def catalog_findings(rows: DataFrame, source: str = "catalog") -> DataFrame:
    """All findings about a catalog. Missing columns stop the row rules."""
    absent = missing_columns(rows)
    spark = rows.sparkSession
    # Codes and message texts.
    if absent:
        text = f"Catalog is missing required columns: {', '.join(absent)}"
        return _note(spark, "error", "missing_required_columns", text, "")
    found = duplicate_keys(rows).unionByName(row_findings(rows))
    loaded = (
        rows.agg(F.count("*").alias("n"))
        .join(
            found.filter("severity = 'error'").select(F.lit(1).alias("one")).limit(1),
            F.lit(True), "left_anti",
        )
        .selectExpr(
            "'info' AS severity", "'catalog_loaded' AS code",
            "concat('Validated ', n, ' catalog rows.') AS message",
            "'' AS canonical_field", "'' AS mapping_status", f"{q(source)} AS source",
        )
    )
    return found.unionByName(classify(loaded))


def load_failure(spark: SparkSession, code: str, message: str, source: str) -> DataFrame:
    """A catalog or profile that cannot be read, as a finding."""
    return _note(spark, "error", code, message, source)


def needs_review(rows: DataFrame) -> DataFrame:
    """Rows whose status or notes mention a review, repeats included."""
    return rows.filter(f"contains({_REVIEW_TEXT}, 'review')").select(
        "canonical_field", "mapping_status", "review_action", "notes"
    )


def vocabulary_issues(rows: DataFrame) -> DataFrame:
    return rows.filter(needs_vocabulary_review()).select(
        "canonical_field", "mapping_status", "webvoc_property_status",
        "webvoc_property_validation", "review_action",
    )


def findings_summary(findings: DataFrame, *, strict: bool = False) -> DataFrame:
    """Counts per severity and the overall verdict."""
    counts = findings.agg(
        *[
            F.count_if(F.col("severity") == s).alias(f"{s}s" if s != "info" else s)
            for s in ("error", "warning", "info")
        ]
    )
    valid = "errors = 0" + (" AND warnings = 0" if strict else "")
    return counts.selectExpr("errors", "warnings", "info", f"{valid} AS valid").withColumn(
        "strict", F.lit(strict)
    )


# --- Reconciliation with a profile ------------------------------------------------


def profile_records(spark: SparkSession, profile: Profile) -> DataFrame:
    records = mapping_records(profile)
    rows = [(i, *r.values()) for i, r in enumerate(records)]
    return spark.createDataFrame(
        rows,
        "pos int, id string, kind string, canonical_field string, "
        "jsonld_property string, xpath string, mapping_file string",
    )


def variant_pairs(left: DataFrame, right: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """Distinct id pairs whose ``canonical_field`` spellings overlap.

    Spellings are exploded on both sides and joined on equality. A pair that
    shares several spellings is kept at its first shared one, so no shuffle is
    needed to remove repeats.
    """
    variants = canonical_variants("canonical_field")
    a = left.selectExpr(left_id, f"{variants} AS va")
    b = right.selectExpr(right_id, f"{variants} AS vb")
    pairs = a.selectExpr(left_id, "va", "explode(va) AS spelling").join(
        b.selectExpr(right_id, "vb", "explode(vb) AS spelling"), "spelling"
    )
    return pairs.filter("spelling = get(array_intersect(va, vb), 0)").select(left_id, right_id)


def every_child(children: DataFrame, parent: str, test: str) -> DataFrame:
    """Per parent whether all of its children pass a test (relational division)."""
    return children.groupBy(parent).agg(F.every(F.expr(test)).alias("all_match"))


def reconcile(records: DataFrame, rows: DataFrame) -> dict[str, DataFrame]:
    """Compare profile records with catalog rows.

    Returns ``coverage`` (per record), ``catalog_coverage`` (per row),
    ``experimental`` and ``findings``.
    """
    rows = with_columns(
        rows,
        {
            "tokens": term_tokens(
                "concat_ws(' ', jsonld_property, recommended_jsonld_property)"
            ),
            "is_experimental": f"contains({_REVIEW_TEXT}, 'experimental') "
            "OR lower(review_action) = 'model_review'",
        },
    )
    records = with_columns(records, {"record_tokens": term_tokens("jsonld_property")})
    pairs = variant_pairs(records, rows, "pos", "row_number")
    matched = (
        pairs.join(records.select("pos", "record_tokens"), "pos")
        .join(
            rows.select("row_number", "tokens", "is_experimental", "mapping_status", "notes",
                        F.col("canonical_field").alias("catalog_field")),
            "row_number",
        )
        .withColumn("aligned", F.arrays_overlap("record_tokens", "tokens"))
    )
    per_record = matched.groupBy("pos").agg(
        F.count("*").alias("catalog_matches"),
        F.coalesce(F.bool_or("aligned"), F.lit(False)).alias("any_aligned"),
        F.min_by(
            F.struct("mapping_status", "notes"),
            F.when(F.col("is_experimental"), F.col("row_number")),
        ).alias("experiment"),
        F.bool_or("is_experimental").alias("any_experiment"),
    )
    coverage = (
        records.join(per_record, "pos", "left")
        .withColumn("catalog_matches", F.coalesce("catalog_matches", F.lit(0)))
        .withColumn("any_aligned", F.coalesce("any_aligned", F.lit(False)))
    )
    children = every_child(
        coverage.filter("kind = 'object_field'").withColumn(
            "parent", F.expr("concat(substring_index(canonical_field, '[]', 1), '[]')")
        ),
        "parent",
        "catalog_matches > 0",
    ).withColumnRenamed("all_match", "children_matched")
    coverage = (
        coverage.join(
            children, (F.col("kind") == "object") & (F.col("canonical_field") == F.col("parent")),
            "left",
        )
        .withColumn("structural", F.expr("catalog_matches = 0 AND coalesce(children_matched, false)"))
        .withColumn("property_aligned", F.expr("any_aligned OR structural"))
        .drop("parent", "children_matched")
    )
    covered = matched.select("catalog_field").distinct()
    catalog_coverage = rows.join(
        covered.withColumn("hit", F.lit(True)),
        F.col("canonical_field") == F.col("catalog_field"), "left",
    ).withColumn("covered_by_yaml", F.coalesce("hit", F.lit(False)))
    # Codes and message texts.
    outcome = first_match(
        [
            (test, record(severity=q(severity), code=q(code), message=q(message)))
            for test, severity, code, message in (
                ("structural", "info", "structural_parent_covered",
                 "YAML object parent is structurally covered by catalogued child mappings."),
                ("catalog_matches = 0", "warning", "yaml_field_missing_from_catalog",
                 "YAML canonical field was not found in the catalog."),
                ("NOT any_aligned", "warning", "yaml_property_not_aligned",
                 "YAML JSON-LD property was not found in catalog property choices."),
                ("true", "info", "mapping_aligned",
                 "YAML mapping is aligned with a catalog row."),
            )
        ]
    )
    record_findings = coverage.withColumn("o", F.expr(outcome)).selectExpr(
        "o.severity", "o.code", "o.message", "canonical_field", "'' AS mapping_status",
        "mapping_file AS source",
    )
    documented = (
        coverage.filter("any_experiment")
        .groupBy("canonical_field", "jsonld_property", "mapping_file")
        .agg(F.min_by("experiment", "pos").alias("e"))
        .selectExpr(
            "canonical_field", "jsonld_property", "e.mapping_status AS mapping_status",
            "e.notes AS notes", "mapping_file",
            "'Experimental mapping is documented by the catalog.' AS message",
        )
    )
    extension = coverage.filter(
        "catalog_matches = 0 AND jsonld_property = 'gs1:referencedDocument'"
    ).selectExpr(
        "canonical_field", "jsonld_property", "'experimental' AS mapping_status",
        "'Project extension not present as a catalog field row.' AS notes", "mapping_file",
        "'Experimental referenced-document parent property is documented.' AS message",
    )
    experimental = documented.unionByName(extension)
    missing = catalog_coverage.filter(
        "(startswith(lower(mapping_status), 'mapped') OR lower(confidence) = 'high') "
        "AND lower(mapping_status) NOT IN ('out_of_scope', 'unsupported') "
        "AND NOT covered_by_yaml"
    )
    findings = (
        record_findings.unionByName(
            experimental.selectExpr(
                "'info' AS severity", "'experimental_mapping_documented' AS code", "message",
                "canonical_field", "mapping_status", "mapping_file AS source",
            )
        ).unionByName(
            missing.selectExpr(
                "'warning' AS severity", "'catalog_field_missing_from_yaml' AS code",
                "'Mapped/high-confidence catalog field was not found in YAML.' AS message",
                "canonical_field", "mapping_status", "technical_mapping_file AS source",
            )
        )
    )
    return {
        "coverage": coverage.select(
            "pos", "id", "kind", "canonical_field", "jsonld_property", "xpath",
            "mapping_file", "catalog_matches", "property_aligned",
        ),
        "missing_from_catalog": coverage.filter("catalog_matches = 0 AND NOT structural").select(
            "id", "kind", "canonical_field", "jsonld_property", "xpath", "mapping_file"
        ),
        "missing_from_yaml": missing.select(
            "canonical_field", "jsonld_property", "technical_mapping_file",
            "mapping_status", "confidence",
        ),
        "catalog_coverage": catalog_coverage.select(
            "canonical_field", "technical_mapping_file", "mapping_status", "confidence",
            "covered_by_yaml",
        ),
        "experimental": experimental.drop("message", "mapping_file"),
        "findings": classify(findings.select(*_FINDING)),
    }


def check_mapping(profile: Profile, rows: DataFrame) -> dict[str, DataFrame]:
    """Catalog rules plus reconciliation, as one report."""
    if missing_columns(rows):
        return {"findings": catalog_findings(rows)}
    report = reconcile(profile_records(rows.sparkSession, profile), rows)
    rules = duplicate_keys(rows).unionByName(row_findings(rows))
    return {
        **report,
        "findings": rules.unionByName(report["findings"]),
        "needs_review": needs_review(rows),
        "webvoc_issues": vocabulary_issues(rows),
    }


# --- Revalidation against a vocabulary snapshot -----------------------------------

_SALTS = 16


def revalidate(rows: DataFrame, terms: DataFrame, linktypes: DataFrame) -> DataFrame:
    """Look up every property token of every row in a vocabulary snapshot.

    ``terms``: term_id, label, range_text. ``linktypes``: name, status. Adds the
    four validation columns and the finding (status, category, token lists).
    """
    tokens = term_tokens("concat_ws(' ', jsonld_property, recommended_jsonld_property)")
    listed = rows.select(
        "row_number", F.expr(f"pmod(row_number, {_SALTS})").alias("salt"),
        F.expr(f"explode(array_distinct({tokens}))").alias("token"),
    )
    links = linktypes.selectExpr("concat('gs1:', name) AS token", "status AS link_status",
                                 "true AS is_link")
    known = terms.selectExpr("term_id AS token", "label", "range_text", "true AS is_term")
    # A token that most rows name is met in as many tasks as there are salts.
    terms_and_links = known.join(links, "token", "full").withColumn(
        "salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(_SALTS - 1).cast("bigint")))
    )
    looked_up = listed.join(terms_and_links, ["token", "salt"], "left").selectExpr(
        "row_number", "token", "coalesce(is_term, false) AS found",
        "coalesce(is_link, false) AS link", "coalesce(link_status, '') AS link_status",
        "coalesce(label, '') AS label", "coalesce(range_text, '') AS range_text",
        "startswith(token, 'gs1:') AS own",
    )
    grouped = looked_up.groupBy("row_number").agg(
        F.array_sort(
            F.collect_list(
                F.struct("token", "found", "link", "link_status", "label", "range_text", "own")
            )
        ).alias("t")
    )
    joined = rows.join(grouped, "row_number", "left")

    def pick(test: str, shown: str = "x.token") -> str:
        return f"coalesce(transform(filter(t, x -> {test}), x -> {shown}), {NO_TEXTS})"

    lists = with_columns(
        joined,
        {
            "found_terms": pick("x.own AND x.found"),
            "available_linktypes": pick("x.own AND x.link"),
            "missing_terms": pick("x.own AND NOT x.found AND NOT x.link"),
            "schema_org_terms": pick("NOT x.own"),
            "_own": "size(filter(t, x -> x.own)) > 0",
        },
    )
    some = {
        name: f"size({name}) > 0"
        for name in ("missing_terms", "available_linktypes", "found_terms", "schema_org_terms")
    }
    # Statuses, categories, marks and action texts.
    marks = [
        pick("x.own AND x.found", "concat(x.token, '=found')"),
        pick("x.own AND x.link AND x.link_status = 'stable'",
             "concat(x.token, '=stable linktype')"),
        pick("x.own AND NOT x.found AND NOT x.link", "concat(x.token, '=NOT FOUND')"),
        pick("NOT x.own", "concat(x.token, '=schema.org')"),
    ]
    validated = f"concat({', '.join(marks)})"
    columns = {
        "webvoc_property_status": first_match(
            [
                (some["missing_terms"], q("needs_webvoc_review")),
                (f"_own AND {some['available_linktypes']} AND NOT {some['found_terms']}",
                 q("webvoc_linktype_available")),
                ("_own", q("webvoc_found")),
                (some["schema_org_terms"], q("schema_org_only")),
            ],
            q("not_applicable"),
        ),
        "webvoc_property_validation": f"array_join({validated}, '; ')",
        "webvoc_property_label": "array_join("
        + pick("x.own AND x.found AND x.label <> ''", "concat(x.token, ': ', x.label)") + ", '; ')",
        "webvoc_property_range": "array_join("
        + pick("x.own AND x.found AND x.range_text <> ''", "concat(x.token, ': ', x.range_text)")
        + ", '; ')",
        "category": first_match(
            [
                (some["missing_terms"], q("webvoc_term_missing")),
                (some["available_linktypes"], q("webvoc_linktype_available")),
                (f"{some['schema_org_terms']} AND NOT coalesce(_own, false)",
                 q("schema_org_fallback")),
            ],
            q("validated"),
        ),
        "recommended_action": first_match(
            [
                (some["missing_terms"],
                 q("Standards review required before changing semantic mappings.")),
                (some["available_linktypes"],
                 q("Consider the stable GS1 link type in a reviewed mapping.")),
            ],
            q("No automatic semantic mapping change."),
        ),
        "blocks_release": "false",
    }
    return with_columns(lists, columns).drop("t", "_own")


def revalidation_summary(revalidated: DataFrame) -> DataFrame:
    return revalidated.agg(
        F.count("*").alias("catalog_rows"),
        F.count_if(F.size("missing_terms") > 0).alias("rows_with_missing_terms"),
        F.count_if(F.size("available_linktypes") > 0).alias("rows_with_available_linktypes"),
    ).withColumn("valid", F.lit(True))

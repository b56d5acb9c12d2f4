"""Vocabulary snapshots: JSON-LD graph, link types, Turtle terms, metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tradeloom.fixed import CLASS_TYPES, PROPERTY_TYPES
from tradeloom.functions import keep, q, strings
from tradeloom.functions.linked import member, text, types, values
from tradeloom.functions.text import compact_name


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """``path`` and ``text`` of each file, without its byte-order mark."""
    return spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("path"),
        F.regexp_replace("value", r"\A\x{FEFF}", "").alias("text"),
    )


def graph_items(texts: DataFrame) -> DataFrame:
    """One row per object of the ``@graph`` list: ``path``, ``pos``, ``item``, ``term_id``.

    Text that is not JSON, or has no list there, yields no rows.
    """
    graphs = texts.select(
        "path",
        F.expr("""try_variant_get(try_parse_json(text), '$["@graph"]', 'array<variant>')""")
        .alias("graph")
    )
    items = graphs.select("path", F.posexplode("graph").alias("pos", "item"))
    term = "try_variant_get(item, '$[\"@id\"]', 'variant')"
    return items.filter("startswith(schema_of_variant(item), 'OBJECT')").withColumn(
        "term_id",
        F.expr(f"IF(schema_of_variant({term}) = 'STRING', CAST({term} AS string), NULL)"),
    )


def graph_from_file(spark: SparkSession, path: str) -> DataFrame:
    return graph_items(whole_files(spark, path))


def own_terms(items: DataFrame) -> DataFrame:
    """Terms of the vocabulary itself as ``term_id`` and JSON ``body``.

    Of duplicates the last one stays, files in order of path; the maximum combines
    before the shuffle.
    """
    terms = items.filter("startswith(term_id, 'gs1:') AND term_id <> 'gs1:'")
    bodies = terms.select("term_id", F.struct("path", "pos").alias("at"), F.to_json("item").alias("body"))
    return bodies.groupBy("term_id").agg(F.max_by("body", "at").alias("body"))


def snapshot_metadata(items: DataFrame) -> DataFrame:
    """Version and modification date from the vocabulary's own node."""
    modified = member("item", "dc:lastModified")
    inner = member(modified, "@value")
    return (
        items.filter("term_id = 'gs1:'")
        .orderBy("path", "pos")
        .limit(1)
        .selectExpr(
            f"{member('item', 'owl:versionInfo', 'string')} AS version",
            f"CAST(coalesce({inner}, {modified}) AS string) AS last_modified",
        )
    )


def _is_kind(kinds: tuple[str, ...]) -> str:
    return f"arrays_overlap({types(member('item', '@type'))}, {strings(kinds)})"


def is_class() -> str:
    return _is_kind(CLASS_TYPES)


def is_property() -> str:
    return _is_kind(PROPERTY_TYPES)


def full_iri() -> str:
    """Equivalent term inside the vocabulary, else the expanded prefix."""
    own = q("https://gs1.org/voc/")
    known = [
        f"get({keep(values(member('item', key)), lambda v: f'startswith({v}, {own})')}, 0)"
        for key in ("owl:equivalentProperty", "owl:equivalentClass")
    ]
    local = compact_name("term_id")
    return (
        f"coalesce({', '.join(known)}, "
        f"CASE WHEN startswith(term_id, 'gs1:') THEN concat({own}, {local}) "
        f"WHEN startswith(term_id, 'schema:') THEN concat('https://schema.org/', {local}) "
        "ELSE term_id END)"
    )


def _shared_columns(list_separator: str) -> list[str]:
    return [
        "term_id",
        f"{compact_name('term_id')} AS compact_name",
        f"{text(member('item', 'rdfs:label'), list_separator)} AS label",
        f"{text(member('item', 'rdfs:comment'), list_separator)} AS comment",
        f"{types(member('item', '@type'))} AS type",
        f"{text(member('item', 'sw:term_status'), list_separator)} AS term_status",
    ]


def vocabulary_classes(items: DataFrame, *, list_separator: str = "; ") -> DataFrame:
    return items.filter(f"startswith(term_id, 'gs1:') AND {is_class()}").selectExpr(
        *_shared_columns(list_separator),
        f"{values(member('item', 'rdfs:subClassOf'))} AS sub_class_of",
        f"{full_iri()} AS full_iri",
    )


def vocabulary_properties(
    items: DataFrame, linktypes: DataFrame | None = None, *, list_separator: str = "; "
) -> DataFrame:
    """Properties with domain, range and the link-type flag."""
    found = items.filter(f"startswith(term_id, 'gs1:') AND {is_property()}").selectExpr(
        *_shared_columns(list_separator),
        f"{values(member('item', 'rdfs:domain'))} AS domain",
        f"{values(member('item', 'rdfs:range'))} AS range",
        f"{values(member('item', 'rdfs:subPropertyOf'))} AS sub_property_of",
        f"{full_iri()} AS full_iri",
    )
    declared = F.array_contains("sub_property_of", "gs1:linkType")
    if linktypes is None:
        return found.withColumn("is_link_type", declared)
    names = linktypes.select(F.col("name").alias("compact_name"), F.lit(True).alias("listed"))
    return (
        found.join(names.distinct(), "compact_name", "left")
        .withColumn("is_link_type", declared | F.coalesce("listed", F.lit(False)))
        .drop("listed")
    )


def linktypes_from_text(texts: DataFrame) -> DataFrame:
    """Link types keyed by name; entries that are not objects are dropped."""
    entries = texts.select(
        F.explode(F.expr("try_variant_get(try_parse_json(text), '$', 'map<string,variant>')"))
        .alias("name", "entry")
    ).filter("startswith(schema_of_variant(entry), 'OBJECT')")
    return entries.selectExpr(
        "name",
        *[f"{member('entry', key, 'string')} AS {key}" for key in ("title", "description", "status")],
        "to_json(entry) AS body",
    )


def linktypes_from_file(spark: SparkSession, path: str | None) -> DataFrame:
    """As ``linktypes_from_text``; no path gives no rows."""
    if path is None:
        empty = spark.createDataFrame([], "path string, text string")
        return linktypes_from_text(empty)
    return linktypes_from_text(whole_files(spark, path))


def turtle_terms(spark: SparkSession, path: str) -> DataFrame:
    """Distinct local names of terms that start a Turtle line."""
    lines = spark.read.text(path)
    name = F.regexp_extract("value", r"^\x{FEFF}?gs1:([A-Za-z][A-Za-z0-9_-]*)(?:\s+|$)", 1)
    return lines.select(name.alias("name")).filter("name <> ''").distinct()

"""Reference-data import and vocabulary update check, composed from operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tradeloom.fixed import VOCABULARY_CLASS_FIELDS, VOCABULARY_PROPERTY_FIELDS
from tradeloom.operators import profiles, ranking, snapshots
from tradeloom.sources import tabular, vocabulary


@dataclass(frozen=True)
class ReferenceImport:
    checks: DataFrame
    attributes: DataFrame
    properties: DataFrame
    classes: DataFrame

    def datasets(self) -> dict[str, DataFrame]:
        """What is written out, by name."""
        return {
            "attributes": self.attributes,
            "vocabulary_properties": self.properties,
            "vocabulary_classes": self.classes,
        }

    def attribute_summary(self) -> DataFrame:
        return profiles.attribute_profile(self.attributes)

    def vocabulary_summary(self) -> DataFrame:
        return profiles.vocabulary_profile(self.properties, self.classes)

    def duplicates(self) -> DataFrame:
        """The most frequent repeated ids and paths (``field``, ``value``, ``count``)."""
        found = [
            ranking.duplicate_values(self.attributes, name).withColumn("field", F.lit(name))
            for name in ("bms_id", "xpath")
        ]
        return found[0].unionByName(found[1])


def import_reference_data(
    sources: DataFrame, files: DataFrame, sheets: dict[str, DataFrame], graph: DataFrame,
    linktypes: DataFrame | None = None, *, attribute_version: str, vocabulary_version: str,
    last_modified: str = "",
) -> ReferenceImport:
    """Normalise attributes and vocabulary; refuse sources whose checksum is wrong.

    ``sources``: manifest rows (source_id, local_path, sha256). ``files``: local_path
    and content of what is on disk. The refusal happens when ``checks`` runs, so
    run it before writing the datasets.
    """
    lineage = {"version": F.lit(vocabulary_version), "last_modified": F.lit(last_modified)}
    properties = vocabulary.vocabulary_properties(graph, linktypes).withColumns(lineage)
    classes = vocabulary.vocabulary_classes(graph).withColumns(lineage)
    return ReferenceImport(
        checks=profiles.require_matching(profiles.checksum_checks(sources, files)),
        attributes=tabular.attribute_sheets(sheets, attribute_version),
        properties=properties.select(*VOCABULARY_PROPERTY_FIELDS),
        classes=classes.select(*VOCABULARY_CLASS_FIELDS),
    )


@dataclass(frozen=True)
class Snapshot:
    """One vocabulary version: its files and what was read from them."""

    files: DataFrame  # source, content
    graph: DataFrame
    linktypes: DataFrame
    turtle: DataFrame | None = None

    def counted(self) -> DataFrame:
        parts = [
            vocabulary.own_terms(self.graph).select(F.lit("jsonld").alias("source")),
            self.linktypes.select(F.lit("linktypes").alias("source")),
        ]
        if self.turtle is not None:
            parts.append(self.turtle.select(F.lit("ttl").alias("source")))
        counted = parts[0]
        for part in parts[1:]:
            counted = counted.unionByName(part)
        return counted


def check_updates(local: Snapshot, remote: Snapshot) -> dict[str, DataFrame]:
    """Compare two snapshots file by file and term by term.

    ``sources`` carries hashes, counts and the changed flag; ``terms`` and
    ``linktypes`` list what is new, removed or changed; ``actions`` says what to do.
    """
    changes = snapshots.source_changes(local.files, remote.files)
    counts = snapshots.term_counts(local.counted(), remote.counted())
    links = [
        side.linktypes.select(F.col("name"), F.expr(snapshots.sorted_json("body")).alias("body"))
        for side in (local, remote)
    ]
    return {
        "sources": changes.join(counts, "source", "left"),
        "terms": snapshots.diff_terms(
            vocabulary.own_terms(local.graph), vocabulary.own_terms(remote.graph)
        ),
        "linktypes": snapshots.diff(links[0], links[1], "name", "body"),
        "actions": snapshots.recommended_actions(changes),
    }

"""Quality rules whose cutoffs carry a guarantee on false rejections.

A rule rejects a document when a ratio of two of its counts, in per cent, exceeds a
cutoff. Cutoffs are chosen per stratum (language) on labelled documents: a cutoff is
valid when the exact binomial bound says that at most ``limit`` of the good documents
are rejected. Testing goes from the loosest cutoff to stricter ones and stops at the
first that fails (fixed sequence), with the error shared over strata and rules
(Bonferroni), so all chosen cutoffs hold together with probability ``1 - error``.
Of the valid cutoffs the loosest one that keeps nearly all of their effect is taken.
A stratum with too few labels for any bound takes the cutoff of all documents together,
whose guarantee is for them together. A stratum with labels enough whose safe cutoffs
reject no bad document takes that cutoff only if it is among the safe ones, else no rule.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tradeloom.llm.common import ship_package, stored
from tradeloom.llm.docstats import document_counts

#: Rule -> (part, whole): rejects when 100 * part > cutoff * whole.
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "duplicate_lines": ("n_dup_lines", "n_lines"),
    "repeated_words": ("n_repeat_words", "n_words"),
    "capitals": ("n_upper", "n_letters"),
    "separators": ("n_pipes", "n_words"),
}
TOP = 100


def most_rejections(n: int, p: float, error: float) -> int:
    """Largest k with P(X <= k) <= error, or -1: the most good documents a cutoff may reject."""
    total, k, log_p, log_q = 0.0, -1, math.log(p), math.log1p(-p)
    while k < n:
        i = k + 1
        total += math.exp(
            math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * log_p + (n - i) * log_q
        )
        if total > error:
            return k
        k = i
    return k


def rejections(levels: np.ndarray, good: np.ndarray, bad: np.ndarray) -> tuple[np.ndarray, int]:
    """Good and bad documents that each cutoff (0..101) rejects, and how many are good."""
    by_level = np.zeros((2, TOP + 2))
    np.add.at(by_level[0], levels, good)
    np.add.at(by_level[1], levels, bad)
    above = by_level[:, ::-1].cumsum(axis=1)[:, ::-1]  # at cutoff c: levels above c
    return np.hstack([above[:, 1:], np.zeros((2, 1))]), int(by_level[0].sum())


def strictest_safe(levels: np.ndarray, good: np.ndarray, bad: np.ndarray, limit: float, error: float) -> int | None:
    """Strictest cutoff shown to be safe (101 rejects nothing), or None with too few labels for any bound."""
    rejected, n = rejections(levels, good, bad)
    allowed = most_rejections(n, limit, error)
    return None if allowed < 0 else int(np.argmax(rejected[0] <= allowed))


def choose_cutoff(levels: np.ndarray, good: np.ndarray, bad: np.ndarray, limit: float, error: float, effect: float) -> int | None:
    """Cutoff for one rule and stratum, or None if no cutoff is shown to be safe and to reject a bad document.

    ``levels`` are the lowest cutoffs that spare a group of documents, ``good`` and
    ``bad`` how many of them are labelled so.
    """
    strictest = strictest_safe(levels, good, bad, limit, error)
    if strictest is None:
        return None
    rejected = rejections(levels, good, bad)[0][1]
    if not rejected[strictest]:
        return None
    return int(np.flatnonzero(rejected >= effect * rejected[strictest])[-1])


def level(part: str, whole: str):
    """Lowest cutoff (0..101) at which the rule spares the document."""
    ratio = F.when(F.col(whole) > 0, F.ceil(100 * F.col(part) / F.col(whole))).otherwise(0)
    return F.least(ratio, F.lit(TOP + 1)).cast("int")


def calibrate(counts: DataFrame, labels: DataFrame, limit: float, error: float, effect: float) -> DataFrame:
    """Cutoffs: ``stratum`` (null: all together) and two nullable int columns per rule.

    ``<rule>_cutoff`` is the stratum's own, ``<rule>_safe`` the strictest its bound shows safe.
    """
    marked = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    )
    rules = F.explode(F.array(*(
        F.struct(F.lit(name).alias("rule"), level(*pair).alias("level")) for name, pair in RULES.items()
    )))
    histogram = stored(
        counts.where("NOT base_failed").join(marked, "doc_id")
        .select("stratum", "quality", rules.alias("r"))
        .select(F.explode(F.array("stratum", F.lit(None))).alias("stratum"), "quality", "r.*")
        .groupBy("stratum", "rule", "level")
        .agg(F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
             F.sum(F.when(F.col("quality") == 1, 0).otherwise(1)).alias("bad"))
    )
    tests = max(1, histogram.select("stratum").distinct().count()) * len(RULES)

    ship_package(counts.sparkSession)

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        found = (rows["level"].to_numpy(), rows["good"].to_numpy(), rows["bad"].to_numpy(), limit / len(RULES), error / tests)
        return pd.DataFrame({"stratum": [rows["stratum"].iloc[0]], "rule": [rows["rule"].iloc[0]],
                             "cutoff": pd.array([choose_cutoff(*found, effect)], dtype="Int32"),
                             "safe": pd.array([strictest_safe(*found)], dtype="Int32")})

    return (
        histogram.groupBy("stratum", "rule").applyInPandas(choose, "stratum string, rule string, cutoff int, safe int")
        .groupBy("stratum").pivot("rule", list(RULES)).agg(F.first("cutoff").alias("cutoff"), F.first("safe").alias("safe"))
    )


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    limit: float = 0.05,
    error: float = 0.05,
    effect: float = 0.98,
    small: int = 10_000,
) -> DataFrame:
    """One row per document: counts, ``base_failed``, ``kept``, and the rules that reject it.

    Words are runs of other than space and \\x09-\\x0D. ``base_failed``: fewer than 50
    words, or more than half of the words in repeated three-word windows. ``kept``:
    neither that nor any rule of the document's stratum rejects it. ``limit`` is the
    share of good documents that all rules together may reject in a stratum, ``error``
    the probability that any chosen cutoff breaks its share.

    A null or empty text has no words and fails. A null language is a stratum of its
    own. A document labelled in several rows counts as good only if all say so; labels
    without id or quality are ignored. Without labels no rule rejects. Repeated rows
    and null ids are judged row by row; other columns are ignored. Up to ``small``
    strata the cutoffs are broadcast; beyond, they are joined by a shuffle.
    """
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    keys = docs.select("doc_id", "text", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("stratum"))
    counts = stored(document_counts(keys, "stratum").withColumn("base_failed", base))
    cutoffs = stored(calibrate(counts, labels, limit, error, effect))
    shared = (cutoffs.where("stratum IS NULL").collect() or [{}])[0]
    own = cutoffs.where("stratum IS NOT NULL")
    if own.limit(small + 1).count() <= small:
        own = F.broadcast(own)
    cutoff = {}
    for rule in RULES:
        every = F.lit(shared[f"{rule}_cutoff"] if shared else None).cast("int")
        safe = F.col(f"{rule}_safe")
        cutoff[rule] = F.coalesce(f"{rule}_cutoff", F.when(safe.isNull() | (every >= safe), every))
    hits = F.array_join(F.array(*(
        F.when((F.col(whole) > 0) & (100 * F.col(part) > cutoff[rule] * F.col(whole)), F.lit(rule))
        for rule, (part, whole) in RULES.items()
    )), ",")
    return (
        counts.join(own, "stratum", "left").withColumn("rejected_by", hits)
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                (~F.col("base_failed") & (F.col("rejected_by") == "")).alias("kept"), "rejected_by")
    )

"""Text helpers (SQL expression text in and out, see the package docstring).

The one exception is ``ascii_fold``: Spark has no NFKD normaliser, so values that
hold non-ASCII characters (and only those) pass an Arrow-batched pandas UDF.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from tradeloom import ship_with_tasks
from tradeloom.fixed import STOPWORDS
from tradeloom.functions import keep, matches, q, replace, some, strings

ship_with_tasks(__name__)

# White space as the source system's string trimming understands it: the Unicode
# White_Space property plus the four ASCII separators.
_WS = r"[\s\x1c-\x1f]"


def strip(e: str) -> str:
    """Trim every kind of Unicode white space (``trim`` only drops spaces)."""
    return replace(e, rf"(?U)^{_WS}+|{_WS}+\z")


def squeeze(e: str) -> str:
    """Collapse white-space runs to one space and trim."""
    return f"trim({replace(e, rf'(?U){_WS}+', ' ')})"


def has_value(e: str) -> str:
    """Text with at least one character that is not white space; null is false."""
    return f"coalesce({matches(e, r'(?U)[^\s\x1c-\x1f]')}, false)"


def has_items(e: str) -> str:
    """True for a non-empty array; null is false."""
    return f"coalesce(size({e}) > 0, false)"


@F.pandas_udf(T.StringType())
def _nfkd_ascii(texts: pd.Series) -> pd.Series:
    return texts.map(
        lambda t: None
        if t is None
        else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode("ascii")
    )


def ascii_fold(c: Column) -> Column:
    """Decompose accents and drop what is not ASCII; ASCII values skip Python."""
    plain = c.rlike(r"\A[\x00-\x7f]*\z")
    return F.when(plain, c).otherwise(_nfkd_ascii(F.when(~plain, c)))


def words_only(folded: str) -> str:
    """Lower-case words separated by single spaces, from folded text."""
    return f"lower(trim({replace(folded, '[^a-zA-Z0-9]+', ' ')}))"


def _tokens(words: str) -> str:
    return f"array_except(split({words}, ' '), {strings((*STOPWORDS, ''))})"


def word_tokens(folded: str) -> str:
    """Distinct non-stopword tokens of folded running text."""
    return _tokens(words_only(f"coalesce({folded}, '')"))


def name_tokens(e: str) -> str:
    """Distinct non-stopword tokens of a camelCase name."""
    spaced = replace(f"coalesce({e}, '')", "([a-z])([A-Z])", "$1 $2")
    return _tokens(f"lower({squeeze(spaced)})")


def xpath_terminal(e: str) -> str:
    """Last segment of a path without prefix, attribute marker and predicates."""
    last = f"element_at(split({replace(e, '/+$')}, '/'), -1)"
    return strip(replace(replace(replace(last, r"\A[^:]*:"), r"\A@+"), r"\[.*?\]"))


def overlap_fraction(a: str, b: str) -> str:
    """Shared tokens over the larger set; null when both sides are empty."""
    return f"(size(array_intersect({a}, {b})) / nullif(greatest(size({a}), size({b})), 0))"


def term_tokens(e: str, *, wide: bool = False) -> str:
    """All prefixed vocabulary terms in a text, in order of appearance.

    ``wide`` also lets ``_`` and ``-`` continue a term (explorer flavour).
    """
    tail = "[A-Za-z0-9_-]*" if wide else "[A-Za-z0-9]*"
    return f"regexp_extract_all({e}, {q(rf'(?:gs1|schema):[A-Za-z]{tail}')}, 0)"


def compact_name(e: str) -> str:
    """What follows the first colon, or the whole text without one."""
    return replace(e, r"\A[^:]*:")


def canonical_variants(e: str) -> str:
    """Distinct spellings under which a canonical field may be catalogued."""
    # Suffixes and renames.
    suffixes = (".value", ".unit_code", "_value", "_unit", "_unit_code", "_code")
    spellings = [e] + [
        f"CASE WHEN endswith({e}, {q(s)}) THEN left({e}, length({e}) - {len(s)}) END"
        for s in suffixes
    ]
    for long in ("preparation_state_code", "nutrient_type_code"):
        spellings.append(f"replace({e}, {q(long)}, {q(long[:-len('_code')])})")
    every = f"array({', '.join(spellings)})"
    return f"array_distinct({keep(every, lambda v: f'{v} <> {q(str())}')})"


def safe_filename(e: str, fallback: str = "file") -> str:
    """Base name with unsafe characters replaced and edge punctuation removed."""
    unified = replace(f"replace({e}, {q(chr(92))}, '/')", "/+$")
    base = f"coalesce(nullif(element_at(split({unified}, '/'), -1), ''), {q(fallback)})"
    safe = replace(replace(base, "[^A-Za-z0-9._-]+", "_"), r"\A[._-]+|[._-]+\z")
    return f"coalesce(nullif({safe}, ''), {q(fallback)})"


def safe_stem(e: str, fallback: str = "file") -> str:
    """``safe_filename`` without its last extension."""
    return replace(safe_filename(e, fallback), r"(?<=.)\.[^.]+\z")


def formula_safe(e: str) -> str:
    """Quote-prefix cells a spreadsheet would evaluate."""
    return f"CASE WHEN {matches(e, r'\A[=+\-@]')} THEN concat(chr(39), {e}) ELSE {e} END"


def safe_archive_path(e: str) -> str:
    """False for blank, absolute, parent-climbing or drive-qualified entries.

    Repeated slashes and single dots inside a path are harmless and ignored.
    """
    path = f"replace({e}, {q(chr(92))}, '/')"
    bad = some(f"split({path}, '/')", lambda p: f"({p} = '..' OR contains({p}, ':'))")
    return f"({has_value(path)} AND NOT startswith({path}, '/') AND NOT {bad})"


def candidate_key(property_id: str, attribute_id: str) -> str:
    def clean(e: str) -> str:
        return replace(e, "[^a-zA-Z0-9_]", "_")

    return f"concat('cand_', {clean(property_id)}, '__', {clean(attribute_id)})"

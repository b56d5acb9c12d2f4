"""Personal data in texts, by DataFrame functions alone.

A regular expression proposes spans of each kind, a validator confirms them (Luhn for
cards, mod-97 for account numbers, ranges and digit counts), and words nearby raise the
score. Positions come from the gaps between matches: a split at the same expression, whose
lengths are summed in blocks. The base expressions are possessive and start only where a
run starts; a text is searched for a kind only if it holds what every match must hold.
Places of a text are read from pieces of fixed length. So reading takes time linear in a
text's length, and *m* matches take no more than *m* times the root of *m* steps.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

#: Code points of a piece of a text.
PIECE = 256
SCORED = "array<struct<start:int,rank:int,end:int,kind:string,score:double>>"


@dataclass(frozen=True)
class Kind:
    """``needs``: expression that any text with a match satisfies. ``alone``: what must not
    stand before or after; ``after``: what must not follow, if not the same.
    ``base``: reported at any score.
    """

    name: str
    pattern: str
    needs: str
    score: float
    checked: float = 0.0
    context: str = ""
    alone: str = ""
    after: str = ""
    base: bool = False


#: Signs of an account number -> countries (IBAN registry).
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FK FO FI GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def iban_pattern() -> str:
    """Account numbers as long as their country's; of other codes, the longest run."""
    group, known = r"(?:\x20?[A-Z0-9]{4})", "|".join(IBAN_LENGTHS.values()).replace(" ", "|")
    parts = []
    for length, countries in IBAN_LENGTHS.items():
        groups, rest = divmod(length - 4, 4)
        tail = rf"\x20?[A-Z0-9]{{{rest}}}" if rest else ""
        parts.append(rf"(?:{countries.replace(' ', '|')})[0-9]{{2}}{group}{{{groups}}}{tail}")
    parts.append(rf"(?!{known})[A-Z]{{2}}[0-9]{{2}}{group}{{2,7}}(?:\x20?[A-Z0-9]{{1,3}})?")
    return "|".join(parts)


_LOCAL = "[A-Za-z0-9._%+-]"
#: In reporting order. The first four are the base kinds.
KINDS = (
    Kind("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.8,
         context="mail|e-mail|email|contact|write", base=True),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+", r"[0-9]\.[0-9]", 0.4, 0.3,
         context="ip|address|host|server", base=True),
    # Whole runs of digits that have 12 to 19: others never pass.
    Kind("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])", r"[0-9](?:[\x20-]?[0-9]){11}", 0.4, 0.4,
         context="card|visa|credit|debit|payment", base=True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", 0.5, 0.2,
         context="phone|tel|call|mobile|fax", base=True),
    Kind("iban", iban_pattern(), r"[A-Z]{2}[0-9]{2}", 0.2, 0.5,
         context="iban|account|bank|konto|compte|cuenta", alone="[A-Za-z0-9]"),
    Kind("local_phone", r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}", r"[0-9]{3}[.-][0-9]{4}", 0.4,
         context="phone|tel|call|mobile|fax|telefon|telefono|téléphone", alone="[0-9+.-]",
         after="[0-9+]|[.-][0-9]"),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "[0-9]{3}-[0-9]{2}-[0-9]{4}", 0.4,
         context="ssn|social security", alone="[0-9-]", after="-?[0-9]"),
)


def matches(text: Column, pattern: str) -> tuple[Column, Column]:
    """All leftmost non-overlapping matches, and the gaps before, between and after them."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)


def pieces_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, wherever it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def numbers() -> Column:
    return F.array().cast("array<int>")


def last(array: Column) -> Column:
    return F.get(array, F.size(array) - 1)


def blocks(array: Column) -> Column:
    """The array in blocks of about the root of its size."""
    return let(F.greatest(F.ceil(F.sqrt(F.size(array))).cast("int"), F.lit(1)), lambda step: F.transform(
        F.when(F.size(array) > 0, F.sequence(F.lit(0), F.floor((F.size(array) - 1) / step).cast("int"))).otherwise(numbers()),
        lambda k: F.slice(array, k * step + 1, step),
    ))


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Running sums or maxima (``join``) of whole numbers from 0 on: within blocks, then across."""

    def scan(part: Column, value: Callable[[Column], Column]) -> Column:
        return F.aggregate(part, numbers(), lambda done, x: F.concat(
            done, F.array(join(F.coalesce(last(done), F.lit(0)), value(x)))))

    return let(F.transform(blocks(values), lambda part: scan(part, lambda x: x)), lambda parts: let(
        scan(parts, last), lambda tops: F.flatten(F.transform(parts, lambda part, k: F.transform(
            part, lambda x: join(x, F.coalesce(F.get(tops, k - 1), F.lit(0))))))))


def located(found: Column, gaps: Column) -> Column:
    """Matches with their places in code points, end exclusive."""
    lengths = F.transform(found, lambda x, k: F.length(F.get(gaps, k)) + F.length(x))
    return let(running(lengths, lambda a, b: a + b), lambda ends: F.transform(found, lambda x, k: F.struct(
        (F.get(ends, k) - F.length(x)).alias("start"), F.get(ends, k).alias("end"), x.alias("found"))))


def cut(pieces: Column, begin: Column, end: Column) -> Column:
    """Code points ``begin`` to ``end`` (exclusive) of a text in pieces."""
    first = F.floor(begin / PIECE).cast("int")
    here = F.slice(pieces, first + 1, F.floor((end - 1) / PIECE).cast("int") - first + 1)
    return F.when(end > begin, F.substr(F.array_join(here, ""), begin - first * PIECE + 1, end - begin)).otherwise("")


def untouched(spans: Column, base: Column) -> Column:
    """``spans`` that no span of ``base`` (sorted by start) overlaps; blocks of ``base`` out of reach are passed over."""

    def meets(x: Column, b: Column) -> Column:
        return (b["start"] < x["end"]) & (x["start"] < b["end"])

    held = F.transform(blocks(base), lambda part: F.struct(
        F.get(part, 0)["start"].alias("start"), F.array_max(F.transform(part, lambda b: b["end"])).alias("end"), part.alias("part")))
    return F.when(F.size(base) == 0, spans).otherwise(let(held, lambda held: F.filter(
        spans, lambda x: ~F.exists(held, lambda h: meets(x, h) & F.exists(h["part"], lambda b: meets(x, b))))))


def digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def mod_97(found: Column) -> Column:
    """Remainder of an account number, its first four signs moved to the end, letters as 10 to 35."""
    bare = F.replace(found, F.lit(" "))
    signs = F.split(F.concat(F.substr(bare, F.lit(5)), F.substr(bare, F.lit(1), F.lit(4))), "")
    value = lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
    return F.aggregate(
        F.filter(signs, lambda c: c != ""), F.lit(0),
        lambda rest, c: (rest * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97,
    )


def confirmed(kind: Kind, found: Column) -> Column:
    n = F.length(digits(found))
    match kind.name:
        case "ip":
            return F.forall(F.split(found, r"\."), lambda part: F.length(F.ltrim(part, F.lit("0"))) <= 3) & F.forall(
                F.split(found, r"\."), lambda part: F.coalesce(F.right(part, F.lit(4)).try_cast("int") <= 255, F.lit(False))
            )
        case "card":
            return n.between(12, 19) & F.call_function("luhn_check", digits(found))
        case "phone":
            return n.between(9, 15)
        case "iban":
            return mod_97(found) == 1
    return F.lit(True)


def scored(pieces: Column, size: Column, rank: int, kind: Kind, spans: Column, reach: int) -> Column:
    """Confirmed spans with the score that checks and nearby words give them."""

    def at(begin: Column, end: Column) -> Column:
        return cut(pieces, F.greatest(begin, F.lit(0)), F.least(end, size))

    def score(x: Column) -> Column:
        value = F.lit(kind.score + kind.checked)
        if not kind.context:
            return value
        near = F.lower(F.concat_ws("\n", at(x["start"] - reach, x["start"]), at(x["end"], x["end"] + reach)))
        return value + F.when(F.rlike(near, F.lit(rf"(^|[^\p{{L}}])({kind.context})([^\p{{L}}]|$)")), 0.3).otherwise(0.0)

    def fits(x: Column) -> Column:
        if not kind.alone:
            return confirmed(kind, x["found"])
        before, behind = at(x["start"] - 1, x["start"]), at(x["end"], x["end"] + 2)
        close = F.rlike(before, F.lit(kind.alone)) | F.rlike(behind, F.lit(f"^(?:{kind.after or kind.alone})"))
        return confirmed(kind, x["found"]) & ~close

    return F.transform(F.filter(spans, fits), lambda x: F.struct(
        x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"),
        F.lit(kind.name).alias("kind"), score(x).alias("score"),
    ))


def detect(docs: DataFrame, least: float = 0.6, reach: int = 30) -> DataFrame:
    """All columns of ``docs``, plus ``pii``: spans by start, then kind as listed.

    A span has start, rank of its kind, end (code points, end exclusive), kind and
    score. Base kinds are reported whenever their validator confirms them; others need
    a score of ``least`` and a place that no base span touches. ``reach`` is how far
    context words are looked for. A null or empty text has no span. Repeated rows and
    null ids are searched row by row; a column named ``pii`` is replaced.
    """
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "pii"]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    proposed = []
    for kind in KINDS:
        possible = F.contains(text, F.lit(kind.needs)) if kind.needs == "@" else F.rlike(text, F.lit(kind.needs))
        found, gaps = matches(text, kind.pattern)
        none = F.array().cast("array<string>")
        proposed.append(F.when(possible, F.struct(found.alias("found"), gaps.alias("gaps"))).otherwise(
            F.struct(none.alias("found"), none.alias("gaps"))).alias(f"_{kind.name}"))
    spans = [located(F.col(f"_{kind.name}.found"), F.col(f"_{kind.name}.gaps")).alias(f"_{kind.name}") for kind in KINDS]
    any_found = F.greatest(*(F.size(F.col(f"_{kind.name}.found")) for kind in KINDS)) > 0
    pieces = F.when(any_found, pieces_of(text)).otherwise(F.array().cast("array<string>"))
    groups = [scored(F.col("_pieces"), F.col("_size"), rank, kind, F.col(f"_{kind.name}"), reach).alias(f"_{kind.name}")
              for rank, kind in enumerate(KINDS)]
    base = F.array_sort(F.concat(*(F.col(f"_{kind.name}") for kind in KINDS if kind.base)))
    more = F.concat(*(F.col(f"_{kind.name}") for kind in KINDS if not kind.base))
    free = untouched(F.filter("_more", lambda x: x["score"] >= least), F.col("_base"))
    return (
        docs.select(*rest, *proposed)
        .select(*rest, *spans, pieces.alias("_pieces"), F.length(text).alias("_size"))
        .select(*rest, *groups)
        .select(*rest, base.alias("_base"), more.alias("_more"))
        .select(*rest, F.array_sort(F.concat("_base", free)).cast(SCORED).alias("pii"))
    )


def spelled(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redact(docs: DataFrame, least: float = 0.6, reach: int = 30) -> DataFrame:
    """``docs`` with each span replaced by its kind in brackets; ``n_chars`` follows if there.

    Overlapping spans are replaced as one, under the kind that starts first. Other
    columns and rows stay; null texts stay null.
    """
    tops = running(F.transform("pii", lambda x: x["end"]), F.greatest)
    n = F.size("pii")
    heads = let(tops, lambda tops: let(
        F.filter(F.sequence(F.lit(0), n - 1), lambda k: (k == 0) | (F.get("pii", k)["start"] >= F.get(tops, k - 1))),
        lambda heads: F.transform(heads, lambda k, i: F.struct(
            F.get("pii", k)["start"].alias("start"), F.get(tops, F.coalesce(F.get(heads, i + 1), n) - 1).alias("end"),
            F.get("pii", k)["kind"].alias("kind")))))
    merged = F.when(n > 0, F.struct(heads.alias("spans"), pieces_of(F.col("text")).alias("pieces")))
    spans, pieces = F.col("_merged.spans"), F.col("_merged.pieces")
    parts = F.transform(spans, lambda x, i: F.concat(
        cut(pieces, F.coalesce(F.get(spans, i - 1)["end"], F.lit(0)), x["start"]), F.lit("["), F.upper(x["kind"]), F.lit("]")))
    clean = F.when(F.col("_merged").isNotNull(), F.concat(
        F.array_join(parts, ""), cut(pieces, last(spans)["end"], F.length("text"))
    )).otherwise(F.col("text"))
    found = detect(docs, least, reach).withColumn("_merged", merged).withColumn("text", clean)
    if "n_chars" in docs.columns:
        found = found.withColumn(
            "n_chars", F.when(F.col("_merged").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
        )
    return found.select(*docs.columns)


def pii_digest(docs: DataFrame) -> DataFrame:
    """One row per document: counts of base spans, their digest, and all spans spelled out."""
    base = F.filter("pii", lambda x: x["rank"] < sum(kind.base for kind in KINDS))

    def count(name: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == name)).cast("long").alias(f"n_{name}")

    counts = [count(kind.name) for kind in KINDS if kind.base]
    return detect(docs.select("doc_id", "text")).select("doc_id", "pii", base.alias("base")).select(
        "doc_id", *counts, F.sha2(spelled(F.col("base")), 256).alias("base_sha256"), spelled(F.col("pii")).alias("spans")
    )

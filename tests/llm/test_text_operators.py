"""Language, page text, benchmark tiling and personal data against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
import unicodedata
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tradeloom.llm import html_regions, language_id, pii, tiling
from tradeloom.llm.oracles import PII

# --- Language --------------------------------------------------------------------

LANGS = {"aa": "the of and thing with from", "bb": "der die und schön über nicht", "cc": "été les une français avec", "dd": "το και την είναι"}


def sentences(chance, lang: str, n: int) -> str:
    return " ".join(chance.choices(LANGS[lang].split(), k=n))


def spans(text: str | None) -> list[str]:
    text = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    return [f" {w} "[k : k + 3] for w in text.split() for k in range(len(w))]


def test_trigrams_are_those_of_words():
    texts = ["It's, über 3.5!", None, "", "x", "\0a\0", "ΑΒΓ  δ", "İstanbul", "a b" * 50]
    grams, sizes = language_id.trigrams(texts)
    at = 0
    for text, size in zip(texts, sizes, strict=True):
        mine = ["".join(chr(int(g) >> s & 0x1FFFFF) for s in (42, 21, 0)) for g in grams[at : at + size]]
        assert mine == spans(text)
        at += size


def test_languages_held_out(spark):
    chance = random.Random(7)
    rows = [(k, sentences(chance, lang, chance.randrange(1, 30)), lang, "x") for k, lang in enumerate(chance.choices(list(LANGS), k=400))]
    rows += [(1000, None, "aa", "x"), (1001, "12 34 !", "aa", "x"), (1002, "the thing", None, "x"), (None, "der die", "bb", "x"), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = language_id.language_ids(docs).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    want = {k: lang for k, _, lang, _ in rows if k is not None and k < 1000}
    held = [r for r in got if r.held_out and r.doc_id in want]
    assert len(held) > 50 and all(r.lang_pred == want[r.doc_id] for r in held)
    of = {r.doc_id: r for r in got}
    assert (of[1000].lang_pred, of[1000].score) == (of[1001].lang_pred, of[1001].score) == ("und", 0.0)
    assert of[1002].lang_pred == "aa" and of[None].lang_pred == "bb" and not of[None].held_out
    nothing = language_id.language_ids(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
    assert language_id.language_ids(docs.limit(0)).count() == 0


def test_filter_has_no_false_negative_and_many_languages():
    chance = np.random.default_rng(3)
    grams = chance.integers(0, 2**62, 5000)
    owner = chance.integers(0, 150, 5000)
    found = language_id.Filter.of([f"l{k:03}" for k in range(150)], grams, owner)
    masks = found.languages_of(grams)
    assert all(masks[k, owner[k] // 64] >> np.uint64(owner[k] % 64) & np.uint64(1) for k in range(5000))
    other = chance.integers(0, 2**62, 20_000)
    rate = np.unpackbits(found.languages_of(other).view(np.uint8)).sum() / 20_000
    assert rate == pytest.approx(found.wrong.sum(), abs=0.002)


def test_filter_is_as_large_as_the_largest_language_needs():
    chance = np.random.default_rng(4)
    grams, owner = chance.integers(0, 2**62, 200 * 5000), np.repeat(np.arange(200), 5000)
    found = language_id.Filter.of([f"l{k:03}" for k in range(200)], grams, owner)
    assert found.slots.nbytes == 4 * 8 * 2**17 and found.wrong.max() < 0.003
    masks = found.languages_of(grams[::50])
    assert all(masks[k, o // 64] >> np.uint64(o % 64) & np.uint64(1) for k, o in enumerate(owner[::50]))


def test_languages_equal_plain_version(spark):
    chance = random.Random(8)
    rows = [(k, " ".join(sentences(chance, lang, 6).split()[: chance.randrange(1, 7)]) + (" the der" if k % 5 == 0 else ""), lang)
            for k, lang in enumerate(chance.choices(list(LANGS), k=200))]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.language_ids(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    counts = {lang: Counter() for lang in LANGS}
    for k, text, lang in rows:
        if zlib.crc32(str(k).encode()) % 4 != 2:
            counts[lang].update(spans(text))
    often = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in counts.items()}
    owned = {lang: {g for g, f in fs.items() if f >= 1e-6 and f >= 0.5 * max(o.get(g, 0) for o in often.values())} for lang, fs in often.items()}
    for k, text, _ in rows:
        hits = {lang: sum(g in owned[lang] for g in spans(text)) / len(spans(text)) for lang in LANGS}
        assert got[k][1] == pytest.approx(max(hits.values()) / sum(hits.values()), abs=0.02)
        if sorted(hits.values())[-1] - sorted(hits.values())[-2] > 0.01:
            assert got[k][0] == max(hits, key=hits.get)


# --- Pages -----------------------------------------------------------------------

PAGES = {
    "plain": ("<html><head><title>T</title><style>p{}</style></head><body><nav><a href=x>Home</a></nav><article><h1>Head &amp; tail</h1>"
              "<p>One\n  two<b>three</b></p><p>x</p><ul><li>li</li></ul></article><footer>&copy; f</footer></body>", "Head & tail\nOne twothree\nx\nli"),
    "unclosed": ("<article><h1>A</h1><p><b>one<br>two<p>three<script>var a='</p>';</script>", "A\none two\nthree"),
    "marked": ("<div class='top ad'>buy</div><main><p>text</p><aside>no</aside><form>f<input></form><div id=comments><p>c</p></div>"
               "<p class=comments-open hidden>h</p></main><div role=banner>b</div>", "text"),
    "open comments": ("<article class='post comments-open'><p>kept</p><article class=comment>gone</article></article>", "kept"),
    "regions": ("<div><a>a</a> <a>b</a> <a>c</a></div><div><p>" + "A long run of text without tags. " * 9 + "</p><p>short</p></div><div><a>d</a><a>e</a></div>",
                ("A long run of text without tags. " * 9).strip() + "\nshort"),
    "text only": ("just &lt;text&gt; &#233;", "just <text> é"),
    "cut": ("<article><p>begin <a href='x", "begin"),
    "empty": ("", ""), "null": (None, ""), "tags only": ("<p></p><br><article></article>", ""), "comment": ("<!-- x --><p>y</p>", "y"),
    "long": ("<article>" + "<p>w</p>" * 20_000 + "</article>", "\n".join(["w"] * 20_000)),
}


def test_page_texts(spark):
    rows = [(k, f"http://{name}", html, "clash") for k, (name, (html, _)) in enumerate(PAGES.items())]
    rows += [rows[0], (None, None, "<p>n</p>", "clash")]
    got = html_regions.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    want = [(r[0], r[1], PAGES[r[1][7:]][1] if r[1] else "n") for r in rows]
    assert sorted(((r.page_id, r.url, r.text) for r in got), key=str) == sorted(want, key=str)
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_regions.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_split_and_smoothing():
    assert html_regions.split_point(np.array([1.0, 2, 1, 30, 28])) == 28
    assert html_regions.split_point(np.array([5.0, 5])) == 5
    assert html_regions.smooth(np.full(7, 3.0), 1.0) == pytest.approx(np.full(7, 3.0))
    peak = html_regions.smooth(np.array([0.0, 0, 9, 0, 0]), 1.0)
    assert peak.argmax() == 2 and peak[1] > peak[0] > 0


PARAGRAPH = "A sentence of the text that has no mark-up in it. " * 6
LINKS = "".join(f"<li><a href=/{k}>Topic {k}</a></li>" for k in range(9))
CARDS = "".join(f"<article><h2><a href=/{k}>Story {k}</a></h2><p>In a few words</p><a href=/{k}>More</a></article>" for k in range(4))


def test_clusters_decide_beside_and_inside_articles():
    texts = "\n".join([PARAGRAPH.strip()] * 3)
    paragraphs = f"<p>{PARAGRAPH}</p>" * 3
    page = html_regions.main_text
    assert page(f"<div>{paragraphs}</div><div>{CARDS}</div>") == texts
    assert page(f"<main><article>{paragraphs}</article><ul>{LINKS}</ul></main>") == texts
    assert page(f"<main>{paragraphs}<ul>{LINKS}</ul></main>") == texts
    assert page(f"<main><div>{paragraphs}</div><div>{LINKS}</div></main>") == texts
    short = "One short paragraph of some fifty characters here."
    sections = f"<section><h2>First</h2>{paragraphs}</section><section><h2>Then</h2><p>{short}</p><p>{short}</p><ul><li>a</li><li>b</li></ul></section>"
    want = f"First\n{texts}\nThen\n{short}\n{short}\na\nb"
    for around in ("article", "main", "div"):
        assert page(f"<{around}>{sections}</{around}><div><ul>{LINKS}</ul></div>") == want
    assert page(f"<article>{paragraphs}</article><section>{paragraphs}</section>") == f"{texts}\n{texts}"
    assert page("<article><p>One line.</p></article><div><p>Another line.</p></div>") == "One line.\nAnother line."


def test_layout_wrappers_are_read():
    page = html_regions.main_text
    body = f"<p>{PARAGRAPH}</p>"
    for attrs in ('class="layout has-sidebar"', 'id="page-header-fixed"', 'class="content no-comments"', 'class="social-post-body"',
                  'class="widget"', 'class="site-header"', 'id="banner-area"'):
        aside = '<div class="sidebar-left">left</div><div class="top ad">buy</div><div id=comments-list><p>said</p></div>'
        assert page(f"<div {attrs}>{body}{aside}</div>") == PARAGRAPH.strip()
        assert page(f"<div {attrs}><article><p>in it</p></article></div><div class=ad>{body}{body}</div>") == "in it"
    assert page(f'<div class="comments"><article class="comment">{body}{body}</article></div><article>{body}</article>') == PARAGRAPH.strip()
    assert page(f'{body}<p class="share">Share this</p><span class="widget">so</span><p>end</p>') == f"{PARAGRAPH.strip()}\nend"


def test_no_page_is_lost_in_a_form_or_an_open_element():
    page, text = html_regions.main_text, PARAGRAPH.strip()
    body = f"<p>{PARAGRAPH}</p>"
    nav = f"<nav><ul>{LINKS}</ul></nav>"
    for wrapped in (f"<form>{nav}<div>{body}</div><label>Name</label><input><button>Go</button></form>",
                    f"<form>{nav}<article>{body}</article><footer>f</footer></form>", f"<form><main>{body}</main><aside>no</aside></form>"):
        assert page(wrapped) == text
    for open_ in ("nav", "aside", "header", "footer"):
        for part in ("article", "main"):
            assert page(f"<{open_}><ul>{LINKS}</ul><{part}><h1>Head</h1>{body}</{part}><footer>f</footer>") == f"Head\n{text}"
    assert page(f"<header><a href=/>Home</a><div>{body}{body}</div>").endswith(f"{text}\n{text}")
    assert page(f"<article><header><h1>Title</h1><p>by somebody</p></header>{body}<footer>f</footer></article>") == f"Title\n{text}"
    assert page(f"<header><h1>Site</h1></header><article>{body}</article><form>Subscribe to us</form>") == text
    assert page(f"<div>{body}{body}</div><aside><article><p>Related story</p></article></aside><form><p>Ask</p></form>") == f"{text}\n{text}"
    assert page(f"<main>{body}<aside><article>{body}{body}{body}</article></aside></main>") == text
    assert page(f"<nav><ul>{LINKS}</ul></nav><footer><p>{PARAGRAPH}</p></footer>") == ""


def test_many_open_elements():
    begin = time.monotonic()
    body = "".join(f"<nav><p>{k} <form><a href=/>l</a><aside>" for k in range(20_000))
    assert html_regions.main_text(f"{body}<article><p>{PARAGRAPH}</p></article>") == PARAGRAPH.strip()
    assert html_regions.main_text(f"<article><p>{PARAGRAPH}</p></article>{body}") == PARAGRAPH.strip()
    assert time.monotonic() - begin < 10


def test_comments_of_readers_beside_a_plain_article():
    page, body = html_regions.main_text, f"<p>{PARAGRAPH}</p>"
    for name in ("post-comments", "user-comment", "reader-responses", "page-sidebar", "blog_replies", "comments-list", "entry-related"):
        assert page(f"<div>{body}{body}{body}</div><div class='{name}'>{body}</div>") == "\n".join([PARAGRAPH.strip()] * 3)
    for name in ("post-header-image", "article-body", "post", "commentary", "page-shareholders"):
        assert page(f"<div class='{name}'>{body}</div><div>{body}</div>") == "\n".join([PARAGRAPH.strip()] * 2)


def plain_smooth(values: list[float], sigma: float) -> list[float]:
    reach = max(1, int(3 * sigma))
    out = []
    for at in range(len(values)):
        near = [(math.exp(-0.5 * ((k - at) / sigma) ** 2), values[k]) for k in range(max(0, at - reach), min(len(values), at + reach + 1))]
        out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
    return out


def plain_split(values: list[float]) -> float:
    """The start of the upper of two clusters with the least sum of squares within, by trying all."""
    def within(part: list[float]) -> float:
        return sum((v - sum(part) / len(part)) ** 2 for v in part)

    cuts = sorted(set(values))[1:]
    return min(cuts, key=lambda c: within([v for v in values if v < c]) + within([v for v in values if v >= c]), default=min(values))


def test_smoothing_and_clustering_equal_plain_versions():
    chance = random.Random(5)
    for _ in range(200):
        values = [chance.choice([1.0, 2.5, 40.0, chance.uniform(0, 60)]) for _ in range(chance.randrange(1, 30))]
        sigma = chance.choice([0.5, 1.0, 2.0])
        assert html_regions.smooth(np.array(values), sigma) == pytest.approx(plain_smooth(values, sigma))
        assert html_regions.split_point(np.array(values)) == pytest.approx(plain_split(values))


# --- Tiling ----------------------------------------------------------------------


def plain_tiles(text: list[str], item: list[str], match: int) -> int:
    """Greedy tiling by trying all starts: the longest free run first, earliest on a tie."""
    used_text, used_item, covered = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for a in range(len(text)):
            for b in range(len(item)):
                n = 0
                while (a + n < len(text) and b + n < len(item) and text[a + n] == item[b + n]
                       and a + n not in used_text and b + n not in used_item):
                    n += 1
                if n > best[0]:
                    best = (n, a, b)
        n, a, b = best
        if n < match:
            return covered
        used_text.update(range(a, a + n))
        used_item.update(range(b, b + n))
        covered += n


def test_tiles_equal_plain_version():
    chance = random.Random(11)
    for _ in range(150):
        item = chance.choices("abcd", k=chance.randrange(0, 25))
        text = chance.choices("abcdx", k=10) + item[8:] + chance.choices("abx", k=4) + item[:8]
        block = tiling.Block.of([(1, " ".join(item))], 3)
        got = list(block.leaks(" ".join(text), 0.0))
        want = plain_tiles(text, item, 3)
        assert (got[0][2] if got else 0) == want


def test_leaks_and_their_removal(spark):
    item = " ".join(f"tok{k}" for k in range(40))
    parts = item.split()
    shuffled = " ".join([*parts[30:], "and", *parts[:15], "then", *parts[15:30]])
    benchmark = spark.createDataFrame([(1, item, "x"), (2, None, "x"), (3, "short one", "x"), (4, "Other, benchmark item; with words enough!", "x")],
                                      "item_id long, text string, doc_id string")
    rows = [(1, f"before {item} after", "x"), (2, shuffled.upper(), "x"), (3, " ".join(parts[:10]), "x"), (4, "clean text of its own", "x"), (5, None, "x"),
            (6, "", "x"), (7, "w " * 30_000 + item, "x"), (8, "other benchmark item with words enough", "x"), (1, f"before {item} after", "x"), (None, item, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    for characters in (20_000_000, 10):
        got = tiling.leaks(docs, benchmark, block_characters=characters).collect()
        assert sorted((r.doc_id or 0, r.item_id) for r in got) == [(0, 1), (1, 1), (1, 1), (2, 1), (7, 1), (8, 4)]
        assert {(r.tiles, r.coverage) for r in got if r.doc_id == 2} == {(3, 1.0)}
        kept = tiling.without_leaks(docs, benchmark, block_characters=characters)
        assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6] and kept.columns == docs.columns
    assert tiling.leaks(docs, benchmark.limit(0)).count() == 0 and tiling.leaks(docs.limit(0), benchmark).count() == 0
    assert tiling.without_leaks(docs, benchmark.limit(0)).count() == len(rows)


# --- Personal data ---------------------------------------------------------------

BASE = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def valid(kind: str, found: str) -> bool:
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(part) <= 255 for part in found.split("."))
    if kind == "card":
        doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def base_spans(text: str | None) -> list[tuple]:
    found = [(m.start(), k, m.end(), kind) for k, (kind, pattern) in enumerate(BASE)
             for m in re.finditer(pattern, text or "") if valid(kind, m[0])]
    return sorted(found)


CASES = [
    None, "", "nothing", "a@b.c", "x.y+z@mail.example.com, 1.2.3.4!", "a@b.c_d@e.f", "a@b", "@x.y", "a@@b.c", "é@b.c ü 😀 9@b.co", "256.1.1.1 1.2.3.4.5.6.7.8 0001.02.3.4 1.2.3.99999999999999999999",
    "4111 1111 1111 1111", "4111111111111112", "4111-1111--1111-1111", "4111111111111111 4111111111111111", "5500 0000 0000 0004-", "1 2 3", "+1 (499) 555-6503 x", "+49 30", "++12345678901", "+1234567890123456",
    "card 4012888888881881 tel +44 20 7946 0958", "0" * 50_000, "a." * 20_000 + "@b.c", "a@" + "b." * 20_000 + "c", "1 " * 10_000, "+" + "1 " * 20_000, "x" * 100_000,
    "IBAN DE89 3704 0044 0532 0130 00.", "GB82WEST12345698765432", "GB82WEST12345698765431", "call 555-123-4567 now", "555-123-4567", "tel: (555) 123-4567", "ssn 123-45-6789 and 123-45-6789-0",
]


def test_base_spans_equal_plain_version(spark):
    chance = random.Random(13)
    rows = [*enumerate(CASES), (None, "a@b.c"), (3, "a@b.c")]
    rows += [(1000 + k, "".join(chance.choices("ab1234. +-()@é", k=chance.randrange(120)))) for k in range(600)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, pii string").repartition(8)
    got = {(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.pii_digest(docs).collect()}
    want = set()
    for doc_id, text in rows:
        found = base_spans(text)
        digest = hashlib.sha256(",".join(f"{kind}:{a}:{b}" for a, _, b, kind in found).encode()).hexdigest()
        want.add((doc_id, *(sum(f[3] == kind for f in found) for kind, _ in BASE), digest))
    assert got == want
    assert pii.pii_digest(docs.limit(0)).count() == 0 and pii.pii_digest(docs).count() == len(rows)


def test_added_kinds_and_context(spark):
    docs = spark.createDataFrame(list(enumerate(CASES)), "doc_id long, text string")
    spans = {CASES[r.doc_id]: r.spans for r in pii.pii_digest(docs).collect()}
    assert spans["IBAN DE89 3704 0044 0532 0130 00."] == "iban:5:32"
    assert spans["GB82WEST12345698765432"] == "iban:0:22" and spans["GB82WEST12345698765431"] == ""
    assert spans["call 555-123-4567 now"] == "local_phone:5:17" and spans["555-123-4567"] == ""
    assert spans["tel: (555) 123-4567"] == "local_phone:5:19"
    assert spans["ssn 123-45-6789 and 123-45-6789-0"] == "ssn:4:15"
    scores = {s.kind: s.score for s in pii.detect(docs.where("text LIKE 'card 4012%'")).first().pii}
    assert scores == pytest.approx({"card": 1.1, "phone": 1.0})


def test_added_kinds_at_boundaries(spark):
    want = {
        "Call me at 555-123-4567.": "local_phone:11:23", "tel 555-123-4567- or so": "local_phone:4:16", "tel 555-123-4567.\n5": "local_phone:4:16",
        "call 555-123-4567.5": "", "call 555-123-4567-8": "", "call 555-123-45678": "", "call 1-555-123-4567": "", "ssn 123-45-6789-": "ssn:4:15",
        "IBAN ES91 2100 0418 4502 0005 1332 El titular": "iban:5:34", "IBAN ES91 2100 0418 4502 0005 1332 TITULAR": "iban:5:34",
        "ES9121000418450200051332 GB82 WEST 1234 5698 7654 32 UND": "iban:0:24,iban:25:52", "ES9121000418450200051332X": "",
        "NO93 8601 1117 947 KONTO": "iban:0:18", "BE68 5390 0754 7034 and": "iban:0:19",
    }
    docs = spark.createDataFrame(list(enumerate(want)), "doc_id long, text string")
    assert {list(want)[r.doc_id]: r.spans for r in pii.pii_digest(docs).collect()} == want
    clean = pii.redact(docs.where("doc_id IN (0, 8)")).orderBy("doc_id").collect()
    assert [r.text for r in clean] == ["Call me at [LOCAL_PHONE].", "IBAN [IBAN] El titular"]


def test_many_matches_take_no_square_of_steps(spark):
    card = "4012888888881881"
    texts = [card + " x" + " 12 x" * 50_000, "call a@b.co or +1 (499) 555-6503, ssn 123-45-6789; " * 4000, "é 1.2.3.4 " * 20_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3, "doc_id")
    begin = time.monotonic()
    got = {r.doc_id: r for r in pii.pii_digest(docs).collect()}
    assert time.monotonic() - begin < 60
    for k, text in enumerate(texts):
        found = base_spans(text)
        assert got[k].base_sha256 == hashlib.sha256(",".join(f"{kind}:{a}:{b}" for a, _, b, kind in found).encode()).hexdigest()
    assert got[1].spans.count("ssn") == 4000 and got[0].spans == "card:0:16"
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert clean[1] == "call [EMAIL] or [PHONE], ssn [SSN]; " * 4000 and clean[2] == "é [IP] " * 20_000


def test_spans_touched_by_base_spans(spark):
    rows = [(1, "call +1 555-123-4567 or 555-123-4567"), (2, "tel 555-123-4567@x.yz 555-123-4567 " * 30), (3, "ssn 123-45-6789@a.b")]
    got = {r.doc_id: r.spans for r in pii.pii_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == "phone:5:20,local_phone:24:36"
    assert got[2] == ",".join(f"email:{k + 4}:{k + 21},local_phone:{k + 22}:{k + 34}" for k in range(0, 30 * 35, 35)) and got[3] == "email:4:19"


def test_spans_equal_sql_twin(spark):
    docs = [(k, text) for k, text in enumerate(CASES) if len(text or "") < 1000]
    mine = {tuple(r) for r in pii.pii_digest(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    assert mine == {tuple(r) for r in con.execute(PII).fetchall()}


def test_redaction(spark):
    rows = [(1, "write x@y.z or +1 (499) 555-6503.", 33, "k"), (2, None, None, "k"), (3, "clean", 5, "k"), (4, "é a@b.c", 7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, extra string")
    got = pii.redact(docs)
    assert got.columns == docs.columns and got.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    assert sorted(map(tuple, got.collect())) == sorted([
        (1, "write [EMAIL] or [PHONE].", 25, "k"), (2, None, None, "k"), (3, "clean", 5, "k"), (4, "é [EMAIL]", 9, None)])


def test_no_python_on_the_path(spark):
    plan = pii.pii_digest(spark.createDataFrame([(1, "x")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan) and unicodedata.category("é") == "Ll"

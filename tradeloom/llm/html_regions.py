"""Main text of web pages from parser events and smoothed text-to-tag ratios.

A page is streamed through the standard library's parser. Its events make lines: one per
block of text, with the tags met since the line before. Elements that are never article
text (scripts, buttons, adverts, comments ...) yield no line; forms, headers, footers, sidebars
and navigation do only if the article is inside them, as when a form is around the page or
one of them is never closed, and a header of an article keeps its headings. The ratio of text
to tags per line is smoothed by a Gaussian, within a region, and its logarithms are split at
the threshold that separates two clusters best. A region, the lines of one sectioning element
or of a list of links, is content when enough of its text lies above the threshold: half,
or a quarter inside an article or main part. All lines of a content region are kept, short
ones too. Where the clusters are not clearly apart, all regions are.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tradeloom.llm.common import batch_of, chunks, in_tasks

#: Fixed names: elements whose text is no article text.
SKIPPED = frozenset(
    "head title script style noscript template button select option textarea "
    "label fieldset menu dialog iframe object svg canvas audio video map".split()
)
#: Elements whose text is no article text unless the article itself is inside.
DOUBTFUL = frozenset("nav header footer aside form".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements without content; they never open a level.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a block of text.
BLOCK = frozenset(
    "address article blockquote body caption center dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 "
    "hgroup hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
SECTION = frozenset("article main section div body table".split())
ARTICLE = frozenset("article main".split())
#: Regions of their own if most of their text is in links.
LISTS = frozenset("ul ol".split())
#: Share of a region's text that has to be dense: elsewhere, and inside an article or main part.
ENOUGH, ENOUGH_IN_ARTICLE = 0.5, 0.25
#: Clusters are clearly apart from this quotient of their (geometric) mean ratios on.
APART = 4.0
#: Text of so many characters a tag is dense, whatever the threshold, in a region with at most this share of links.
SURE, FEW_LINKS = 20.0, 0.2
#: Whole names in class, id and role that mark what is no article text; also with these words before or after.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation "
    "menu breadcrumb breadcrumbs sidebar header footer masthead comment comments disqus reply replies respond responses "
    "notice notices cookie cookies consent gdpr popup modal newsletter subscribe subscription signup login share "
    "sharing social related recommended widget toolbar pagination pager search alert complementary contentinfo".split()
)
_SPACES = re.compile(r"\s+")
_BEFORE = "bottom global left main right site top".split()
_AFTER = "area bar block bottom box container left links list right section slot top wrapper".split()
#: Whose comments, or what the sidebar is beside; before these words alone.
_OF = "article blog entry guest page post reader user".split()
_OWNED = "comment comments reply replies respond responses sidebar related share sharing newsletter".split()
_MARKED = re.compile(
    rf"(?:(?:{'|'.join(_BEFORE)})[-_]|(?:{'|'.join(_OF)})[-_](?=(?:{'|'.join(_OWNED)})(?![a-z])))?"
    rf"({'|'.join(sorted(MARKS))})(?:[-_](?:{'|'.join(_AFTER)}|[0-9]+))?"
)
#: Marked so, an element without an article inside is no article text even if it is most of the page's.
NEVER = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion "
    "comment comments disqus reply replies respond responses cookie cookies consent gdpr".split()
)
#: A tag that the end of the page cuts off.
_CUT_OFF = re.compile(r"<[A-Za-z/!][^<>]*\Z")


def marks(tag: str, attrs: list) -> str:
    """The mark by which class, id or role say the element is no article text, or an empty one.

    Whole names count ("comments", "comments-list"; not "no-comments" or "has-sidebar");
    of an article or main part those without words around.
    """
    found = ""
    for name, value in attrs:
        if name in ("class", "id", "role"):
            for token in (value or "").lower().split():
                match = _MARKED.fullmatch(token)
                if match and (tag not in ARTICLE or match[1] == token) and found not in NEVER:
                    found = match[1]
    return found


class Lines(HTMLParser):
    """Collects lines: text, tags since the last line, characters in links, region number, inside an article?

    ``of_line`` has the marked elements around each line; ``judged`` says which of them
    are no article text after all lines are known.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, bool]] = []
        self.of_line: list[tuple[int, ...]] = []
        self.marks: list[str] = []  # of marked elements, by number
        self.holders: set[int] = set()  # marked elements with an article or main part inside
        self.doubtful: dict[int, bool] = {}  # marked by their tag -> inside an article?
        self.headings: set[int] = set()  # numbers of lines that are headings
        self.heading = False
        self.around_here: tuple[int, ...] = ()
        self.open: list[tuple[str, int, tuple[int, ...], bool, int, bool]] = []  # tag, tags, marked around, then as where
        self.names: Counter[str] = Counter()  # of the open elements
        self.regions = self.tags = self.linked = 0
        self.in_link = False
        self.around: dict[int, int] = {}  # region of a list -> region around it
        self.parts: list[str] = []
        self.where = (False, 0, False)  # skipped, region, in article

    def end_line(self) -> None:
        text = _SPACES.sub(" ", "".join(self.parts)).strip()
        self.parts = []
        if text:
            if self.heading:
                self.headings.add(len(self.lines))
            self.lines.append((text, self.tags, self.linked, *self.where[1:]))
            self.of_line.append(self.around_here)
            self.tags = 0
        self.linked = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        skipped, region, article = self.where
        self.tags += not skipped
        if tag in BLOCK or tag in SKIPPED or tag in DOUBTFUL:
            self.end_line()
            self.heading = tag in HEADINGS
        elif tag == "br":
            self.parts.append(" ")
        elif tag == "a":
            self.in_link = True
        if tag in VOID:
            return
        hidden = tag in SKIPPED or tag not in ("html", "body") and any(name == "hidden" for name, _ in attrs)
        mark = "" if skipped or hidden or tag in ("html", "body") else tag if tag in DOUBTFUL else marks(tag, attrs)
        if tag in DOUBTFUL and any(self.marks[k] == tag and self.doubtful[k] == article for k in self.around_here if k in self.doubtful):
            mark = ""  # in one of its kind already
        if tag in SECTION or tag in LISTS or tag in DOUBTFUL or hidden or mark:
            self.open.append((tag, self.tags, self.around_here, *self.where))
            self.names[tag] += 1
            if tag in ARTICLE and not (skipped or hidden or mark) and all(
                    self.marks[k] == "form" for k in self.around_here if k in self.doubtful):
                self.holders.update(self.around_here)
            if mark:
                self.end_line()
                self.around_here += (len(self.marks),)
                if tag in DOUBTFUL:
                    self.doubtful[len(self.marks)] = article
                self.marks.append(mark)
            if not (skipped or hidden):
                self.regions += 1
                if tag in LISTS or tag == "header" and article:
                    self.around[self.regions] = region
                region = self.regions
            self.where = (skipped or hidden, region, article or (tag in ARTICLE and not (hidden or mark)))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += not self.where[0]
        if tag in BLOCK or tag in SKIPPED or tag in DOUBTFUL:
            self.end_line()
            self.heading = False
        elif tag == "a":
            self.in_link = False
        while self.names[tag]:
            name, tags, around, *where = self.open.pop()
            self.names[name] -= 1
            if name == tag:
                if around != self.around_here:
                    self.end_line()
                    self.tags = tags
                self.around_here, self.where = around, tuple(where)
                break

    def handle_data(self, data: str) -> None:
        if not self.where[0]:
            self.parts.append(data)
            if self.in_link:
                self.linked += len(data.strip())

    def surely(self) -> list[int]:
        """Numbers of the lines that no form, header, footer, sidebar or navigation takes away.

        Without an article or main part outside of these, one inside counts if it is longer
        than what is outside; without any, an element (but a footer) that holds most of the
        text, little of it in links.
        """
        around = [[k for k in ks if k in self.doubtful] for ks in self.of_line]
        title = [at in self.headings and all(self.doubtful[k] and self.marks[k] == "header" for k in ks)
                 for at, ks in enumerate(around)]
        plain = [at for at, ks in enumerate(around) if not ks or title[at]]
        size = [len(text) for text, *_ in self.lines]
        outside = sum(size[at] for at in plain)
        inside_article = [line[4] for line in self.lines]
        if any(inside_article[at] for at in plain):
            return plain
        kept = {at for at, ks in enumerate(around) if inside_article[at] and (title[at] or not any(self.doubtful[k] for k in ks))}
        if sum(size[at] for at in kept) > outside:
            return sorted(kept | {at for at, ks in enumerate(around) if all(self.marks[k] == "form" and not self.doubtful[k] for k in ks)})
        total, text, linked = sum(size), Counter(), Counter()
        for at, ks in enumerate(around):
            text.update(dict.fromkeys(ks, size[at]))
            linked.update(dict.fromkeys(ks, self.lines[at][2]))
        good = {k for k in self.doubtful if self.marks[k] != "footer" and 2 * text[k] > total and linked[k] <= FEW_LINKS * text[k]}
        return [at for at, ks in enumerate(around) if good.issuperset(ks)]

    def judged(self) -> list[tuple]:
        """Lines without those in marked elements, unless these hold an article, a main part or most of the text."""
        sure = [(self.lines[at], self.of_line[at]) for at in self.surely()]
        inside = Counter()
        for (text, *_), around in sure:
            inside.update(dict.fromkeys(around, len(text)))
        total = sum(len(text) for (text, *_), _ in sure)
        out = {k for k, mark in enumerate(self.marks)
               if k not in self.holders and k not in self.doubtful and (mark in NEVER or 2 * inside[k] <= total)}
        return [line for line, around in sure if out.isdisjoint(around)]


def smooth(ratios: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing; the kernel is normalised at the borders."""
    radius = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(ratios)), kernel)[radius : radius + len(ratios)]
    return np.convolve(ratios, kernel)[radius : radius + len(ratios)] / weight


def split_point(values: np.ndarray) -> float:
    """Threshold with the largest variance between the values below and from it on."""
    order = np.sort(values)
    total, n = order.sum(), len(order)
    below = np.arange(1, n)
    left = order.cumsum()[:-1]
    between = (left / below - (total - left) / (n - below)) ** 2 * below * (n - below)
    between[order[1:] == order[:-1]] = -1
    return float(order[int(between.argmax()) + 1]) if n > 1 and between.max() > 0 else float(order[0])


def region_of_lines(lines: list[tuple], around: dict[int, int]) -> np.ndarray:
    """Region of each line; a list belongs to the region around it unless most of its text is in links."""
    text, linked = Counter(), Counter()
    for line, _, in_links, region, _ in lines:
        text[region] += len(line)
        linked[region] += in_links
    final: dict[int, int] = {}
    for region in sorted(text.keys() | around.keys()):  # outer before inner
        own = region not in around or 2 * linked[region] > text[region]
        final[region] = region if own else final.get(around[region], around[region])
    return np.array([final[line[3]] for line in lines])


def content_regions(lines: list[tuple], of: np.ndarray, sigma: float) -> set[int]:
    """Regions with enough dense text; all of them if dense and sparse lines are not clearly apart."""
    length = np.array([len(text) for text, *_ in lines], float)
    raw = np.split(length / np.maximum(1, [tags for _, tags, *_ in lines]), np.flatnonzero(np.diff(of)) + 1)
    ratio = np.log1p(np.concatenate([smooth(run, sigma) for run in raw]))
    threshold = split_point(ratio)
    dense = ratio >= threshold
    regions = set(of.tolist())
    if dense.all() or ratio[dense].mean() - ratio[~dense].mean() < np.log(APART):
        return regions
    linked = np.array([in_links for _, _, in_links, *_ in lines], float)
    article = np.array([inside for *_, inside in lines])
    kept = set()
    for region in regions:
        here = of == region
        total = length[here].sum()
        sure = linked[here].sum() <= FEW_LINKS * total
        least = min(threshold, np.log1p(SURE)) if sure else threshold
        enough = ENOUGH_IN_ARTICLE if article[here].any() else ENOUGH
        if length[here & (ratio >= least)].sum() > enough * total:
            kept.add(region)
    return kept or regions


def main_text(html: str | None, sigma: float = 1.0) -> str:
    """Kept lines in page order, joined by one line feed; empty if there is none."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(_CUT_OFF.sub("", html))
    parser.close()
    parser.end_line()
    lines = parser.judged()
    if not lines:
        return ""
    of = region_of_lines(lines, parser.around)
    kept = content_regions(lines, of, sigma)
    return "\n".join(line[0] for line, region in zip(lines, of.tolist(), strict=True) if region in kept)


def extract(pages: DataFrame, sigma: float = 1.0) -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars`` (code points of the text).

    White space inside a block is one space, blocks are joined by one line feed. Null,
    empty and text-free pages give an empty text. Lines of equal ratio fall on one side of
    the threshold; where all are equal, all are kept. Cut-off pages and unclosed elements
    are read as far as they go. Repeated rows and null ids are read row by row; other
    columns are ignored. Pages are independent: a narrow pass, whatever their hosts.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 1000, 8_000_000, "html"):
            texts = [main_text(html, sigma) for html in batch.column("html").to_pylist()]
            yield batch_of(schema, [batch.column("page_id"), batch.column("url"), texts, list(map(len, texts))])

    source = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return in_tasks(source, run, "page_id long, url string, text string, n_chars long")

"""The main text of web pages, by block rules in two passes.

A page is cut into blocks at block-level tags. A block knows its length, the share of
its words that are stop words, the share of its text that stands in links, and where it
stands: inside a boilerplate element (by tag, role, class or id), inside an article, or
elsewhere.

The first pass decides by density: blocks of boilerplate elements and link lists are bad,
long blocks with many stop words are good, long ones with few are bad, and short or
middling ones stay open. Inside an article the thresholds are lower: few stop words make
a block good there, and none leave it open. In the second pass open blocks inherit the
label of the nearest decided neighbours: where both agree, or one is clearly nearer,
theirs; amid two they are bad, but good inside an article. Headings look ahead. Blocks
inside an article have their neighbours there, with the edges of the article as good ones.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querylog.llm.textkit import spaced_words
from querylog.llm.toxicity import STOP_WORDS



@dataclass(frozen=True)
class Thresholds:
    """Characters of short and long blocks, shares of stop words, and share of linked text."""

    short: int
    long: int
    few_stops: float
    many_stops: float
    most_links: float


ELSEWHERE = Thresholds(70, 140, 0.08, 0.2, 0.3)
INSIDE = Thresholds(20, 20, 0.0, 0.02, 0.9)
_STOPS = {word for words in STOP_WORDS.values() for word in words}
#: What is not part of a word at its edges.
_EDGES = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum())

#: Names of elements.
_RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "noembed", "noframes", "xmp", "title", "svg", "math", "object", "select", "canvas", "audio", "video"}
_BAD = {"nav", "footer", "header", "aside", "form", "menu", "dialog", "button", "fieldset", "head", "figcaption"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "div", "dl",
    "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr",
    "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td",
    "tfoot", "th", "thead", "tr", "ul",
}
#: Parts of class, id and role names of what is not the article.
_HINTS = {
    "ad", "ads", "advert", "advertisement", "adverts", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent",
    "cookie", "cookies", "disclaimer", "disqus", "footer", "gdpr", "header", "login", "masthead", "menu", "modal", "nav",
    "navbar", "navigation", "newsletter", "notice", "notices", "notification", "pagination", "paywall", "popup", "promo",
    "promoted", "related", "replies", "respond", "search", "share", "sharing", "sidebar", "signup", "skip", "social",
    "sponsor", "sponsored", "subscribe", "subscription", "tags", "toolbar", "topbar", "widget",
    "complementary", "contentinfo", "alert", "alertdialog",
}
_GOOD = {"article", "main"}
_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)",
    re.S,
)
_NAMES = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)


@dataclass
class _Block:
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    bad: bool = False
    inside: bool = False
    heading: bool = False


class _Open:
    """The open elements, and how many there are of each name."""

    def __init__(self):
        self.elements: list[tuple[str, bool, bool]] = []  # name, bad, inside an article
        self.names: Counter[str] = Counter()

    @property
    def place(self) -> tuple[bool, bool]:
        return self.elements[-1][1:] if self.elements else (False, False)

    def push(self, name: str, bad: bool, inside: bool) -> None:
        self.elements.append((name, bad, inside))
        self.names[name] += 1

    def pop(self) -> str:
        name = self.elements.pop()[0]
        self.names[name] -= 1
        return name

    def close(self, name: str) -> None:
        """Close the innermost element of a name, and all within; nothing if there is none."""
        if self.names[name]:
            while self.pop() != name:
                pass


def _hinted(attributes: str) -> bool:
    """Whether names or visibility mark an element as no part of the article."""
    if not attributes:
        return False
    for match in _NAMES.finditer(attributes):
        value = match[2] or match[3] or match[4] or ""
        words = re.split(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])", value)
        if any(word.lower() in _HINTS for word in words):
            return True
    return bool(_HIDDEN.search(attributes))


def _blocks(page: str) -> Iterator[_Block]:
    """Blocks of a page in order, in one pass over its tags."""
    open_ = _Open()
    block, links, skip_to = _Block(), 0, ""
    bad = inside = False
    at = 0
    for token in _TOKEN.finditer(page):
        if skip_to:
            if token[2] is None or not token[1] or token[2].lower() != skip_to:
                continue
            skip_to, at = "", token.end()
            continue
        if token.start() > at:
            text = page[at : token.start()]
            block.parts.append(text)
            if links:
                block.linked += len(text)
        at = token.end()
        if token[2] is None:
            continue
        closing, name, attributes = bool(token[1]), token[2].lower(), token[3]
        if name in _RAW:
            if not closing and not attributes.rstrip().endswith("/"):
                skip_to = name
            continue
        if name == "a":
            links = 0 if closing else 1
        if name == "br":
            block.parts.append(" ")
        hinted = not closing and _hinted(attributes) and name not in ("html", "body", *_GOOD)
        if name in _BLOCKS or hinted:
            yield block
            links = 0
            if closing:
                open_.close(name)
            elif name not in _VOID:
                if name in ("p", "li", "dt", "dd", "tr", "td", "th") and open_.elements and open_.elements[-1][0] == name:
                    open_.pop()
                was_bad, was_in = open_.place
                own_header = name in ("header", "figcaption") and was_in and not hinted
                open_.push(name, was_bad or hinted or (name in _BAD and not own_header), was_in or name in _GOOD)
            bad, inside = open_.place
            block = _Block(bad=bad, inside=inside, heading=name in ("h1", "h2", "h3", "h4", "h5", "h6") and not closing)
        elif closing and open_.names[name]:
            yield block
            open_.close(name)
            bad, inside = open_.place
            block = _Block(bad=bad, inside=inside)
    if not skip_to and at < len(page):
        block.parts.append(page[at:])
    yield block


@dataclass(frozen=True)
class Judged:
    """A block's text, its label by density (None: open), and whether it is a heading."""

    text: str
    label: bool | None
    inside: bool
    heading: bool


def judged_blocks(page: str) -> list[Judged]:
    """The first pass: blocks that have a text, in page order, labelled by density."""
    out = []
    for block in _blocks(page):
        text = " ".join(html.unescape("".join(block.parts)).split())
        if text:
            linked = block.linked / max(1, sum(map(len, block.parts)))
            label = False if block.bad else _by_density(text, linked, block.heading, INSIDE if block.inside else ELSEWHERE)
            out.append(Judged(text, label, block.inside and not block.bad, block.heading))
    return out


def _by_density(text: str, linked: float, heading: bool, at: Thresholds) -> bool | None:
    if linked > at.most_links:
        return False
    if len(text) < at.short or heading:
        return None
    words = [w.strip(_EDGES) for w in spaced_words(text.encode(errors="replace"))]
    stops = sum(w.decode(errors="replace") in _STOPS for w in words) / len(words)
    if stops >= at.many_stops:
        return True if len(text) >= at.long else None
    return False if stops < at.few_stops else None


def inherited(blocks: list[Judged]) -> list[bool]:
    """The second pass: open blocks take the label of the nearest decided neighbours."""
    out: list[bool] = []
    for inside, run in groupby(blocks, key=lambda b: b.inside):
        part = list(run)
        out += _nearest([b.label for b in part], [b.heading for b in part], inside)
    return out


def _nearest(labels: list[bool | None], headings: list[bool], edge: bool) -> list[bool]:
    n = len(labels)
    before, last = [], (-1, edge)
    for i, label in enumerate(labels):
        before.append(last)
        if label is not None:
            last = (i, label)
    out, after = [False] * n, (n, edge)
    for i in range(n - 1, -1, -1):
        if labels[i] is not None:
            out[i] = labels[i]
            after = (i, labels[i])
        elif before[i][1] == after[1] or headings[i]:
            out[i] = after[1]
        else:
            back, ahead = i - before[i][0], after[0] - i
            out[i] = before[i][1] if back < ahead else after[1] if ahead < back else edge
    return out


def main_text(page: str | None) -> str:
    """The article of a page: its blocks joined by single spaces, empty for an empty page."""
    blocks = judged_blocks(page or "")
    return " ".join(b.text for b, good in zip(blocks, inherited(blocks), strict=True) if good)


def _texts(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in pages:
        yield pa.array([main_text(page.as_py()) for page in batch], pa.string())


def extracted(pages: DataFrame, column: str = "html", to: str = "text") -> DataFrame:
    """Pages with the column ``to``: the main text of ``column``, whole.

    All columns stay; one of the same name is replaced. A null or empty page has an
    empty text. Rows are independent of each other, so repeated ones have the same text
    and there is no shuffle. A page takes time in proportion to its length, however many
    elements it leaves open.
    """
    return pages.withColumn(to, F.arrow_udf(_texts, "string")(F.col(column)))

"""Main text of web pages by the distribution of text over lines.

Markup is stripped and block elements become lines; boundaries of larger parts become empty lines, more of them the more
the depth changes. Each line has a weight: its length, less for links, more inside article elements, none inside elements
whose kind or name marks them as something else. Weights are summed over a sliding window of lines. Where the sums rise
from zero a stretch begins (surge), where they fall back to zero it ends (dive). A stretch whose sums reach a share of the
page's largest sum is part of the article.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from annograph.llm.common import unpack

WINDOW = 3
SHARE = 0.4  # of the page's largest window that a stretch must reach
ENOUGH = 215  # code points of a window that count as a large one on any page
ARTICLE_WEIGHT = 8  # of a code point inside an article element

#: Elements by what they do to the text around them.
_RAW = "script|style|noscript|template|textarea|svg|iframe|title|object|canvas|audio|video|select|math|xmp"
_DROPPED = set("nav header footer aside form button dialog menu datalist fieldset".split())
_ARTICLE = {"article", "main"}
_PARTS = set("html body div section table ul ol dl head center hgroup details search".split())
_BLOCKS = set("p h1 h2 h3 h4 h5 h6 li dt dd tr td th caption thead tbody tfoot pre blockquote address figure figcaption hr summary legend option".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_WALLS = ("table", "td", "th", "caption")  # no end tag of an element outside reaches into these
#: What an opening tag closes without an end tag, and the elements that it does not reach beyond.
_IMPLIED = {
    "li": (("li",), ("ul", "ol", *_WALLS)), "dt": (("dt", "dd"), ("dl", *_WALLS)), "dd": (("dt", "dd"), ("dl", *_WALLS)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("caption", "tr"), ("table",)),
    **{t: (("caption", "thead", "tbody", "tfoot"), ("table",)) for t in ("thead", "tbody", "tfoot")}, "option": (("option",), _WALLS),
}
#: Names of classes, ids and roles that mark what is not the article.
_NAMES = set(
    "ad ads adv advert adverts advertisement advertising adbox adsense sponsor sponsored promo promotion cookie cookies consent gdpr notice notices "
    "notification alert disclaimer popup breadcrumb breadcrumbs comment comments commentlist discussion disqus reply replies respond reactions share sharing "
    "social related recommended recommendations newsletter subscribe subscription signup login search searchbox toolbar pagination pager complementary "
    "contentinfo paywall skip".split()
)
#: Names of places on a page; one that holds most of the page's text is not that place.
_PLACES = set("banner modal overlay sidebar rail widget widgets menu nav navigation navbar navigational header masthead topbar footer bottombar".split())
#: First parts of a name that turn its meaning, and those that make a header one of the article.
_TURNED = {"has", "with", "no", "without", "layout"}
_HEADED = {"entry", "article", "post", "story", "content"}

_TAG = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_RAW})(?=[\s/>])(?>[^>\"']+|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1(?=[\s/>])[^>]*>|\Z)"
    r"|<(/?)([a-z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([a-z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)|</[^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _kind(tag: str, attributes: str, in_article: bool) -> int:
    """2 for an element that is no part of the article with all inside it, 1 if only the name of a place says so, else 0."""
    named = hidden = False
    place = turned = False
    for name, value in _ATTRIBUTE.findall(attributes) if attributes and tag not in ("html", "body") else ():
        name, value = name.lower(), value.strip("\"'").lower()
        hidden |= name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and bool(_HIDDEN.search(value)))
        for word in value.split() if name in ("class", "id", "role") else ():
            parts = re.split(r"[-_]+", word)
            own = {word, parts[0], parts[-1]}
            turned |= parts[0] in _HEADED and parts[-1] == "header"
            if parts[0] in _TURNED or (parts[0] in _HEADED and parts[-1] == "header"):
                continue
            named |= bool(own & _NAMES) and (tag not in _ARTICLE or bool(own & {"comment", "comments", "reply", "ad", "sponsored", "related"}))
            place |= bool(own & _PLACES) and tag not in _ARTICLE
    if hidden or named or (tag in _DROPPED and not (tag == "header" and (in_article or turned))):
        return 2
    return int(place)


@dataclass
class _Line:
    text: str
    weight: int  # 0 for links alone and for boundaries
    place: int  # the innermost element that is named as a place, 0 for none


@dataclass
class _Page:
    """Open elements and the lines found so far. Positions of open elements are kept by tag, so no search walks the stack."""

    lines: list[_Line] = field(default_factory=list)
    stack: list[tuple[str, int, int, int]] = field(default_factory=list)  # tag, dropped, place, articles around and with it
    at: dict[str, list[int]] = field(default_factory=lambda: defaultdict(list))
    outer: list[int] = field(default_factory=lambda: [0])  # the place around each place; the first entry is the page
    held: list[str] = field(default_factory=list)
    linked: int = 0
    plain: int = 0
    letters: int = 0
    links: bool = False
    closed: int = 0  # parts that closed and opened since the last line
    opened: int = 0
    apart: bool = False

    def state(self) -> tuple[int, int, int]:
        return self.stack[-1][1:] if self.stack else (0, 0, 0)

    def add(self, text: str) -> None:
        if self.state()[0]:
            return
        self.held.append(text)
        count = len(text) - text.count(" ") if not text.isspace() else 0
        if self.links:
            self.linked += count
        elif count:
            self.plain += count
            self.letters += any(c.isalnum() for c in text)

    def end_line(self) -> None:
        text = " ".join(unescape("".join(self.held)).split()) if self.held else ""
        if text:
            self.end_run()
            _, place, articles = self.state()
            share = 1.0 if not self.linked or articles else self.plain / (self.plain + self.linked) if self.letters else 0.0
            self.lines.append(_Line(text, int(len(text) * share) * (ARTICLE_WEIGHT if articles else 1), place))
        self.held.clear()
        self.linked = self.plain = self.letters = 0

    def end_run(self) -> None:
        """A run of boundaries is one empty line, and one more for each level that the depth changes by, up to a window; where a
        window of parts closes or opens, it is a whole window."""
        if self.closed or self.opened or self.apart:
            n = WINDOW if self.apart or max(self.closed, self.opened) >= WINDOW else min(WINDOW, 1 + abs(self.closed - self.opened))
            self.lines.extend(_Line("", 0, 0) for _ in range(n))
        self.closed = self.opened = 0
        self.apart = False

    def last(self, tags) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def pop_to(self, depth: int) -> None:
        self.end_line()
        while len(self.stack) > depth:
            tag, dropped, _, articles = self.stack.pop()
            self.at[tag].pop()
            around = self.state()
            if tag in _ARTICLE and not around[2] and not around[0]:
                self.apart = True
            elif not around[0] and not articles and (tag in _PARTS or dropped):
                self.closed += 1
                self.opened += dropped  # beside it, not below

    def open(self, tag: str, attributes: str) -> None:
        block = tag in _BLOCKS or tag in _PARTS or tag in _DROPPED or tag in _ARTICLE
        if block:
            self.end_line()
            under, walls = _IMPLIED.get(tag, ((), ()))
            for tags, bounds in ((("p",), (*_WALLS, "button")), (under, walls)):
                if tags and self.last(tags) > self.last(bounds):
                    self.pop_to(min(self.at[t][-1] for t in tags if self.at.get(t) and self.at[t][-1] > self.last(bounds)))
        if tag in _VOID:
            return
        dropped, place, articles = self.state()
        kind = 0 if dropped else _kind(tag, attributes, articles > 0)
        if not block and not kind:
            return
        if kind == 1 and block:
            self.outer.append(place)
            place = len(self.outer) - 1
        self.at[tag].append(len(self.stack))
        if tag in _ARTICLE and not dropped and kind != 2:
            self.apart |= not articles
            articles += 1
        elif tag in _PARTS and not dropped and not articles and kind != 2:
            self.opened += 1
        self.stack.append((tag, 1 if dropped or kind == 2 or (kind and not block) else 0, place, articles))

    def close(self, tag: str) -> None:
        depth = self.last((tag,))
        walled = depth >= 0 and tag not in ("tr", "thead", "tbody", "tfoot", *_WALLS) and depth < self.last(_WALLS)
        if tag in ("tr", "thead", "tbody", "tfoot", "td", "th", "caption"):
            walled = depth < self.last(("table",))
        if tag == "li":
            walled |= depth < self.last(("ul", "ol"))
        if depth >= 0 and not walled:
            inline = not (tag in _BLOCKS or tag in _PARTS or tag in _DROPPED or tag in _ARTICLE)
            if not inline or depth == len(self.stack) - 1:
                if inline:
                    self.at[tag].pop()
                    self.stack.pop()
                else:
                    self.pop_to(depth)
        elif tag in _BLOCKS or tag in _PARTS:
            self.end_line()
            self.closed += tag in _PARTS and not any(self.state()[::2])


def lines_of(html: str) -> list[_Line]:
    """Lines of a page and the empty lines between them, without those of elements that are no part of the article."""
    page = _Page()
    at = 0
    for m in _TAG.finditer(html):
        if m.start() > at:
            page.add(html[at : m.start()])
        at = m.end()
        tag = (m[3] or m[6] or "").lower()
        closing = bool(m[2] or m[5])
        if tag == "a":
            page.links = not closing
        elif tag == "br":
            page.add(" ")
        elif tag:
            page.close(tag) if closing else page.open(tag, m[4] or m[7] or "")
    if at < len(html):
        page.add(html[at:])
    page.end_line()
    return _without_places(page.lines, page.outer)


def _without_places(lines: list[_Line], outer: list[int]) -> list[_Line]:
    """Lines in elements named as places become empty, unless the place holds over half the page's weight and a long text."""
    if len(outer) == 1:
        return lines
    held = [0] * len(outer)
    for line in lines:
        held[line.place] += line.weight
    for place in range(len(outer) - 1, 0, -1):  # an inner place has the higher number
        held[outer[place]] += held[place]
    gone = [False] * len(outer)
    for place in range(1, len(outer)):
        gone[place] = gone[outer[place]] or not (2 * held[place] > held[0] and held[place] >= SHARE * ENOUGH)
    return [_Line("", 0, 0) if gone[line.place] else line for line in lines]


def window_sums(weights: list[int]) -> list[int]:
    """Sum of the `WINDOW` weights that end at each line, going on until the last line has left the window."""
    sums, running = [], 0
    for i in range(len(weights) + WINDOW - 1):
        running += (weights[i] if i < len(weights) else 0) - (weights[i - WINDOW] if i >= WINDOW else 0)
        sums.append(running)
    return sums


def extract(html: str | None) -> str:
    """The text of all stretches between a surge and a dive whose sums reach the page's threshold.

    The threshold is `SHARE` of the largest sum, or of that of `ENOUGH` code points if the largest is higher; where the
    largest window lies in an article element, its points weigh as all points there. A line of links alone is kept inside a
    stretch, and fewer than `WINDOW` such lines right behind its last text.
    """
    lines = lines_of(html or "")
    weights = [x.weight for x in lines]
    sums = window_sums(weights)
    if not any(sums):
        return ""
    peak = max(range(len(sums)), key=sums.__getitem__)
    inside = any(x.weight > len(x.text) for x in lines[max(0, peak - WINDOW + 1) : peak + 1])
    threshold = SHARE * min(sums[peak], ENOUGH * (ARTICLE_WEIGHT if inside else 1))
    kept: list[str] = []
    begin = last = None
    high = 0
    for i in range(len(sums) + 1):
        total = sums[i] if i < len(sums) else 0
        if total and begin is None:  # surge
            begin, high = i, 0
        high = max(high, total)
        if i < len(lines) and weights[i]:
            last = i
        if begin is not None and not total:  # dive
            end = last + 1
            while end < min(last + WINDOW, len(lines)) and lines[end].text:
                end += 1
            if high >= threshold:
                kept += [x.text for x in lines[begin:end] if x.text]
            begin = None
    return "\n".join(kept)


def main_text(html: Column) -> Column:
    @F.arrow_udf("string")
    def extracted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in batches:
            yield pa.array([extract(h.as_py()) for h in pages], pa.string())

    return extracted(html)


def extract_pages(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """The columns of `pages` plus `text` and `n_chars` (its code points).

    Menus, page headers, footers, sidebars, notices, adverts, forms, comments, scripts, styles and hidden elements are left
    out with all they hold, as are lines of links alone away from text, and stretches of little weight beside the page's
    largest (`extract`). End tags that HTML lets a page leave out are put in; another element that is never closed ends with
    the element around it. Character references are decoded, white space in a block becomes one blank, blocks are joined by
    a line end; a br is white space. Null and empty pages, and pages without text, give an empty text. Repeated pages give
    equal texts. Existing columns of the added names are replaced.
    """
    found = pages.select(F.struct("*").alias("row"), main_text(F.col(html_col)).alias("text"))
    return unpack(found, {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")})

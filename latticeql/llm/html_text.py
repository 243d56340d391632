"""Main text of web pages by line-block distribution.

Markup is stripped to lines: a block of text each, in page order; each edge of a container and each stripped element
leaves an empty line. A line's size is the length of its text, without that of links, and many times it inside an article the page
marks. Sizes are summed over a sliding window of WINDOW lines; a surge point is a line where the sums leave zero, its dive
point the last line before they are zero again. Of the stretches between surge and dive the heaviest is kept, with those of at
least SHARE of its weight and those that have a line in the same container as it; the rest (menus of links, lone lines between other
containers) goes. So sums decide on marked and unmarked pages alike; a mark is worth MARK times its text.

Stripped with all they hold are elements that are surely no article: scripts, styles, menus, headers, footers, sidebars, forms and
adverts by their tag, or by a class, id or role all of whose words say so ("site-footer", not "content-with-sidebar").

Elements end as browsers end them: p before a block, li, dt, dd, td, th, tr and option before their next sibling, inner ones
with their outer one; end tags don't reach out of a table cell, those of inline elements not out of a block; the head
needs no end; "/>" ends any element.

Cases: null and empty pages, and pages without text outside of stripped elements, have the empty text; a page with only
link text has that; an article ends unclosed menus or adverts before it; an unclosed script, style or title runs to the page's end, as in
browsers; repeated rows stay repeated rows; an empty table gives an empty table. Only the named columns are read, so other
columns can have any name.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticeql.llm import bpe
from latticeql.llm.common import bound_batches, text_of

#: Lines of a window; share of the heaviest stretch that another needs; times that text in a marked article counts.
WINDOW, SHARE, MARK = 3, 0.2, 1000

# Elements of HTML by what they mean here, and words of class, id and role.
RAW = "script|style|textarea|title|iframe|noembed|noframes|xmp"
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html"
    " legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul video audio object".split()
)
CONTAINER = set("article blockquote center details dir div dl figure main ol section table td th ul".split())
HEADING = set("h1 h2 h3 h4 h5 h6".split())
SKIP = set("nav header footer aside form button select option menu dialog fieldset noscript template svg canvas audio video object search".split())
MAIN = {"article", "main"}
BOILERPLATE = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay"
    " newsletter subscribe subscription signup login share sharing social related recommended recommendations sidebar widget widgets menu nav navbar navigation breadcrumb breadcrumbs"
    " footer header masthead comment comments disqus reply replies respond pagination pager toolbar toc skip search complementary contentinfo".split()
)
#: Boilerplate whose own articles (a comment, a teaser) are boilerplate too.
NESTING = set("comment comments disqus reply replies respond related recommended recommendations sidebar widget widgets".split())
#: Words that say nothing beside one of BOILERPLATE.
NEUTRAL = set("area article bar block bottom box btn button buttons col column container form global icon icons inline inner item items js left link links list main middle outer page post posts primary right secondary section site slot sticky text title top unit wrap wrapper".split())
#: Siblings that end an open element, and the elements beyond which an end isn't looked for.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"}, "tbody": {"tr", "td", "th", "tbody", "thead", "tfoot"}, "thead": {"tr", "td", "th", "tbody", "thead", "tfoot"}, "tfoot": {"tr", "td", "th", "tbody", "thead", "tfoot"}}
WALLS = {"li": {"ul", "ol", "dir", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}, "optgroup": {"select"}}
CELLS = {"table", "td", "th", "caption", "button"}

TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|([^<]+|<)", re.S | re.I)
MARKS = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
CLOSED = re.compile(r"(?:^|[\s\"'])/\Z")


def _said(attributes: str) -> set:
    """The words of BOILERPLATE in those of class, id and role all of whose words are of it or neutral."""
    out = set()
    for m in MARKS.finditer(attributes):
        for token in (m[1] or m[2] or m[3] or "").split():
            # A change from lower to upper case begins a word, too.
            words = {w for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", token).lower()) if w}
            if words & BOILERPLATE and words <= BOILERPLATE | NEUTRAL:
                out |= words & BOILERPLATE
    return out


def _boilerplate(tag: str, attributes: str) -> tuple[bool, bool]:
    """(whether an element is boilerplate, whether articles in it are too)."""
    words = _said(attributes) if attributes and tag not in ("html", "body") else set()
    if tag in MAIN:
        return bool(words & NESTING), True
    return tag in SKIP or bool(words), tag in ("aside", "footer") or bool(words & NESTING)


def _without_loose_ends(page: str) -> str:
    """The page with what can't begin a tag any more, as no tag ends behind it, as references: a scan from each such place to the
    end would take quadratic time. Open comments stay."""
    end = page.rfind(">") + 1
    comment = page.find("<!--", end)
    tail = page[end:] if comment < 0 else page[end:comment]
    return page if "<" not in tail else page[:end] + tail.replace("<", "&lt;") + ("" if comment < 0 else page[comment:])


class Line(NamedTuple):
    """A line of a stripped page; empty ones have no text. inside: the containers it is in, as a chain (number, outer chain)."""

    text: str
    size: int
    inside: tuple | None


class Element(NamedTuple):
    tag: str
    skip: bool
    main: bool
    nesting: bool  # boilerplate with all articles in it


class Parser:
    """One page's lines."""

    def __init__(self) -> None:
        self.lines: list = []
        self.here: list = []  # the texts of the line at hand, and whether each is a link's
        self.stack: list = []
        self.blocks: list = []  # places of the stack's block elements
        self.opened: Counter = Counter()
        self.skips = self.mains = self.links = self.headings = self.containers = 0
        self.inside: tuple | None = None

    def end_line(self) -> None:
        if self.here:
            text = " ".join(html.unescape("".join(t for t, _ in self.here)).split())
            if text:
                plain = " ".join(html.unescape("".join("" if link else t for t, link in self.here)).split())
                self.lines.append(Line(text, MARK * len(text) if self.mains else len(plain), self.inside))
            self.here.clear()

    def gap(self, n: int = 1) -> None:
        self.lines.extend([Line("", 0, None)] * n)

    def edge(self, e: Element, first: bool) -> None:
        """The first or last edge of an element outside of stripped ones."""
        if e.tag in CONTAINER:
            # Where marked text begins or ends, nothing is bridged.
            self.gap(WINDOW if e.main and self.mains == (0 if first else 1) else 1)
            if first:
                self.containers += 1
                self.inside = (self.containers, self.inside)
            else:
                self.inside = self.inside[1]

    def pop(self) -> None:
        e = self.stack.pop()
        self.opened[e.tag] -= 1
        if self.blocks and self.blocks[-1] == len(self.stack):
            self.blocks.pop()
            if not self.skips:
                self.end_line()
        if not self.skips:
            self.edge(e, False)
        self.skips -= e.skip
        self.mains -= e.main
        self.links -= e.tag == "a"
        self.headings -= e.tag in HEADING

    def close_to(self, at: int) -> None:
        while len(self.stack) > at:
            self.pop()

    def found(self, tags: set, walls: set) -> int | None:
        """The place of the innermost open block of the tags, not looked for beyond the walls."""
        if not any(self.opened[t] for t in tags):
            return None
        for at in reversed(self.blocks):
            if self.stack[at].tag in tags:
                return at
            if self.stack[at].tag in walls:
                return None
        return None

    def start(self, tag: str, attributes: str) -> None:
        if tag in BLOCK:
            if self.blocks and self.stack[self.blocks[-1]].tag == "p" and tag not in ("br", "button", "select", "option", "optgroup", "video", "audio", "object"):
                self.close_to(self.blocks[-1])
            if tag in SIBLINGS and (at := self.found(SIBLINGS[tag], WALLS.get(tag, {"table"}))) is not None:
                # All ends that the sibling brings: the outermost of them.
                while (outer := next((b for b in reversed(self.blocks) if b < at and self.stack[b].tag in SIBLINGS[tag] and all(self.stack[x].tag in SIBLINGS[tag] for x in self.blocks if b < x < at)), None)) is not None:
                    at = outer
                self.close_to(at)
            if not self.skips:
                self.end_line()
        if tag in MAIN:
            # An article ends a menu or an advert that was left open before it; a form around it is but a wrapper.
            while self.skips and not any(x.nesting for x in self.stack if x.skip):
                self.pop()
            if not self.skips:
                self.end_line()
        if tag in VOID or CLOSED.search(attributes):
            return
        skip, nesting = _boilerplate(tag, attributes)
        if skip and not self.skips:
            if tag in BLOCK:
                self.end_line()
            self.gap(tag in BLOCK)
        e = Element(tag, skip, tag in MAIN and not self.skips and not skip, nesting and skip)
        if not self.skips and not skip:
            self.edge(e, True)
        if tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(e)
        self.opened[tag] += 1
        self.skips += e.skip
        self.mains += e.main
        self.links += tag == "a"
        self.headings += tag in HEADING

    def end(self, tag: str) -> None:
        if not self.opened[tag]:
            if tag in BLOCK and not self.skips:
                self.end_line()
            return
        if tag in BLOCK:
            at = self.found({tag}, {"table"} if tag in CELLS | SIBLINGS.keys() - WALLS.keys() else CELLS | WALLS.get(tag, set()))
            if tag == "table":
                at = self.found({tag}, set())
            if at is not None:
                self.close_to(at)
            elif not self.skips:
                self.end_line()
            return
        floor = self.blocks[-1] if self.blocks else -1
        at = len(self.stack) - 1
        while at > floor and self.stack[at].tag != tag:
            at -= 1
        if at > floor:
            self.close_to(at)

    def read(self, page: str) -> list:
        for m in TOKEN.finditer(_without_loose_ends(page)):
            if m[5] is not None:
                if not self.skips:
                    self.here.append((m[5], self.links > 0 and not self.headings))
            elif m[3]:
                (self.end if m[2] else lambda t: self.start(t, m[4]))(m[3].lower())
        self.close_to(0)
        if not self.skips:
            self.end_line()
        return self.lines


def lines_of(page: str) -> list:
    return Parser().read(page)


def stretches(sizes: list, window: int = WINDOW) -> list:
    """(surge, dive) of the sums over windows: the first line, and the one behind the last, of each run of lines with no window's
    length of empty ones between."""
    total, sums = sum(sizes[:window]), []
    for k in range(len(sizes)):
        sums.append(total)
        total += (sizes[k + window] if k + window < len(sizes) else 0) - sizes[k]
    out, k = [], 0
    while k < len(sizes):
        if not sizes[k]:
            k += 1
            continue
        surge = k
        while k < len(sizes) and sums[k]:
            k += 1
        dive = k
        while not sizes[dive - 1]:
            dive -= 1
        out.append((surge, dive))
    return out


def kept(lines: list) -> list:
    """The lines between surge and dive of the stretches that are kept."""
    sizes = [x.size for x in lines]
    if not any(sizes):
        sizes = [len(x.text) for x in lines]
    found = stretches(sizes)
    if len(found) > 1:
        # A container of a single line is that line's own: what counts is the container around.
        held: Counter = Counter()
        for x in lines:
            at = x.inside
            while at:
                held[at[0]] += 1
                at = at[1]

        def parents(surge: int, dive: int) -> set:
            out = set()
            for x in lines[surge:dive]:
                if x.text:
                    at = x.inside
                    while at and held[at[0]] == 1:
                        at = at[1]
                    out.add(at[0] if at else 0)
            return out

        weights = [sum(sizes[a:z]) for a, z in found]
        most = weights.index(max(weights))
        near = parents(*found[most])
        found = [s for s, w in zip(found, weights, strict=True) if w >= SHARE * weights[most] or parents(*s) & near]
    return [x for a, z in found for x in lines[a:z] if x.text]


def extract(page: str) -> str:
    """The main text of a page: its blocks joined by one space."""
    return " ".join(x.text for x in kept(lines_of(page)))


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id_col, url_col, text: a row for each row of pages."""
    bound_batches(pages.sparkSession)
    udf = F.arrow_udf(lambda x: pa.array([extract(t.decode()) for t in bpe.texts(x)], pa.string()), "string")
    return pages.select(id_col, url_col, udf(text_of(html_col)).alias("text"))

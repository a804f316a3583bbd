"""The main text of web pages, from a stream of parser events and text-to-tag ratios.

A page passes the standard library's parser once. Text between the boundaries of block elements
is a line; a line remembers how many tags stood in it, how much of its text is in links, and
which containers it lies in. What elements, roles or class names call a menu, header, footer,
sidebar, notice, advert, form, script, style or comment is cut as it passes.

The ratio of text to tags per line is smoothed by a Gaussian; lines whose smoothed ratio is at
least the standard deviation of all are the cluster of content. They choose the region: the
article that holds most of them, else the main element, else the innermost container that holds
most of them. The region is then taken whole, so that short paragraphs, lists and headings in
it stay.

Results per row:

* null or empty html, and a page without any text outside what is cut, gives an empty text;
* broken markup is read as far as it goes: an open paragraph ends at the next block, an end tag
  without its start is passed over, an open comment or tag at the end is no text;
* very long pages are read whole, a piece of a batch at a time;
* repeated rows and null ids give rows of their own; equal pages have equal texts;
* an empty table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratacart.llm.common import on_workers, slices

HTML_BYTES = 4 << 20
#: Lines on either side that a line's ratio is smoothed with, and the Gaussian's width.
RADIUS, WIDTH = 2, 1.0
#: A container with more than this part of the content's text is stepped into.
MOST = 0.5

# Names of elements by what they are.
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li "
    "main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead "
    "tr ul".split()
)
CONTAINERS = frozenset("article body blockquote center div main section table td".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Never text of an article.
CUT = frozenset(
    "aside audio button canvas dialog footer iframe menu noembed noframes noscript object "
    "option script search select style svg template textarea title video".split()
)
#: As these, unless an article or main element starts within.
CUT_AROUND = frozenset("form header nav".split())
CUT_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation "
    "search".split()
)
#: Words of class names and ids.
CUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising aside comment comments complementary "
    "disqus footer promo promoted recommended related replies reply respond sidebar sponsor "
    "sponsored teaser widget widgets".split()
)
CUT_AROUND_WORDS = frozenset(
    "alert banner breadcrumb breadcrumbs consent cookie cookies copyright form gdpr header "
    "login masthead menu modal nav navbar navigation newsletter notice notices overlay pager "
    "pagination popup search share sharing signup social subscribe subscription toolbar "
    "topbar".split()
)
#: A name that begins so tells what is elsewhere on the page.
ELSEWHERE = frozenset("has no not with without".split())
#: What ends an open element of the same list when one of them starts.
ENDED_BY = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"),
    "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
}
#: Elements that an end tag of another kind does not reach beyond.
WALLS = frozenset("article main table td th".split())

_PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_UNFINISHED = re.compile(r"<[!/?A-Za-z]")
_HIDDEN = re.compile(r"display\s*:\s*none")

KEPT, AROUND, GONE = 0, 1, 2


def named_cut(attributes: dict[str, str | None]) -> int:
    """What class, id, role and the like say of an element."""
    if "hidden" in attributes or (attributes.get("aria-hidden") or "").lower() == "true":
        return GONE
    if _HIDDEN.search((attributes.get("style") or "").lower()):
        return GONE
    found = KEPT
    if (attributes.get("role") or "").lower() in CUT_ROLES:
        found = AROUND
    for name in f"{attributes.get('class') or ''} {attributes.get('id') or ''}".split():
        pieces = [p.lower() for p in _PIECES.findall(name)]
        if not pieces or pieces[0] in ELSEWHERE:
            continue
        words = {*pieces, "".join(pieces)}
        if words & CUT_WORDS:
            return GONE
        if words & CUT_AROUND_WORDS:
            found = AROUND
    return found


@dataclass
class Line:
    """Text between block boundaries; ``container`` is the innermost one, -1 for none."""

    text: str
    tags: int
    linked: int
    container: int
    heading: str


@dataclass
class Open:
    """An element whose end has not come, with what its parents say of what is inside."""

    tag: str
    cut: int
    container: int
    heading: str
    linked: bool
    headings_only: bool
    in_article: bool


@dataclass
class Page:
    """Lines in order; containers by the order of their starts, each with its parent."""

    lines: list[Line] = field(default_factory=list)
    containers: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)


_OUTSIDE = Open("", KEPT, -1, "", False, False, False)


class Lines(HTMLParser):
    """Collects the lines of a page. What is asked of open elements is known of the innermost
    one, so that the work does not grow with their depth."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.page = Page()
        self.open: list[Open] = []
        self.counts: Counter[str] = Counter()
        self.parts: list[str] = []
        self.tags = self.linked = 0

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """Sections of other markup languages are comments in HTML."""
        return self.parse_bogus_comment(i)

    def _inner(self) -> Open:
        return self.open[-1] if self.open else _OUTSIDE

    def _close_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            inner = self._inner()
            if inner.heading or not inner.headings_only:
                self.page.lines.append(
                    Line(text, self.tags, self.linked, inner.container, inner.heading)
                )
            self.tags = 0
        self.parts, self.linked = [], 0

    def _close_to(self, place: int) -> None:
        ended = self.open[place:]
        if any(e.tag in BLOCKS for e in ended):
            self._close_line()
        self.counts.subtract(e.tag for e in ended)
        del self.open[place:]

    def _last(self, tags: tuple[str, ...], walls: frozenset[str]) -> int | None:
        if not any(self.counts[t] > 0 for t in tags):
            return None
        for place in range(len(self.open) - 1, -1, -1):
            if self.open[place].tag in tags:
                return place
            if self.open[place].tag in walls:
                return None
        return None

    # Parser events.

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in VOID:
            if tag == "hr":
                self._close_line()
            elif tag == "br":
                self.parts.append(" ")
            return
        if tag in BLOCKS:
            place = self._last(("p",), WALLS | {"button"})
            if place is not None:
                self._close_to(place)
            lists = WALLS | {"ul", "ol", "dl", "menu"} if tag in ("li", "dt", "dd") else {"table"}
            place = self._last(ENDED_BY.get(tag, ()), frozenset(lists))
            if place is not None:
                self._close_to(place)
            self._close_line()
        elif tag == "a" and (place := self._last(("a",), BLOCKS)) is not None:
            self._close_to(place)
        self.open.append(self._opened(tag, dict(attrs)))
        self.counts[tag] += 1

    def _opened(self, tag: str, attributes: dict[str, str | None]) -> Open:
        outer = self._inner()
        around, own, headings_only = outer.cut, KEPT, outer.headings_only
        if tag in CUT:
            own = GONE
        elif tag not in ("html", "body"):
            own = named_cut(attributes)
            if tag in CUT_AROUND:
                own = max(own, AROUND)
            if tag in ("article", "main"):
                own = own if own == GONE and tag == "article" else KEPT
                around = KEPT if around == AROUND else around
            elif tag in HEADINGS:
                own = KEPT
            elif own == AROUND and outer.in_article and self._is_header(tag, attributes):
                own, headings_only = KEPT, True
        container = outer.container
        if tag in CONTAINERS:
            is_main = tag == "main" or (attributes.get("role") or "").lower() == "main"
            self.page.parents.append(container)
            container = len(self.page.containers)
            self.page.containers.append("main" if is_main else tag)
        return Open(
            tag,
            max(own, around),
            container,
            tag if tag in HEADINGS else outer.heading,
            tag == "a" or (outer.linked and tag not in BLOCKS),
            headings_only,
            outer.in_article or tag in ("article", "main"),
        )

    @staticmethod
    def _is_header(tag: str, attributes: dict[str, str | None]) -> bool:
        names = f"{attributes.get('class') or ''} {attributes.get('id') or ''}"
        pieces = {p.lower() for p in _PIECES.findall(names)}
        return (tag == "header" or "header" in pieces) and not (
            pieces & (CUT_AROUND_WORDS - {"header"})
        )

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        """A slash before the end of a tag means nothing, but for elements of other markup."""
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCKS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in ("br", "p") and self._last((tag,), WALLS - {tag}) is None:
            self.parts.append(" ")
            return
        walls = (WALLS if tag in BLOCKS else BLOCKS) - {tag}
        place = self._last((tag,), walls if tag not in ("body", "html", "table") else frozenset())
        if place is not None:
            self._close_to(place)

    def handle_data(self, data: str) -> None:
        inner = self._inner()
        if inner.cut != KEPT:
            return
        self.parts.append(data)
        if inner.linked:
            self.linked += len(data)

    def close(self) -> None:
        if _UNFINISHED.match(self.rawdata):
            self.rawdata = ""
        super().close()
        self._close_line()


def ratios(lines: list[Line]) -> np.ndarray:
    """Text outside links per tag, line by line."""
    return np.array([max(0, len(x.text) - x.linked) / max(1, x.tags) for x in lines])


def smoothed(values: np.ndarray) -> np.ndarray:
    places = np.arange(-RADIUS, RADIUS + 1)
    kernel = np.exp(-(places**2) / (2 * WIDTH**2))
    sums = np.convolve(values, kernel)[RADIUS : RADIUS + len(values)]
    shares = np.convolve(np.ones(len(values)), kernel)[RADIUS : RADIUS + len(values)]
    return sums / shares


def content(lines: list[Line]) -> np.ndarray:
    """Which lines are in the cluster of content."""
    values = smoothed(ratios(lines))
    return (values >= min(values.std(), values.max())) & (values > 0)


def _mass(page: Page, chosen: np.ndarray) -> list[int]:
    """Characters of content in each container."""
    found = [0] * len(page.containers)
    for line, is_content in zip(page.lines, chosen, strict=True):
        if is_content and line.container >= 0:
            found[line.container] += len(line.text)
    for container in range(len(found) - 1, 0, -1):  # parents start before their children
        if page.parents[container] >= 0:
            found[page.parents[container]] += found[container]
    return found


def _ends(page: Page) -> list[int]:
    """The last container within each."""
    found = list(range(len(page.containers)))
    for container in range(len(found) - 1, 0, -1):
        if (parent := page.parents[container]) >= 0:
            found[parent] = max(found[parent], found[container])
    return found


def region(page: Page) -> list[Line]:
    """The lines of the main text."""
    lines = page.lines
    if not lines:
        return []
    chosen = content(lines)
    if not chosen.any():
        return []
    mass, ends = _mass(page, chosen), _ends(page)
    total = sum(len(x.text) for x, is_content in zip(lines, chosen, strict=True) if is_content)
    large = [c for c, n in enumerate(mass) if n > MOST * total]
    for kind in ("article", "main"):
        roots = [c for c in large if page.containers[c] == kind]
        if roots:
            return [x for x in lines if roots[0] <= x.container <= ends[roots[0]]]
    # Containers that hold most of the content lie in each other.
    root = large[-1] if large else -1
    inside = [root < 0 or root <= x.container <= ends[root] for x in lines]
    # Beside the cluster, a container in the root without any content is not of the text.
    child = [-1] * len(mass)
    for container, parent in enumerate(page.parents):
        child[container] = container if parent == root else child[parent] if parent >= 0 else -1

    def kept(line: Line) -> bool:
        below = child[line.container] if line.container >= 0 else -1
        return below < 0 or mass[below] > 0

    first = inside.index(True)
    title = [x for x in lines[:first] if x.heading == "h1"][-1:]
    has_title = any(x.heading == "h1" for x, within in zip(lines, inside, strict=True) if within)
    taken = [x for x, within in zip(lines, inside, strict=True) if within and kept(x)]
    return taken if has_title else title + taken


def main_text(html: str | None) -> str:
    parser = Lines()
    parser.feed(html or "")
    parser.close()
    return "\n".join(x.text for x in region(parser.page))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    on_workers(pages.sparkSession)
    plain = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    kinds = ", ".join(f"{n} {t}" for n, t in plain.dtypes if n != "html")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "html", HTML_BYTES):
                texts = pa.array([main_text(h.as_py()) for h in piece["html"]], type=pa.string())
                counts = pc.utf8_length(texts).cast(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [piece["page_id"], piece["url"], texts, counts],
                    ["page_id", "url", "text", "n_chars"],
                )

    return plain.mapInArrow(read, f"{kinds}, text string, n_chars long")

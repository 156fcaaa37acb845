"""HTML extraction: the main text of a page.

One pass over the events of the standard library's parser makes lines (one per
block element). A line knows its text, its number of tags, the share of its
characters inside links, the container it stands in, and the marked element
around it: one whose class or id has a word that menus, notices, adverts and the
like often have. What HTML itself calls no main text (navigation, page headers
and footers, asides, forms, scripts, by element or role) makes no lines.

The text-to-tag ratio of all lines of the page, in page order, is smoothed with a
Gaussian kernel and clustered by a threshold (one standard deviation, at most the
mean). The lines above it decide the rest:

* Marks are weak evidence. A marked element is left out, unless it holds more than
  half of the characters above the threshold, in three lines or more, while less
  than a tenth of them stand outside marked elements: then its name misleads.
* Where a page says which part is its article (article, then main or its role),
  that part is the content area; on other pages it is the smallest container that
  holds nine tenths of the characters above the threshold.
* Containers in the content area that hold more text than links, or most of whose
  lines are above it, are content regions; where that area is the whole page,
  containers that have a line above it and hold more text than links. All remaining
  lines of a content region belong to the text, however short.

Pages are independent, so this is one narrow pass: no shuffle, and a task holds
an Arrow batch of pages and the lines of one page.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tablelens.llm.stage import ship_package

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NEVER = frozenset("head script style noscript template nav footer aside form button select textarea iframe object "
                   "svg canvas video audio dialog menu datalist title".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption "
                   "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section "
                   "summary table tbody thead tfoot tr caption ul".split())
_CONTAINER = frozenset("article body div main section td html center".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar "
                   "toolbar".split())
_WORDS = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie "
    "cookies consent gdpr notice notices notification popup modal overlay sidebar menu nav navbar navigation breadcrumb "
    "breadcrumbs header masthead footer comment comments commentlist discussion respond reply replies disqus share "
    "sharing social related recommended recommendations teaser newsletter subscribe subscription signup login search "
    "widget widgets toolbar pagination pager skip".split())
#: Marks of things that may have article elements of their own.
_LISTED = frozenset("comment comments commentlist discussion respond reply replies disqus sidebar related recommended "
                    "recommendations teaser widget widgets ad ads advert adverts".split())
_STATES = frozenset("has with without no is".split())
_SPACE = re.compile(r"\s+")
_PARTS = re.compile(r"[^a-z0-9]+")
_MARKED = re.compile(r"<!\[[^>]*>")
_UNFINISHED = re.compile(r"</?[a-zA-Z][^<>]*\Z")
#: An open element is closed by these starts (end tags that HTML leaves out).
_CLOSED_BY = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
              "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]),
              "option": frozenset(["option"]), "p": _BLOCK}


class _Lines(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        # open elements: (tag, inside something dropped, container, article level, in an article's header, mark)
        self.stack = [("", False, 0, 0, False, 0)]
        self.open: dict[str, int] = {}
        self.around = [0]  # the container around each container; the page is its own
        self.page = {0}  # containers that are the whole page
        self.marks = [0]  # the marked element around each marked element; 0 stands for none
        self.listed = [False]  # whether a mark, or one around it, is one of _LISTED
        self.links = 0
        self.lines: list[tuple] = []
        self._new()

    def _new(self):
        self.text: list[str] = []
        self.tags = self.linked = 0
        self.heading = False

    def _end_line(self):
        if self.text:
            text = _SPACE.sub(" ", "".join(self.text)).strip()
            if text:
                _, _, container, level, header, mark = self.where
                if not header or self.heading:
                    self.lines.append((text, self.tags, self.linked, container, level, mark))
        self._new()

    def _dropped(self, tag: str, attrs: dict, level: int) -> bool:
        if tag in _NEVER or (tag == "header" and not level):
            return True
        if tag in ("html", "body", "main"):
            return False
        role = (attrs.get("role") or "").lower()
        if role in _ROLES or "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true":
            return True
        return "none" in (style := (attrs.get("style") or "").lower()) and bool(re.search(r"display\s*:\s*none", style))

    def _mark(self, tag: str, attrs: dict, level: int, mark: int) -> int:
        """The number of the marked element around an element's text."""
        words = frozenset()
        if tag not in _HEADING and tag not in ("html", "body", "main") and not (tag == "header" and level):
            words = frozenset(_PARTS.split(f"{attrs.get('class') or ''} {attrs.get('id') or ''}".lower()))
        if words & _WORDS and not words & _STATES:
            self.marks.append(mark)
            self.listed.append(self.listed[mark] or bool(words & _LISTED))
            return len(self.marks) - 1
        # a page's own article is one, whatever is written on what it stands in
        return 0 if tag in ("article", "main") and not self.listed[mark] else mark

    def handle_starttag(self, tag, attrs):
        stack = self.stack
        if self.open.get("p") and tag in _BLOCK or tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            top = stack[-1][0]
            while top in _CLOSED_BY and tag in _CLOSED_BY[top]:
                self._pop()
                top = stack[-1][0]
            if tag in _BLOCK and self.open.get("p") and tag != "li":
                self._close("p")
        if tag in _BLOCK:
            self._end_line()
        self.tags += 1
        if tag == "br" or tag in ("td", "th"):
            self.handle_data(" ")
        if tag in _VOID:
            return
        _, dropped, container, level, header, mark = stack[-1]
        attrs = dict(attrs)
        dropped = dropped or self._dropped(tag, attrs, level)
        if not dropped:
            mark = self._mark(tag, attrs, level, mark)
        if tag in _CONTAINER:
            self.around.append(container)
            container = len(self.around) - 1
            if tag in ("html", "body", "center"):
                self.page.add(container)
        if tag == "article":
            level = 2
        elif tag == "main" or (attrs.get("role") or "").lower() == "main":
            level = max(level, 1)
        if tag in _HEADING:
            self.heading = True
        if tag == "a":
            self.links += 1
        stack.append((tag, dropped, container, level, header or (tag == "header" and level > 0), mark))
        self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def _pop(self):
        tag = self.stack.pop()[0]
        self.open[tag] -= 1
        if tag == "a":
            self.links -= 1
        if tag in _BLOCK:
            self._end_line()

    def _close(self, tag):
        if self.open.get(tag):
            while self.stack[-1][0] != tag:
                self._pop()
            self._pop()

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in _BLOCK:
            self._end_line()
        if tag == "p" or tag not in _CONTAINER or self.open.get(tag):
            self._close(tag)

    def handle_data(self, data):
        here = self.stack[-1]
        if here[1]:
            return
        if not self.text:
            self.where = here
        self.text.append(data)
        if self.links:
            self.linked += len(data)


def content_lines(ratios: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Which lines have a smoothed text-to-tag ratio above the threshold."""
    if len(ratios) == 0:
        return np.zeros(0, dtype=bool)
    radius = max(1, int(np.ceil(2 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    kernel /= kernel.sum()
    smooth = np.convolve(np.pad(ratios, radius, mode="edge"), kernel, mode="valid")
    return smooth >= min(smooth.std(), smooth.mean())


def main_text(html: str | None) -> str:
    """The main text of one page: blocks in page order, joined by two line
    breaks; empty if there is none. Broken markup is read as far as it goes."""
    if not html:
        return ""
    parser = _Lines()
    # as browsers read them: "<![" begins a comment that ends at the next ">",
    # and a tag that the page's end cuts off is dropped
    html = _UNFINISHED.sub("", _MARKED.sub("", html))
    try:
        parser.feed(html)
        parser.close()
    except AssertionError:  # the parser's own limits on broken declarations
        pass
    parser._end_line()
    lines = parser.lines
    if not lines:
        return ""
    size = np.array([len(x[0]) for x in lines], dtype=float)
    linked = np.array([min(x[2], len(x[0])) for x in lines], dtype=float)
    above = content_lines((size - linked) / np.array([max(1, x[1]) for x in lines]))
    content = np.where(above, size - linked, 0.0)
    open_marks = _misleading(parser.marks, np.array([x[5] for x in lines]), content)
    keep = [k for k, x in enumerate(lines) if x[5] in open_marks]
    if not keep:
        return ""
    level = max(lines[k][4] for k in keep)
    keep = [k for k in keep if lines[k][4] == level]
    # all that an article holds lies in the content area
    area = _content_area(parser, np.array([lines[k][3] for k in keep]), content[keep]) if not level else None
    regions: dict[int, list[float]] = {}
    for k in keep:
        r = regions.setdefault(lines[k][3], [0.0, 0.0, 0.0, 0])
        r[0] += size[k]
        r[1] += linked[k]
        r[2] += above[k]
        r[3] += 1
    # inside the content area a region goes only if it holds more links than text and
    # most of its lines (smoothing lifts those beside a paragraph) are below the
    # threshold; without one it must reach the threshold and hold more text than links
    if area is None or area.any():
        good = {c for c, (n, m, up, of) in regions.items() if (area is None or area[c]) and (m < 0.5 * n or 2 * up > of)}
    else:
        good = {c for c, (n, m, up, _) in regions.items() if up and m < 0.5 * n}
    return "\n\n".join(lines[k][0] for k in keep if lines[k][3] in good)


def _inside(parents: list[int], own: np.ndarray, content: np.ndarray) -> np.ndarray:
    """Content of each element and all elements in it (parents have smaller numbers)."""
    total = np.bincount(own, weights=content, minlength=len(parents))
    for k in range(len(parents) - 1, 0, -1):
        total[parents[k]] += total[k]
    return total


def _misleading(marks: list[int], own: np.ndarray, content: np.ndarray) -> set[int]:
    """Marks that say nothing: 0 (none), and those whose elements hold the content."""
    direct = np.bincount(own, weights=content, minlength=len(marks))
    total, count = _inside(marks, own, content), _inside(marks, own, (content > 0).astype(float))
    children: dict[int, list[int]] = {}
    for k in range(1, len(marks)):
        children.setdefault(marks[k], []).append(k)
    here, out = 0, {0}
    while here in children and direct[here] < 0.1 * total[here]:
        best = max(children[here], key=lambda k: total[k])
        if total[best] <= 0.5 * total[here] or count[best] < 3:
            break
        here = best
        out.add(here)
    return out


def _content_area(parser: _Lines, own: np.ndarray, content: np.ndarray) -> np.ndarray:
    """Which containers lie in the smallest one that holds nine tenths of the content
    (none, if that is the whole page)."""
    around = parser.around
    total = _inside(around, own, content)
    area = 0
    for k in range(1, len(around)):  # containers in it have larger numbers
        if around[k] == area and total[k] >= 0.9 * total[0] > 0:
            area = k
    inside = np.zeros(len(around), dtype=bool)
    if area not in parser.page:
        inside[area] = True
        for k in range(area + 1, len(around)):
            inside[k] = inside[around[k]]
    return inside


def extract_main_text(html: Column) -> Column:
    """Main text of an HTML column (null: empty)."""
    @F.arrow_udf("string")
    def extract(column: pa.Array) -> pa.Array:
        return pa.array([main_text(x.as_py()) for x in column], pa.string())

    return extract(html)


def extract_pages(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` without its html column, with ``text_col``, the main text.

    Null or empty html gives an empty text; repeated rows give equal texts; all
    other columns are carried along; a column named ``text_col`` is refused. An
    empty table gives an empty result. Very long pages cost time and memory in
    proportion to their length.
    """
    if text_col in [c for c in pages.columns if c != html_col]:
        raise ValueError(f"pages has a column {text_col}")
    ship_package(pages.sparkSession)
    others = [F.col(f"`{c}`") for c in pages.columns if c != html_col]
    return pages.select(*others, extract_main_text(F.col(f"`{html_col}`").cast("string")).alias(text_col))

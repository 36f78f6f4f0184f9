"""Fields of review blocks from stored HTML (SRC3-SRC6) with selectors given as data.

A page is read once, tag by tag, with a stack of the open elements; nothing is built but that stack and the texts of
the elements that a selector picks.  A layout is a set of selectors: the one of the review block, those of the fields
inside a block and those of the page.  All layouts are read in the same pass; which one counts is decided
by the page's marker (SRC4).  Page fields are repeated on every block (SRC5), a block without votes has "0" (SRC6).

Broken markup: an end tag without its element is ignored, an end tag closes what is open inside its element, a
paragraph, list item or table cell ends where the next one starts, and what is open at the end of the page ends there.
Script, style and comments are no text; ``<br>`` is a line break; all character references are decoded; texts are trimmed.

Spark reads and deals the pages; the helper sees one page at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinio import resources as R

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_ENDS = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_HOLDS = {"article", "body", "div", "ol", "section", "table", "ul", "blockquote", "nav"}    # a new one ends an open paragraph


@dataclass(frozen=True)
class Step:
    """One element of a selector: its tag, attributes that are equal to or contain a text, and its place among the
    siblings of its tag.  ``child``: directly below the step before, else anywhere below."""
    tag: str
    equal: tuple[tuple[str, str], ...] = ()
    within: tuple[tuple[str, str], ...] = ()
    nth: int = 0
    child: bool = False


def selector(text: str) -> tuple[Step, ...]:
    """``div[id*=foreign] span.name > a:2``: tag, ``[attribute=value]`` or ``[attribute*=part]`` (values without brackets, blanks allowed),
    ``:n`` place among the siblings of its tag, ``>`` for a child."""
    steps, child = [], False
    for part in re.findall(r"(?:\[[^\]]*\]|[^\s\[])+", text):
        if part == ">":
            child = True
            continue
        tag, rest = re.match(r"[a-z0-9]+", part).group(), part
        pairs = re.findall(r"\[([a-z-]+)(\*?)=([^\]]*)\]", rest)
        nth = re.search(r":(\d+)$", rest)
        steps.append(Step(tag, tuple((a, v) for a, star, v in pairs if not star), tuple((a, v) for a, star, v in pairs if star),
                          int(nth.group(1)) if nth else 0, child))
        child = False
    return tuple(steps)


@dataclass(frozen=True)
class Layout:
    block: str
    fields: dict[str, str]
    page: dict[str, str] = field(default_factory=dict)


# ---------------------------------------------------------------------------
# FIXED VALUES: the elements that hold the fields of a review page, for blocks in a foreign language and for others.
_PAGE = {
    "Model": "span[class=a-list-item] > a[class=a-link-normal]",
    "Company": "span[id=cr-arp-byline] > a[class=a-size-base a-link-normal]",
    "Overall_product_rating": "span[data-hook=rating-out-of-text]",
    "Overall_product_rating_count": "div[data-hook=total-review-count] > span[class=a-size-base a-color-secondary]",
}
_BLOCK = "div[class=a-section review aok-relative]"
_SAME = {
    "Review": "span[class=a-size-base review-text review-text-content]",
    "Review_helpful_rating": "span[class=a-size-base a-color-tertiary cr-vote-text]",
}
_TITLE_LINK = "a[class=a-size-base a-link-normal review-title a-color-base review-title-content a-text-bold]"
FOREIGN = Layout(_BLOCK, {
    "Review_title": "span[data-hook=review-title] span:1",
    "Reviewer_name": "div[class=a-profile] span[class=a-profile-name]",
    "Review_Rating": "i[data-hook=cmps-review-star-rating] span[class=a-icon-alt]", **_SAME}, _PAGE)
LOCAL = Layout(_BLOCK, {
    "Review_title": _TITLE_LINK + " > span:2",
    "Reviewer_name": "a[class=a-profile] span[class=a-profile-name]",
    "Review_Rating": _TITLE_LINK + " span[class=a-icon-alt]", **_SAME}, _PAGE)
FOREIGN_MARKER = "div[id*=customer_review_foreign]"
# ---------------------------------------------------------------------------
#: Stored article pages: the paragraphs of the article are the blocks.
ARTICLE = Layout("article p", {"Review": "p"}, {"Model": "h1", "page_title": "title"})


class _Open:
    __slots__ = ("tag", "attrs", "nth", "below", "takes")

    def __init__(self, tag, attrs, nth):
        self.tag, self.attrs, self.nth, self.below, self.takes = tag, attrs, nth, {}, []


class Reader(HTMLParser):
    """Reads one page for several layouts."""

    def __init__(self, layouts: dict[str, Layout], marker: str = ""):
        super().__init__(convert_charrefs=True)
        self.of_tag: dict[str, list] = {}                     # last tag of a selector -> (layout, kind, field, steps)
        for name, x in layouts.items():
            for kind, some in (("block", {"": x.block}), ("field", x.fields), ("page", x.page)):
                for f, text in some.items():
                    steps = selector(text)
                    self.of_tag.setdefault(steps[-1].tag, []).append((name, kind, f, steps))
        if marker:
            self.of_tag.setdefault(selector(marker)[-1].tag, []).append(("", "marker", "", selector(marker)))
        self.layouts = layouts

    def read(self, html: str) -> Reader:
        self.reset()
        self.stack = [_Open("", {}, 0)]
        self.texts: list[list[str]] = []                      # of the elements being taken
        self.page = {n: {} for n in self.layouts}
        self.blocks = {n: [] for n in self.layouts}
        self.inside: dict[str, list[dict]] = {n: [] for n in self.layouts}   # open blocks
        self.markers = 0
        self.feed(html)
        self.close()
        self._end(1)
        return self

    def _fits(self, steps: tuple[Step, ...]) -> bool:
        def one(s: Step, e: _Open) -> bool:
            return (s.tag == e.tag and (not s.nth or s.nth == e.nth) and all(e.attrs.get(a) == v for a, v in s.equal)
                    and all(v in (e.attrs.get(a) or "") for a, v in s.within))

        def up(k: int, at: int) -> bool:                      # step k fits the element at this depth
            if at < 1 or not one(steps[k], self.stack[at]):
                return False
            if k == 0:
                return True
            return up(k - 1, at - 1) if steps[k].child else any(up(k - 1, x) for x in range(at - 1, 0, -1))
        return up(len(steps) - 1, len(self.stack) - 1)

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in _VOID:
            if tag == "br":
                self.handle_data("\n")
            return
        ends = _ENDS.get(tag) or ({"p"} if tag in _HOLDS else ())
        if ends:
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k].tag in ends:
                    self._end(k)
                    break
                if self.stack[k].tag in _HOLDS:
                    break
        up = self.stack[-1]
        up.below[tag] = up.below.get(tag, 0) + 1
        e = _Open(tag, dict(attrs), up.below[tag])
        self.stack.append(e)
        for name, kind, f, steps in self.of_tag.get(tag, ()):
            if not self._fits(steps):
                continue
            if kind == "marker":
                self.markers += 1
            elif kind == "block":
                block: dict = {}
                self.blocks[name].append(block)
                self.inside[name].append(block)
                e.takes.append((name, kind, f, None))
        for name, kind, f, steps in self.of_tag.get(tag, ()):     # a block can be its own field
            if kind == "page" and self._fits(steps) or kind == "field" and self.inside[name] and self._fits(steps):
                where = self.page[name] if kind == "page" else self.inside[name][-1]
                if f not in where:                            # the first one counts
                    where[f] = text = []
                    self.texts.append(text)
                    e.takes.append((name, kind, f, text))

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                self._end(k)
                return

    def _end(self, k: int) -> None:
        while len(self.stack) > k:
            for name, kind, _, text in self.stack.pop().takes:
                if kind == "block":
                    self.inside[name].pop()
                else:
                    self.texts = [t for t in self.texts if t is not text]

    def handle_data(self, data: str) -> None:
        if self.texts and self.stack[-1].tag not in ("script", "style"):
            for t in self.texts:
                t.append(data)


def _text(parts: list[str] | None) -> str | None:
    return None if parts is None else "".join(parts).strip(" \t\r\n")


def extract(pages: DataFrame, layouts: dict[str, Layout], columns: list[str], marker: str = "", marked: str = "",
            id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per block: the id, ``layout``, ``block_no`` and the text of each column (missing: null).  Pages with more
    than one ``marker`` element have the layout ``marked``, others the first of the others.  A null page has no blocks."""
    other = next(n for n in layouts if n != marked)
    kind = pages.schema[id_col].dataType.simpleString()
    names = [id_col, "layout", "block_no", *columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(layouts, marker)
        for b in batches:
            for k in range(0, b.num_rows, 200):
                part = b.slice(k, 200)
                rows, of = [], []
                for i, html in enumerate(part.column(1).to_pylist()):
                    got = reader.read(html or "")
                    name = marked if marked and got.markers > 1 else other
                    for n, block in enumerate(got.blocks[name]):
                        of.append(i)
                        rows.append((name, n, *(_text(block.get(c, got.page[name].get(c))) for c in columns)))
                cols = list(zip(*rows)) or [()] * (2 + len(columns))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(of, pa.int64())), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()),
                     *(pa.array(c, pa.string()) for c in cols[2:])], names=names)

    return (pages.select(id_col, html_col)
            .mapInArrow(run, f"{id_col} {kind}, layout string, block_no int, " + ", ".join(f"{c} string" for c in columns)))


def raw_reviews(pages: DataFrame, columns: list[str], id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Review pages -> raw review rows (the input of the cleaning step), with the page's id, layout and block number."""
    out = extract(pages, {"foreign": FOREIGN, "local": LOCAL}, columns, FOREIGN_MARKER, "foreign", id_col, html_col)
    return out.withColumn("Review_helpful_rating", F.coalesce(F.nullif("Review_helpful_rating", F.lit("")), F.lit(R.DEFAULT_VOTES)))

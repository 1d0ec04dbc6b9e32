"""Main text of HTML pages.

The standard library's streaming parser turns a page into lines (the text of one
block) without building a tree. Each line has a text-to-tag ratio; the ratios are
smoothed with a Gaussian, and a two-cluster threshold separates content lines from
the rest. Candidate regions compete by the text of their content lines: sibling
articles together, a main, or the container with most content and its neighbours that are
content too; articles and mains get a bonus, no more. All lines of the winner are kept, short
ones too, but runs of lines that are links alone. Parts that are boilerplate by their element or
their class, id or role never become lines. Of equal candidates the more special one wins (articles,
then main), and of equal containers the first on the page; a page is read whole, however long.

Defined cases: null html is empty html, whose text is empty; markup that is cut off
or never closed ends with the page; all other columns pass through; an existing
``main_text`` column is replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from glint.llm.common import schema_with

# Element names of HTML by their role.
BLOCKS = frozenset("""address article aside blockquote body caption center dd details div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre
section summary table tbody td tfoot th thead tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("""aside audio button canvas datalist dialog footer form head iframe label menu nav
noscript object option script select style svg template textarea title video""".split())
REGIONS = frozenset("article main section div td body".split())
SIGMA = 1.0                   # of the Gaussian, in lines
REST = 0.25                   # weight of text that is not in a content line
BONUS = {"article": 1.5, "main": 1.2, None: 1.0}
LINKS = (3, 0.8)              # lines of a run of links, and their share of link text
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Parts of class, id and role values that mark boilerplate.
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|adsense|banner|breadcrumbs?|comments?|commentlist|consent|cookies?|"
    r"copyright|disqus|footer|gdpr|header|masthead|menu|modal|nav\w*|newsletter|notices?|notification|pagination|"
    r"popup|promo\w*|related|replies|reply|responses|share|sharing|sidebar|signup|social|sponsor\w*|subscribe|"
    r"subscription|toolbar|widget|complementary|contentinfo|search(?!-results?)|alert|dialog)(?:$|[\s_-])", re.I)


class PageLines(HTMLParser):
    """Lines of a page: (text, tags since the last line, link characters, region)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int]] = []
        self.regions: list[tuple[str, int]] = [("body", -1)]      # kind, enclosing region
        self.open: list[tuple[str, int]] = []                     # open region elements
        self.buf: list[str] = []
        self.tags = self.link = self.in_link = 0
        self.skip = ""
        self.depth = 0
        self.in_head = False

    @property
    def region(self) -> int:
        return self.open[-1][1] if self.open else 0

    def flush(self) -> None:
        text = " ".join("".join(self.buf).split())
        self.buf.clear()
        if text:
            self.lines.append((text, self.tags, self.link, self.region))
            self.tags = self.link = 0

    def in_article(self) -> bool:
        return any(kind == "article" for kind, _ in self.open)

    def marked(self, tag: str, attrs: list) -> bool:
        if tag in ("html", "body", "main"):
            return False
        for k, v in attrs:
            if k == "hidden" or (k == "aria-hidden" and v == "true"):
                return True
            if k in ("class", "id", "role") and v:
                hits = {m.strip(" _-").lower() for m in MARKS.findall(v)}
                if hits - {"header"} or (hits and not self.in_article()):     # an article's header has its title
                    return True
        return False

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if self.skip:
            rescue = tag in ("article", "main") and self.skip in ("nav", "header", "head", "title", "menu", "footer") \
                and not self.marked(tag, attrs)
            if tag == "body" and self.skip in ("head", "title"):
                rescue = True
            if not rescue:
                self.depth += tag == self.skip and tag not in VOID
                return
            self.skip = ""            # never closed
        if tag in BLOCKS:
            self.flush()
        if tag in VOID:
            if tag == "br":
                self.buf.append(" ")
            return
        header = tag == "header" and not self.in_article()
        if tag in DROPPED or header or self.marked(tag, attrs):
            self.buf.append(" ")
            self.skip, self.depth = tag, 1
            if tag in BLOCKS:
                self.flush()
            return
        if tag in REGIONS:
            self.regions.append((tag, self.region))
            self.open.append((tag, len(self.regions) - 1))
        self.in_link += tag == "a"

    def handle_startendtag(self, tag, attrs):
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        else:                         # HTML ignores the slash of an element that is not void
            self.handle_starttag(tag, attrs)
            if tag in self.CDATA_CONTENT_ELEMENTS:
                self.set_cdata_mode(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        if self.skip:
            if tag == self.skip:
                self.depth -= 1
                if not self.depth:
                    self.skip = ""
            elif tag in ("html", "body"):
                self.skip = ""
            return
        if tag in BLOCKS:
            self.flush()
        if tag in REGIONS:
            for at in range(len(self.open) - 1, -1, -1):
                if self.open[at][0] == tag:
                    del self.open[at:]
                    break
        if tag == "a":
            self.in_link = max(0, self.in_link - 1)

    def handle_data(self, data):
        if not self.skip:
            self.buf.append(data)
            if self.in_link:
                self.link += len(data)


def content_lines(lines: list) -> np.ndarray:
    """Marks of the lines whose smoothed text-to-tag ratio is in the upper cluster."""
    sigma = SIGMA
    ratio = np.array([max(0, len(t) - link) / max(1, tags) for t, tags, link, _ in lines], dtype=float)
    reach = np.arange(-int(3 * sigma), int(3 * sigma) + 1)
    kernel = np.exp(-reach ** 2 / (2 * sigma * sigma))
    smooth = np.convolve(np.pad(ratio, len(reach) // 2, mode="edge"), kernel / kernel.sum(), mode="valid")
    low, high = smooth.min(), smooth.max()
    for _ in range(20):               # two means on one axis
        cut = (low + high) / 2
        upper = smooth >= cut
        if upper.all() or not upper.any():
            break
        new = smooth[~upper].mean(), smooth[upper].mean()
        if new == (low, high):
            break
        low, high = new
    return smooth >= (low + high) / 2


def main_text(html: str | None) -> str:
    """The article of one page: blocks in page order, joined by two line ends."""
    page = PageLines()
    page.feed(html or "")
    page.close()
    page.flush()
    lines = page.lines
    if not lines:
        return ""
    content = content_lines(lines)
    value = [(len(t) - link) * (1.0 if hit else REST) for (t, _, link, _), hit in zip(lines, content, strict=True)]

    def ancestors(r: int) -> list[int]:
        out = []
        while r >= 0:
            out.append(r)
            r = page.regions[r][1]
        return out

    up = [ancestors(r) for *_, r in lines]
    inside: dict[int, float] = {}             # of a region with all that is in it
    own: dict[int, float] = {}                # of the lines that are directly in it
    holds: set[int] = set()                   # regions with a content line
    for v, near, hit in zip(value, up, content, strict=True):
        own[near[0]] = own.get(near[0], 0.0) + v
        for r in near:
            inside[r] = inside.get(r, 0.0) + v
        holds.update(near if hit else ())

    def outermost(kind: str) -> list[int]:
        found = [[r for r in near if page.regions[r][0] == kind] for near in up]
        return sorted({f[-1] for f in found if f})

    candidates: list[tuple[float, str | None, set[int]]] = []
    siblings: dict[int, list[int]] = {}
    for r in outermost("article"):
        siblings.setdefault(page.regions[r][1], []).append(r)
    for group in siblings.values():
        best = max(inside[r] for r in group)
        kept = {r for r in group if inside[r] == best or (r in holds and inside[r] >= 0.1 * best)}
        candidates.append((sum(inside[r] for r in kept), "article", kept))
    candidates += [(inside[r], "main", {r}) for r in outermost("main")]
    # the container with most text of its own, and the others that are content too
    best = max(own, key=lambda r: (own[r], -r))
    wide = {best}
    for r, w in own.items():
        marks = [hit for (*_, at), hit in zip(lines, content, strict=True) if at == r]
        if w >= 0.2 * own[best] and np.mean(marks) >= 0.5:
            wide.add(r)
    candidates.append((sum(own[r] for r in wide), None, wide))
    order = ("article", "main", None)
    _, kind, chosen = max(candidates, key=lambda c: (c[0] * BONUS[c[1]], -order.index(c[1]), -min(c[2])))
    mine = [i for i, near in enumerate(up) if (near[0] in chosen if kind is None else chosen.intersection(near))]
    return "\n\n".join(lines[i][0] for i in without_link_lists(lines, mine))


def without_link_lists(lines: list, at: list[int]) -> list[int]:
    """The lines ``at`` without runs of lines that are links alone (lists of further reading, menus)."""
    least, share = LINKS
    out: list[int] = []
    run: list[int] = []
    for i in [*at, -1]:
        if i >= 0 and lines[i][2] >= share * len(lines[i][0]):
            run.append(i)
            continue
        out += run if len(run) < least else []
        run = []
        if i >= 0:
            out.append(i)
    return out


def extract_main_text(pages: DataFrame, html: str = "html", out: str = "main_text") -> DataFrame:
    """``pages`` with the article text of ``html`` as ``out`` (empty if there is none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                kept = [c for c in part.schema.names if c.lower() != out.lower()]
                texts = [main_text(x.as_py()) for x in part.column(html)]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [pa.array(texts, pa.string())],
                                                 [*kept, out])

    return pages.mapInArrow(run, schema_with(pages, **{out: T.StringType()}))

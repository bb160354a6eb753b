"""Operator 12: main text of web pages by text-to-tag ratios.

The standard library's streaming parser gives events; they are cut into lines,
one per block of text, each with its characters, the tags since the line
before, and the characters inside links.

* A line's ratio is its characters by its tags. Ratios are smoothed along the
  page by a Gaussian, and a threshold between two cluster means (iterated until
  it stands) parts content lines from the rest.
* Elements that the contract names (menus, headers, footers, sidebars, notices,
  adverts, forms, comments) are known by tag, role, class and id, and out.
* The region: the article that holds the most content characters, if it is the
  only one or holds most of the text of all articles; else the main element; else
  the smallest container that holds nine tenths of the content and most lines, with
  the headings of first rank before it, and without lines below the threshold that
  are mostly links. All lines of the region stay, short ones too.

Parsing is tolerant: an end tag closes what is open inside its element, but a
tag inside a text never closes a block; blocks close an open paragraph; items,
rows and cells close their predecessors; what is open at the end is closed.
A form, menu or header that holds an article or main element (or a form with a
heading of first rank) is a wrapper and stays.

Defined cases: null and empty html give the empty text; so do pages without
text in the region. Repeated rows are extracted each; page_id and url are
carried as they are, null or not; pages of any length are read whole; an empty
table gives no rows; extra columns do not matter.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagetide.llm.common import python_ready

# fixed values: elements by role
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
SILENT = frozenset(  # no text of a page comes out of these
    "head script style noscript template svg math iframe object applet select textarea button datalist "
    "audio video canvas map title option progress meter".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot "
    "thead tr ul search".split()
)
CELLS = frozenset(("td", "th"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
OUT_TAGS = frozenset("nav header footer aside form dialog menu search".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: What a start tag closes, and the elements that it does not look beyond.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
}
# fixed values: words of class and id names, and prefixes that say something of the rest of the page
OUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot banner sponsor sponsored sponsors promo promotion promoted "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay paywall "
    "sidebar sidebars aside rail menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager topbar toolbar masthead "
    "header footer comment comments commentlist comments-area discussion disqus replies respond "
    "related recommended recommendations share sharing social newsletter subscribe subscription signup login widget widgets skip".split()
)
KEEP_PREFIXES = frozenset("has with no without is not".split())
WRAPPER_WORDS = frozenset("header menu menus nav navbar navigation banner widget widgets form".split())

SIGMA = 1.0
_kernel = np.exp(-0.5 * (np.arange(-3, 4) / SIGMA) ** 2)
REGION_SHARE = 0.9
LINK_SHARE = 0.5

_name = re.compile(r"[a-z0-9]+(?:[-_]+[a-z0-9]+)*")


def out_word(names: str) -> str | None:
    """The word of a class or id attribute that marks page furniture."""
    for name in _name.findall(names.lower()):
        words = re.split(r"[-_]+", name)
        if words[0] in KEEP_PREFIXES:
            continue
        # a name says in its first or last word what it stands for
        for w in (name, words[0], words[-1]):
            if w in OUT_WORDS:
                return w
    return None


class Page(HTMLParser):
    """Lines and elements of one page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        # elements: tag, parent, out, wrapper allowed; element 0 is the page
        self.tag, self.parent, self.out, self.may_wrap = ["#page"], [-1], [False], [False]
        self.main, self.article = [], []
        self.stack, self.silent, self.links = [0], 0, 0
        self.lines: list[tuple[int, str, int, int]] = []  # element, text, tags, link characters
        self._parts: list[str] = []
        self._tags = self._linked = 0

    # events -----------------------------------------------------------

    def handle_starttag(self, tag, attrs):
        self._tags += 1
        if tag in VOID:
            if tag == "hr":
                self._flush()
            elif tag == "br":
                self._parts.append(" ")
            return
        if tag == "body" and "body" in (self.tag[e] for e in self.stack):
            return
        if tag == "body":
            self._close_to("head")  # a head without its end
        if tag in BLOCKS:
            self._close_to("p", barrier=BLOCKS - {"p"} | CELLS)
            self._flush()
        if tag in CELLS:
            self._parts.append(" ")
        if tag in CLOSES:
            names, barrier = CLOSES[tag]
            for name in names:
                self._close_to(name, barrier)
        self._open(tag, dict(attrs))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCKS and tag not in ("a", "b", "i", "em", "strong", "span"):
            self.handle_endtag(tag)  # <svg/>; on text and block elements the slash means nothing

    def handle_endtag(self, tag):
        self._tags += 1
        if tag == "br":
            self._parts.append(" ")
        elif tag in BLOCKS:
            # one that nothing opened means nothing, but </p> parts blocks
            self._close_to(tag, barrier=BLOCKS - {"p"} | CELLS if tag == "p" else ())
            if tag == "p":
                self._flush()
        elif tag in CELLS:
            self._close_to(tag, barrier=("table",))
            self._parts.append(" ")
        else:
            self._close_to(tag, barrier=BLOCKS | CELLS if tag not in SILENT else ())

    def handle_data(self, data):
        if not self.silent:
            self._parts.append(data)
            if self.links:
                self._linked += len(data)

    def parse_marked_section(self, i, report=1):
        # <![...[ is a comment in HTML, whatever stands inside
        return self.parse_bogus_comment(i)

    def unknown_decl(self, data):
        pass

    # elements and lines -----------------------------------------------

    def _open(self, tag, attrs):
        role = (attrs.get("role") or "").lower()
        out, wraps = tag in OUT_TAGS or role in OUT_ROLES, tag in ("form", "nav", "header", "menu")
        if "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true":
            out = True
        if not out and tag not in ("html", "body", "main"):
            word = out_word(f"{attrs.get('class') or ''} {attrs.get('id') or ''}")
            out, wraps = word is not None, word in WRAPPER_WORDS
        me = len(self.tag)
        self.tag.append(tag)
        self.parent.append(self.stack[-1])
        self.out.append(out)
        self.may_wrap.append(out and wraps)
        if not out and (tag == "article" or role == "article" or attrs.get("itemprop") == "articleBody"):
            self.article.append(me)
        elif not out and (tag == "main" or role == "main"):
            self.main.append(me)
        self.stack.append(me)
        self.silent += tag in SILENT
        self.links += tag == "a"

    def _close_to(self, tag, barrier=()):
        """Close the innermost open ``tag`` and all inside, unless a barrier
        stands before it."""
        for at in range(len(self.stack) - 1, 0, -1):
            name = self.tag[self.stack[at]]
            if name == tag:
                break
            if name in barrier:
                return
        else:
            return
        if tag in BLOCKS:
            self._flush()
        for e in self.stack[at:]:
            self.silent -= self.tag[e] in SILENT
            self.links -= self.tag[e] == "a"
        del self.stack[at:]

    def _flush(self):
        text = " ".join("".join(self._parts).split())
        self._parts = []
        if text:
            self.lines.append((self.stack[-1], text, self._tags, min(self._linked, len(text))))
            self._tags = self._linked = 0

    def finish(self):
        self.close()
        self._flush()
        self.silent = self.links = 0


def content_lines(chars: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """Lines whose smoothed text-to-tag ratio is on the upper side of the
    threshold between two clusters."""
    ratio = chars / np.maximum(tags, 1)
    weight = np.convolve(np.ones(len(ratio)), _kernel, mode="full")[3:-3]
    smooth = np.convolve(ratio, _kernel, mode="full")[3:-3] / weight
    at = smooth.mean()
    while True:
        high = smooth >= at
        if high.all():
            return high
        nxt = (smooth[high].mean() + smooth[~high].mean()) / 2
        if abs(nxt - at) <= 1e-9 * max(1.0, at):
            return high
        at = nxt


def main_lines(page: Page) -> list[str]:
    """Texts of the lines of the page's main region."""
    if not page.lines:
        return []
    where = np.array([line[0] for line in page.lines])
    chars = np.array([len(line[1]) for line in page.lines])
    tags = np.array([line[2] for line in page.lines])
    linked = np.array([line[3] for line in page.lines])
    high = content_lines(chars, tags)

    n = len(page.tag)
    parent, out = page.parent, list(page.out)
    for e in page.article + page.main + [e for e in range(n) if page.tag[e] == "h1"]:
        p = parent[e]
        while p > 0:
            if page.may_wrap[p] and (page.tag[e] != "h1" or page.tag[p] == "form"):
                out[p] = False
            p = parent[p]
    inside = [False] * n  # in an article
    gone = [False] * n
    for e in range(1, n):  # a parent stands before its children
        p = parent[e]
        inside[e] = inside[p] or page.tag[p] == "article"
        gone[e] = gone[p] or out[e]
        # the headings of an article's own header are the article's
        if gone[e] and page.tag[e] in HEADINGS and inside[e]:
            q = p
            while page.tag[q] == "hgroup":
                q = parent[q]
            gone[e] = not (page.tag[q] == "header" and not gone[parent[q]] and not (page.out[e] and page.tag[e] not in OUT_TAGS))
    stays = ~np.array([gone[e] for e in where])
    if not stays.any():
        return []
    if not (stays & high).any():
        high = stays
    weight = np.zeros(n, np.int64)
    np.add.at(weight, where, chars * (stays & high))
    held, count = np.zeros(n, np.int64), np.zeros(n, np.int64)  # characters and lines, content or not
    np.add.at(held, where, chars * stays)
    np.add.at(count, where, stays)
    for e in range(n - 1, 0, -1):
        weight[parent[e]] += weight[e]
        held[parent[e]] += held[e]
        count[parent[e]] += count[e]

    def outermost(elements):
        mine = {e for e in elements if not gone[e] and held[e]}
        top = []
        for e in sorted(mine):
            p = parent[e]
            while p > 0 and p not in mine:
                p = parent[p]
            if p <= 0:
                top.append(e)
        return top

    def within(region):
        ok = [False] * n
        for e in range(region, n):
            ok[e] = e == region or (parent[e] >= region and ok[parent[e]])
        return np.array([ok[e] for e in where])

    articles = outermost(page.article)
    region = None
    if articles:
        best = max(articles, key=lambda e: (weight[e], held[e]))
        if len(articles) == 1 or 2 * held[best] > sum(held[e] for e in articles):
            region = best
    if region is None:
        mains = outermost(page.main)
        region = max(mains, key=lambda e: (weight[e], held[e])) if mains else None
    if region is not None:
        keep = stays & within(region)
    else:
        region = 0
        while True:
            # the container of the blocks, not a block
            heavy = [
                e for e in range(region + 1, n)
                if parent[e] == region and weight[e] >= REGION_SHARE * weight[0] and 2 * count[e] > count[region]
            ]
            if not heavy or count[heavy[0]] < 2:
                break
            region = heavy[0]
        mine = within(region)
        before = np.arange(len(where)) < (np.flatnonzero(mine)[0] if mine.any() else 0)
        title = np.array([page.tag[e] == "h1" for e in where])
        menu = ~high & (linked > LINK_SHARE * chars)
        keep = stays & (mine | (before & title)) & ~menu
    return [page.lines[i][1] for i in np.flatnonzero(keep)]


def main_text(html: str | None) -> str:
    page = Page()
    page.feed(html or "")
    page.finish()
    return "\n".join(main_lines(page))


def _extract(batches):
    for b in batches:
        text = pa.array([main_text(h) for h in b.column("html").to_pylist()], pa.string())
        keep = [i for i, name in enumerate(b.schema.names) if name != "html"]
        n_chars = pa.compute.utf8_length(text).cast(pa.int64())
        names = [b.schema.names[i] for i in keep]
        yield pa.RecordBatch.from_arrays([*[b.column(i) for i in keep], text, n_chars], names=[*names, "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text (main text, a block a line) and n_chars of every page."""
    python_ready(pages.sparkSession)
    src = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    schema = T.StructType([src.schema["page_id"], src.schema["url"]]).add("text", "string").add("n_chars", "long")
    return src.mapInArrow(_extract, schema)


def op12_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir.rstrip('/')}/pages.parquet"))

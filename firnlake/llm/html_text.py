"""Main text of web pages, with site templates found by counting element subtrees per host.

A page is parsed into a tree. Parts that are never article text go by what they are: scripts,
styles, forms, menus, page headers and footers, sidebars, and elements whose class, id or role says
menu, advert, notice, comments and the like. A class or id counts if one of its words is such a name as
a whole or consists of such names alone (``cookie-notice``, not ``no-sidebar`` or ``related-work``). A name
or a form never costs the page its only article or main, nor an article its heading block. Every block-level subtree that is left outside the
article is hashed (tag, text and children), unless an article or main is inside it; Spark counts on how
many different pages of a host each hash occurs. A subtree that recurs on at least ``MIN_PAGES`` pages and ``MIN_SHARE`` of the host's pages
belongs to the site's template and is deleted. Block-level subtrees inside articles are counted apart, over
different articles: those with the same first heading (else with the same content) are one, so that edited
copies of an article do not make its paragraphs a template. Such a subtree goes if it recurs in at least
``MIN_PAGES`` articles and ``ARTICLE_SHARE`` of the host's; headings, list items and table cells stay. What remains of the ``article`` elements (else of
``main``, else of the body) is the text: character references decoded, white space inside a block
one space, blocks joined by one space.

Copies of a page count once: hashes are first made distinct by host, hash and digest of the html, which
deals a large host over all tasks, then counted. Templates of a host are few by construction: at most its mean number of
subtrees over ``MIN_SHARE``. They are broadcast up to ``BROADCAST_ROWS`` rows in all and joined by
host beyond that.

Defined results: null or empty html gives an empty text. A null url is a host of its own (''). Each
of repeated rows gets its text. Broken markup never fails: open elements end with
their parent, stray end tags are skipped, a cut-off tag is dropped. Other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firnlake.llm.common import stored, table
from firnlake.llm.url_filter import host_and_path

MIN_PAGES = 10
MIN_SHARE = 0.3
ARTICLE_SHARE = 0.5
BROADCAST_ROWS = 50_000

# HTML element names by their role.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "template"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd",
    "label", "mark", "meter", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time",
    "tt", "u", "var", "wbr", "nobr",
}
DROPPED = {
    "script", "style", "noscript", "template", "title", "textarea", "xmp", "iframe", "noembed", "noframes", "head", "nav", "aside",
    "footer", "form", "button", "select", "option", "input", "object", "embed", "svg", "canvas", "audio", "video", "map", "dialog",
    "menu", "link", "meta",
}
ENDS_P = {
    "address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1",
    "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul",
}
CLOSES = {  # an opening tag ends these open elements, up to the nearest of the second set
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar", "form"}
NAMES = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "breadcrumb", "breadcrumbs", "comment",
    "comments", "commentlist", "consent", "cookie", "cookies", "disclaimer", "disqus", "footer", "gdpr", "header", "masthead", "menu",
    "menus", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pager", "pagination", "popup", "promo",
    "promoted", "related", "replies", "reply", "respond", "share", "sharing", "sidebar", "sidenav", "signup", "skip", "social", "sponsor",
    "sponsored", "subscribe", "topbar", "toolbar", "widget", "widgets",
}

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]|=\s*\"[^\"]*\"|=\s*'[^']*'|[=\"'])*?)(?:(/?)>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\bhidden\b", re.S)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


# inside articles these are no blocks of their own
PIECES = HEADINGS | {"li", "dt", "dd", "tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup", "col", "br", "hr", "figcaption", "summary"}
INSIDE = b"\0a"


class Element:
    __slots__ = ("below", "dropped", "mark", "tag", "why")

    def __init__(self, tag: str, why: str = ""):
        self.tag, self.why, self.dropped, self.below = tag, why, why != "", []
        self.mark: bytes | None = None


def _named(word: str) -> bool:
    """Whether a word of a class or id is a name, or names and numbers alone."""
    pieces = [x for x in re.split(r"[-_]+|(?<=\D)(?=\d)", word) if x and not x.isdigit()]
    return bool(pieces) and NAMES.issuperset(pieces)


def _unwanted(tag: str, attributes: str, inside_article: bool) -> str:
    """Why an element goes: "kind" is final, "name" and "header" depend on what it holds; "" if it stays."""
    if tag in DROPPED:
        return "name" if tag == "form" else "kind"
    if not attributes or tag in ("html", "body", "article", "main"):
        return ""
    for found in ATTRIBUTE.finditer(attributes):
        name = (found[1] or "hidden").lower()
        value = html.unescape(found[2] or found[3] or found[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return "kind"
        if name == "role" and value in ROLES:
            return "name"
        if name == "style" and re.search(r"display\s*:\s*none", value):
            return "kind"
        if name in ("class", "id") and (words := [w for w in value.split() if _named(w)]):
            # a heading, or text marked inside a line, is no page part
            if tag in HEADINGS or tag in INLINE and inside_article:
                return ""
            return "header" if inside_article and set(words) == {"header"} else "name"
    return ""


SOFT = {"p", "tr", "td", "th", "tbody", "thead", "tfoot"}  # blocks that an end tag of an outer one may pass


class Open:
    """The open elements, with the places of each tag, so that none is searched for."""

    def __init__(self, root: Element):
        self.stack = [root]
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []  # not inline
        self.hard: list[int] = []  # neither inline nor soft

    def last(self, tag: str) -> int:
        """The innermost open element of a tag, 0 if there is none."""
        places = self.places.get(tag)
        return places[-1] if places else 0

    def push(self, element: Element) -> None:
        place, tag = len(self.stack), element.tag
        self.stack.append(element)
        self.places.setdefault(tag, []).append(place)
        if tag not in INLINE:
            self.blocks.append(place)
            if tag not in SOFT:
                self.hard.append(place)

    def close(self, place: int) -> None:
        """End the element at a place and all inside it."""
        while len(self.stack) > place:
            self.places[self.stack.pop().tag].pop()
        for found in (self.blocks, self.hard):
            while found and found[-1] >= place:
                found.pop()


def parse(text: str) -> Element:
    """The tree of a page; children are elements and decoded texts.  Time is in proportion to the text."""
    root = Element("#root")
    open_, at, size = Open(root), 0, len(text)
    stack = open_.stack
    search = TAG.search
    while at < size:
        found = search(text, at)
        if found is None:
            stack[-1].below.append(html.unescape(text[at:]))
            break
        if found.start() > at:
            chunk = text[at : found.start()]
            stack[-1].below.append(html.unescape(chunk) if "&" in chunk else chunk)
        at = found.end()
        name = found[2]
        if name is None:
            if text.startswith("<![CDATA[", found.start()):
                stack[-1].below.append(text[found.start() + 9 : at].removesuffix("]]>"))
            continue
        if at == size and text[-1] != ">":
            break  # a tag that is cut off
        tag = name.lower()
        if found[1]:
            depth = open_.last(tag)
            # a misplaced inline end tag ends nothing
            if depth and (tag not in INLINE or not open_.blocks or open_.blocks[-1] < depth):
                open_.close(depth)
            continue
        if tag in ENDS_P or tag in CLOSES:
            closes, until = CLOSES.get(tag, ({"p"}, {"table", "td", "th", "button", "object"}))
            ends = max(map(open_.last, closes))
            if ends and ends >= max(open_.hard[-1] if open_.hard else 0, *map(open_.last, until)):
                open_.close(ends)
        element = Element(tag, _unwanted(tag, found[3], open_.last("article") > 0))
        stack[-1].below.append(element)
        if tag in VOID or found[4]:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(text, at)
            close = text.find(">", end.end()) if end else -1
            at = close + 1 if close >= 0 else size
            continue
        open_.push(element)
    return root


def _settle_names(root: Element) -> None:
    """Elements that go by a name stay if the page's only article (else its only main) is inside them."""
    for wanted in ("article", "main"):
        todo: list[tuple[Element, tuple]] = [(root, ())]
        inside: list[tuple] = []
        while todo:
            e, above = todo.pop()
            if e.tag == wanted and not e.dropped:
                if not above:
                    return  # one that nothing hides
                inside.append(above)
                continue
            if e.why == "kind":
                continue
            above = (e, above) if e.dropped else above
            todo.extend((x, above) for x in e.below if isinstance(x, Element))
        for above in inside:
            while above:
                above[0].dropped = False
                above = above[1]
        if inside:
            return


def _holds_heading(element: Element) -> bool:
    todo = [element]
    while todo:
        e = todo.pop()
        if e.tag in HEADINGS:
            return True
        todo.extend(x for x in e.below if isinstance(x, Element) and not x.dropped)
    return False


def _settle_headers(element: Element, inside: bool = False) -> None:
    """Headers go, but the header of an article that holds its heading stays."""
    todo = [(element, inside)]
    while todo:
        e, within = todo.pop()
        for child in e.below:
            if isinstance(child, Element):
                if child.why == "header" and within and _holds_heading(child):
                    child.dropped = False
                if child.tag == "header" and not (within and any(isinstance(x, Element) and x.tag in HEADINGS for x in child.below)):
                    child.dropped = True
                if not child.dropped:
                    todo.append((child, within or child.tag in ("article", "main")))


def _marked(root: Element) -> tuple[list[tuple[Element, int, int]], list[int]]:
    """Hashes kept block-level subtrees bottom-up, without recursion.

    Returns those that may be template, each with its number and the number of its article (0 outside
    articles), and the numbers of the articles.
    """
    order, todo = [], [(root, None)]
    while todo:
        e, article = todo.pop()
        order.append((e, article))
        within = article or (e if e.tag == "article" else None)
        todo.extend((x, within) for x in reversed(e.below) if isinstance(x, Element) and not x.dropped)
    found: list[tuple[Element, Element | None, bytes]] = []
    heading: dict[int, bytes] = {}  # of an article: its first heading
    holding: set[int] = set()  # elements with an article or main inside
    for e, article in reversed(order):
        holds = any(isinstance(x, Element) and not x.dropped and (x.tag in ("article", "main") or id(x) in holding) for x in e.below)
        if holds:
            holding.add(id(e))
        digest = blake2b(e.tag.encode(), digest_size=8)
        filled = False
        for x in e.below:
            if isinstance(x, str):
                words = " ".join(x.split())
                if words:
                    digest.update(b"\0t" + words.encode("utf-8", "surrogatepass"))
                    filled = True
            elif not x.dropped and x.mark is not None:
                digest.update(b"\0e" + x.mark)
                filled = True
        e.mark = digest.digest() if filled else None
        if not filled:
            continue
        if article is not None and e.tag in HEADINGS:
            heading[id(article)] = e.mark  # the last one met is the first of the page
        if not holds and e.tag not in INLINE and e.tag not in ("#root", "html", "body", "article", "main"):
            if article is None:
                found.append((e, None, e.mark))
            elif e.tag not in PIECES:
                found.append((e, article, blake2b(INSIDE + e.mark, digest_size=8).digest()))
    name = {id(e): _number(heading.get(id(e), e.mark)) for e, article in order if e.tag == "article" and article is None and e.mark}
    return [(e, _number(mark), name[id(article)] if article else 0) for e, article, mark in found], list(name.values())


def tree(text: str) -> tuple[Element, list[tuple[Element, int, int]], list[int]]:
    root = parse(text)
    _settle_names(root)
    _settle_headers(root)
    return root, *_marked(root)


def _number(mark: bytes) -> int:
    return int.from_bytes(mark, "little", signed=True)


def subtree_marks(text: str) -> list[tuple[int, int, bool]]:
    """Distinct (hash, page or article, whether inside articles) of possible template parts; hash 0 counts pages and articles."""
    page = _number(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest())
    _, parts, articles = tree(text)
    inside = {(mark, article, True) for _, mark, article in parts if article} | {(0, a, True) for a in articles}
    return [(0, page, False), *sorted({(mark, page, False) for _, mark, article in parts if not article}), *sorted(inside)]


def main_text(text: str, templates: set[int]) -> str:
    root, parts, _ = tree(text)
    if templates:
        for e, mark, _ in parts:
            if mark in templates:
                e.dropped = True
    for wanted in ("article", "main", "body"):
        tops = _tops(root, wanted)
        if tops:
            return _text(tops)
    return _text([root])


def _tops(root: Element, tag: str) -> list[Element]:
    out, todo = [], [root]
    while todo:
        e = todo.pop()
        if e.tag == tag:
            out.append(e)
        else:
            todo.extend(reversed([x for x in e.below if isinstance(x, Element) and not x.dropped]))
    return out


def _text(elements: list[Element]) -> str:
    pieces: list[str] = []
    todo: list = list(reversed(elements))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            pieces.append(x)
        elif not x.dropped:
            if x.tag in INLINE:
                todo.extend(reversed(x.below))
            else:
                pieces.append(" ")
                todo.append(" ")
                todo.extend(reversed(x.below))
    return " ".join("".join(pieces).split())


# -- Spark ------------------------------------------------------------------------------------


def _host_key(pages: DataFrame):
    host, _ = host_and_path(F.col("url"))
    return F.xxhash64(host)


def find_templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, mark) of the subtrees that recur on many pages of a host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, marks, units, inside = [], [], [], []
            for host, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = subtree_marks(text)
                hosts.extend([host] * len(found))
                marks.extend(m for m, _, _ in found)
                units.extend(u for _, u, _ in found)
                inside.extend(i for _, _, i in found)
            arrays = [pa.array(hosts, pa.int64()), pa.array(marks, pa.int64()), pa.array(units, pa.int64()), pa.array(inside, pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, names=["host", "mark", "unit", "inside"])

    rows = pages.select(_host_key(pages).alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    units = rows.mapInArrow(run, "host long, mark long, unit long, inside boolean").distinct()
    counts = units.groupBy("host", "inside", "mark").agg(F.count(F.lit(1)).alias("n"))
    counts = stored(counts.where(f"n >= {min_pages} OR mark = 0"), "html-marks")
    sizes = counts.where("mark = 0").select("host", "inside", F.col("n").alias("units"))
    share = F.when(F.col("inside"), F.lit(max(ARTICLE_SHARE, min_share))).otherwise(F.lit(min_share))
    return counts.where("mark <> 0").join(sizes, ["host", "inside"]).where(F.col("n") >= share * F.col("units")).select("host", "mark")


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    spark = pages.sparkSession
    templates = stored(find_templates(pages, min_pages, min_share), "html-templates")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), _host_key(pages).alias("host"),
    )
    small = templates.count() <= broadcast_rows
    known: dict[int, set[int]] = {}
    if small:
        for r in templates.collect():
            known.setdefault(r.host, set()).add(r.mark)
    else:
        per_host = templates.groupBy("host").agg(F.collect_list("mark").alias("marks"))
        rows = rows.join(per_host, "host", "left").select("page_id", "url", "html", "host", "marks")
    shared = spark.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, urls, texts, hosts, *marks = batch.columns
            found = marks[0].to_pylist() if marks else [shared.value.get(h, ()) for h in hosts.to_pylist()]
            out = [main_text(t, set(m or ())) for t, m in zip(texts.to_pylist(), found, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [ids, urls, pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op10_html_text(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return extract(table(spark, folder, "pages"))

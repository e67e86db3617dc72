"""Main text of web pages by wrappers: union-free regular expressions per host.

A page's token stream of tags and texts is read as nested groups. A wrapper is
an expression over such streams without alternatives: named groups in order,
each perhaps optional or repeated, with text slots that are constant or vary.
Wrappers of the same host are aligned again and again: groups that match by
name are merged, a group that one side lacks becomes optional, runs of one name
become repeated, and differing texts become slots that vary.

Each task aligns its own pages by host; the partial wrappers (small, whatever
the number of pages) are aligned in two rounds, by salt and then by host, so a
host that holds a third of all pages is no single task's work.

A page is then read along its host's wrapper. Groups are labelled by their tag
and class: menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles and reader comments are dropped, and article groups are content, whatever
their class. A class, role or id counts as a whole, with words such as "site" or
"list" beside it, so "no-sidebar" or "related-work" drop nothing. For all
other text the wrapper's slots decide, on every page: a slot is template if at
least two different pages showed the same text there and none another one, and
then only where a page shows that text. Pages whose kept texts are equal count
as one, so a copied page does not make its own text a template.

Defined results: null and empty html gives an empty text; a url without a host
is a host of its own; repeated rows get equal texts; blocks that are blank
vanish; an empty table gives no rows. Pages of any length are read whole. Of alignments that
share equally many groups, the one that passes over the left side's groups first is taken. Columns
other than page_id, url and html are not read.
"""

from __future__ import annotations

import html
import json
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, read_table, written

SALTS = 32
#: Hosts whose wrappers a task gathers before it passes them on.
TASK_HOSTS = 1_000
SEVERAL = -1
#: Groups nested deeper than this stand inside their last ancestor, as in browsers.
MAX_DEPTH = 300

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    # a quote opens a value only right after its equals sign; elsewhere it is a character like others
    r"|<([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>]*+))*+)(?:>|\Z)",
    re.S,
)
_NAMED = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_DIGIT = re.compile(r"[0-9]")
_SPACE = re.compile(r"\s+")
_RAW = {t: re.compile(rf"</{t}[^>]*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "template")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split()
)
#: Block-level starts before which an open paragraph ends.
_ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
_ENDS_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_DROPPED_TAGS = frozenset(
    "head nav header footer aside form script style noscript template iframe svg canvas button select option menu dialog textarea title object audio video".split()
)
_DROPPED_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo sidebar comment comments disqus notice notices cookie cookies consent menu nav navbar navigation "
    "breadcrumb breadcrumbs header masthead footer related share sharing social newsletter subscribe signup popup modal alert toolbar pagination complementary contentinfo search".split()
)
#: Words that only say more about such a name before or after them, as in site-header, cookie-bar or ad-300x250.
_BEFORE = "site main top bottom mobile global primary secondary google dfp".split()
_AFTER = (
    "list wrapper wrap container area section block box bar unit slot widget widgets inner link links icon icons button buttons form item items message messages "
    "thread toggle posts articles stories".split()
)
#: What may stand beside a post and be named after it; a post's header is its own.
_BESIDE_POST = "ad ads comment comments nav navigation newsletter pagination related share sharing social".split()
_ANY = "|".join(sorted(_DROPPED_NAMES))
_DROPPED_WORD = re.compile(
    rf"(?:(?:(?:{'|'.join(_BEFORE)})[-_]+)*(?:{_ANY})|(?:post|posts|article|entry|reader|user)[-_]+(?:{'|'.join(_BESIDE_POST)}))"
    rf"(?:[-_]+(?:{_ANY}|{'|'.join(_AFTER)}|[0-9]+(?:x[0-9]+)?))*"
)
_ARTICLE_TAGS = frozenset(("article", "main"))
#: Never dropped by a name.
_KEPT_TAGS = _ARTICLE_TAGS | {"html", "body"}
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


class Group:
    """One group of a wrapper or of a page: a name, children in order, and text slots."""

    __slots__ = ("name", "dropped", "children", "optional", "repeated", "slot", "page", "parts")

    def __init__(self, name: str, dropped: bool = False):
        self.name = name
        #: On pages: whether its tag, class, id or role says that it is no content.
        self.dropped = dropped
        self.children: list[Group] = []
        self.optional = self.repeated = False
        #: Digest of the constant text of the group's own slots, -1 where it varies, 0 without text.
        self.slot = 0
        #: Digest of the one page that showed the slot, SEVERAL where different pages did.
        self.page = 0
        #: On pages: texts and children in page order.
        self.parts: list = []

    def dump(self) -> list:
        return [self.name, int(self.optional), int(self.repeated), self.slot, self.page, [c.dump() for c in self.children]]

    @staticmethod
    def load(data: list) -> Group:
        group = Group(data[0])
        group.optional, group.repeated, group.slot, group.page = bool(data[1]), bool(data[2]), data[3], data[4]
        group.children = [Group.load(c) for c in data[5]]
        return group


def _names(tag: str, attributes: str) -> tuple[str, tuple[str, ...], tuple[str, ...]]:
    """The group's name, the words of its class and role, and its ids.

    Names leave out ids and words with digits, which may be one page's own.
    """
    if not attributes:
        return tag, (), ()
    found = [(a.lower(), n) for a, b, c, d in _NAMED.findall(attributes) for n in (b or c or d).lower().split()]
    words = tuple(n for a, n in found if a != "id")
    return tag + "".join("." + n for n in words if not _DIGIT.search(n)), words, tuple(n for a, n in found if a == "id")


@lru_cache(100_000)
def dropped(tag: str, words: tuple[str, ...] = (), ids: tuple[str, ...] = (), inside: bool = False) -> bool:
    """Whether a group is no content; ``inside`` an article, ids of sections are its chapters' names."""
    if tag in _DROPPED_TAGS:
        return True
    if tag in _KEPT_TAGS:
        return False
    named = words if tag in _HEADINGS or inside and tag == "section" else words + ids
    return any(_DROPPED_WORD.fullmatch(n) for n in named)


def read_page(source: str) -> Group:
    """The page's tokens as nested groups; tags left open and stray ends are mended as browsers do."""
    root = Group("")
    stack = [root]
    articles = 0
    flat: Counter[str] = Counter()

    def text(data: str) -> None:
        if data and not data.isspace():
            stack[-1].parts.append(data)

    def close(tags: tuple[str, ...], stop: tuple[str, ...]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            tag = stack[k].name.partition(".")[0]
            if tag in tags:
                del stack[k:]
                return
            if tag in stop:
                return

    at = 0
    token = _TOKEN.search(source)
    while token:
        start, end = token.span()
        text(source[at:start])
        at = end
        tag = token[2]
        if tag:
            tag = tag.lower()
            if tag in _VOID:
                if tag in ("br", "hr", "img", "wbr"):
                    stack[-1].parts.append("" if tag == "wbr" else " ")
                token = _TOKEN.search(source, at)
                continue
            name, words, ids = _names(tag, token[3])
            # a main without an article so far is the article
            inside = bool(ids) and tag == "section" and any(g.name.partition(".")[0] in ("article",) + ("main",) * (not articles) for g in stack)
            out = dropped(tag, words, ids, inside)
            articles += tag == "article"
            if tag not in _INLINE or out:
                if tag in _ENDS_P:
                    close(("p",), ("article", "aside", "body", "div", "section", "td", "th", "button", "object"))
                elif tag in _ENDS_SAME:
                    close(_ENDS_SAME[tag], ("ul", "ol", "dl", "table", "select"))
                group = Group(name, out)
                stack[-1].parts.append(group)
                if not token[3].rstrip().endswith("/") or tag not in ("svg", "path"):
                    if tag in _RAW:
                        closing = _RAW[tag].search(source, at)
                        at = closing.end() if closing else len(source)
                    elif len(stack) <= MAX_DEPTH or out and not stack[-1].dropped:
                        stack.append(group)
                    else:
                        flat[tag] += 1
        elif token[1]:
            tag = token[1].lower()
            if flat[tag]:
                flat[tag] -= 1
                stack[-1].parts.append(Group(tag))
            elif tag not in _INLINE or any(g.name.partition(".")[0] == tag for g in stack):
                close((tag,), ())
        token = _TOKEN.search(source, at)
    text(source[at:])
    return root


def _digest(text: str) -> int:
    return zlib.crc32(" ".join(text.split()).encode("utf-8", "surrogatepass")) + 1


def _own_text(group: Group) -> str:
    return " ".join(p for p in group.parts if isinstance(p, str))


def _kept_texts(group: Group) -> Iterator[str]:
    for part in group.parts:
        if isinstance(part, str):
            yield part
        elif not part.dropped:
            yield from _kept_texts(part)


def _settle(group: Group, page: int | None = None) -> Group:
    """A page's group as a wrapper: runs of one name become one repeated group."""
    if page is None:
        page = _digest(" ".join(_kept_texts(group)))
    text = _own_text(group)
    group.slot, group.page = _digest(text) if text.strip() else 0, page
    children: list[Group] = []
    for part in group.parts:
        if isinstance(part, Group):
            _settle(part, page)
            if children and children[-1].name == part.name:
                children[-1] = align(children[-1], part)
                children[-1].repeated = True
            else:
                children.append(part)
    group.children, group.parts = children, []
    return group


def _paired(x: list[str], y: list[str]) -> Iterator[tuple[int | None, int | None]]:
    """Both lists in order along a longest common subsequence: pairs of places, or a place of one list alone.

    A row of the usual table is one number whose zero bits are the steps of that row, so
    each of ``x`` costs a few operations on as many bits as ``y`` is long. Every
    so many rows are kept, and those between are made again as the way passes
    them: memory grows with the root of one length times the other.
    """
    n, m = len(x), len(y)
    places: dict[str, int] = {}
    for j, name in enumerate(y):
        places[name] = places.get(name, 0) | 1 << (m - 1 - j)
    full = (1 << m) - 1

    def above(row: int, name: str) -> int:
        hit = row & places.get(name, 0)
        return (row + hit | row - hit) & full

    step = max(1, math.isqrt(n))
    kept, row = {n: full}, full
    for i in range(n - 1, -1, -1):
        row = above(row, x[i])
        if i % step == 0:
            kept[i] = row
    rows: dict[int, int] = {}

    def common(i: int, j: int) -> int:
        """How much the lists share from these places on."""
        low = m - j
        return low - (rows[i] & (1 << low) - 1).bit_count()

    i = j = 0
    while i < n and j < m:
        if i not in rows or i + 1 not in rows:
            end = min(n, i - i % step + step)
            row = kept[end]
            rows = {end: row}
            for k in range(end - 1, i - 1, -1):
                row = rows[k] = above(row, x[k])
        if x[i] == y[j]:
            yield i, j
            i, j = i + 1, j + 1
        elif common(i + 1, j) >= common(i, j + 1):
            yield i, None
            i += 1
        else:
            yield None, j
            j += 1
    yield from ((k, None) for k in range(i, n))
    yield from ((None, k) for k in range(j, m))


def align(a: Group, b: Group) -> Group:
    """The smallest expression here that covers both groups of one name."""
    out = Group(a.name)
    out.optional, out.repeated = a.optional or b.optional, a.repeated or b.repeated
    out.slot = a.slot if a.slot == b.slot else -1
    out.page = a.page if a.page == b.page else SEVERAL
    x, y = a.children, b.children
    if [c.name for c in x] == [c.name for c in y]:
        out.children = [align(c, d) for c, d in zip(x, y)]
        return out
    found: list[Group] = []
    for i, j in _paired([c.name for c in x], [c.name for c in y]):
        if i is not None and j is not None:
            found.append(align(x[i], y[j]))
        else:
            one = x[i] if i is not None else y[j]
            one.optional = True
            found.append(one)
    for child in found:
        if out.children and out.children[-1].name == child.name:
            merged = align(out.children[-1], child)
            merged.optional, merged.repeated = out.children[-1].optional and child.optional, True
            out.children[-1] = merged
        else:
            out.children.append(child)
    return out


def is_template(group: Group, along: Group | None) -> bool:
    """Whether the page's group shows the text that different pages of its host show in this slot, and no page another one."""
    return along is not None and along.slot > 0 and along.page == SEVERAL and _digest(_own_text(group)) == along.slot


def extract(page: Group, wrapper: Group | None) -> str:
    """Texts of the page's content slots, one block a line."""
    blocks: list[str] = []
    run: list[str] = []

    def end_block() -> None:
        if run:
            joined = _SPACE.sub(" ", html.unescape("".join(run))).strip()
            if joined:
                blocks.append(joined)
            run.clear()

    def walk(group: Group, along: Group | None, inside: bool) -> None:
        tag = group.name.partition(".")[0]
        inside = inside or tag in _ARTICLE_TAGS
        content = inside or not is_template(group, along)
        place = 0
        inline = tag in _INLINE
        if not inline:
            end_block()
        for part in group.parts:
            if isinstance(part, str):
                if content:
                    run.append(part)
            elif not part.dropped:
                child = None
                if along is not None:
                    k = place
                    while k < len(along.children) and along.children[k].name != part.name:
                        k += 1
                    if k < len(along.children):
                        child, place = along.children[k], k
                walk(part, child, inside)
            else:
                end_block()
        if not inline:
            end_block()

    walk(page, wrapper, False)
    return "\n".join(blocks)


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)), F.lit(""))


def _dump(wrapper: Group) -> str:
    return json.dumps(wrapper.dump(), separators=(",", ":"), ensure_ascii=False)


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper) over all pages (host, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Group] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([_dump(w) for w in found.values()], pa.string())], names=["host", "wrapper"])
            found.clear()
            return out

        for batch in batches:
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if source:
                    page = _settle(read_page(source))
                    found[host] = align(found[host], page) if host in found else page
                    if len(found) > TASK_HOSTS:
                        yield flush()
        if found:
            yield flush()

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        wrappers = sorted(set(pdf["wrapper"]))
        merged = Group.load(json.loads(wrappers[0]))
        for text in wrappers[1:]:
            merged = align(merged, Group.load(json.loads(text)))
        return pd.DataFrame({"host": [key[0]], "wrapper": [_dump(merged)]})

    parts = map_batches(pages.select("host", F.col("html").cast("string")), run, "host string, wrapper string")
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)))
    by_salt = salted.groupBy("host", "salt").applyInPandas(merge, "host string, wrapper string")
    return by_salt.groupBy("host").applyInPandas(merge, "host string, wrapper string")


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html)."""
    pages = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), "html")
    wrappers = written(infer_wrappers(pages), "wrappers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded: dict[str, Group] = {}
        for batch in batches:
            texts = []
            for source, wrapper in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if wrapper and wrapper not in loaded:
                    if len(loaded) > 1_000:
                        loaded.clear()
                    loaded[wrapper] = Group.load(json.loads(wrapper))
                texts.append(extract(read_page(source), loaded.get(wrapper)) if source else "")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    # wrappers are a written table: Spark broadcasts it when its files are small and shuffles both sides when not
    along = pages.join(wrappers, "host", "left").select("page_id", "url", F.col("html").cast("string").alias("html"), "wrapper")
    return map_batches(along, run, "page_id bigint, url string, text string, n_chars bigint")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(read_table(spark, sf_dir, "pages"))

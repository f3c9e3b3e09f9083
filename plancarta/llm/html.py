"""HTML extraction: page structure, and a suffix array per host for all that structure leaves open.

A page's elements are read in order. Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments are dropped where an element or role says so, or the whole name of a container's class or id does
(`comment-list`, but not `share-price`). Where the page marks its article (`article`, else `main`), its text is the main
text, and what stands in `main` beside an article inside it is open. Open too are containers inside an article that have a
class or id of any name and less than half of its text, and everything on a page that marks nothing.

Open blocks that follow each other in one container are a unit. The units of a host are cut into tokens and concatenated,
a suffix array, built by doubling, finds the substrings of RUN tokens or more that repeat on distinct pages, and covered
text goes: inside an article a block that is covered whole, elsewhere the covered tokens, so that the unique runs stay.
Repetition alone can't decide for what an article plainly holds: pages share passages inside articles, and menus and
adverts that occur once are no less boilerplate.

Equal units of a host's pages are one, and covered whole. A host of over SHARD tokens is cut into
shards: each window of RUN tokens goes to the shard of its smallest inner hash, so equal windows meet, and neighbours
mostly travel as one piece. Pages with the same open units count as one page.

Defined cases: null or empty html gives an empty text; a null url is a host of its own; open elements end with their
parent or the page; repeated rows each get a row; null ids are allowed; an empty table gives no rows; other columns are
not read. `br` and table cells are white space inside a block; rows, list items and headings are blocks.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import grams, raw, rows_of, ship, store

RUN, SHARD = 8, 1_000_000

# fixed values: elements of HTML, and usual names of a page's parts
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "noscript", "template", "xmp"}
DROPPED = {"head", "nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "svg", "canvas", "object", "audio", "video", "math"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul"}
SPACES = {"br", "td", "th", "img", "wbr"}
ROLES = {"alert", "alertdialog", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "menubar", "navigation", "search", "toolbar"}
NAMES = {"ad", "ads", "adbox", "advert", "advertisement", "advertising", "adverts", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "consent", "cookie", "cookies", "copyright", "disqus", "footer", "gdpr", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "overlay", "pager", "pagination", "popup", "promo", "promoted", "promotion", "recommended", "related", "replies", "respond", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "subscription", "toolbar", "topbar", "widget", "widgets"}
#: What else the name of such a part may hold.
PARTS = {"area", "article", "articles", "bar", "block", "body", "bottom", "box", "btn", "button", "buttons", "card", "center", "col", "container", "content", "form", "global", "group", "header", "icon", "icons", "inner", "item", "items", "js", "label", "left", "link", "links", "list", "main", "media", "message", "more", "news", "outer", "page", "post", "posts", "reader", "readers", "right", "row", "section", "side", "site", "slot", "sticky", "stories", "story", "text", "thread", "title", "top", "unit", "user", "users", "wrap", "wrapper", "x"}
#: Start tags that end an open element of these names, up to a container.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CONTAINERS = {"ul", "ol", "dl", "table", "select", "article", "section", "div", "body", "main", "nav", "aside", "footer", "header", "form"}
#: Containers whose class or id may name a part.
NAMED = CONTAINERS - {"article", "body", "main"} | {"figure", "details", "p", "li", "fieldset", "center", "iframe"}

_TAG = re.compile(r"""<!--(?:.*?-->|.*\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']|"[^"]*"|'[^']*')*+|[^>]*)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|([^\s=/"'>]+)""")
_NOT = {"no", "has", "with", "without", "is"}


def _names_part(value: str) -> bool:
    """Whether a word of a class or id is the name of a part, as a whole."""
    for word in value.split():
        parts = [x for x in re.split(r"[^a-z]+", word) if x]
        if parts and parts[0] not in _NOT and any(x in NAMES for x in parts) and all(x in NAMES or x in PARTS for x in parts):
            return True
    return False


def _seen(name: str, attributes: str, marked: bool) -> tuple[bool, bool, bool]:
    """Whether an element is a part that doesn't belong to the main text, is a container with a class or id, and has the
    role of main. marked: inside an article or main."""
    drop = name in DROPPED or name == "header" and not marked
    if drop or not attributes:
        return drop, False, False
    labelled = main = False
    for key, value, lone in _ATTRIBUTE.findall(attributes):
        key = (key or lone).lower()
        value = value.strip("\"'").lower()
        if name not in ("html", "body") and (key == "hidden" or key == "role" and value in ROLES):
            return True, False, False
        main |= key == "role" and value == "main"
        if key in ("class", "id") and name in NAMED:
            if _names_part(value):
                return True, False, False
            labelled |= name in CONTAINERS
    return False, labelled, main


#: How a block is judged: kept, dropped if covered whole, or without its covered tokens.
KEPT, WHOLE, TOKENS = 0, 1, 2


def blocks(page: str) -> list[tuple[int, int, str]]:
    """How to judge, the container, and the text of each block that structure doesn't drop."""
    # open elements: name, whether it begins something dropped, an article or main, and its own number as a container
    stack: list[tuple[str, bool, str, int]] = []
    opened: Counter = Counter()
    drop, made = 0, 0
    inside = {"article": 0, "main": 0}
    labels, holders = [0], [0]  # of open elements: labelled ones inside an article, and containers
    found: list[tuple[bool, bool, int, int, str]] = []
    here: list[str] = []

    def end() -> None:
        if here:
            text = " ".join(entities.unescape("".join(here)).split())
            here.clear()
            if text:
                found.append((inside["article"] > 0, inside["main"] > 0, labels[-1], holders[-1], text))

    def pop() -> None:
        nonlocal drop
        name, dropped, kind, number = stack.pop()
        opened[name] -= 1
        if name in BLOCKS or kind:
            end()
        drop -= dropped
        if kind:
            inside[kind] -= 1
        if number:
            holders.pop()
            if labels[-1] == number:
                labels.pop()

    at, size = 0, len(page)
    while at < size:
        m = _TAG.search(page, at)
        if not drop:
            here.append(page[at : m.start() if m else size])
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            if opened[name]:
                while stack[-1][0] != name:
                    pop()
                pop()
            elif name in BLOCKS:
                end()
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = close.end() if close else size
            if not drop:
                here.append(" " * (name not in ("script", "style", "template")))
            continue
        if name in ENDS:
            k = len(stack) - 1
            while k >= 0 and any(opened[x] for x in ENDS[name]) and stack[k][0] not in CONTAINERS:
                if stack[k][0] in ENDS[name]:
                    while len(stack) > k:
                        pop()
                k -= 1
        if name in BLOCKS:
            while opened["p"]:  # no container can be open inside it
                pop()
            end()
        elif name in SPACES and not drop:
            here.append(" ")
        if name in VOID or m[3].endswith("/") and name not in BLOCKS:
            continue
        dropped, labelled, main = _seen(name, m[3], bool(inside["article"] or inside["main"]))
        kind = "" if drop or dropped else "article" if name == "article" else "main" if name == "main" or main else ""
        number = 0
        if name in CONTAINERS:
            made += 1
            number = made
            holders.append(number)
            if labelled and inside["article"] and not dropped:
                labels.append(number)
        stack.append((name, dropped, kind, number))
        opened[name] += 1
        drop += dropped
        if kind:
            inside[kind] += 1
    while stack:
        pop()
    end()
    return _judged(found)


def _judged(found: list[tuple[bool, bool, int, int, str]]) -> list[tuple[int, int, str]]:
    article = [x for x in found if x[0]]
    if not article:
        main = [x for x in found if x[1]]
        return [(KEPT, 0, x[4]) for x in main] or [(TOKENS, x[3], x[4]) for x in found]
    by: Counter = Counter()
    for x in article:
        by[x[2]] += len(x[4])
    half = sum(by.values()) / 2
    within = any(x[1] for x in article)
    return [(WHOLE if x[2] and by[x[2]] < half else KEPT, x[2], x[4]) if x[0] else (TOKENS, -x[3], x[4]) for x in found if x[0] or within and x[1]]


_UNITS = pa.list_(pa.struct([("judge", pa.int32()), ("text", pa.string())]))
_PAGE = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("open", _UNITS)])
BREAK = "\n\n"


def units(page: str) -> list[dict]:
    """Blocks that follow each other in one container and are judged alike, as one text."""
    out: list[dict] = []
    last = None
    for judge, container, text in blocks(page):
        if (judge, container) == last:
            out[-1]["text"] += BREAK + text
        else:
            out.append({"judge": judge, "text": text})
            last = judge, container
    return out


def _parse(batches):
    for b in batches:
        texts, opens = [], []
        for page in raw(b.column(2)):
            found = units(page.decode())
            sure = all(u["judge"] == KEPT for u in found)
            texts.append(BREAK.join(u["text"] for u in found) if sure else None)
            opens.append(None if sure else found)
        yield rows_of(_PAGE, page_id=b.column(0), url=b.column(1), text=texts, open=opens)


def left_of(unit: str, judge: int, covered: set[int]) -> str:
    """A unit's blocks without what is covered, the places of its tokens being counted over all of it."""
    at, kept = 0, []
    for block in unit.split(BREAK):
        words = block.split(" ")
        left = [w for i, w in enumerate(words, at) if i not in covered]
        at += len(words)
        if left:
            kept.append(block if judge == WHOLE else " ".join(left))
    return BREAK.join(kept)


def repeated(tokens: np.ndarray, page: np.ndarray, size: int) -> np.ndarray:
    """Which tokens lie in a substring of size tokens that also starts on another page, by a suffix array.

    tokens: ids, a separator's being its own each time; page: each token's page, of separators -1.
    """
    n = len(tokens)
    rank, length = np.unique(tokens, return_inverse=True)[1].astype(np.int64), 1
    while length < size:
        step = min(length, size - length)
        later = np.full(n, -1, np.int64)
        later[: n - step] = rank[step:]
        order = np.lexsort((later, rank))  # the suffix array, by the first length + step tokens
        new = np.r_[0, np.cumsum((rank[order][1:] != rank[order][:-1]) | (later[order][1:] != later[order][:-1]))] if n else rank
        rank = np.empty(n, np.int64)
        rank[order] = new
        length += step
    order = np.lexsort((page, rank))
    r, p = rank[order], page[order]
    first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if n else np.zeros(0, np.int64)
    last = np.r_[first[1:], n] - 1
    several = np.repeat(p[first] != p[last], last - first + 1) if n else np.zeros(0, bool)
    hit = np.zeros(n + 1, np.int64)
    starts = order[several]
    np.add.at(hit, starts, 1)
    np.add.at(hit, np.minimum(starts + size, n), -1)
    return np.cumsum(hit[:-1]) > 0


_PIECE = pa.schema([("host", pa.string()), ("shard", pa.int32()), ("key", pa.int64()), ("page", pa.int64()), ("start", pa.int32()), ("tokens", pa.list_(pa.int64()))])


def _pieces(run: int):
    """A block whole, or for hosts of several shards in pieces by shard."""

    def cut(batches):
        for b in batches:
            out: dict[str, list] = {f.name: [] for f in _PIECE}
            for host, shards, key, page, text in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                h = np.array([xxhash.xxh3_64_intdigest(w) for w in text.encode().split()], np.uint64)
                if len(h) < run:
                    continue
                if shards == 1:
                    parts = [(0, 0, len(h))]
                else:
                    g = grams(h, run // 2)
                    low = np.lib.stride_tricks.sliding_window_view(g, run - run // 2 + 1).min(axis=1)
                    shard = (low % np.uint64(shards)).astype(np.int64)
                    begin = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
                    parts = [(int(shard[i]), int(i), int(j) + run - 1) for i, j in zip(begin, np.r_[begin[1:], len(shard)], strict=True)]
                for shard, i, j in parts:
                    for name, v in zip(out, (host, shard, key, page, i, h[i:j].view(np.int64)), strict=True):
                        out[name].append(v)
            yield rows_of(_PIECE, **out)

    return cut


_COVER = pa.schema([("host", pa.string()), ("key", pa.int64()), ("covered", pa.list_(pa.int32()))])


def _suffixes(run: int):
    def find(group):
        lists = group["tokens"].combine_chunks()
        sizes = lists.value_lengths().to_numpy().astype(np.int64)
        ends = np.cumsum(sizes + 1)
        begins = ends - sizes - 1
        tokens = np.zeros(int(ends[-1]), np.int64)
        page = np.full(len(tokens), -1, np.int64)
        is_token = np.ones(len(tokens), bool)
        is_token[ends - 1] = False
        ids = np.unique(lists.flatten().to_numpy(zero_copy_only=False), return_inverse=True)[1]
        tokens[is_token] = ids
        tokens[ends - 1] = len(tokens) + np.arange(len(ends))
        page[is_token] = np.repeat(np.unique(group["page"].to_numpy(), return_inverse=True)[1], sizes)
        hit = repeated(tokens, page, run)
        # a window that runs over a separator is its own, so it hits nothing
        start = group["start"].to_numpy()
        covered = [(np.flatnonzero(hit[a : e - 1]) + s).astype(np.int32) for a, e, s in zip(begins, ends, start, strict=True)]
        return pa.table({"host": group["host"], "key": group["key"], "covered": pa.array(covered, pa.list_(pa.int32()))}, schema=_COVER)

    return find


_LEFT = pa.schema([("p", pa.int64()), ("place", pa.int32()), ("kept", pa.string())])


def _left(run: int):
    def find(batches):
        for b in batches:
            kept = []
            for judge, text, whole, covered in zip(*(b.column(i).to_pylist() for i in range(2, 6)), strict=True):
                n = len(text.split())
                kept.append(text if judge == KEPT else left_of(text, judge, {*range(n)} if whole and n >= run else {*(covered or ())}))
            yield rows_of(_LEFT, p=b.column(0), place=b.column(1), kept=kept)

    return find


def _unique_runs(open_pages: DataFrame, run: int, shard: int) -> DataFrame:
    """p, place, kept: what is left of each unit of open_pages (p, host, open)."""
    one = open_pages.select("p", "host", F.xxhash64("open").alias("page"), F.posexplode("open").alias("place", "unit")).select("p", "host", "page", "place", "unit.judge", "unit.text")
    one = store(one.withColumn("key", F.xxhash64("host", "text")), "units")
    apart = one.where(F.col("judge") != KEPT).groupBy("host", "key").agg(F.min("page").alias("page"), F.max("page").alias("other"), F.first("text").alias("text"))
    apart = store(apart, "apart")
    words = F.size(F.split("text", r"\s+"))
    hosts = store(apart.groupBy("host").agg(F.ceil(F.sum(words) / shard).cast("int").alias("shards")), "hosts")
    known = apart.join(hosts, apart.host.eqNullSafe(hosts.host)).select(apart.host, "shards", "key", "page", "text")
    pieces = known.mapInArrow(_pieces(run), "host string, shard int, key long, page long, start int, tokens array<long>")
    cover = pieces.groupBy("host", "shard").applyInArrow(_suffixes(run), "host string, key long, covered array<int>")
    cover = store(cover.where(F.size("covered") > 0).groupBy("host", "key").agg(F.array_distinct(F.flatten(F.collect_list("covered"))).alias("covered")), "cover")
    said = apart.alias("a").join(cover.alias("c"), F.col("a.host").eqNullSafe(F.col("c.host")) & (F.col("a.key") == F.col("c.key")), "left")
    said = store(said.select(F.col("a.key").alias("key"), (F.col("page") != F.col("other")).alias("whole"), "covered"), "said")
    rows = one.join(said, "key", "left").select("p", "place", "judge", "text", F.coalesce("whole", F.lit(False)).alias("whole"), "covered")
    return rows.mapInArrow(_left(run), "p long, place int, kept string")


def host(url: str):
    return F.lower(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)", 1))


def extract(pages: DataFrame, run: int = RUN, shard: int = SHARD) -> DataFrame:
    """page_id, url, text and n_chars of each row of pages (page_id, url, html)."""
    ship(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    read = store(rows.mapInArrow(_parse, "page_id long, url string, text string, open array<struct<judge: int, text: string>>"), "read")
    done = read.where("open is null").select("page_id", "url", "text")
    # rows alike get the same text, so they share a number
    left = read.where("open is not null").withColumn("p", F.xxhash64("page_id", "url", "open")).withColumn("host", host("url"))
    if not read.where("open is not null").limit(1).count():
        return done.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
    runs = _unique_runs(left.dropDuplicates(["p"]), run, shard).where("kept <> ''")
    joined = runs.groupBy("p").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "kept"))), lambda x: x.kept), "\n\n").alias("text"))
    rest = left.drop("text").join(joined, "p", "left").select("page_id", "url", F.coalesce("text", F.lit("")).alias("text"))
    return done.unionByName(rest).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))

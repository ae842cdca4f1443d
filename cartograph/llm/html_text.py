"""Main text of HTML pages: markup regions, then nearest-URL page differencing.

Each page is cut into blocks (lines of text). Markup tells chrome (menus, headers, footers, sidebars, notices, adverts,
forms, comments) from the article; what it leaves open is judged by differencing, on pages with an article too. Pages
with open lines are ordered by host and path; of its two neighbours within the host a page is paired with the one that shares the longer prefix of path segments
(then of characters). The open lines of a pair are aligned by longest common subsequence, and shared lines, the site's
template, are deleted, unless they are most of either page: then the pair are copies of each other and nothing goes.
Lines of a marked article are never template, so that passages which articles share stay; they count as text of a pair
that may be copies. What is left of the open lines stands where it stood among the article's.

Neighbours come from a range partitioning by (host, path), which deals a host with a third of all rows over many tasks;
rows at the edges of partitions meet over a table of one row per partition.

Cases: a null or empty html gives an empty text; a null URL belongs to the empty host; repeated rows are pages of their
own; broken and unclosed markup is read as far as it goes; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .url_rules import split_url

MAIN, OPEN, CHROME = 0, 1, 2
#: Shared lines that are more than this part of a page's text make the pair copies, not pages of one template.
COPY_SHARE = 0.7

# Fixed names of HTML elements.
SKIP = {"script", "style", "noscript", "template", "iframe", "svg", "math", "object", "textarea", "select", "button", "canvas", "audio", "video", "head"}
CHROME_TAGS = {"nav", "footer", "aside", "form", "dialog", "menu"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option",
    "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul",
}
#: Words in class, id or role that mark chrome.
CHROME_WORDS = {
    "ad", "ads", "advert", "advertisement", "adverts", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary", "consent",
    "contentinfo", "cookie", "cookies", "disqus", "footer", "gdpr", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice",
    "pagination", "popup", "promo", "related", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}

_ATTR = re.compile(r"""(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_SPACE = re.compile(r"\s+")


def _tag_end(page: str, at: int) -> int:
    """Past the > that ends the tag at ``at``; quoted values may hold one."""
    quick = page.find(">", at)
    if quick < 0:
        return len(page)
    tag = page[at:quick]
    if tag.count('"') % 2 == 0 and tag.count("'") % 2 == 0:
        return quick + 1
    i, n = at, len(page)
    while i < n:
        c = page[i]
        if c == ">":
            return i + 1
        if c == "=":
            m = re.compile(r"\s*([\"'])").match(page, i + 1)
            if m:
                close = page.find(m[1], m.end())
                if close < 0:
                    return quick + 1
                i = close
        i += 1
    return quick + 1


def blocks(page: str | None) -> list[tuple[str, int]]:
    """(line, MAIN, OPEN or CHROME) of a page in order; white space in a line is one space, empty lines are left out."""
    if not page:
        return []
    out: list[tuple[str, int]] = []
    text: list[str] = []
    stack: list[tuple[str, int]] = []  # open elements and the kind that they give their content
    kind = OPEN

    def flush() -> None:
        if text:
            line = _SPACE.sub(" ", entities.unescape("".join(text))).strip()
            if line:
                out.append((line, kind))
            text.clear()

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            text.append(page[at:])
            break
        if lt > at:
            text.append(page[at:lt])
        following = page[lt + 1 : lt + 2]
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if following in ("!", "?"):
            at = _tag_end(page, lt)
            continue
        closing = following == "/"
        m = _NAME.match(page, lt + 1 + closing)
        if not m:
            text.append("<")
            at = lt + 1
            continue
        name, end = m[0].lower(), _tag_end(page, lt)
        if closing:
            if name in BLOCK:
                flush()
            elif name == "br":
                text.append(" ")
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    flush() if name not in BLOCK and stack[k][1] != (stack[k - 1][1] if k else OPEN) else None
                    del stack[k:]
                    kind = stack[-1][1] if stack else OPEN
                    break
            at = end
            continue
        if name in SKIP and page[end - 2 : end - 1] != "/":
            if name == "head":
                close = re.compile(r"</head\s*>|<body\b", re.I).search(page, end)
                at = end if not close else (close.end() if close[0].startswith("</") else close.start())
            else:
                close = re.compile(rf"</{name}\s*>", re.I).search(page, end)
                at = close.end() if close else (n if name in ("script", "style", "textarea") else end)
            if name in ("object", "iframe"):
                flush()
            continue
        if name in BLOCK:
            flush()
            if name == "p" and stack and stack[-1][0] == "p":
                stack.pop()
                kind = stack[-1][1] if stack else OPEN
        elif name in ("br", "wbr", "hr"):
            text.append(" " if name != "wbr" else "")
        if name not in VOID and page[end - 2 : end - 1] != "/":
            new = kind
            if kind != CHROME:
                attrs = page[m.end() : end - 1]
                found = {a[1].lower(): (a[2] or a[3] or a[4] or "") for a in _ATTR.finditer(attrs)} if attrs.strip() else {}
                marks = set(re.split(r"[\s_-]+", " ".join(found.get(k, "") for k in ("class", "id", "role")).lower()))
                if name in CHROME_TAGS or (name == "header" and kind != MAIN) or (marks & CHROME_WORDS and name not in ("body", "html", "article", "main")) or "hidden" in found or found.get("aria-hidden", "").lower() == "true":
                    new = CHROME
                elif name in ("article", "main") or found.get("role", "").lower() in ("main", "article") or found.get("itemprop", "").lower() == "articlebody":
                    new = MAIN
            if new != kind and name not in BLOCK:
                flush()
            if new != kind or name in BLOCK:
                stack.append((name, new))
                kind = new
        at = end
    flush()
    return out


def common_lines(a: list[str], b: list[str]) -> list[bool]:
    """Which lines of ``a`` a longest common subsequence with ``b`` keeps. Bit-parallel: a row is one integer."""
    keep = [False] * len(a)
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        keep[lo] = True
        lo += 1
    ea, eb = len(a), len(b)
    while ea > lo and eb > lo and a[ea - 1] == b[eb - 1]:
        ea, eb = ea - 1, eb - 1
        keep[ea] = True
    both = set(a[lo:ea]) & set(b[lo:eb])  # other lines are in no common subsequence
    ia = [i for i in range(lo, ea) if a[i] in both]
    right = [x for x in b[lo:eb] if x in both]
    where: dict[str, int] = {}
    for j, x in enumerate(right):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(right)) - 1
    v, rows = full, [full]
    for i in ia:
        u = v & where[a[i]]
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    # zero bits of row i mark where the length of the subsequence of the first i lines grows
    j = len(right)
    for k in range(len(ia), 0, -1):
        below = (1 << j) - 1
        grown, before = ~rows[k] & below, ~rows[k - 1] & below
        if grown.bit_count() > before.bit_count():
            keep[ia[k - 1]] = True
            j = (where[a[ia[k - 1]]] & ((1 << (grown.bit_length())) - 1)).bit_length() - 1
    return keep


def _shared_prefix(a: str, b: str) -> tuple[int, int]:
    n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[:n].count("/"), n


def template_lines(own: list[str], partner: list[str], marked: list[int] = [], theirs: list[int] = []) -> list[bool]:  # noqa: B006
    """Open lines of a page to delete: those shared with its partner, unless the two are copies. ``marked`` and ``theirs``
    are the ``_mark`` of the lines of their articles."""
    keep = common_lines(own, partner)
    shared = sum(len(x) for x, k in zip(own, keep, strict=True) if k) + _length((Counter(marked) & Counter(theirs)).elements())
    if shared > COPY_SHARE * min(sum(map(len, own)) + _length(marked), sum(map(len, partner)) + _length(theirs)):
        return [False] * len(own)
    return keep


def _mark(line: str) -> int:
    """A line as 40 bits of hash and 23 of its length."""
    import xxhash

    return xxhash.xxh64_intdigest(line) >> 24 << 23 | min(len(line), (1 << 23) - 1)


def _length(marks) -> int:
    return sum(m & ((1 << 23) - 1) for m in marks)


def neighbours(pages: DataFrame) -> DataFrame:
    """(rid, partner) over materialized (rid, host, path): the nearest neighbour by path within the host."""
    n = max(pages.rdd.getNumPartitions(), pages.sparkSession.sparkContext.defaultParallelism)
    r = pages.select("rid", "host", "path").repartitionByRange(n, "host", "path", "rid").withColumn("part", F.spark_partition_id())
    r = materialize(r)
    at = F.struct("host", "path", "rid")
    edge = r.groupBy("part").agg(F.min(at).alias("low"), F.max(at).alias("high"))  # one row per partition
    over = Window.orderBy("part")
    edge = materialize(edge.select("part", F.lag("high").over(over).alias("before"), F.lead("low").over(over).alias("after")), partitions=1)
    w = Window.partitionBy("part").orderBy("host", "path", "rid")
    r = r.select("rid", "host", "path", "part", F.lag(at).over(w).alias("prev"), F.lead(at).over(w).alias("next")).join(F.broadcast(edge), "part")
    r = r.withColumn("prev", F.coalesce("prev", "before")).withColumn("next", F.coalesce("next", "after"))
    for side in ("prev", "next"):
        r = r.withColumn(side, F.when(F.col(f"{side}.host") == F.col("host"), F.col(side)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for rid, path, p, q in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                best = max((x for x in (p, q) if x), key=lambda x: (_shared_prefix(path, x["path"]), x["path"] == path, -x["rid"]), default=None)
                rows.append((rid, best["rid"] if best else None))
            cols = list(zip(*rows, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["rid", "partner"])

    return r.select("rid", "path", "prev", "next").mapInArrow(run, "rid long, partner long")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row of ``pages``: page_id, url, text, n_chars."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 36
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int64())]
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                rows = []
                for page, url, doc in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    found = blocks(doc)
                    main = [x for x, k in found if k == MAIN]
                    host, path = split_url(url)
                    open_, at, before = [], [], 0
                    for x, k in found:
                        before += k == MAIN
                        if k == OPEN:
                            open_.append(x)
                            at.append(before)
                    rows.append((rid, page, url, host, path, main, open_, at, [_mark(x) for x in main] if open_ else []))
                    rid += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["rid", "page_id", "url", "host", "path", "main", "open", "at", "marks"])

    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    p = materialize(p.mapInArrow(parse, "rid long, page_id long, url string, host string, path string, main array<string>, open array<string>, at array<int>, marks array<bigint>"))
    some = p.where(F.size("open") > 0)
    other = some.select(F.col("rid").alias("partner"), F.col("open").alias("theirs"), F.col("marks").alias("their_marks"))
    mine = some.select("rid", "open", "at", "marks").join(neighbours(some), "rid").join(other, "partner", "left")

    def difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line = pa.struct([("at", pa.int32()), ("main", pa.int32()), ("n", pa.int32()), ("line", pa.string())])
        for batch in batches:
            left = []
            for own, at, marks, theirs, their_marks in zip(*(batch.column(i).to_pylist() for i in range(1, 6)), strict=True):
                gone = template_lines(own, theirs or [], marks, their_marks or [])
                left.append([{"at": k, "main": 0, "n": n, "line": x} for n, (x, k, g) in enumerate(zip(own, at, gone, strict=True)) if not g])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(left, pa.list_(line))], ["rid", "left"])

    rest = mine.select("rid", "open", "at", "marks", "theirs", "their_marks").mapInArrow(difference, "rid long, left array<struct<at:int,main:int,n:int,line:string>>")
    # only pages with open lines meet them again; the others' text is not shuffled
    marked = p.where(F.size("open") == 0).select("page_id", "url", F.array_join("main", "\n").alias("text"))
    # an open line with k lines of the article before it comes before the article's line k
    article = F.transform("main", lambda x, i: F.struct(i.alias("at"), F.lit(1).alias("main"), F.lit(0).alias("n"), x.alias("line")))
    lines = F.transform(F.array_sort(F.concat(article, F.col("left"))), lambda x: x["line"])
    others = some.select("rid", "page_id", "url", "main").join(rest, "rid").select("page_id", "url", F.array_join(lines, "\n").alias("text"))
    out = marked.unionByName(others)
    return out.withColumn("n_chars", F.length("text").cast("long"))

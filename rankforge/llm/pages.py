"""Main text of web pages by differencing against the page with the nearest URL.

Pages are sorted by URL path within each host, so the page with the longest
common path is a neighbour.  The lines of both are aligned by their longest
common subsequence; shared lines are the site's template and go.

Two rules keep this right where plain differencing is wrong:

* Menus, adverts and footers often rotate their texts.  Lines inside such
  markup are compared by their place in the template instead of their text
  and go with it; a page without a neighbour loses them by markup alone.
* Copies of an article would delete each other.  Pages with equal lines are
  compared as one page; a neighbour that shares 0.8 of the characters that
  could go is a near copy and deletes nothing.  Pages that mark no article
  keep what is left of ``main``, or else of the body.

Every page is aligned with both neighbours, also one that marks its article.
There a line shared with one neighbour may be a quotation, so it goes only if
three pages in a row share it, and an article that shares half of its
characters is another version of the neighbour's and loses nothing.

Defined results: null html gives empty text, a null URL is host and path ""; a
page alone on its host is judged by markup; repeated rows each give a row; an
unclosed tag, comment or script reaches to the end of its parent or of the
page; long pages are read whole; an empty table gives none; extra columns are
not read.  Cells of a table row and line breaks are white space, other blocks
are lines.
"""

from __future__ import annotations

import html as markup
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, sliced, stored

NEAR_COPY = 0.8
VERSION = 0.5  #: of an article's characters
ARTICLE, FURNITURE, OPEN = 0, 1, 2

# Element names and class words.
RAW = ("script", "style", "title", "textarea", "template", "noscript", "iframe", "svg", "object", "xmp")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption",
          "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "li", "main", "menu", "nav", "ol", "option",
          "p", "pre", "search", "section", "select", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul"}
FURNISHING = {"aside", "button", "dialog", "footer", "form", "head", "menu", "nav", "search", "select"}
ROLES = {"alert", "alertdialog", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "menubar", "navigation", "search", "toolbar"}
STRONG = {"ad", "ads", "advert", "adverts", "advertisement", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies",
          "disqus", "footer", "gdpr", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "pagination", "popup", "promo", "related",
          "replies", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar"}
WEAK = {"banner", "copyright", "disclaimer", "header", "masthead", "notice", "notices", "recommended", "widget"}
CONTENT = {"article", "body", "content", "entry", "main", "post", "story", "text"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)>", re.S)
_CLOSE_RAW = {n: re.compile(rf"</{n}\b[^>]*>", re.I) for n in RAW}
_NAMES = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORD = re.compile(r"[A-Za-z0-9]+")


def _furnishes(name: str, attributes: str, in_article: bool) -> bool:
    """Whether an element holds furniture, by its name, role and class words."""
    if name in FURNISHING or name == "header" and not in_article:
        return True
    if not attributes or name in ("html", "body"):
        return False
    said: set[str] = set()
    for m in _NAMES.finditer(attributes):
        key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
            return True
        if key == "role" and value in ROLES:
            return True
        if key in ("class", "id"):
            said.update(_WORD.findall(value))
    return bool(said & STRONG) and name != "main" or bool(said & WEAK) and not said & CONTENT and name not in ("main", "article")


def blocks(page: str) -> list[tuple[str, int, str]]:
    """(text, zone, template place) of the non-empty blocks of a page, in page order."""
    out: list[tuple[str, int, str]] = []
    stack: list[tuple[str, str, bool]] = []  # name, place of furniture or "", zone starts here
    buffer: list[str] = []
    articles = mains = 0
    place = ""

    def flush() -> None:
        text = " ".join(markup.unescape("".join(buffer)).split())
        buffer.clear()
        if text:
            zone = FURNITURE if place else ARTICLE if articles else OPEN
            out.append((text, zone, place or ("main" if mains else "")))

    def leave(depth: int) -> None:
        nonlocal articles, mains, place
        while len(stack) > depth:
            name, _, _ = stack.pop()
            articles -= name == "article"
            mains -= name == "main"
        place = stack[-1][1] if stack else ""

    at = 0
    while m := _TOKEN.search(page, at):
        buffer.append(page[at:m.start()])
        at, name = m.end(), (m[2] or "").lower()
        if not name:
            continue
        if name in _CLOSE_RAW and not m[1]:
            end = _CLOSE_RAW[name].search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in BLOCKS:
            flush()
        elif name in ("br", "td", "th"):
            buffer.append(" ")
        if name in VOID or name == "p":
            continue
        if m[1]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if depth is not None:
                leave(depth)
            continue
        new = _furnishes(name, m[3], articles > 0)
        if new and name not in BLOCKS:
            flush()
        if name not in BLOCKS and not new:
            continue  # inline markup
        stack.append((name, place or (f"{'/'.join(s[0] for s in stack)}/{name}{m[3]}" if new else ""), new))
        articles += name == "article"
        mains += name == "main"
        place = stack[-1][1]
    buffer.append(page[at:])
    flush()
    return out


def _judged(page: str) -> tuple[bool, list[str], list[int], list[int], list[int]]:
    """Whether the page marks an article; the lines that differencing decides
    on; the line keys of the whole page, their lengths, and which keys are of
    deciding lines."""
    found = blocks(page)
    keys = [xxhash.xxh64_intdigest(f"{zone == FURNITURE}{spot}" if zone == FURNITURE else f"t{text}") - (1 << 63) for text, zone, spot in found]
    size = [len(t) for t, _, _ in found]
    at = [i for i, (_, zone, _) in enumerate(found) if zone == ARTICLE]
    marked = bool(at)
    if not marked:
        wanted = "main" if any(zone == OPEN and spot for _, zone, spot in found) else ""
        at = [i for i, (_, zone, spot) in enumerate(found) if zone == OPEN and spot == wanted]
    return marked, [found[i][0] for i in at], keys, size, at


def _address(url: str | None) -> tuple[str, str]:
    """Host and path; the path without a closing slash or file ending."""
    try:
        parts = urlsplit(url or "")
        return (parts.netloc.rpartition("@")[2].lower(), re.sub(r"(?:/|/index\.\w+|\.\w+)$", "", parts.path))
    except ValueError:
        return "", url or ""


_PARSED = ("page_id long, url string, host string, path string, marked boolean, lines array<string>, keys array<long>, sizes array<int>, "
           "open array<int>, sig long")


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, urls, at = batch.column(0), batch.column(1).to_pylist(), 0
        for texts in sliced(batch.column(2), 1 << 21):
            rows = [_judged(t or "") for t in texts]
            homes = [_address(u) for u in urls[at:at + len(texts)]]
            sig = [xxhash.xxh64_intdigest(repr((k, o))) - (1 << 63) for _, _, k, _, o in rows]
            yield pa.RecordBatch.from_arrays(
                [ids.slice(at, len(texts)), batch.column(1).slice(at, len(texts)), pa.array([h for h, _ in homes]), pa.array([p for _, p in homes]),
                 pa.array([r[0] for r in rows], pa.bool_()), pa.array([r[1] for r in rows], pa.list_(pa.string())),
                 pa.array([r[2] for r in rows], pa.list_(pa.int64())), pa.array([r[3] for r in rows], pa.list_(pa.int32())),
                 pa.array([r[4] for r in rows], pa.list_(pa.int32())), pa.array(sig, pa.int64())],
                ["page_id", "url", "host", "path", "marked", "lines", "keys", "sizes", "open", "sig"])
            at += len(texts)


def common_lines(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Index pairs of one longest common subsequence.

    Bit-parallel: a row of the table is one integer.  Only every s-th row is
    kept (s about the root of the number of rows) and the rows between are
    computed again on the way back, so memory stays at some 2 s rows.
    """
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head:len(a) - tail], b[head:len(b) - tail]
    masks: dict[int, int] = {}
    for j, v in enumerate(y):
        masks[v] = masks.get(v, 0) | 1 << j
    full = (1 << len(y)) - 1

    def step(row: int, v: int) -> int:
        u = row & masks.get(v, 0)
        return (row + u | row - u) & full

    every = max(1, int(len(x) ** 0.5))
    kept, row = [full], full
    for i, v in enumerate(x, 1):
        row = step(row, v)
        if i % every == 0:
            kept.append(row)
    middle: list[tuple[int, int]] = []
    j = len(y)
    for block in range(len(x) // every, -1, -1):
        rows = [kept[block]]
        for v in x[block * every:(block + 1) * every]:
            rows.append(step(rows[-1], v))
        i = len(rows) - 1
        while i and j:
            if rows[i] >> (j - 1) & 1:
                j -= 1  # column j adds nothing
            elif _ones(rows[i - 1], j) == _ones(rows[i], j):
                i -= 1  # row i adds nothing
            else:
                middle.append((head + block * every + i - 1, head + j - 1))
                i, j = i - 1, j - 1
    return [*((i, i) for i in range(head)), *reversed(middle), *((len(a) - t, len(b) - t) for t in range(tail, 0, -1))]


def _ones(row: int, width: int) -> int:
    return (row & (1 << width) - 1).bit_count()


_PAGE = ("host", "sig", "marked", "keys", "sizes", "open")
_SHARED = "host string, sig long, other long, marked boolean, lines array<int>, texts array<long>"
_ALONG = f"{_SHARED}, part int, place int, keys array<long>, sizes array<int>, open array<int>"


def _shared(a: dict, b: dict) -> list[dict]:
    """For each page of a pair that is no copy: its deciding lines that both have."""
    if a["host"] != b["host"]:
        return []
    pairs = common_lines(a["keys"], b["keys"])
    sides = []
    for page, matched in ((a, {i for i, _ in pairs}), (b, {j for _, j in pairs})):
        free, sizes = page["open"], page["sizes"]
        shared = [n for n, i in enumerate(free) if i in matched]
        sides.append((page, shared, sum(sizes[free[n]] for n in shared), sum(sizes[i] for i in free)))
    most = VERSION if a["marked"] and b["marked"] else NEAR_COPY
    if any(whole and part >= most * whole for *_, part, whole in sides) and all(whole for *_, whole in sides):
        return []
    return [{"host": page["host"], "sig": page["sig"], "other": other["sig"], "marked": page["marked"], "lines": shared,
             "texts": [page["keys"][page["open"][n]] for n in shared]}
            for (page, shared, *_), other in zip(sides, (b, a)) if shared]


def _rows(found: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(found, schema)


_LONGS, _INTS = pa.list_(pa.int64()), pa.list_(pa.int32())
_SHARED_ROWS = pa.schema([("host", pa.string()), ("sig", pa.int64()), ("other", pa.int64()), ("marked", pa.bool_()), ("lines", _INTS), ("texts", _LONGS)])
_ALONG_ROWS = pa.schema([*_SHARED_ROWS, ("part", pa.int32()), ("place", pa.int32()), ("keys", _LONGS), ("sizes", _INTS), ("open", _INTS)])


def _along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every page of a sorted partition beside the next one; the first and the
    last page (place 0 and 1) are handed on for the pairs across partitions."""
    last = None
    for batch in batches:
        found = []
        for page in batch.to_pylist():
            found += [{**page, "place": 0}] if last is None else _shared(last, page)
            last = page
        yield _rows(found, _ALONG_ROWS)
    if last is not None:
        yield _rows([{**last, "place": 1}], _ALONG_ROWS)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last page of every partition beside the first of the next."""
    last = None
    for batch in batches:
        found = []
        for page in batch.to_pylist():
            if page["place"]:
                last = page
            elif last is not None:
                found += _shared(last, page)
        yield _rows([{k: r[k] for k in _SHARED_ROWS.names} for r in found], _SHARED_ROWS)


def template_lines(parsed: DataFrame) -> DataFrame:
    """(host, sig, lost): the deciding lines that are the site's template.

    Pages with equal lines are one row here, and the sorted order is cut
    anywhere, so neither a host nor a group of copies meets in one task.
    """
    spark = parsed.sparkSession
    distinct = parsed.groupBy("host", "sig").agg(F.min("path").alias("path"), *[F.any_value(c).alias(c) for c in ("marked", "keys", "sizes", "open")])
    order = ["host", "path", "sig"]
    ranged = distinct.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    along = stored(map_arrow(ranged.select(*_PAGE, F.spark_partition_id().alias("part")), _along, _ALONG), "neighbours")
    edges = along.filter("place is not null").repartition(1).sortWithinPartitions("part", "place")  # two pages a partition
    shared = along.filter("place is null").select(*_SHARED_ROWS.names).unionByName(map_arrow(edges, _across, _SHARED))
    shared = stored(shared, "shared-lines")
    both = F.collect_list("texts")  # two neighbours at most
    template = shared.groupBy("host", "sig").agg(F.when(F.size(both) == 2, F.array_intersect(both[0], both[1])).alias("own")).filter(F.size("own") > 0)
    theirs = template.select("host", F.col("sig").alias("other"), F.col("own").alias("theirs"))
    known = F.concat(*[F.coalesce(c, F.array().cast("array<long>")) for c in ("own", "theirs")])
    three = F.filter("lines", lambda _, i: F.array_contains(known, F.get("texts", i)))
    lost = (shared.join(template, ["host", "sig"], "left").join(theirs, ["host", "other"], "left")
            .select("host", "sig", F.when(F.col("marked"), three).otherwise(F.col("lines")).alias("lost")).filter(F.size("lost") > 0))
    return lost.groupBy("host", "sig").agg(F.array_distinct(F.flatten(F.collect_list("lost"))).alias("lost"))


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url and the main text of every page."""
    plain = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    parsed = stored(map_arrow(plain, _parse, _PARSED), "parsed-pages")
    judged = parsed.select("page_id", "url", "host", "sig", "lines").join(template_lines(parsed), ["host", "sig"], "left")
    kept = F.filter("lines", lambda line, i: ~F.coalesce(F.array_contains("lost", i), F.lit(False)))
    return judged.select("page_id", "url", F.array_join(kept, "\n").alias("text"))

"""HTML extraction by nearest-URL page differencing.

Every page is cut into text lines (its blocks). Within a host, pages in the order of their URL paths are each paired with that neighbour whose path shares
the longer prefix; the lines of the two are aligned by longest common subsequence, and lines that both have are deleted as site furniture.

Differencing alone can't give right results where a page's advert or comments are its own, or where neighbours carry the same article, so
markup has the first word: lines inside menus, headers, footers, sidebars, notices, adverts, forms and comments (by element, role, class or id)
always go; a page with an article or main element keeps the lines inside it; on every other page the alignment decides all lines that
markup leaves open. ``markup=False`` leaves every line to the alignment.

Only line hashes are shuffled for the pairing. Hosts with more than ``BLOCK`` pages are cut into ranges of the path order of about that
many, so no task sorts a whole hot host; each range's first and last page are passed to the ranges beside it, so neighbours are the
same at every size.

Defined results: null or empty html has the empty text; a page alone on its host loses only what markup marks; repeated rows are one page for
the pairing and keep a result each; pages without a parseable URL share one host named by the empty string; null ids are allowed; a page of any
length is read whole, its alignment with n lines against m taking n * m bits; an empty table gives an empty result; a ``keep`` column named like
a result raises ValueError, other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillon.llm import words as W
from quillon.llm.store import Written

BLOCK = 2048
BROADCAST_LINES = 200_000
MAIN, BOILER, OPEN = 2, 1, 0

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*)>|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>|</?[a-zA-Z][^>]*\Z|</[^a-zA-Z][^>]*(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_WORD = re.compile(r"[a-z0-9]+")
_SPACE = re.compile(r"\s+")

RAW = frozenset("script style noscript template textarea select svg math canvas object iframe video audio title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = frozenset("nav aside footer form menu dialog button head".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
TRACKED = frozenset("article aside body blockquote center details dialog div dl fieldset figure footer form head header main menu nav ol section table ul button".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
#: Words of class and id names that mark furniture anywhere, and those that do so outside of the article only.
MARKS = frozenset("ad ads adsense advert adverts advertisement advertising sponsor sponsored promo promotion share sharing social related recommended comment comments disqus newsletter subscribe subscription cookie cookies consent gdpr notice sidebar breadcrumb breadcrumbs pagination pager nav navbar navigation menu footer popup modal outbrain taboola".split())
OUTER_MARKS = MARKS | frozenset("header masthead topbar banner widget widgets login signup search toolbar skip".split())


def _verdict(tag: str, attrs: str, in_main: bool) -> int:
    """Whether an element is the article, furniture or neither."""
    role, names, hidden = "", "", False
    if attrs.strip():
        for k, a, b, c in _ATTR.findall(attrs):
            k = k.lower()
            if k == "role":
                role = (a or b or c).lower()
            elif k in ("class", "id"):
                names += " " + (a or b or c).lower()
        hidden = bool(re.search(r"(?:^|\s)hidden(?:\s|$|/)", _ATTR.sub(" ", attrs)))
    if hidden or tag in FURNITURE or role in ROLES or (tag == "header" and not in_main):
        return BOILER
    if names and tag not in ("body", "html", "main") and not (MARKS if in_main else OUTER_MARKS).isdisjoint(_WORD.findall(names)):
        return BOILER
    return MAIN if tag in ("article", "main") or role in ("main", "article") else OPEN


def lines(page: str | None) -> list[tuple[str, int]]:
    """The text blocks in page order, each with what markup says of it."""
    if not page:
        return []
    out: list[tuple[str, int]] = []
    held: list[str] = []
    stack: list[tuple[str, int]] = []  # open elements that matter, each with the verdict in force inside

    def flush() -> None:
        if held:
            text = _SPACE.sub(" ", "".join(held)).strip()
            held.clear()
            if text:
                out.append((text, stack[-1][1] if stack else OPEN))

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            held.append(entities.unescape(page[at:]))
            break
        if m.start() > at:
            held.append(entities.unescape(page[at : m.start()]))
        at = m.end()
        if m["cdata"] is not None:
            held.append(m["cdata"])
            continue
        tag = m["tag"] or m["tag2"]
        if not tag:
            continue
        tag, end, attrs = tag.lower(), m["end"] or m["end2"], m["attrs"] or m["attrs2"] or ""
        if tag == "br":
            held.append(" ")
            continue
        if tag in BLOCKS:
            flush()
        if end:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    flush()
                    del stack[i:]
                    break
                if tag not in TRACKED and stack[i][0] in TRACKED:
                    break  # the end of a small element doesn't close a large one
            continue
        if tag in RAW:
            if not attrs.rstrip().endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
                at = close.end() if close else n
            continue
        if tag in BLOCKS:  # a block ends a paragraph
            while stack and stack[-1][0] in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
                stack.pop()
        if tag in VOID or attrs.rstrip().endswith("/") and tag not in BLOCKS:
            continue
        now = stack[-1][1] if stack else OPEN
        found = _verdict(tag, attrs, now == MAIN)
        if found == BOILER and tag not in BLOCKS:
            flush()
        if tag in TRACKED or found != OPEN:
            stack.append((tag, BOILER if BOILER in (now, found) else max(now, found)))
    flush()
    return out


def common(a: list[int], b: list[int]) -> list[int]:
    """Positions in a of a longest common subsequence with b: bit-parallel, a row of bits for each element of a."""
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v, rows = full, []
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    out = []
    i, j = len(a), len(b)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if not (i and not rows[i - 1] >> (j - 1) & 1):
                j -= 1
                out.append(i)
    return out[::-1]


def _hashes(texts: list[str]) -> list[int]:
    data, bounds = W.raw(pa.array(texts, pa.string()))
    return W.hashes(data, bounds[:-1], bounds[1:]).view(np.int64).tolist()


def judged(page: str | None, markup: bool) -> list[tuple[str, int]]:
    """The lines with what is decided before any alignment: MAIN stays, BOILER goes, OPEN is left to it."""
    found = lines(page)
    if not markup:
        return [(t, OPEN) for t, _ in found]
    if any(m == MAIN for _, m in found):
        return [(t, m if m == MAIN else BOILER) for t, m in found]
    return found


def _line_hashes(batches: Iterator[pa.RecordBatch], markup: bool) -> Iterator[pa.RecordBatch]:
    for part in W.slices(batches, "html"):
        found = [judged(t, markup) for t in part.column("html").to_pylist()]
        flat = iter(_hashes([t for page in found for t, _ in page]))
        hashes = [[next(flat) for _ in page] for page in found]
        open_lines = [any(m == OPEN for _, m in page) for page in found]
        yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(hashes, pa.list_(pa.int64())), pa.array(open_lines)], names=["key", "hashes", "open"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column("hashes").to_pylist(), batch.column("other").to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([common(x, y) for x, y in zip(a, b, strict=True)], pa.list_(pa.int32()))], names=["key", "shared"])


def _extract(batches: Iterator[pa.RecordBatch], markup: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for part in W.slices(batches, "html"):
        texts = []
        for page, shared in zip(part.column("html").to_pylist(), part.column("shared").to_pylist(), strict=True):
            gone = {*(shared or ())}
            texts.append("\n\n".join(t for i, (t, m) in enumerate(judged(page, markup)) if m == MAIN or m == OPEN and i not in gone))
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if f.name == "main_text" else part.column(f.name) for f in schema], schema=schema)


def extract(pages: DataFrame, url: str = "url", html: str = "html", keep: tuple[str, ...] = ("page_id", "url"), markup: bool = True) -> DataFrame:
    """keep columns and main_text, a row for each row of pages."""
    if "main_text" in keep or {"key", "shared", "html"} & {*keep} - {html}:
        raise ValueError("a column has the name of a result")
    address = F.coalesce(F.col(url).cast("string"), F.lit(""))
    taken = pages.select(*dict.fromkeys(keep), F.col(html).cast("string").alias("html"), F.xxhash64(F.col(url).cast("string"), F.col(html).cast("string")).alias("key"))
    light = Written(pages.select(F.xxhash64(F.col(url).cast("string"), F.col(html).cast("string")).alias("key"), F.lower(F.regexp_extract(address, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)).alias("host"), F.regexp_extract(address, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1).alias("path")).distinct(), "places")
    tables, light = [light], light.read()
    hot = light.groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    n = hot.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    hot = F.broadcast(hot.select("host"))  # at most one host for BLOCK pages
    dealt = light.join(hot, "host", "left_anti").withColumn("range", F.lit(-1))
    if n:
        cut = Written(light.join(hot, "host", "left_semi").repartitionByRange(-(-n // BLOCK), "host", "path", "key").withColumn("range", F.spark_partition_id()), "ranges")
        tables, cut = [*tables, cut], cut.read()
        dealt = dealt.unionByName(cut)
    order = Window.partitionBy("host", "range").orderBy("path", "key")
    near = dealt.select("host", "range", "key", "path", F.lag("key").over(order).alias("k1"), F.lag("path").over(order).alias("p1"), F.lead("key").over(order).alias("k2"), F.lead("path").over(order).alias("p2"))
    if n:
        page = F.struct("path", "key")
        beside = Window.partitionBy("host").orderBy("range")
        ends = cut.groupBy("host", "range").agg(F.min(page).alias("first"), F.max(page).alias("last"))  # a row for each range and hot host
        ends = ends.select("host", "range", F.lag("last").over(beside).alias("before"), F.lead("first").over(beside).alias("after"))
        or_end = lambda c, end: F.coalesce(c, end).alias(c)
        near = near.join(F.broadcast(ends), ["host", "range"], "left").select("key", "path", or_end("k1", "before.key"), or_end("p1", "before.path"), or_end("k2", "after.key"), or_end("p2", "after.path"))
    size = lambda a, b: F.length(F.regexp_extract(F.concat_ws("\n", a, b), r"^(.*).*\n\1", 1))
    pairs = near.select("key", F.when(F.col("k1").isNull() | (F.col("k2").isNotNull() & (size("path", "p2") > size("path", "p1"))), F.col("k2")).otherwise(F.col("k1")).alias("neighbour")).where("neighbour is not null")
    hashes = Written(taken.select("key", "html").mapInArrow(partial(_line_hashes, markup=markup), "key bigint, hashes array<bigint>, open boolean").dropDuplicates(["key"]), "lines")
    tables, hashes = [*tables, hashes], hashes.read()
    both = hashes.join(pairs, "key").join(hashes.select(F.col("key").alias("neighbour"), F.col("hashes").alias("other")), "neighbour")
    # rows only where the alignment has something to decide
    shared = Written(both.where("open").select("key", "hashes", "other").mapInArrow(_shared, "key bigint, shared array<int>").where(F.size("shared") > 0), "shared").read()
    for x in tables:
        x.drop()
    small = shared.agg(F.coalesce(F.sum(F.size("shared") + 2), F.lit(0)).alias("n")).first()["n"] <= BROADCAST_LINES
    joined = taken.join(F.broadcast(shared) if small else shared, "key", "left")
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in taken.schema if f.name in keep), T.StructField("main_text", T.StringType())])
    return joined.mapInArrow(partial(_extract, markup=markup, schema=to_arrow_schema(schema)), schema)

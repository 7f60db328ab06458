"""Main text of pages by differencing each with the page of the nearest URL on its host.

A page becomes text lines, one for each block, with a mark of where it stands: in the article, in an element that
never holds the article (navigation, footer, form, advert and the like), or in neither. Pages of a host are
ordered by path; each is paired with the neighbour whose path shares the longest start with its own, the lines of
both are aligned by longest common subsequence, and lines that both have are deleted. Copies of an article would
lose their text that way, and an advert that changes from page to page would stay, so marks take part: lines in
an article are not deleted, and lines in elements that never hold one go whether shared or not.

Sorting is spread by split points, sampled by a hash of the key so that a rerun has the same ones; a host with a
third of all pages is cut by path into many blocks. A block also gets the page at which the next begins and the
last one of the block before, so every page sees both its neighbours and its text doesn't hang on the split points.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from html import unescape
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapql.llm.urls import host_of, path_of
from mapql.runtime import partitions

#: About so many split points at most, and pages between two at least.
SPLITS = 2000
BLOCK_PAGES = 64

ARTICLE, ASIDE, OTHER = 2, 1, 0
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_HINTED = re.compile(r"\b(?:class|id|role|itemprop|hidden)\b", re.I)
#: Elements of HTML by their use.
RAW = frozenset("script style noscript template textarea title iframe svg math canvas object xmp noembed noframes".split())
_RAW_END = {name: re.compile(rf"</{name}(?:[\s/][^>]*)?(?:>|\Z)", re.I) for name in RAW}
NEVER = frozenset("nav footer aside form menu dialog button select head".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in class, id or role that mark what isn't the article.
HINTS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies disqus footer header masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promotion related respond share sharing sidebar social sponsor sponsored subscribe subscription toolbar widget complementary contentinfo search alert".split())
_WORDS = re.compile(r"[a-z]+")
#: Inline elements whose end also ends what is still open in them.
_SCOPED = frozenset(("button", "select"))
#: Elements whose start ends an open paragraph, as browsers do.
_CLOSES_P = BLOCKS - {"html", "body", "head", "option", "optgroup", "td", "th", "tr", "tbody", "thead", "tfoot"}


def _mark(name: str, attributes: str, above: int, around: set[str]) -> int:
    """The mark of an element; ``around``: names of open elements. An article in an article is a reader's comment."""
    if above == ASIDE or name in NEVER or (name == "header" and around.isdisjoint(("article", "main"))) or (name == "article" and "article" in around):
        return ASIDE
    main = name in ("article", "main")
    if attributes and _HINTED.search(attributes):
        for key, a, b, c in _ATTRIBUTE.findall(attributes):
            value = (a or b or c).lower()
            key = key.lower()
            if key == "hidden" or key == "aria-hidden" and value == "true":
                return ASIDE
            if key == "role" and value == "main" or key == "itemprop" and value == "articlebody":
                main = True
            elif key in ("class", "id", "role") and not main and name not in ("html", "body") and not HINTS.isdisjoint(_WORDS.findall(value)):
                return ASIDE
    return ARTICLE if main else above


def lines(html: str) -> list[tuple[str, int]]:
    """(text, mark) of each block of a page that has text."""
    out: list[tuple[str, int]] = []
    part: list[str] = []
    stack: list[tuple[str, int, str]] = []  # of inline elements those that change the mark, and of their names all in these
    mark, at = OTHER, 0

    def flush() -> None:
        text = " ".join(unescape("".join(part)).split()) if part else ""
        if text:
            out.append((text, mark))
        part.clear()

    def marked(name: str, attributes: str) -> int:
        return _mark(name, attributes, stack[-1][1] if stack else OTHER, {x[0] for x in stack})

    while m := _TAG.search(html, at):
        closing, name = m[1], m[2]
        if m.start() > at:
            part.append(html[at : m.start()])
        at = m.end()
        if name is None:
            continue
        name = name.lower()
        if name == "br":
            part.append(" ")
            continue
        if name in BLOCKS:
            flush()
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    inside = stack[i + 1 :] if name not in BLOCKS and name not in _SCOPED else []
                    del stack[i:]
                    # a block that an inline element doesn't enclose wholly goes on without it
                    for n, _, attributes in inside:
                        stack.append((n, marked(n, attributes), attributes))
                    new = stack[-1][1] if stack else OTHER
                    if new != mark:
                        flush()
                        mark = new
                    break
        elif name in RAW:
            if not (m[3] or "").endswith("/"):
                # nothing in it counts, so only its end is looked for; without one it goes to the page's end
                end = _RAW_END[name].search(html, at)
                at = end.end() if end else len(html)
        elif name not in VOID:
            if name in _CLOSES_P:
                i = len(stack) - 1
                while i >= 0 and stack[i][0] not in BLOCKS and stack[i][0] not in _SCOPED:
                    i -= 1
                if i >= 0 and stack[i][0] == "p":
                    del stack[i:]
                    mark = stack[-1][1] if stack else OTHER
            new = marked(name, m[3] or "")
            if name in BLOCKS or new != mark or any(x[0] == name for x in stack):
                if new != mark:
                    flush()
                stack.append((name, new, m[3] or ""))
                mark = new
    if at < len(html):
        part.append(html[at:])
    flush()
    return out


def _rows(a: list[int], b: list[int]) -> list[int]:
    """Bit-parallel LCS: for each prefix of ``a`` an integer whose zero bits are steps of the length over ``b``."""
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v, out = full, []
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
        out.append(v)
    return out


def common(a: list[int], b: list[int], most: int = 1 << 28) -> set[int]:
    """Indices of ``a`` that are in a longest common subsequence with ``b``; memory stays under ``most`` bits."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    kept = {*range(start), *range(len(a) - end, len(a))}
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if not a or not b or set(a).isdisjoint(b):
        return kept
    if len(a) > 1 and len(a) * len(b) > most:
        half = len(a) // 2
        down, up = _rows(a[:half], b)[-1:], _rows(a[half:][::-1], b[::-1])[-1:]
        steps = lambda v: np.concatenate(([0], np.cumsum(1 - np.unpackbits(np.frombuffer(v[0].to_bytes((len(b) + 7) // 8, "little"), np.uint8), bitorder="little", count=len(b)).astype(np.int64))))
        cut_at = int(np.argmax(steps(down) + steps(up)[::-1]))
        found = common(a[:half], b[:cut_at], most) | {half + i for i in common(a[half:], b[cut_at:], most)}
        return kept | {start + i for i in found}
    rows = _rows(a, b)
    i, j = len(a) - 1, len(b) - 1
    while i >= 0 and j >= 0:
        if a[i] == b[j]:
            kept.add(start + i)
            i, j = i - 1, j - 1
            continue
        above = rows[i - 1] if i else (1 << len(b)) - 1
        mask = (1 << (j + 1)) - 1
        if (j + 1) - (above & mask).bit_count() >= (j + 1) - (rows[i] & mask).bit_count():
            i -= 1
        else:
            j -= 1
    return kept


def main_text(page: list[tuple[str, int]], other: list[tuple[str, int]] | None) -> str:
    """The lines of a page that stay after differencing it with its neighbour."""
    shared: set[int] = set()
    if other and any(m == OTHER for _, m in page):
        shared = common([hash(t) for t, _ in page], [hash(t) for t, _ in other])
    return "\n".join(t for i, (t, m) in enumerate(page) if m == ARTICLE or m == OTHER and i not in shared)


def extract(pages: DataFrame, splits: int = SPLITS, block_pages: int = BLOCK_PAGES) -> DataFrame:
    """page_id, url, text, n_chars for each row of ``pages``.

    Needs page_id, url and html; other columns are not read. Defined for odd rows: a null or empty html gives an
    empty text; a null url or one without ``://`` counts as an empty host with an empty path, and such pages
    neighbour each other; repeated rows are neighbours of each other, so that text outside an article goes in
    both; an empty table gives an empty table.
    """
    spark = pages.sparkSession
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    every = max(block_pages, keyed.count() // splits)
    number = F.coalesce(F.col("page_id"), F.lit(-1))
    picked = keyed.where(F.pmod(F.xxhash64("host", "path", number), F.lit(every)) == 0).select("host", "path", number.alias("n")).distinct()
    points = sorted(tuple(r) for r in picked.collect())
    shared = spark.sparkContext.broadcast(points)

    def numbered(batches):
        for batch in batches:
            keys = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([bisect_right(shared.value, k) for k in keys], pa.int64()), *batch.columns], ["block", "host", "path", "n"])

    placed = keyed.select("host", "path", number.alias("n")).mapInArrow(numbered, "block long, host string, path string, n long")
    lasts = {r["block"]: tuple(r["last"]) for r in placed.groupBy("block").agg(F.max(F.struct("host", "path", "n")).alias("last")).collect()} if points else {}
    last = spark.sparkContext.broadcast(lasts)

    def blocks(batches):
        ends = shared.value
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                out = []
                for page_id, url, html, host, path in zip(*(c.to_pylist() for c in batch.slice(first, 256).columns), strict=True):
                    found = lines(html or "")
                    texts, marks = [t for t, _ in found], bytes(m for _, m in found)
                    key = (host, path, -1 if page_id is None else page_id)
                    block = bisect_right(ends, key)
                    out.append((block, False, page_id, url, host, path, texts, marks))
                    if block and ends[block - 1] == key:
                        out.append((block - 1, True, page_id, url, host, path, texts, marks))
                    if block < len(ends) and last.value[block] == key:
                        out.append((block + 1, True, page_id, url, host, path, texts, marks))
                kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], [f"c{i}" for i in range(8)])

    def difference(batches):
        before = page = None  # (block, ghost, page_id, url, host, path, lines)

        def near(x, y):
            """Characters that two paths share; -1 if the pages can't be paired."""
            return len(commonprefix((x[5], y[5]))) if x and y and x[0] == y[0] and x[4] == y[4] else -1

        def done(after):
            a, b = near(page, before), near(page, after)
            other = before if a >= b and a >= 0 else after if b >= 0 else None
            return page[2], page[3], main_text(page[6], other and other[6])

        def batch_of(rows):
            ids, urls, texts = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                out = []
                for row in zip(*(c.to_pylist() for c in batch.slice(first, 256).columns), strict=True):
                    new = (*row[:6], list(zip(row[6], row[7], strict=True)))
                    if page and not page[1]:
                        out.append(done(new))
                    before, page = page, new
                if out:
                    yield batch_of(out)
        if page and not page[1]:
            yield batch_of([done(None)])

    marked = keyed.mapInArrow(blocks, "block long, ghost boolean, page_id long, url string, host string, path string, lines array<string>, marks binary")
    ordered = marked.repartition(partitions(spark), "block").sortWithinPartitions("block", "host", "path", "page_id", "ghost")
    return ordered.mapInArrow(difference, "page_id long, url string, text string, n_chars long")


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


#: For pages as the tables have them: one article of headings and paragraphs. Other pages are tested in Python.
OP2_SQL = r"""
WITH a AS (SELECT page_id, url, string_split_regex(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?(p|h[1-6]|ul|li|div|article)[^>]*>') AS parts FROM pages),
b AS (SELECT page_id, url, list_transform(parts, lambda x: trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', ' ', 'g'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&#x27;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))) AS parts FROM a),
c AS (SELECT page_id, url, coalesce(array_to_string(list_filter(parts, lambda x: x <> ''), chr(10)), '') AS text FROM b)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM c
"""

"""Main text of web pages: nearest-URL page differencing beside structural marks.

A page is cut into blocks (one line of text each). Pages of a host stand in
order of their URL path; URLs that differ only in query, fragment, a trailing
slash or the ending .html or .htm are addresses of one page. Each page is
paired with that neighbour whose path shares the longer beginning (the earlier
one on a tie). The two pages' lines are aligned by longest common subsequence
and shared lines are deleted: everywhere in a page that doesn't say where its
article is; in ``article`` or ``main``, at its head and its tail, up to its
first and from its last line that is the page's own, as what pages share in
between is text that articles quote, not a frame around them. A page without
any line of its own is a copy of its neighbour and loses nothing.

Differencing alone can't give the main text where menus, adverts and footers
are drawn anew for each page, so blocks inside elements that name themselves
(nav, footer, aside, form, class="ad", role=navigation, ...) go as well. Where
a page has an ``article`` or ``main``, only its blocks are the main text.

Work on Spark: a narrow pass makes line hashes, which a checkpoint keeps; pages
of one path make one row, and only hosts and paths are range-sorted, so a hot
host spreads over many partitions; the two paths on either side of a
partition's edge are brought together by a window over two short rows of each
partition. Pages meet their neighbour's line hashes by path. A second narrow
pass cuts the texts again and drops the deleted lines; those are joined by
broadcast while they are few (a checked count), else by a shuffle. The html
itself is not shuffled in the first case.

Defined results: a null or empty html gives an empty text; a null url belongs
to one host of its own; repeated rows get the same text; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm._arrow import small_batches, sub_batches
from quillon.session import durable

BROADCAST_ROWS = 100_000
ARTICLE, FREE, MARKED = 0, 1, 2

# Elements of HTML and names that pages give to what is not their main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
DROPPED = frozenset("nav footer aside form menu dialog head title button select option datalist object canvas audio video map figcaption header".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus donate footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination paywall popup promo promoted promotion recommended related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(script|style|noscript|template|iframe|textarea|svg|math|xmp|noembed|noframes)\b[^>]*(?:>|\Z).*?(?:</\1\s*[^>]*(?:>|\Z)|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
WORDS = re.compile(r"[a-z]+")


def _marked(name: str, attributes: str) -> bool:
    if name in DROPPED:
        return True
    if "=" not in attributes and "hidden" not in attributes:
        return False
    for key, a, b, c in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), (a or b or c).lower()
        if key in ("class", "id") and not NAMES.isdisjoint(WORDS.findall(value)):
            return name not in ("html", "body", "article", "main") or key == "class" and name == "article" and "comment" in value
        if key == "role" and value in ROLES or key == "aria-hidden" and value == "true":
            return True
        if key == "style" and "display:none" in value.replace(" ", ""):
            return True
    return bool(re.search(r"(?:^|\s)hidden(?:\s|/|$)", attributes, re.I))


def blocks(page: str) -> list[tuple[str, int]]:
    """(text, ARTICLE, FREE or MARKED) of every block with text, in page order."""
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, bool, bool]] = []  # element, in a marked element, in an article
    text: list[str] = []
    at = 0

    def close() -> None:
        line = " ".join(entities.unescape("".join(text)).split())
        text.clear()
        if line:
            _, marked, article = stack[-1] if stack else ("", False, False)
            out.append((line, MARKED if marked else ARTICLE if article else FREE))

    for token in TOKEN.finditer(page):
        if token.start() > at:
            text.append(page[at : token.start()])
        at = token.end()
        name = token[3] or token[6]
        if name is None:
            continue
        name, ends, attributes = name.lower(), bool(token[2] or token[5]), token[4] or token[7] or ""
        if name == "br":
            text.append(" ")
            continue
        if name in BLOCK:
            close()
        if name in VOID:
            continue
        if ends:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if text and any(x[1] for x in stack[k:]) != (stack[k - 1][1] if k else False):
                        close()
                    del stack[k:]
                    break
            continue
        if name in BLOCK:  # an open paragraph or item ends here
            while stack and (stack[-1][0] == "p" or stack[-1][0] not in BLOCK and any(s[0] == "p" for s in stack[-4:]) and name == "p"):
                stack.pop()
            if name == "li" and stack and stack[-1][0] == "li":
                stack.pop()
        _, marked, article = stack[-1] if stack else ("", False, False)
        article = article or name in ("article", "main") or 'role="main"' in attributes.lower()
        own = _marked(name, attributes)
        if name == "header" and article:
            own = False  # an article's own header holds its title
        if own and not marked and name not in BLOCK:
            close()
        stack.append((name, marked or own, article))
    if at < len(page):
        text.append(page[at:])
    close()
    return out


def aligned(a: list[int], b: list[int]) -> list[int]:
    """The positions in ``a`` of a longest common subsequence of ``a`` and ``b``."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    where = defaultdict(list)
    for j in range(len(b) - end - 1, start - 1, -1):
        where[b[j]].append(j)
    tails: list[int] = []
    nodes: list[tuple] = []  # (position in a, the chain before it) at the end of each length
    for i in range(start, len(a) - end):
        for j in where.get(a[i], ()):
            k = bisect_left(tails, j)
            node = (i, nodes[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                nodes.append(node)
            else:
                tails[k], nodes[k] = j, node
    middle, node = [], nodes[-1] if nodes else None
    while node:
        middle.append(node[0])
        node = node[1]
    return [*range(start), *middle[::-1], *range(len(a) - end, len(a))]


def common_start(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def deleted(lines: list[int], zones: list[int], theirs: list[int]) -> list[int]:
    """The lines that a page loses to its neighbour's."""
    shared = set(aligned(lines, theirs))
    article = [i for i, z in enumerate(zones) if z == ARTICLE]
    free = article or [i for i, z in enumerate(zones) if z == FREE]
    own = [i for i in free if i not in shared]
    if not own:
        return []
    return [i for i in free if i in shared and not (article and own[0] < i < own[-1])]


PAGE = "k1 long, k2 long, host string, path string, lines array<long>, zones array<int>"
NEAR = "host string, path string, near string"
#: part, nth: of a partition's first and last path, whose other neighbour is in another partition; inner: the one in its own.
EDGES = f"{NEAR}, part int, nth int, inner_host string, inner_path string"


def _hashed(pages: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sub_batches(whole, "html"):
                lines, zones = [], []
                for page in batch.column("html").to_pylist():
                    found = blocks(page or "")
                    lines.append([xxhash.xxh64_intdigest(t) - (1 << 63) for t, _ in found])
                    zones.append([z for _, z in found])
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("k1", "k2", "host", "path")), pa.array(lines, pa.list_(pa.int64())), pa.array(zones, pa.list_(pa.int32()))], names=["k1", "k2", "host", "path", "lines", "zones"])

    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    path = F.coalesce(F.regexp_replace(F.regexp_extract("url", r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)", 1), r"(\.html?)?/*$", ""), F.lit(""))
    return pages.select("k1", "k2", host.alias("host"), path.alias("path"), "html").mapInArrow(run, PAGE)


def nearest(host: str, path: str, others: list[tuple[str, str] | None]) -> str | None:
    """The path among (host, path) pairs, the earlier first, that lies nearest on the same host."""
    own = [p for h, p in (o for o in others if o is not None) if h == host]
    return max(own, key=lambda p: common_start(p, path), default=None)


def _near(paths: DataFrame) -> DataFrame:
    """NEAR rows: the nearest other path of each (host, path), which must be different; null if the host has no other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth = TaskContext.get().partitionId(), 0
        before = now = None
        names = [f.split()[0] for f in EDGES.split(", ")]

        def rows(found: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], kind) for k, kind in enumerate(kinds)], names=names)

        for batch in batches:
            found = []
            for page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if now is not None:
                    found.append((*now, None, part, nth, *page) if before is None else (*now, nearest(*now, [before, page]), None, None, None, None))
                    nth = 1
                before, now = now, page
            if found:
                yield rows(found)
        if now is not None:
            yield rows([(*now, None, part, nth, *(before or (None, None)))])

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for r in batch.to_pylist():
                inner, ahead, behind = ((r[f"{x}_host"], r[f"{x}_path"]) if r[f"{x}_path"] is not None else None for x in ("inner", "ahead", "behind"))
                # the first path of a partition has its inner neighbour behind it, the last one ahead
                near.append(nearest(r["host"], r["path"], [ahead, inner or behind] if r["nth"] == 0 else [inner, behind]))
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("path"), pa.array(near, pa.string())], names=["host", "path", "near"])

    found = durable(paths.select("host", "path").repartitionByRange("host", "path").sortWithinPartitions("host", "path").mapInArrow(run, EDGES))
    order = Window.orderBy("part", "nth")  # two rows of each partition at most
    outer = {f"{name}_{c}": f(c).over(order) for name, f in (("ahead", F.lag), ("behind", F.lead)) for c in ("host", "path")}
    edges = found.where("part IS NOT NULL").withColumns(outer).select("host", "path", "nth", *(f"{x}_{c}" for x in ("inner", "ahead", "behind") for c in ("host", "path")))
    return found.where("part IS NULL").select("host", "path", "near").union(edges.mapInArrow(resolve, NEAR))


def _losses(hashed: DataFrame) -> DataFrame:
    """(k1, k2, gone): the lines each page loses, for pages that lose some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = [deleted(*row) for row in zip(*(batch.column(c).to_pylist() for c in ("lines", "zones", "theirs")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), pa.array(gone, pa.list_(pa.int32()))], names=["k1", "k2", "gone"])

    paths = durable(hashed.groupBy("host", "path").agg(F.min_by("lines", F.struct("k1", "k2")).alias("theirs")))
    near = _near(paths).where("near IS NOT NULL").join(paths.withColumnRenamed("path", "near"), ["host", "near"]).select("host", "path", "theirs")
    return hashed.join(near, ["host", "path"]).select("k1", "k2", "lines", "zones", "theirs").mapInArrow(run, "k1 long, k2 long, gone array<int>").where(F.size("gone") > 0)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html)."""
    keyed = small_batches(pages).select("page_id", "url", "html", F.xxhash64("url", "html").alias("k1"), F.xxhash64(F.lit(1), "html", "url").alias("k2"))
    gone = durable(_losses(durable(_hashed(keyed).dropDuplicates(["k1", "k2"]))))
    few = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    joined = keyed.join(F.broadcast(gone) if few else gone, ["k1", "k2"], "left").select("page_id", "url", "html", "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sub_batches(whole, "html"):
                texts = []
                for page, lost in zip(batch.column("html").to_pylist(), batch.column("gone").to_pylist(), strict=True):
                    found, lost = blocks(page or ""), set(lost or ())
                    zone = ARTICLE if any(z == ARTICLE for _, z in found) else FREE
                    kept = [t for i, (t, z) in enumerate(found) if z == zone and i not in lost]
                    texts.append("\n\n".join(kept))
                yield pa.RecordBatch.from_arrays([batch.column("page_id").cast(pa.int64()), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")

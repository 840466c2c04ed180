"""Operator 4, main text extraction by nearest-URL page differencing.

A page is cut into lines (the text of its blocks), each with the place it stands in: an article or main element, a marked
region (menus, headers, footers, sidebars, notices, adverts, forms, comments; by element, or by a class, id or role that
names one), or neither. Pages of a host are ordered by URL path; each is paired with the page before and the page after it,
and all lines of both are aligned by a longest common subsequence. Lines that a page shares with a neighbour are deleted,
wherever they stand outside an article or main element, with one exact check: pages that have over 85 % of the longer one's text in common
are copies of each other, not two pages of one template, and take only marked lines from each other.

Markup decides what differencing can't tell: text inside an article or main element stays even where another page repeats
it (pages of a host often quote one passage); lines of marked regions go even where no neighbour has them (adverts differ from page to page); and
on pages with an article or main element the unmarked lines outside it stay only if a neighbour was there to compare with.
A class, id or role names a region only as a whole token, or as a compound all of whose parts are names of regions or of
positions (``site-footer``, but not ``has-sidebar`` or ``share-price``).

Pages are dealt into parts by host and path, so that a host of any size spreads over tasks, and each is parsed once, in order.
Where parts begin is read off a bounded sample of keys once, and stands in the plan as literals: a page's part is a function of
the page, however often Spark reads or deals out the table. The first and last page of every part are compared across its
edges in a table of a row a part, so the result doesn't depend on where parts begin.

Defined results: null html gives the empty text; pages without a host form one group; equal paths are ordered by page_id;
repeated rows are copies of each other; very long pages are read whole; an element that is never closed ends with the page,
or where an article begins; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from .common import cut, shuffles, tidy

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|textarea)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(noscript|template|svg|iframe|object|title)\b(?:[^>]*/>|[^>]*>.*?</\2\s*>)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>"
    r"|<[!?][^>]*>",
    re.S | re.I,
)
_NAMED = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_REGION = frozenset("nav header footer aside form button select menu dialog head".split())
_BLOCK = frozenset(
    "p div h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table caption thead tbody tfoot tr section article main blockquote pre figure figcaption hr header footer nav aside form fieldset "
    "legend address details summary body html head center menu dialog".split()
)
_SPACE = frozenset("br td th option".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_MAIN = frozenset(("article", "main"))
#: Names of regions that are not the article, in class, id or role.
_ASIDE = frozenset(
    "nav navbar navigation menu menubar header masthead footer sidebar aside notice notices cookie cookies consent banner ad ads advert adverts advertisement advertising sponsor "
    "sponsored promo promotion comment comments disqus respond share sharing social related recommended breadcrumb breadcrumbs pagination pager newsletter subscribe signup login "
    "search popup modal widget toolbar copyright contentinfo complementary".split()
)
_POSITION = frozenset("site page main top bottom left right primary secondary global bar box slot list section area block container wrapper wrap form links item unit inner outer".split())
OUTSIDE, INSIDE, MARKED = 0, 1, 2


def _names_region(token: str) -> bool:
    parts = [p for p in re.split(r"[-_]+", re.sub(r"\d+$", "", token.lower())) if p]
    return any(p in _ASIDE for p in parts) and all(p in _ASIDE or p in _POSITION or p.isdigit() for p in parts)


def _marked(attributes: str) -> bool:
    return any(_names_region(w) for m in _NAMED.finditer(attributes) for w in (m[1] or m[2] or m[3] or "").split())


def lines(page: str | None) -> tuple[list[str], list[int]]:
    """The lines of a page in order, and where each stands: OUTSIDE, INSIDE (an article or main element) or MARKED."""
    texts: list[str] = []
    places: list[int] = []
    parts: list[str] = []
    aside: list[str] = []  # what stood before an inline region began
    region, depth, inside, any_main = "", 0, 0, False

    def end_line() -> None:
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            texts.append(text)
            places.append(MARKED if region else INSIDE if inside else OUTSIDE)
        parts.clear()

    def end_region() -> None:
        nonlocal region, depth
        end_line()
        region, depth = "", 0
        parts.extend(aside)
        aside.clear()

    page, at = page or "", 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        name = m[4] or m[7]
        if not name:
            continue
        name, closing, attributes = name.lower(), bool(m[3] or m[6]), (m[5] or m[8] or "")
        if region:
            if name == region:
                depth += -1 if closing else 0 if attributes.endswith("/") else 1
            never_closed = name in _MAIN and not closing and not any_main and region not in _MAIN and not _marked(attributes) or name == "body" and (region == "head" or closing) or region in ("p", "li") and name in _BLOCK and not closing
            if depth == 0 or never_closed:
                end_region()
                if closing or not never_closed:
                    continue
            else:
                if name in _BLOCK:
                    end_line()
                elif name in _SPACE:
                    parts.append(" ")
                continue
        if name in _BLOCK:
            end_line()
        elif name in _SPACE:
            parts.append(" ")
        if closing:
            if name in _MAIN and inside:
                inside -= 1
            continue
        if name not in _VOID and not attributes.endswith("/") and ((name in _REGION and not (name == "header" and inside)) or (name not in ("html", "body") and attributes and _marked(attributes))):
            if name not in _BLOCK:
                aside.extend(parts)
                parts.clear()
            region, depth = name, 1
        elif name in _MAIN and not attributes.endswith("/"):
            inside, any_main = inside + 1, True
    parts.append(page[at:])
    end_line()
    if aside:
        parts.extend(aside)
        region = ""
        end_line()
    return texts, places


def common(a: list, b: list) -> list[int]:
    """The places in a of a longest common subsequence of a and b, bit-parallel; every sqrt(len(a))-th row is kept."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    own, other = a[head : len(a) - tail], b[head : len(b) - tail]
    where: dict = {}
    for j, x in enumerate(other):
        where[x] = where.get(x, 0) | 1 << j
    middle: list[int] = []
    if not where.keys().isdisjoint(own):
        every, full = math.isqrt(len(own)) + 1, (1 << len(other)) - 1

        def after(row: int, x) -> int:
            hit = row & where.get(x, 0)
            return ((row + hit) | (row - hit)) & full

        kept, row = [full], full  # row i has a 0 wherever a column adds to the best of own[:i]
        for i, x in enumerate(own):
            row = after(row, x)
            if (i + 1) % every == 0:
                kept.append(row)
        i, j, first, rows = len(own), len(other), len(own) + 1, []
        while i and j:
            if i <= first:  # the rows from the one kept before own[i - 1] to this one
                first = (i - 1) // every * every
                rows = [kept[first // every]]
                for x in own[first:i]:
                    rows.append(after(rows[-1], x))
            if rows[i - first] >> (j - 1) & 1:
                j -= 1
                continue
            i -= 1
            if not i or rows[i - first] >> (j - 1) & 1:
                j -= 1
                middle.append(head + i)
    return [*range(head), *reversed(middle), *range(len(a) - tail, len(a))]


def shared(own: tuple, other: tuple) -> set[int]:
    """Places of own lines that a neighbour has too and that may go for it. Pages are (host, texts, places)."""
    same = common(own[1], other[1])
    copies = 20 * sum(len(own[1][i]) for i in same) > 17 * max(sum(map(len, page[1])) for page in (own, other))
    return {i for i in same if own[2][i] == MARKED or own[2][i] == OUTSIDE and not copies}


def judged(own: tuple, *neighbours: tuple | None) -> tuple[str, int, int]:
    """The main text of a page, how many lines went because a neighbour has them, how many because of markup alone."""
    compared = [x for x in neighbours if x is not None and x[0] == own[0]]
    gone: set[int] = set().union(*[shared(own, x) for x in compared])
    only_inside = INSIDE in own[2] and not compared
    kept = [t for i, (t, at) in enumerate(zip(own[1], own[2], strict=True)) if i not in gone and at != MARKED and (at == INSIDE or not only_inside)]
    return "\n\n".join(kept), len(gone), len(own[1]) - len(gone) - len(kept)


def boundaries(keys: DataFrame, parts: int, each: int = 20, most: int = 100_000) -> list[Row]:
    """At most parts - 1 keys that cut the keys' order into parts of about one size, from a sample of bounded size. They decide
    where pages are worked on, and never what comes out."""
    order = keys.columns
    sample = keys.withColumn("chance", F.xxhash64(F.monotonically_increasing_id())).orderBy("chance").limit(min(each * parts, most)).drop("chance")
    rows = sample.orderBy(*order).collect()
    cuts = [rows[len(rows) * k // parts] for k in range(1, parts)] if rows else []
    return [r for k, r in enumerate(cuts) if not k or r != cuts[k - 1]]


def part_number(keys: DataFrame, cuts: list[Row]) -> Column:
    """How many of the sorted cuts are at most the row's key: first among every so many of them, then among those after it."""
    if not cuts:
        return F.lit(0)
    step = math.isqrt(len(cuts)) + 1
    fields = keys.schema.fields
    one = lambda r: F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r, fields, strict=True)])
    groups = [cuts[k : k + step] for k in range(0, len(cuts), step)]
    own = F.struct(*[f.name for f in fields])
    at_most = lambda column: F.size(F.filter(column, lambda x: x <= own))
    group = at_most(F.array(*[one(g[0]) for g in groups]))
    within = F.get(F.array(*[F.array(*[one(r) for r in g]) for g in groups]), F.greatest(group - 1, F.lit(0)))
    return F.when(group == 0, 0).otherwise((group - 1) * step + at_most(within)).cast("int")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: page_id, url, text, n_chars, n_shared (lines deleted by differencing), n_marked (by markup alone)."""
    address = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)([^?#]*)"
    url = F.coalesce(F.col(url_col), F.lit(""))
    path = F.rtrim(F.when(url.rlike(address), F.regexp_extract(url, address, 2)).otherwise(url), F.lit("/"))
    path = F.regexp_replace(F.regexp_replace(path, r"(\d+)", "000000000000$1"), r"\d*(\d{12})(?!\d)", "$1")  # near numbers are near
    named = pages.select(
        F.lower(F.regexp_extract(url, address, 1)).alias("host"), path.alias("path"), F.col(id_col).alias("page_id"), F.xxhash64(id_col, url_col, html_col).alias("key"), F.col(url_col).alias("url"),
        F.col(html_col).alias("html"),
    )
    order, parts = ["host", "path", "page_id", "key"], max(1, shuffles(pages))
    keys = named.select(*order)
    own = named.withColumn("part", part_number(keys, boundaries(keys, parts)))
    kind, id_type = named.schema["page_id"].dataType.simpleString(), _arrow(named.schema["page_id"].dataType)
    result = pa.schema([("page_id", id_type), ("url", pa.string()), ("text", pa.string()), ("n_shared", pa.int64()), ("n_marked", pa.int64())])
    schema = f"page_id {kind}, url string, text string, n_shared bigint, n_marked bigint"

    def inner(batches):
        """All pages of a part but the first and the last, each held against the pages beside it."""
        part = before = now = None
        out: list[tuple] = []
        size = 0
        for batch in batches:
            columns = [batch.column(c) for c in ("part", "host", "page_id", "url", "html")]
            for k in range(batch.num_rows):
                at, host, page_id, address, page = (c[k].as_py() for c in columns)
                if at != part:
                    part, before, now = at, None, None
                after = (page_id, address, (host, *lines(page)))
                if before is not None:
                    out.append((*now[:2], *judged(now[2], before[2], after[2])))
                    size += len(out[-1][2])
                    if size > 1_000_000:
                        yield _batch(out, result)
                        out, size = [], 0
                before, now = now, after
        if out:
            yield _batch(out, result)

    page_type = pa.struct([("page_id", id_type), ("url", pa.string()), ("host", pa.string()), ("texts", pa.list_(pa.string())), ("places", pa.list_(pa.int32()))])
    page_schema = f"struct<page_id:{kind},url:string,host:string,texts:array<string>,places:array<int>>"

    def parsed(batches):
        """Pages at the edges of parts, as lines."""
        for batch in batches:
            for r in batch.to_pylist():
                texts, places = lines(r["html"])
                page = {"page_id": r["page_id"], "url": r["url"], "host": r["host"], "texts": texts, "places": places}
                yield pa.RecordBatch.from_arrays([pa.array([r["part"]], pa.int32()), pa.array([r["up"]], pa.int32()), pa.array([r["down"]], pa.int32()), pa.array([page], page_type)], names=["part", "up", "down", "page"])

    def outer(batches):
        """The first and the last page of each part, held against the pages beside them, in their part or in the next one."""
        page = lambda x: x and (x["host"], x["texts"], x["places"])
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                alone = r["second"] is None
                out.append((r["first"]["page_id"], r["first"]["url"], *judged(page(r["first"]), page(r["before"]), page(r["after"] if alone else r["second"]))))
                if not alone:
                    out.append((r["last"]["page_id"], r["last"]["url"], *judged(page(r["last"]), page(r["last_but_one"]), page(r["after"]))))
            yield _batch(out, result)

    # The first two and the last two pages of every part: their keys, then their texts. Four rows a part.
    up, down = (F.row_number().over(Window.partitionBy("part").orderBy(*[f(c) for c in order])) for f in (F.asc, F.desc))
    keyed = own.select("part", *order)
    ends = [keyed.withColumn("nth", n).filter("nth <= 2") for n in (up, down)]
    none = F.lit(None).cast("int")
    edge = ends[0].select("part", *order, F.col("nth").alias("up"), none.alias("down")).unionByName(ends[1].select("part", *order, none.alias("up"), F.col("nth").alias("down")))
    edge = cut(edge.groupBy("part", *order).agg(F.collect_set("up").alias("up"), F.collect_set("down").alias("down")))
    hits = own.alias("a").join(F.broadcast(edge.alias("b")), [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("part", *order)])
    hits = hits.select("a.*", "b.up", "b.down").dropDuplicates(["part", *order])  # equal keys are one page's copies
    places = hits.select("page_id", "url", "host", "html", "part", F.explode(F.concat(F.transform("up", lambda n: F.struct(n.alias("up"), none.alias("down"))), F.transform("down", lambda n: F.struct(none.alias("up"), n.alias("down"))))).alias("at"))
    pages_at = cut(places.select("page_id", "url", "host", "html", "part", "at.*").mapInArrow(tidy(parsed), f"part int, up int, down int, page {page_schema}"))
    where = lambda c, n: F.max_by("page", F.when(F.col(c) == n, 1)).alias
    sides = pages_at.groupBy("part").agg(where("up", 1)("first"), where("up", 2)("second"), where("down", 2)("last_but_one"), where("down", 1)("last"))
    sides = cut(sides)
    filled = sorted(r[0] for r in sides.select("part").collect())  # at most a number for each part
    next_to = pages.sparkSession.createDataFrame(list(zip(filled, [None, *filled], [*filled[1:], None], strict=False)), "part int, before_part int, after_part int")
    met = sides.join(F.broadcast(next_to), "part")
    for side, page in (("before", "last"), ("after", "first")):
        met = met.join(sides.select(F.col("part").alias(f"{side}_part"), F.col(page).alias(side)), f"{side}_part", "left")
    found = own.repartitionById(parts, "part").sortWithinPartitions("part", *order).select("part", "host", "page_id", "url", "html").mapInArrow(tidy(inner), schema)
    found = found.unionByName(met.select("first", "second", "last_but_one", "last", "before", "after").mapInArrow(tidy(outer), schema))
    return found.select(F.col("page_id").alias(id_col), F.col("url").alias(url_col), "text", F.char_length("text").cast("bigint").alias("n_chars"), "n_shared", "n_marked")


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

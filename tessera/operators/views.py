"""What viewers and reports derive from results: shortened rows, badges, positions, fetched pages."""

from __future__ import annotations

import ipaddress
import urllib.parse
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions import web as W
from ..kernel import markup
from . import asof
from . import rows as R
from .style import aligned
from .table_diff import CATEGORIES, rank_of


def visible(df: DataFrame) -> DataFrame:
    """Columns whose metadata do not say hidden."""
    return df.select(*[F.col(f"`{f.name}`") for f in df.schema if not f.metadata.get("hidden")])


def short_columns(headers: list[str], least: int = 3) -> list[str]:
    """Merged headers without a prefix that at least ``least`` of them share."""
    prefix = lambda h: h.rpartition(" / ")[0]
    return [V.header_tail(h) if prefix(h) and sum(prefix(x) == prefix(h) for x in headers) >= least else h for h in headers]


def capped_cells(cells: Column, keys: list[str], most: int = 12) -> Column:
    """struct<shown, rest>: key cells first, then non-blank ones, ``most`` in all, and how many are left out (P10).

    ``cells`` is a map from name to text.
    """
    first = F.array(*[F.lit(k) for k in keys]).cast("array<string>")
    rest = F.filter(F.map_keys(cells), lambda k: ~F.array_contains(first, k) & ~V.is_blank(cells[k]))
    names = F.concat(first, rest)
    shown = F.transform(F.slice(names, 1, most), lambda k: F.concat_ws(": ", k, F.coalesce(cells[k], F.lit(""))))
    return F.struct(shown.alias("shown"), F.greatest(F.size(names) - most, F.lit(0)).alias("rest"))


def section(diff: DataFrame, view: str = "all") -> DataFrame:
    """Rows of one category or of all in report order."""
    some = diff if view == "all" else diff.where(F.col("category") == view)
    return some.withColumn("section", rank_of(F.col("category"))).orderBy("sheet", "section", "new_row", "old_row")


def badges(diff: DataFrame, sheets: DataFrame) -> DataFrame:
    """Differences of every sheet, zero where there are none."""
    n = diff.groupBy("sheet").agg(*[F.count_if(F.col("category") == c).alias(c) for c in CATEGORIES])
    return sheets.select("sheet").join(n, "sheet", "left").fillna(0, list(CATEGORIES)).withColumn("badge", F.col("added") + F.col("modified") + F.col("deleted"))


def pixel_width(width: Column, header: Column) -> Column:
    """Column width in pixels from its width in characters, else from its header."""
    from_header = F.length(header) * 14 + 24
    px = F.coalesce(F.floor(width * 7.5 + 12 + 0.5), from_header)
    return F.greatest(F.lit(56), F.least(F.lit(420), px)).cast("int")


def report_name(left: Column, right: Column, at: Column) -> Column:
    """Default name of a table report."""
    return F.concat_ws("-", left, right, F.lit("对比报告"), F.concat(F.date_format(at, "yyyyMMddHHmm"), F.lit(".xlsx")))


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over UTF-16 units in hexadecimal (F19); null counts as the empty text."""
    units = F.hex(F.encode(F.coalesce(text, F.lit("")), "UTF-16BE"))
    each = F.transform(F.sequence(F.lit(1), (F.length(units) / 4).cast("int")), lambda k: F.conv(F.substring(units, k * 4 - 3, F.lit(4)), 16, 10).cast("long"))
    each = F.when(F.length(units) > 0, each).otherwise(F.array().cast("array<bigint>"))
    step = lambda h, u: (h.bitwiseXOR(u) * F.lit(0x01000193)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.lower(F.hex(F.aggregate(each, F.lit(0x811C9DC5), step)))


def line_positions(items: DataFrame, by: str, page_top: Column) -> DataFrame:
    """Top and height of every line (X1): its highest item, and a line 0 at the very top."""
    t = F.col("transform")
    size = F.sqrt(t[2] * t[2] + t[3] * t[3])
    placed = items.withColumn("top", page_top - t[5] - size).withColumn("height", size * 1.2)
    first = F.row_number().over(Window.partitionBy(by, "line").orderBy("top"))
    lines = placed.withColumn("_n", first).where("_n = 1").select(by, F.col("line").cast("long").alias("line"), "top", "height")
    zero = lines.select(by).distinct().select(by, F.lit(0).cast("long").alias("line"), F.lit(0.0).alias("top"), F.lit(0.0).alias("height"))
    return zero.unionByName(lines)


def with_reach(lines: DataFrame, by: str) -> DataFrame:
    """Each line's distance to the next one, its own height for the last."""
    w = Window.partitionBy(by).orderBy("top", "line")
    return lines.withColumn("reach", F.coalesce(F.lead("top").over(w) - F.col("top"), F.col("height"))).withColumn("next_line", F.lead("line").over(w))


def inlined_styles(pages: DataFrame, assets: DataFrame) -> DataFrame:
    """Style sheets of each page (S27): id, css found in order, and the addresses that failed.

    ``pages``: id, url, html; ``assets``: url, css. An address is tried
    against the page and against the site's origin.
    """
    links = pages.select("id", "url", F.coalesce(W.site_origin(F.col("html")), F.lit("")).alias("site"), F.posexplode(W.css_links(F.col("html"))).alias("n", "href"))
    base = W.origin(F.col("url"))
    path = F.regexp_replace("href", "^/+", "")
    full = F.when(F.col("href").rlike("(?i)^https?://"), F.col("href")).when(F.col("href").startswith("//"), F.concat(F.lit("https:"), "href"))
    here = F.coalesce(full, F.when(F.col("href").startswith("/"), F.concat(base, path)).otherwise(F.concat(F.regexp_replace("url", "[^/]*$", ""), "href")))
    there = F.coalesce(full, F.concat("site", path))
    tried = links.withColumn("here", here).withColumn("there", there)
    a = assets.select(F.col("url").alias("here"), F.col("css").alias("css_a"))
    b = assets.select(F.col("url").alias("there"), F.col("css").alias("css_b"))
    met = tried.join(a, "here", "left").join(b, "there", "left").withColumn("css", F.coalesce("css_a", "css_b"))
    packed = F.array_sort(F.collect_list(F.struct("n", "href", "css")))
    per = met.groupBy("id").agg(packed.alias("p"))
    found, lost = F.filter("p", lambda x: x["css"].isNotNull()), F.filter("p", lambda x: x["css"].isNull())
    return per.select("id", F.array_join(F.transform(found, lambda x: x["css"]), "\n").alias("css"), F.transform(lost, lambda x: x["href"]).alias("failed"))


def blocks(pages: DataFrame) -> DataFrame:
    """Texts of the block elements of pages (id, html) in order (X15), whitespace collapsed."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(i, p["i"], " ".join(p["text"].split())) for i, h in f.itertuples(index=False) for p in markup.html_paragraphs(h)]
            yield pd.DataFrame(rows, columns=["id", "n", "text"])

    return pages.select("id", "html").mapInPandas(run, "id long, n int, text string")


def trimmed(pages: DataFrame, container: Column | None = None, tag: str | None = None, notes: Column | None = None) -> DataFrame:
    """Pages (id, html) with their container and what is around it alone (X16); see ``markup.trimmed``.

    ``container`` tells a page's id of it (default: the first known one that the markup has), ``tag`` what
    serves where there is no such element, ``notes`` an array of remarks.
    """
    named = W.container(F.col("html")) if container is None else container

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            cut = [markup.trimmed(h, c, tag, list(n) if n is not None else []) for h, c, n in zip(f["html"], f["container"], f["notes"], strict=True)]
            yield pd.DataFrame({"id": f["id"], "html": cut})

    said = F.lit(None).cast("array<string>") if notes is None else notes
    return pages.select("id", "html", named.alias("container"), said.alias("notes")).mapInPandas(run, "id long, html string")


def paragraph_positions(measured: DataFrame, texts: DataFrame, by: str, between: bool = True) -> DataFrame:
    """Positions of a text's paragraphs in the rendered document (X2): by, line, top, height, measured.

    ``measured``: by, i, text, top, height of the document's blocks in order.
    ``texts``: by, text; its paragraphs are parted by blank lines. Blocks and
    paragraphs of equal text are aligned in order and give a line its top.
    Where the first one lies below line 0, a line 0 stands at the very top,
    as high as the first (16 where that has no height). With ``between``,
    paragraphs that have no block lie between the aligned ones around them,
    by their lines. Documents without any aligned block have no positions.
    Ids must not be null; lines of equal top keep their order.
    """
    cut = R.paragraphs(texts, by)
    blocks_ = measured.select(by, "i", F.regexp_replace("text", "\u2003", "\t").alias("text"))
    pairs = aligned(blocks_, cut.select(by, F.col("para_no").alias("i"), F.col("paragraph").alias("text")), by)
    met = pairs.where("a IS NOT NULL AND e IS NOT NULL")
    tops = met.join(measured.select(by, F.col("i").alias("a"), "top", "height"), [by, "a"]).join(cut.select(by, F.col("para_no").alias("e"), "line"), [by, "e"])
    found = tops.select(by, "line", F.col("top").cast("double").alias("top"), F.col("height").cast("double").alias("height"), F.lit(True).alias("measured"))
    first = found.groupBy(by).agg(F.min_by("height", F.struct("top", "line")).alias("height"), F.min_by("line", F.struct("top", "line")).alias("at"))
    zero = first.where("at >= 1").select(by, F.lit(0).cast("long").alias("line"), F.lit(0.0).alias("top"), F.coalesce(F.nullif("height", F.lit(0.0)), F.lit(16.0)).alias("height"), F.lit(True).alias("measured"))
    index = found.unionByName(zero)
    if not between:
        return index
    left = cut.join(met.select(by, F.col("e").alias("para_no")), [by, "para_no"], "left_anti").join(first.select(by), by, "left_semi").select(by, F.col("line").alias("x"))
    placed = asof.interpolate(left, index.select(by, F.col("line").alias("l"), F.col("top").alias("r")), by)
    return index.unionByName(placed.select(by, F.col("x").alias("line"), F.col("y").alias("top"), F.lit(0.0).alias("height"), F.lit(False).alias("measured")))


# --- fetching -----------------------------------------------------------------------

Transport = Callable[[str, float, int], tuple[int, dict, bytes]]


def allowed(url: str, resolve: Callable[[str], list[str]]) -> str | None:
    """Why an address must not be fetched (S9); None if it may."""
    parts = urllib.parse.urlsplit(url)
    if parts.scheme not in ("http", "https") or not parts.hostname:
        return "only http and https"
    for ip in resolve(parts.hostname):
        a = ipaddress.ip_address(ip)
        a = getattr(a, "ipv4_mapped", None) or a
        if a.is_private or a.is_loopback or a.is_link_local or a.is_unspecified:
            return "private address"
    return None


def fetch_one(url: str, transport: Transport, resolve: Callable[[str], list[str]], timeout: float = 20.0, most: int = 8 << 20, hops: int = 5) -> dict:
    """One page over the transport (S8): every redirect is checked anew, sizes are bounded."""
    at = url
    for _ in range(hops + 1):
        if why := allowed(at, resolve):
            return {"url": url, "final_url": at, "status": 400, "content_type": None, "content": None, "error": why}
        try:
            status, headers, body = transport(at, timeout, most)
        except Exception as e:  # the transport's own failures become rows
            return {"url": url, "final_url": at, "status": 502, "content_type": None, "content": None, "error": str(e)}
        if status in (301, 302, 303, 307, 308) and headers.get("location"):
            at = urllib.parse.urljoin(at, headers["location"])
            continue
        if len(body) > most:
            return {"url": url, "final_url": at, "status": 502, "content_type": None, "content": None, "error": "too large"}
        bad = status >= 400
        return {"url": url, "final_url": at, "status": 502 if bad else status, "content_type": headers.get("content-type"), "content": None if bad else body, "error": f"upstream {status}" if bad else None}
    return {"url": url, "final_url": at, "status": 502, "content_type": None, "content": None, "error": "too many redirects"}


def fetched(urls: DataFrame, transport: Transport, resolve: Callable[[str], list[str]]) -> DataFrame:
    """Pages of the addresses (url), fetched where the rows are; the transport is the caller's."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([fetch_one(u, transport, resolve) for u in f["url"]], columns=["url", "final_url", "status", "content_type", "content", "error"])

    return urls.select("url").mapInPandas(run, "url string, final_url string, status int, content_type string, content binary, error string")

"""Addresses and markup of web pages as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ids of content containers, in order of preference.
CONTAINERS = ("content_zw", "vsb_content", "article_content", "zoom", "jzoom", "ccontent", "zoomcontent", "article", "content", "main")


def charset(content_type: Column, head: Column) -> Column:
    """Charset of the header, else of a meta tag in the first 4096 characters, else utf-8."""
    from_header = F.nullif(F.regexp_extract(F.lower(content_type), r"charset\s*=\s*[\"']?([a-z0-9_-]+)", 1), F.lit(""))
    from_meta = F.nullif(F.regexp_extract(F.lower(F.substring(head, 1, 4096)), r"<meta[^>]+charset\s*=\s*[\"']?([a-z0-9_-]+)", 1), F.lit(""))
    return F.coalesce(from_header, from_meta, F.lit("utf-8"))


def container(markup: Column, ids: tuple[str, ...] = CONTAINERS) -> Column:
    """The first of the ids that the markup has."""
    has = lambda i: F.contains(markup, F.lit(f'id="{i}"')) | F.contains(markup, F.lit(f"id='{i}'"))
    return F.coalesce(*[F.when(has(i), F.lit(i)) for i in ids])


def site_origin(markup: Column) -> Column:
    """Site of a saved page (S26): its meta tag, else the first official address, else the first host without scheme."""
    first = lambda p: F.nullif(F.regexp_extract(markup, p, 1), F.lit(""))
    meta = F.coalesce(first(r"(?i)<meta[^>]+name=[\"']SiteDomain[\"'][^>]+content=[\"']([^\"']+)"), first(r"(?i)<meta[^>]+content=[\"']([^\"']+)[\"'][^>]*name=[\"']SiteDomain[\"']"))
    host = F.coalesce(F.trim(meta), first(r"(?i)https?://([a-z0-9.-]+\.gov\.cn)"), first(r"(?i)[\"']//([a-z0-9.-]+)/"))
    return F.coalesce(F.concat(F.lit("https://"), host, F.lit("/")), F.lit(""))


def css_links(markup: Column) -> Column:
    """Addresses of linked style sheets, in order."""
    tags = F.regexp_extract_all(markup, F.lit(r"(?i)(<link\b[^>]*>)"), F.lit(1))
    sheets = F.filter(tags, lambda t: t.rlike(r"(?i)rel\s*=\s*[\"']?stylesheet"))
    return F.filter(F.transform(sheets, lambda t: F.regexp_extract(t, r"(?i)href\s*=\s*[\"']?([^\"'\s>]+)", 1)), lambda h: h != "")


def sanitized(markup: Column, base: Column | None = None) -> Column:
    """Markup without scripts and linked style sheets, with a base address."""
    x = F.regexp_replace(markup, r"(?is)<script\b.*?(</script\s*>|$)", "")
    x = F.regexp_replace(x, r"(?i)<link\b[^>]*rel\s*=\s*[\"']?stylesheet[^>]*>", "")
    if base is None:
        return x
    tag = F.concat(F.lit('<base href="'), base, F.lit('">'))
    opened = F.regexp_extract(x, r"(?i)(<head\b[^>]*>)", 1)
    return F.when(opened != "", F.replace(x, opened, F.concat(opened, tag))).otherwise(F.concat(tag, x))


def reference(text: Column) -> Column:
    """What a typed reference means (S29): an address, a saved page's path, or nothing."""
    t = F.trim(text)
    return F.when(t.rlike("^//"), F.concat(F.lit("https:"), t)).when(t.rlike("(?i)^https?://"), t).when(t.rlike(r"(?i)^([a-z]:[\\/]|/).*\.html?$"), t)


def file_kind(name: Column) -> Column:
    """Reader for a file (S2); old binary formats are rejected."""
    ext = F.lower(F.regexp_extract(name, r"\.([^.\\/]+)$", 1))
    return (
        F.when(name.rlike("(?i)^https?://") | ext.isin("html", "htm"), "web")
        .when(ext == "pdf", "pdf")
        .when(ext == "docx", "docx")
        .when(ext == "xlsx", "xlsx")
        .when(ext.isin("doc", "xls", "xlsm"), "rejected")
        .otherwise("text")
    )


def origin(url: Column) -> Column:
    """Scheme and host with a slash."""
    return F.concat(F.nullif(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)", 1), F.lit("")), F.lit("/"))


def parent(path: Column) -> Column:
    """The path without its last segment."""
    return F.regexp_replace(F.regexp_replace(path, r"[\\/]+$", ""), r"[\\/][^\\/]*$", "")

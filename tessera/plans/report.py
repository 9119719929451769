"""Reports: tables per category, workbooks, and self-contained HTML pages.

All are DataFrames of any size: files are rows (name, content) that executors
make and write (``sources.written``), one workbook or page per key, and
further volumes where a key has more rows than a file may hold.
"""

from __future__ import annotations

from collections.abc import Iterator
from html import escape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..kernel import align, ooxml
from ..operators import rows as R
from ..operators import table_diff as D
from ..options import NormOptions
from ..sources.written import write_files  # noqa: F401

#: Rows that a sheet of one report file may hold; more go to further volumes.
MOST_ROWS = 200_000
TITLES = {"above": "表头上方", "added": "新增", "modified": "修改", "deleted": "删除", "summary": "变更汇总", "overview": "总览"}


def added_table(diff: DataFrame, headers: list[str]) -> DataFrame:
    """Added rows with all columns of the new side."""
    return diff.where("category = 'added'").select("sheet", *[F.col("new_values")[h].alias(h) for h in headers], F.col("new_row").alias("新文件行号"))


def deleted_table(diff: DataFrame, headers: list[str]) -> DataFrame:
    """Deleted rows with all columns of the old side."""
    return diff.where("category = 'deleted'").select("sheet", *[F.col("old_values")[h].alias(h) for h in headers], F.col("old_row").alias("旧文件行号"))


def modified_table(diff: DataFrame, new: DataFrame, headers: list[str], row: str) -> DataFrame:
    """Modified rows (R2): every column, the old value right behind each column that changed anywhere, deleted ones, row numbers.

    The names of the changed columns are the only thing the driver sees; there
    are at most as many as columns. Cells fall back to the new row (X20).
    """
    changed = diff.where("category = 'modified'")
    names = {r[0] for r in changed.select(F.explode("changed_cols")).distinct().collect()}
    cells = new.select(F.col(row).cast("long").alias("new_row"), F.struct(*[F.col(f"`{h}`").cast("string").alias(h) for h in headers]).alias("cells"))
    joined = changed.join(cells, "new_row", "left")
    columns = []
    for h in headers:
        columns.append(F.coalesce(F.col("new_values")[h], F.col("cells")[h], F.lit("")).alias(h))
        if h in names:
            columns.append(F.when(F.array_contains("changed_cols", h), F.coalesce(F.col("old_values")[h], F.lit(""))).alias(D.OLD_MARK + h))
    columns += [F.col("old_values")[n].alias(n) for n in sorted(names) if n.startswith(D.OLD_MARK) and n.removeprefix(D.OLD_MARK) not in headers]
    return joined.select("sheet", *columns, F.array_join("changed_cols", "、").alias("变化情况"), F.col("new_row").alias("新文件行号"), F.col("old_row").alias("旧文件行号"))


def summary_table(diff: DataFrame, new: DataFrame, headers: list[str], keys: list[str], row: str) -> DataFrame:
    """All categories in one table (R4): rank, category, key columns first, the rest, row numbers; changed cells as ``old → new``."""
    cells = new.select(F.col(row).cast("long").alias("new_row"), F.struct(*[F.col(f"`{h}`").cast("string").alias(h) for h in headers]).alias("cells"))
    joined = diff.join(cells, "new_row", "left")
    order = [*keys, *(h for h in headers if h not in keys)]

    def cell(h: str) -> Column:
        old, now = F.coalesce(F.col("old_values")[h], F.lit("")), F.coalesce(F.col("new_values")[h], F.lit(""))
        changed = (F.col("category") == "modified") & F.array_contains("changed_cols", h)
        kept = F.when(F.col("category") == "deleted", old).otherwise(F.coalesce(F.col("cells")[h], now))
        return F.when(changed, F.concat(old, F.lit(" → "), now)).otherwise(kept).alias(h)

    return joined.select("sheet", D.rank_of(F.col("category")).alias("category_rank"), "category", *map(cell, order), F.col("new_row").alias("新文件行号"), F.col("old_row").alias("旧文件行号"))


def tables(diff: DataFrame, new: DataFrame, old_headers: list[str], new_headers: list[str], row: str, above: DataFrame | None = None) -> dict[str, DataFrame]:
    """All report tables by name (R1-R6); ``above``: rows above the header, as ``sources.office.above_rows`` gives them."""
    return ({"above": above} if above is not None else {}) | {
        "overview": D.overview(diff),
        "modified": modified_table(diff, new, new_headers, row),
        "added": added_table(diff, new_headers),
        "deleted": deleted_table(diff, old_headers),
        "summary": D.change_summary(diff).orderBy("category_rank", "new_row", "old_row"),
    }


def write_tables(found: dict[str, DataFrame], path: str, form: str = "parquet") -> None:
    """One folder per table below ``path`` (R8), distributed."""
    for name, df in found.items():
        df.write.mode("overwrite").format(form).save(f"{path}/{name}")


def _cells(found: dict[str, DataFrame], by: str | None) -> DataFrame:
    """All tables as one: book, sheet, at (its place), cells (texts in order of the columns)."""
    out = None
    for name, df in found.items():
        text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
        numbers = [F.coalesce(F.col(f"`{c}`").cast("long"), F.lit(-1)) for c in df.columns if c.endswith("行号")]
        cells = F.array(*map(text, df.columns))
        part = df.select((text(by) if by else F.lit("report")).alias("book"), F.lit(TITLES.get(name, name)).alias("sheet"), F.array(*numbers).cast("array<bigint>").alias("at"), cells.alias("cells"))
        out = part if out is None else out.unionByName(part)
    return out


def workbooks(found: dict[str, DataFrame], by: str | None = None, formats: DataFrame | None = None, most: int = MOST_ROWS) -> DataFrame:
    """The tables as workbooks (R8): name, content; one for each value of the column ``by``, which all have, or one for all.

    Rows stand by the row numbers they show, then by their cells. A sheet of
    more than ``most`` rows goes on in further volumes (``name-2.xlsx``);
    rows are numbered by a range sort, so a book that holds most rows is no
    task of its own until it is cut. ``formats`` (book, sheet, formats, as
    ``sources.office.formats_of`` gives them, fitted to the tables) restores
    those of a source (R7); columns without widths follow the content. Null
    keys are the empty name; an empty table gives no file.
    """
    headers = {TITLES.get(k, k): df.columns for k, df in found.items()}
    numbered = R.numbered(_cells(found, by), ["book", "sheet"], ["at", "cells"], "n")
    cut = numbered.select("book", F.floor(F.col("n") / most).cast("int").alias("volume"), "sheet", "n", "cells")
    if formats is not None:
        volumes = cut.select("book", "volume").distinct()
        told = formats.join(volumes, "book").select("book", "volume", "sheet", F.lit(-1).cast("long").alias("n"), F.array("formats").alias("cells"))
        cut = cut.unionByName(told)

    def make(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        book, volume = key
        f = f.sort_values("n", kind="stable")
        known = {s: ooxml.Formats.from_json(c[0]) for s, n, c in zip(f["sheet"], f["n"], f["cells"], strict=True) if n < 0}
        held = f[f["n"] >= 0]
        sheets = {s: (headers[s], [list(c) for c in held.loc[held["sheet"] == s, "cells"]]) for s in headers if (held["sheet"] == s).any()}
        name = "".join("_" if c in '\\/:*?"<>|' or ord(c) < 32 else c for c in book) + (f"-{volume + 1}" if volume else "")
        return pd.DataFrame({"name": [f"{name}.xlsx"], "content": [ooxml.write(sheets, formats=known)]})

    return cut.groupBy("book", "volume").applyInPandas(make, "name string, content binary")


STYLE = """body{font:14px/1.6 sans-serif;margin:24px}table{border-collapse:collapse;width:100%;table-layout:fixed}
td,th{border:1px solid #ddd;padding:2px 6px;white-space:pre-wrap;word-break:break-all;vertical-align:top;text-align:left}td.n{width:3em;color:#999;text-align:right}
tr.add{background:#eaffea}tr.remove{background:#ffecec}tr.change{background:#fffbe6}del{background:#fbb6b6}ins{background:#a6e9a6;text-decoration:none}
section{scroll-margin-top:16px}.side{position:fixed;right:8px;top:40%;display:flex;flex-direction:column;background:#fff;border:1px solid #ddd;padding:6px}
[hidden]{display:none}pre{white-space:pre-wrap}.bad{color:#b00}.ok{color:#070}"""
#: Every section shows one of its views; a click shows the same view of all, and the choice is remembered.
SCRIPT = """(()=>{const show=v=>document.querySelectorAll("[data-is]").forEach(e=>{e.hidden=e.dataset.is!==v});
document.addEventListener("click",e=>{const v=e.target.dataset&&e.target.dataset.show;if(v){show(v);try{localStorage.setItem("reportView",v)}catch(_){}}});
let v=null;try{v=localStorage.getItem("reportView")}catch(_){}show(["split","redline","raw"].includes(v)?v:"split")})()"""


def segments_html(segs: list, plain: str | None) -> str:
    if segs is None:
        return escape(plain or "")
    mark = {"rm": "del", "ad": "ins"}
    return "".join(f"<{mark[s['cls']]}>{escape(s['text'])}</{mark[s['cls']]}>" if s["cls"] in mark else escape(s["text"]) for s in segs)


def split_view(rows: list[dict]) -> str:
    """Both sides with their line numbers."""
    number = lambda n: str(n + 1) if n >= 0 else ""
    body = (
        f'<tr class="{r["type"]}"><td class="n">{number(r["li"])}</td><td>{segments_html(r["seg_l"], r["left_text"])}</td><td class="n">{number(r["ri"])}</td><td>{segments_html(r["seg_r"], r["right_text"])}</td></tr>'
        for r in rows
    )
    return f"<table>{''.join(body)}</table>"


def redline_view(rows: list[dict]) -> str:
    """One text: what went struck out, what came underlined, in the order of the lines."""

    def line(r: dict) -> str:
        if r["type"] == "change":
            return segments_html(align.redline(list(r["seg_l"]), list(r["seg_r"])), None)
        if r["type"] == "remove":
            return f"<del>{escape(r['left_text'])}</del>"
        return f"<ins>{escape(r['right_text'])}</ins>" if r["type"] == "add" else escape(r["left_text"])

    return "".join(f"<div>{line(r)}</div>" for r in rows)


def flow_rows(found: dict) -> list[dict]:
    """Whole-text segments as one changed row, for the same views."""
    same = all(s["cls"] == "eq" for s in [*found["seg_l"], *found["seg_r"]])
    plain = "".join(s["text"] for s in found["seg_l"])
    return [{"type": "equal" if same else "change", "li": 0, "ri": 0, "seg_l": found["seg_l"], "seg_r": found["seg_r"], "left_text": plain, "right_text": "".join(s["text"] for s in found["seg_r"])}]


def style_block(found: list | None) -> str:
    """Differences of styles as a table; none if they were not looked at."""
    if found is None:
        return ""
    if not len(found):
        return '<h3>样式核对</h3><p class="ok">0</p>'
    rows = "".join("<tr>" + "".join(f"<td>{escape(str(x[k]) if x[k] is not None else '')}</td>" for k in ("para", "prop", "expect", "actual")) + "</tr>" for x in found)
    return f'<h3>样式核对</h3><p class="bad">{len(found)}</p><table>{rows}</table>'


def section_html(anchor: str, label: str, left: str, right: str, raw: tuple[str, str] | None, styles: list | None, o: NormOptions, limit: int | None) -> tuple[str, str]:
    """One pair with its views (R9), and its summary."""
    if o.ignore_newline:
        found = align.flow(left, right, o, limit)
        message = f"-{found['removed_chars']} +{found['added_chars']}"
        rows = [] if found["skipped"] else flow_rows(found)
    else:
        rows = align.grid(left, right, o, limit=limit)
        n = {t: sum(r["type"] == t for r in rows) for t in ("change", "add", "remove")}
        message = f"修改 {n['change']} · 新增 {n['add']} · 删除 {n['remove']}" if any(n.values()) else "内容一致"
    before = align.grid(*raw, NormOptions(), limit=limit) if raw else []
    untouched = split_view(before) if raw else "<p>-</p>"
    buttons = "".join(f'<button type="button" data-show="{v}">{t}</button>' for v, t in (("split", "左右分栏"), ("redline", "Redline"), ("raw", "原始文本")))
    return (
        f'<section id="{anchor}"><h2>{label}</h2><p>{escape(message)}</p><p>{buttons}</p><div data-is="split">{split_view(rows)}</div>'
        f'<div data-is="redline" hidden>{redline_view(rows)}</div><div data-is="raw" hidden>{untouched}</div>{style_block(styles)}<a href="#top">↑</a></section>'
    ), message


def html_pages(pairs: DataFrame, by: str, o: NormOptions = NormOptions(), limit: int | None = align.PRODUCT_LIMIT) -> DataFrame:
    """A self-contained page (name, content) for each value of ``by`` (R9): contents, links, and every pair in three views.

    ``pairs``: ``by``, pair_id, left_name, right_name, left, right, and if
    known raw_left and raw_right (texts before tidying), styles (an array of
    para, prop, expect, actual, as ``style.style_diff`` gives them) and error (why there is no comparison).
    Pairs are compared each where it is; a page is put together of finished
    sections, in order of pair_id. Volumes keep a page's pairs few
    (``plans.task``). Pages of one pair have no contents.
    """
    optional = {"raw_left": "string", "raw_right": "string", "styles": "array<struct<para:int,prop:string,expect:string,actual:string>>", "error": "string"}
    more = [F.col(c) if c in pairs.columns else F.lit(None).cast(t).alias(c) for c, t in optional.items()]
    given = pairs.select(F.coalesce(F.col(by).cast("string"), F.lit("")).alias("page"), "pair_id", "left_name", "right_name", "left", "right", *more)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for page, p, ln, rn, left, right, raw_l, raw_r, styles, error in f.itertuples(index=False):
                label = f"{escape(ln or '')} ↔ {escape(rn or '')}"
                if error is not None:
                    html, message = f'<section id="pair-{p}"><h2>{label}</h2><p class="bad">对比失败 {escape(error)}</p><a href="#top">↑</a></section>', "对比失败"
                else:
                    raw = (raw_l or "", raw_r or "") if raw_l is not None or raw_r is not None else None
                    html, message = section_html(f"pair-{p}", label, left or "", right or "", raw, styles, o, limit)
                out.append((page, p, label, message, html))
                if len(out) >= 16:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            if out:
                yield pd.DataFrame(out, columns=names)

    names = ["page", "pair_id", "label", "message", "html"]
    sections = given.mapInPandas(run, "page string, pair_id long, label string, message string, html string")
    per = sections.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("pair_id", "label", "message", "html"))).alias("s"))
    link = lambda x: F.concat(F.lit('<a href="#pair-'), x["pair_id"].cast("string"), F.lit('">'), x["label"], F.lit("</a>"))
    many = F.size("s") > 1
    contents = F.when(many, F.concat(F.lit("<ol>"), F.array_join(F.transform("s", lambda x: F.concat(F.lit("<li>"), link(x), F.lit(" "), x["message"], F.lit("</li>"))), ""), F.lit("</ol>"))).otherwise("")
    side = F.when(many, F.concat(F.lit('<nav class="side"><a href="#top">顶部</a>'), F.array_join(F.transform("s", link), ""), F.lit('<a href="#bottom">底部</a></nav>'))).otherwise("")
    title = F.replace(F.replace(F.replace("page", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    head = F.concat(F.lit('<!DOCTYPE html><html><head><meta charset="utf-8"><title>'), title, F.lit(f'</title><style>{STYLE}</style></head><body><div id="top"></div><h1>'), title, F.lit("</h1>"))
    body = F.concat(head, side, contents, F.array_join(F.transform("s", lambda x: x["html"]), ""), F.lit(f'<div id="bottom"></div><script>{SCRIPT}</script></body></html>'))
    return per.select(F.concat(F.regexp_replace("page", r'[\\/:*?"<>|\x00-\x1F]', "_"), F.lit(".html")).alias("name"), body.cast("binary").alias("content"))

"""Queries on files: workbooks, documents and texts made from the tables and read again, reports, batch plans."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import CONFIG, DIFF_SQL, ORDER_COLUMNS, order_versions, query, table
from .functions import values as V
from .kernel import ooxml
from .operators import batch, table_diff
from .plans import report
from .plans.task import Task, compared_files, planned
from .sources import office, written
from .sources.cache import Cache
from .sources.scratch import shared_folder

FILE = "path string, content binary"
#: Rows of a table in one file.
PER_BOOK = 500


# --- workbooks of customers: a title, two header rows, the rows; and a sheet of notes ---------------

_BOOKS = f"""WITH b AS (SELECT *, c_custkey // {PER_BOOK} AS k, 'book-' || c_custkey // {PER_BOOK} || '.xlsx' AS book, (row_number() OVER (PARTITION BY c_custkey // {PER_BOOK} ORDER BY c_custkey) + 3)::INT AS row_no FROM customer),
books AS (SELECT k, book, count(*) AS n FROM b GROUP BY k, book),
c AS (SELECT book, 'customers' AS sheet, row_no, 1 AS col_no, c_custkey::VARCHAR AS text FROM b UNION ALL SELECT book, 'customers', row_no, 2, c_name FROM b UNION ALL SELECT book, 'customers', row_no, 3, c_nationkey::VARCHAR FROM b
  UNION ALL SELECT book, 'customers', 1, 1, 'Customers ' || k FROM books
  UNION ALL SELECT book, 'customers', r, j, x FROM books, (VALUES (2, 1, '客户'), (2, 2, '客户'), (2, 3, '地址'), (3, 1, '编号'), (3, 2, '名称'), (3, 3, '国')) v(r, j, x)
  UNION ALL SELECT book, 'notes', 1, j, x FROM books, (VALUES (1, 'k'), (2, 'v')) v(j, x) UNION ALL SELECT book, 'notes', 2, 1, 'size' FROM books UNION ALL SELECT book, 'notes', 2, 2, n::VARCHAR FROM books)
"""


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): a workbook for every 500 customer keys."""

    def make(f: pd.DataFrame) -> pd.DataFrame:
        k = int(f["k"].iloc[0])
        rows = f.sort_values("c_custkey")[["c_custkey", "c_name", "c_nationkey"]].astype(str).to_numpy().tolist()
        sheets = {"customers": ([f"Customers {k}"], [["客户", "客户", "地址"], ["编号", "名称", "国"], *rows]), "notes": (["k", "v"], [["size", str(len(rows))]])}
        wide = {"customers": ooxml.auto_widths(["Customers " + str(k), "", ""], [["客户", "客户", "地址"], ["编号", "名称", "国"], *rows])}
        return pd.DataFrame({"path": [f"book-{k}.xlsx"], "content": [ooxml.write(sheets, wide)]})

    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", F.floor(F.col("c_custkey") / PER_BOOK).alias("k"))
    return c.groupBy("k").applyInPandas(make, FILE)


def book_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return office.cells_of(books(spark, sf_dir), ["customers"])


@query(_BOOKS + "SELECT book, sheet, row_no::INT AS row_no, col_no::INT AS col_no, text FROM c")
def workbook_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return office.cells_of(books(spark, sf_dir))


@query(_BOOKS + "SELECT book, sheet, row_no::INT AS row_no, col_no::INT AS col_no, text FROM c WHERE row_no <= 10")
def workbook_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return office.cells_of(books(spark, sf_dir), max_rows=10)


@query(_BOOKS + "SELECT book, row_no, c_custkey::VARCHAR AS \"编号\", c_name AS \"名称\", c_nationkey::VARCHAR AS \"国\" FROM b")
def sheet_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = book_cells(spark, sf_dir)
    headers = ["客户 / 编号", "客户 / 名称", "地址 / 国"]
    out = office.sheet_rows(cells, office.header_cells(cells, 2, 3), 3)
    return out.select("book", "row_no", *[F.col("cells")[h].alias(V.header_tail(h)) for h in headers])


@query(_BOOKS + "SELECT book, 'customers' AS sheet, '客户 / 编号;客户 / 名称;地址 / 国' AS choices FROM books UNION ALL SELECT book, 'notes', 'size;' || n FROM books")
def key_column_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = office.column_choices(office.header_cells(office.cells_of(books(spark, sf_dir)), 2, 3))
    return out.select("book", "sheet", F.array_join("choices", ";").alias("choices"))


@query(_BOOKS + "SELECT book, sheet, CASE sheet WHEN 'customers' THEN 3 ELSE 1 END::INT AS header_row FROM (SELECT DISTINCT book, sheet FROM c)")
def header_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return office.guessed_headers(office.cells_of(books(spark, sf_dir), max_rows=10))


@query(_BOOKS + "SELECT book, 1::INT AS row_no, 'Customers ' || k AS title FROM books")
def above_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return office.above_rows(book_cells(spark, sf_dir), 2).select("book", "row_no", F.array_join("cells", ";").alias("title"))


@query(
    _BOOKS + ", w AS (SELECT book, col_no, greatest(8, least(60, max(CASE WHEN row_no IN (2, 3) THEN 2 * length(text) ELSE length(text) END))) + 2.5 AS w FROM c WHERE sheet = 'customers' GROUP BY book, col_no) "
    "SELECT book, max(w) FILTER (col_no = 1)::DOUBLE AS w1, max(w) FILTER (col_no = 2)::DOUBLE AS w2, max(w) FILTER (col_no = 3)::DOUBLE AS w3, 1::INT AS freeze_rows, 0::INT AS freeze_columns FROM w GROUP BY book"
)
def sheet_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = office.meta_of(books(spark, sf_dir)).where("sheet = 'customers'")
    return m.select("book", *[F.col("widths")[i].alias(f"w{i}") for i in (1, 2, 3)], "freeze_rows", "freeze_columns")


@query(
    "SELECT 'f' || s_suppkey AS path, CASE s_suppkey % 4 WHEN 0 THEN 'f' || s_suppkey || ': the file is empty' WHEN 1 THEN 'f' || s_suppkey || ': the file is cut short (2 bytes)' WHEN 2 THEN 'f' || s_suppkey || ': not an Office Open XML file' END AS error FROM supplier"
)
def file_head_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey") % 4
    content = F.when(k == 0, "").when(k == 1, "PK").when(k == 2, "<html>").otherwise("PKxyz").cast("binary")
    return office.head_errors(table(spark, sf_dir, "supplier").select(F.concat(F.lit("f"), F.col("s_suppkey").cast("string")).alias("path"), content.alias("content")))


def typed_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): parts as cells of every kind: number, date, truth, formula, error."""

    def make(f: pd.DataFrame) -> pd.DataFrame:
        k = int(f["k"].iloc[0])
        plain = ooxml.write({"parts": (["x"], [])})
        rows = []
        for p in f.sort_values("p_partkey").itertuples(index=False):
            r = len(rows) + 1
            serial = 40000 + p.p_size + (p.p_partkey % 3) * 0.25
            rows.append(
                f'<row r="{r}"><c r="A{r}"><v>{p.p_partkey}</v></c><c r="B{r}"><v>{p.p_retailprice!r}</v></c><c r="C{r}" s="1"><v>{serial!r}</v></c>'
                f'<c r="D{r}" t="b"><v>{p.p_partkey % 2}</v></c><c r="E{r}"><f>A{r}+1</f></c><c r="F{r}" t="e"><v>#N/A</v></c></row>'
            )
        out = io.BytesIO()
        with zipfile.ZipFile(io.BytesIO(plain)) as z, zipfile.ZipFile(out, "w") as w:
            for name in z.namelist():
                body = z.read(name).decode()
                if name == "xl/styles.xml":
                    body = body.replace("</cellStyleXfs>", '</cellStyleXfs><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs>', 1).split("<cellXfs count=\"2\"><xf/>")[0] + "</styleSheet>"
                elif name.startswith("xl/worksheets/"):
                    body = body.split("<sheetData>")[0] + f"<sheetData>{''.join(rows)}</sheetData></worksheet>"
                w.writestr(name, body)
        return pd.DataFrame({"path": [f"parts-{k}.xlsx"], "content": [out.getvalue()]})

    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.col("p_retailprice").cast("double").alias("p_retailprice"), F.floor(F.col("p_partkey") / PER_BOOK).alias("k"))
    return p.groupBy("k").applyInPandas(make, FILE)


@query(
    f"WITH p AS (SELECT *, p_retailprice::DOUBLE AS x, DATE '1899-12-30' + (40000 + p_size)::INT AS d, row_number() OVER (PARTITION BY p_partkey // {PER_BOOK} ORDER BY p_partkey) AS r FROM part) "
    "SELECT p_partkey::VARCHAR AS key, CASE WHEN x = floor(x) THEN x::BIGINT::VARCHAR ELSE x::VARCHAR END AS number, strftime(d, '%Y-%m-%d') || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' 06:00' ELSE ' 12:00' END AS day, "
    "CASE WHEN p_partkey % 2 = 1 THEN 'TRUE' ELSE 'FALSE' END AS truth, '=A' || r || '+1' AS formula, '#N/A' AS error FROM p"
)
def typed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = office.cells_of(typed_books(spark, sf_dir))
    per = cells.groupBy("book", "row_no").agg(F.map_from_entries(F.collect_list(F.struct("col_no", "text"))).alias("c"))
    return per.select(*[F.col("c")[i].alias(n) for i, n in enumerate(("key", "number", "day", "truth", "formula", "error"), 1)])


# --- documents and texts ------------------------------------------------------------------------------


@query("SELECT 'n' || n_nationkey || '.docx' AS doc, i::INT AS para_no, CASE i WHEN 0 THEN n_name WHEN 1 THEN '' ELSE 'in ' || r_name END AS text FROM nation JOIN region ON n_regionkey = r_regionkey, range(0, 3) g(i)")
def document_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of three paragraphs, the second one blank."""

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                data = io.BytesIO()
                with zipfile.ZipFile(data, "w") as z:
                    z.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:body><w:p><w:r><w:t>{r.n_name}</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>in </w:t></w:r><w:r><w:t>{r.r_name}</w:t></w:r></w:p></w:body></w:document>')
                out.append((f"n{r.n_nationkey}.docx", data.getvalue()))
            yield pd.DataFrame(out, columns=["path", "content"])

    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    found = n.select("n_nationkey", "n_name", "r_name").mapInPandas(make, FILE)
    return office.paragraphs_of(office.parts_of(found))


@query("SELECT n_regionkey::INT AS region, string_agg(n_name, chr(10) ORDER BY n_name) || chr(10) AS text, sum(length(n_name) + 1)::BIGINT AS length, 'txt' AS ext FROM nation GROUP BY n_regionkey")
def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of each region's nations as a text file in a folder of its own, listed and read back."""
    path = shared_folder(spark, "texts")
    n = table(spark, sf_dir, "nation").select("n_regionkey", "n_name").repartition("n_regionkey").sortWithinPartitions("n_regionkey", "n_name")
    n.write.partitionBy("n_regionkey").text(path)
    listed = office.files(spark, path, "*.txt").select("path", "ext", "length")
    read = office.texts(spark, path, "*.txt")
    region = F.regexp_extract("path", r"n_regionkey=(\d+)", 1).cast("int").alias("region")
    return listed.select(region, "length", "ext").join(read.select(region, "text"), "region")


@query("SELECT c_custkey, 'c' || c_custkey || '.TXT' AS name, 'txt' AS ext, strlen(c_name || 'é')::BIGINT AS length FROM customer")
def held_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    held = office.held(table(spark, sf_dir, "customer").select(F.concat(F.lit("/in/memory/c"), key, F.lit(".TXT")).alias("ref"), F.concat("c_name", F.lit("é")).alias("bytes")), "ref", "bytes")
    return held.select(F.regexp_extract("name", r"(\d+)", 1).cast("long").alias("c_custkey"), "name", "ext", "length")


# --- reports of the order comparison -------------------------------------------------------------------

_SIDE = ", ".join(f"coalesce(%s.{c}, '') AS {c}" for c in ORDER_COLUMNS)


def order_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    old, new = (v.withColumn("row", F.col("id").cast("long")) for v in order_versions(spark, sf_dir))
    return report.tables(table_diff.table_diff(old, new, CONFIG, row="row"), new, list(ORDER_COLUMNS), list(ORDER_COLUMNS), "row")


def _filled(df: DataFrame) -> DataFrame:
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) if t == "string" else F.col(f"`{c}`").cast("long").alias(c) for c, t in df.dtypes])


@query(DIFF_SQL + "SELECT 'orders' AS sheet, " + _SIDE.replace("%s", "n") + ", n.id::BIGINT AS \"新文件行号\" FROM diff d JOIN new_t n ON n.id = d.key WHERE category = 'added'")
def report_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filled(order_tables(spark, sf_dir)["added"])


@query(DIFF_SQL + "SELECT 'orders' AS sheet, " + _SIDE.replace("%s", "o") + ", o.id::BIGINT AS \"旧文件行号\" FROM diff d JOIN old_t o ON o.id = d.key WHERE category = 'deleted'")
def report_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filled(order_tables(spark, sf_dir)["deleted"])


@query(
    DIFF_SQL + "SELECT 'orders' AS sheet, n.id, coalesce(n.status, '') AS status, n.price, o.price AS \"旧_price\", n.day, coalesce(n.note, '') AS note, 'price' AS \"变化情况\", n.id::BIGINT AS \"新文件行号\", o.id::BIGINT AS \"旧文件行号\" "
    "FROM diff d JOIN new_t n ON n.id = d.key JOIN old_t o ON o.id = d.key WHERE category = 'modified'"
)
def report_modified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only prices change in a way that counts, so only they have a column of old values."""
    return _filled(order_tables(spark, sf_dir)["modified"])


@query(
    "WITH s AS (SELECT s_nationkey::VARCHAR AS book, s_suppkey::VARCHAR AS id, s_suppkey AS k FROM supplier) "
    "SELECT book, '新增' AS sheet, count(*)::BIGINT AS n, min(id) AS first, max(k)::BIGINT AS last_row FROM s WHERE k % 5 = 0 GROUP BY book UNION ALL SELECT book, '删除', count(*), min(id), max(k) FROM s WHERE k % 7 = 0 AND k % 5 <> 0 GROUP BY book"
)
def report_workbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report per nation as a workbook, all written by executors and read again."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), "s_name", F.col("s_nationkey").cast("string").alias("nation"), F.col("s_suppkey").alias("row"))
    old, new = s.where("row % 5 <> 0"), s.where("row % 7 <> 0 OR row % 5 = 0")
    columns = ["id", "s_name", "nation"]
    found = report.tables(table_diff.table_diff(old, new, row="row"), new, columns, columns, "row")
    path = shared_folder(spark, "reports")
    written.write_files(report.workbooks({k: found[k] for k in ("added", "deleted")}, by="nation"), path)
    cells = office.workbook_cells(spark, path).where("row_no > 1 AND col_no IN (2, 5)")
    rows_ = cells.groupBy("book", "sheet", "row_no").agg(F.max(F.when(F.col("col_no") == 2, F.col("text"))).alias("id"), F.max(F.when(F.col("col_no") == 5, F.col("text"))).cast("long").alias("at"))
    return rows_.groupBy(F.regexp_extract("book", r"([^/]+)\.xlsx$", 1).alias("book"), "sheet").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.max("at").alias("last_row"))


@query(
    "SELECT 'old_only' AS sheet, 'deleted' AS category, count(*) AS n FROM nation UNION ALL SELECT 'new_only', 'added', count(*) FROM region UNION ALL "
    "SELECT 'both', CASE WHEN s_suppkey % 3 = 0 THEN 'modified' ELSE 'unchanged' END, count(*) FROM supplier GROUP BY ALL"
)
def workbook_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation").selectExpr("n_nationkey AS id", "n_name AS v"), table(spark, sf_dir, "region").selectExpr("r_regionkey AS id", "r_name AS v")
    s = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "s_name AS v")
    changed = s.withColumn("v", F.when(F.col("id") % 3 == 0, F.concat("v", F.lit("*"))).otherwise(F.col("v")))
    return table_diff.diff_counts(table_diff.workbook_diff({"both": s, "old_only": n}, {"both": changed, "new_only": r}))


# --- batch plans --------------------------------------------------------------------------------------------


@query(
    "WITH f AS (SELECT p_brand AS dir, CASE p_partkey % 10 WHEN 0 THEN 'left-' WHEN 1 THEN 'right-' ELSE 'note-' END || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN '.html' ELSE '.txt' END AS name FROM part), u AS (SELECT * FROM f WHERE name NOT LIKE '%.html'), "
    "p AS (SELECT a.dir, a.name AS \"left\", b.name AS \"right\" FROM u a JOIN u b ON a.dir = b.dir WHERE a.name LIKE 'left-%' AND b.name LIKE 'right-%'), "
    "v AS (SELECT *, ((row_number() OVER (PARTITION BY dir ORDER BY \"left\", \"right\") - 1) // 10 + 1)::INT AS volume FROM p) "
    "SELECT dir, \"left\", \"right\", volume, 'out/' || dir || CASE WHEN max(volume) OVER (PARTITION BY dir) > 1 THEN '-' || volume ELSE '' END AS output FROM v"
)
def batch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left and right files of every brand's folder; web pages take no part, and notes match neither pattern."""
    k = F.col("p_partkey")
    name = F.concat(F.when(k % 10 == 0, "left-").when(k % 10 == 1, "right-").otherwise("note-"), k.cast("string"), F.when(k % 3 == 0, ".html").otherwise(".txt"))
    files = table(spark, sf_dir, "part").select(F.col("p_brand").alias("dir"), name.alias("name"))
    plan = planned(spark, Task("t", "out", source={"root": "", "left": "left-*", "right": "right-*"}), files)
    return plan.select("dir", "left", "right", "volume", "output")


@query("SELECT sha1(concat_ws('|', p_name, p_size::VARCHAR, p_partkey::VARCHAR)) AS key, p_partkey, contains(list_extract(string_split_regex(p_type, '[- ]+'), -1), 'E') AS named FROM part")
def file_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(batch.file_key(F.col("p_name"), F.col("p_size"), F.col("p_partkey")).alias("key"), "p_partkey", batch.last_segment_has(F.col("p_type"), "E").alias("named"))


@query(_BOOKS + "SELECT 'book-' || k || '.xlsx' AS sheet, 3::INT AS header_start, 3::INT AS header_end, false AS only_old FROM books WHERE k % 2 = 0 UNION ALL SELECT 'book-' || k || '.xlsx', 1, 1, true FROM books WHERE k % 2 = 1")
def sheet_configuration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each book's customers as one sheet; the new workbook has those of even number."""
    cells = office.cells_of(books(spark, sf_dir), ["customers"], 10).withColumn("sheet", F.col("book")).withColumn("book", F.lit("b"))
    return office.sheet_configs(cells, cells.where(F.regexp_extract("sheet", r"(\d+)", 1).cast("int") % 2 == 0))


@query(
    DIFF_SQL + "SELECT 'orders' AS sheet, CASE category WHEN 'modified' THEN 0 WHEN 'added' THEN 1 WHEN 'deleted' THEN 2 ELSE 3 END::BIGINT AS category_rank, category, coalesce(n.id, o.id) AS id, "
    "coalesce(n.status, o.status, '') AS status, CASE category WHEN 'modified' THEN o.price || ' → ' || n.price WHEN 'deleted' THEN o.price ELSE n.price END AS price, CASE category WHEN 'deleted' THEN o.day ELSE n.day END AS day, "
    "coalesce(CASE category WHEN 'deleted' THEN o.note ELSE n.note END, '') AS note, coalesce(n.id::BIGINT, -1) AS \"新文件行号\", coalesce(o.id::BIGINT, -1) AS \"旧文件行号\" FROM diff d LEFT JOIN new_t n ON n.id = d.key LEFT JOIN old_t o ON o.id = d.key"
)
def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = (v.withColumn("row", F.col("id").cast("long")) for v in order_versions(spark, sf_dir))
    out = report.summary_table(table_diff.table_diff(old, new, CONFIG, row="row"), new, list(ORDER_COLUMNS), ["id"], "row")
    return out.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("" if t == "string" else -1)).cast("string" if t == "string" else "long").alias(c) for c, t in out.dtypes])


@query(
    "SELECT r_regionkey::VARCHAR AS book, (20 + r_regionkey)::DOUBLE AS w1, 12.5::DOUBLE AS w2, r_regionkey % 2 = 1 AS hidden, (30 + r_regionkey)::DOUBLE AS height, 1::INT AS freeze_rows, (r_regionkey % 3)::INT AS freeze_columns, "
    "'FF' || repeat(r_regionkey::VARCHAR, 6) AS fill, '0.00' AS number, 'center' AS alignment, true AS italic, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey)::BIGINT AS n FROM region"
)
def restored_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source workbook per region with its own widths, hidden columns, heights, panes and header styles, and those of the report made of it."""

    def source(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for k in f["r_regionkey"].astype(int):
                style = {"font": "<font><i/></font>", "fill": f'<fill><patternFill patternType="solid"><fgColor rgb="FF{str(k) * 6}"/></patternFill></fill>', "number": "0.00", "alignment": '<alignment horizontal="center"/>'}
                own = ooxml.Formats({1: 20.0 + k, 2: 12.5}, [2] if k % 2 else [], {1: 30.0 + k}, (1, k % 3), {1: style, 2: {"font": "<font><u/></font>"}})
                out.append((str(k), ooxml.write({"data": (["a", "b"], [["1", "2"]])}, formats={"data": own})))
            yield pd.DataFrame(out, columns=["path", "content"])

    regions = table(spark, sf_dir, "region").select("r_regionkey").mapInPandas(source, FILE)
    formats = office.formats_of(regions).select("book", F.lit("新增").alias("sheet"), "formats")
    n = table(spark, sf_dir, "nation").select("n_name", F.col("n_regionkey").cast("string").alias("region"), F.col("n_nationkey").alias("行号"))
    path = shared_folder(spark, "formats")
    written.write_files(report.workbooks({"added": n}, by="region", formats=formats), path)
    found = office.files(spark, path, "*.xlsx")
    told = office.formats_of(found).select("book", F.from_json("formats", "array<string>").alias("f"))
    first = F.from_json(F.col("f")[4], "array<array<string>>")[0][1]
    style = F.from_json(first, "map<string,string>")
    meta = office.meta_of(found)
    rows_ = office.cells_of(found).where("col_no = 1 AND row_no > 1").groupBy("book").agg(F.count(F.lit(1)).alias("n"))
    both = meta.join(told.select("book", style.alias("s")), "book").join(rows_, "book")
    return both.select(
        F.regexp_extract("book", r"([^/]+)\.xlsx$", 1).alias("book"), F.col("widths")[1].alias("w1"), F.col("widths")[2].alias("w2"), F.array_contains("hidden", 2).alias("hidden"), F.col("heights")[1].alias("height"), "freeze_rows", "freeze_columns",
        F.regexp_extract(F.col("s")["fill"], 'rgb="(\\w+)"', 1).alias("fill"), F.col("s")["number"].alias("number"), F.regexp_extract(F.col("s")["alignment"], 'horizontal="(\\w+)"', 1).alias("alignment"), F.contains(F.col("s")["font"], F.lit("<i")).alias("italic"), "n",
    )


@query("SELECT n_regionkey::VARCHAR || '.html' AS name, count(*)::BIGINT AS sections, count(*)::BIGINT AS links, sum(CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS struck, true AS complete FROM nation GROUP BY n_regionkey")
def report_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page per region with a pair for each nation, of which those of even number differ; written by executors and read again."""
    n = table(spark, sf_dir, "nation")
    right = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("about "), F.lower("n_name"))).otherwise(F.concat(F.lit("about "), "n_name"))
    pairs = n.select(F.col("n_regionkey").cast("string").alias("region"), F.col("n_nationkey").cast("long").alias("pair_id"), F.concat("n_name", F.lit(".txt")).alias("left_name"), F.lit("new.txt").alias("right_name"), F.concat(F.lit("about "), "n_name").alias("left"), right.alias("right"))
    path = shared_folder(spark, "pages")
    written.write_files(report.html_pages(pairs.withColumn("raw_left", F.col("left")), "region"), path)
    read = office.texts(spark, path, "*.html")
    count = lambda p: F.size(F.split("text", p, -1)).cast("long") - 1
    contents = F.size(F.split(F.regexp_extract("text", "(?s)<ol>(.*?)</ol>", 1), "<a href=", -1)).cast("long") - 1
    struck = F.size(F.filter(F.split("text", "<section ", -1), lambda x: F.regexp_extract(x, '(?s)data-is="redline"(.*?)data-is="raw"', 1).contains("<del>"))).cast("long")
    whole = F.col("text").contains('id="top"') & F.col("text").contains('id="bottom"') & F.col("text").contains("localStorage")
    return read.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), count("<section ").alias("sections"), contents.alias("links"), struck.alias("struck"), whole.alias("complete"))




@query("SELECT s_nationkey::VARCHAR AS book, 'all' AS name, '$A$2:$XFC$2025' AS area, '$A$2:$B$' || (count(*) + 1) AS narrowed FROM supplier GROUP BY s_nationkey UNION ALL SELECT s_nationkey::VARCHAR, 'first', '$B$1', '$B$1' FROM supplier GROUP BY s_nationkey")
def narrowed_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workbook per nation whose names reach far below and right of its suppliers."""

    def make(f: pd.DataFrame) -> pd.DataFrame:
        content = ooxml.write({"own data": (["key", "name"], f[["s_suppkey", "s_name"]].values.tolist()), "other": (["x"], [])}, areas={"all": "'own data'!$A$2:$XFC$2025", "first": "'own data'!$B$1", "sum": "1+2"})
        return pd.DataFrame({"path": [str(f["s_nationkey"].iloc[0])], "content": [content]})

    books_ = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey").groupBy("s_nationkey").applyInPandas(make, FILE)
    plain = lambda c: F.regexp_extract(c, "!(.*)$", 1).alias(c)
    return office.areas_of(books_).select("book", "name", plain("area"), F.regexp_replace(F.regexp_extract("narrowed", "!(.*)$", 1), r"^(\$B\$1):\$B\$1$", "$1").alias("narrowed"))


@query(
    "WITH b AS (SELECT s_nationkey::VARCHAR AS book, s_suppkey, s_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) + 1 AS r FROM supplier) "
    "SELECT book, 'names' AS sheet, r::INT AS row_no, 2::INT AS col_no, s_name AS text FROM b WHERE r <= 5 UNION ALL SELECT book, 'keys', r::INT, 2, s_suppkey::VARCHAR FROM b WHERE r <= 5 UNION ALL SELECT DISTINCT book, s, 1, 2, s FROM b, (VALUES ('names'), ('keys')) v(s)"
)
def split_workbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workbook per nation with two sheets, written, read as one partition per sheet, and no further than the second column of five rows."""

    def make(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("s_suppkey")
        content = ooxml.write({"names": (["n", "names"], [[k, v] for k, v in enumerate(f["s_name"])]), "keys": (["n", "keys"], [[k, v] for k, v in enumerate(f["s_suppkey"])])})
        return pd.DataFrame({"name": [f"{f['s_nationkey'].iloc[0]}.xlsx"], "content": [content]})

    path = shared_folder(spark, "split")
    written.write_files(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey").groupBy("s_nationkey").applyInPandas(make, "name string, content binary"), path)
    sheets = office.split_sheets(office.files(spark, path, "*.xlsx"))
    cells = office.cells_of(sheets.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "sheet"), max_rows=5, columns=[2])
    return cells.withColumn("book", F.regexp_extract("book", r"([^/]+)\.xlsx$", 1))


# --- files of a folder to counts ------------------------------------------------------------------------


@query(
    "WITH n AS (SELECT n_nationkey AS k, n_regionkey::VARCHAR AS dir, n_name, n_nationkey % 4 AS kind FROM nation), f AS (SELECT *, 'left-' || k || '.txt' AS l, 'right-' || k || CASE kind WHEN 0 THEN '.txt' WHEN 3 THEN '.doc' ELSE '.docx' END AS r FROM n), "
    "p AS (SELECT a.dir, a.l, b.r, a.k = b.k AS same, b.kind, ((row_number() OVER (PARTITION BY a.dir ORDER BY a.l, b.r) - 1) // 10 + 1)::INT AS volume FROM f a JOIN f b ON a.dir = b.dir) "
    "SELECT dir, l AS \"left\", r AS \"right\", volume, CASE WHEN kind > 1 THEN -1 WHEN kind = 0 AND same THEN 2 ELSE 1 END::BIGINT AS equal, CASE WHEN kind > 1 THEN -1 WHEN kind = 0 AND NOT same THEN 1 ELSE 0 END::BIGINT AS modified, CASE WHEN kind > 1 THEN -1 ELSE 0 END::BIGINT AS added, "
    "CASE WHEN kind > 1 THEN -1 WHEN kind = 1 THEN 1 ELSE 0 END::BIGINT AS removed, CASE kind WHEN 2 THEN r || ': ValueError' WHEN 3 THEN r || ': no reader for rejected files' ELSE '' END AS error FROM p"
)
def compared_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder per region: a text of each nation against texts, documents, broken documents and files of an old format, all written and read again."""

    def make(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        for f in frames:
            out = []
            for k, region, name in f.itertuples(index=False):
                text = f"same\n{name}".encode()
                data = io.BytesIO()
                with zipfile.ZipFile(data, "w") as z:
                    z.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:body><w:p><w:r><w:t>same</w:t></w:r></w:p></w:body></w:document>')
                end, content = ((".txt", text), (".docx", data.getvalue()), (".docx", b"<html>"), (".doc", text))[k % 4]
                out += [(f"{region}/left-{k}.txt", text), (f"{region}/right-{k}{end}", content)]
            yield pd.DataFrame(out, columns=["name", "content"])

    path = shared_folder(spark, "pairs")
    written.write_files(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", "n_name").mapInPandas(make, "name string, content binary"), path)
    found = compared_files(spark, Task("t", "out", source={"root": path, "left": "left-*", "right": "right-*"}))
    return found.withColumn("error", F.coalesce("error", F.lit(""))).fillna(-1, ["equal", "modified", "added", "removed"])


@query(
    "SELECT p_partkey AS id, p_partkey % 5 <> 0 AND p_size % 7 <> 0 AS hit, CASE WHEN p_partkey % 5 = 0 OR p_size % 7 = 0 THEN '' WHEN p_partkey % 3 = 0 AND p_partkey % 2 = 1 THEN 'new ' || p_name ELSE p_name END AS text FROM part"
)
def maintained_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of all parts, written twice: old ones expire, broken ones are rejected, each newer one that is whole takes its place."""
    p = table(spark, sf_dir, "part").withColumn("key", batch.file_key(F.col("p_name"), F.col("p_size"), F.col("p_partkey")))
    cache = Cache(spark, shared_folder(spark, "cache"), "key", valid=F.col("text") != "")
    at = lambda day: F.lit(f"2024-01-{day:02} 12:00:00").cast("timestamp")
    whole = F.when(F.col("p_size") % 7 != 0, F.col("p_name")).otherwise("")
    cache.upsert(p.select("key", whole.alias("text"), F.when(F.col("p_partkey") % 5 == 0, at(1)).otherwise(at(9)).alias("fetched_at")))
    newer = F.when((F.col("p_partkey") % 2 == 1) & (F.col("p_size") % 7 != 0), F.concat(F.lit("new "), "p_name")).otherwise("")
    cache.upsert(p.where("p_partkey % 3 = 0 AND p_partkey % 5 <> 0").select("key", newer.alias("text"), at(10).alias("fetched_at")), oldest=at(5))
    found = cache.lookup(p.select(F.col("p_partkey").alias("id"), "key"), at(10), hours=48)
    return found.select("id", "hit", F.coalesce("text", F.lit("")).alias("text"))

"""Workbooks and documents as DataFrames.

``register`` makes ``spark.read.format("tessera_xlsx")`` available; the other
readers start from Spark's binary file source, so they read whatever store
Spark reads.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from itertools import batched

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..kernel import markup, ooxml
from .written import opened

#: Rows that a reader hands on at a time.
BATCH = 20_000
CELLS = "book string, sheet string, row_no int, col_no int, text string"


def _each_file(files: DataFrame, make, schema: str) -> DataFrame:
    """Rows made from (path, content) of every file."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, content in f.itertuples(index=False):
                for rows in batched(make(path, bytes(content)), BATCH):
                    yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(run, schema)


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files below a path (S3, S5): path, name, ext, length, modificationTime, content."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return found.select("path", name.alias("name"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("ext"), "length", "modificationTime", "content")


def texts(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Whole files as UTF-8 text (S1): path, text."""
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def held(df: DataFrame, name: str, content: str) -> DataFrame:
    """Files that are held in a table instead of a store (S6), in the form of ``files``."""
    n = F.col(name)
    return df.select(n.alias("path"), F.element_at(F.split(n, "/"), -1).alias("name"), F.lower(F.regexp_extract(n, r"\.([^.]+)$", 1)).alias("ext"), F.octet_length(content).cast("long").alias("length"), F.lit(None).cast("timestamp").alias("modificationTime"), F.col(content).cast("binary").alias("content"))


def cells_of(found: DataFrame, sheets: list[str] | None = None, max_rows: int | None = None, columns: list[int] | None = None) -> DataFrame:
    """All cells of workbooks (path, content) as text (S10): book, sheet, row_no, col_no, text.

    Sheets are read row by row, no further than ``max_rows``, and only
    ``columns`` (from 1) become text; rows are handed on as they come.
    ``split_sheets`` before makes sheets of one workbook independent rows.
    """
    wanted = set(columns) if columns is not None else None

    def make(p: str, content: bytes) -> Iterator[tuple]:
        book = ooxml.Workbook(content, p)
        for name in sheets or book.sheet_names:
            if name in book.paths:
                for r, row in book.rows(name, max_rows, wanted):
                    for c, text in row.items():
                        yield p, name, r, c, text

    return _each_file(found, make, CELLS)


def split_sheets(found: DataFrame, sheets: list[str] | None = None) -> DataFrame:
    """Workbooks (path, content) with one sheet each, under the path of their source: path, sheet, content.

    Deal these rows anew to read the sheets of few large workbooks in parallel.
    """

    def make(p: str, content: bytes) -> Iterator[tuple]:
        book = ooxml.Workbook(content, p)
        for name in book.sheet_names:
            if sheets is None or name in sheets:
                yield p, name, book.alone(name)

    return _each_file(found, make, "path string, sheet string, content binary")


def areas_of(found: DataFrame) -> DataFrame:
    """Names for areas in workbooks (path, content) (S12): book, name, area, and the area cut to what its sheet uses."""

    def make(p: str, content: bytes) -> Iterator[tuple]:
        for row in ooxml.Workbook(content, p).areas():
            yield p, *row

    return _each_file(found, make, "book string, name string, area string, narrowed string")


def workbook_cells(spark: SparkSession, path: str, sheets: list[str] | None = None, max_rows: int | None = None, columns: list[int] | None = None) -> DataFrame:
    return cells_of(files(spark, path, "*.xlsx"), sheets, max_rows, columns)


def preview(spark: SparkSession, path: str, rows: int = 10) -> DataFrame:
    """The first rows of each sheet."""
    return workbook_cells(spark, path, max_rows=rows)


def head_errors(found: DataFrame) -> DataFrame:
    """Why files (path, content) are no workbooks (S11): path, error; null where they may be one. JVM only."""
    n, name = F.octet_length("content"), F.col("path")
    why = (
        F.when(F.coalesce(n, F.lit(0)) == 0, F.concat(name, F.lit(": the file is empty")))
        .when(n < 4, F.concat(name, F.lit(": the file is cut short ("), n.cast("string"), F.lit(" bytes)")))
        .when(F.hex(F.substring("content", 1, 2)) != "504B", F.concat(name, F.lit(": not an Office Open XML file")))
    )
    return found.select("path", why.alias("error"))


def header_cells(cells: DataFrame, header_start: int = 1, header_end: int | None = None) -> DataFrame:
    """Headers of each sheet (S15): book, sheet, col_no, header; parts of several rows joined, a number where there are none, repeats counted."""
    last = max(header_start, header_end or header_start)
    used = cells.where(F.trim("text") != "")
    width = used.groupBy("book", "sheet").agg(F.max("col_no").alias("width"))
    columns = width.select("book", "sheet", F.explode(F.sequence(F.lit(1), "width")).alias("col_no"))
    part = F.when(F.col("row_no").between(header_start, last), F.struct("row_no", F.trim("text").alias("t")))
    named = used.groupBy("book", "sheet", "col_no").agg(F.array_sort(F.collect_list(part)).alias("p"))
    full = columns.join(named, ["book", "sheet", "col_no"], "left")
    name = F.coalesce(F.nullif(F.array_join(F.transform("p", lambda x: x["t"]), " / "), F.lit("")), F.concat(F.lit("列"), F.col("col_no").cast("string")))
    seen = F.row_number().over(Window.partitionBy("book", "sheet", "name").orderBy("col_no"))
    return full.withColumn("name", name).withColumn("n", seen).select("book", "sheet", "col_no", F.when(F.col("n") == 1, F.col("name")).otherwise(F.concat_ws("#", "name", F.col("n").cast("string"))).alias("header"))


def column_choices(headers: DataFrame) -> DataFrame:
    """Names to pick key columns from (S18): each once, in order, blanks dropped: book, sheet, choices."""
    listed = headers.where(F.trim("header") != "").groupBy("book", "sheet").agg(F.array_sort(F.collect_list(F.struct("col_no", "header"))).alias("h"))
    return listed.select("book", "sheet", F.array_distinct(F.transform("h", lambda x: x["header"])).alias("choices"))


def sheet_rows(cells: DataFrame, headers: DataFrame, header_end: int = 1) -> DataFrame:
    """Rows below the header (S14): book, sheet, row_no, cells (header -> text); blank rows are passed over."""
    body = cells.where(F.col("row_no") > header_end).join(headers, ["book", "sheet", "col_no"])
    pairs = F.map_from_entries(F.collect_list(F.struct("header", "text")))
    return body.groupBy("book", "sheet", "row_no").agg(pairs.alias("cells"), F.max((F.trim("text") != "").cast("int")).alias("filled")).where("filled = 1").drop("filled")


def above_rows(cells: DataFrame, header_start: int) -> DataFrame:
    """Rows above the header (R5): book, sheet, row_no, cells (texts from the first column on)."""
    above = cells.where(F.col("row_no") < header_start)
    per = above.groupBy("book", "sheet", "row_no").agg(F.map_from_entries(F.collect_list(F.struct("col_no", "text"))).alias("m"), F.max("col_no").alias("width"))
    return per.select("book", "sheet", "row_no", F.transform(F.sequence(F.lit(1), "width"), lambda c: F.coalesce(F.col("m")[c], F.lit(""))).alias("cells"))


def guessed_headers(cells: DataFrame) -> DataFrame:
    """The most header-like of the first rows of each sheet's preview (S17): book, sheet, header_row."""
    filled = cells.where(F.trim("text") != "").withColumn("t", F.trim("text"))
    last = cells.groupBy("book", "sheet").agg(F.countDistinct("row_no").alias("n"))
    word = (~F.col("t").rlike(r"^[+-]?([0-9]|\.[0-9])")).cast("int")
    per = filled.groupBy("book", "sheet", "row_no").agg((F.count(F.lit(1)) + 2 * F.sum(word) + 10 * F.countDistinct("t") / F.count(F.lit(1))).alias("score"))
    tried = per.join(last, ["book", "sheet"]).where(F.col("row_no") <= F.least(F.lit(5), F.greatest(F.lit(1), F.col("n") - 1)))
    return tried.groupBy("book", "sheet").agg(F.max_by("row_no", F.struct("score", (-F.col("row_no")).alias("first"))).cast("int").alias("header_row"))


def sheet_table(spark: SparkSession, path: str, sheet: str, header_start: int = 1, header_end: int | None = None) -> DataFrame:
    """One sheet of the workbooks at a path as a table of texts (S14) with ``_book`` and ``_row``, its row numbers.

    The driver sees the headers, at most a sheet's columns; rows stay distributed.
    """
    end = max(header_start, header_end or header_start)
    cells = workbook_cells(spark, path, [sheet])
    headers = header_cells(cells, header_start, end)
    names = [r["header"] for r in headers.groupBy("header").agg(F.min("col_no").alias("n")).orderBy("n", "header").collect()]
    rows = sheet_rows(cells, headers, end)
    return rows.select(F.col("book").alias("_book"), F.col("row_no").cast("long").alias("_row"), *[F.coalesce(F.col("cells")[n], F.lit("")).alias(n) for n in names])


def meta_of(found: DataFrame) -> DataFrame:
    """Widths, hidden columns, heights, freeze and merges of each sheet of workbooks (path, content)."""

    def make(p: str, content: bytes) -> Iterator[tuple]:
        book = ooxml.Workbook(content, p)
        for name in book.sheet_names:
            s = book.sheet(name)
            freeze = s.freeze or (0, 0)
            yield p, name, s.widths, s.hidden, s.heights, freeze[0], freeze[1], s.merges

    schema = "book string, sheet string, widths map<int;double>, hidden array<int>, heights map<int;double>, freeze_rows int, freeze_columns int, merges array<string>"
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for p, content in f.itertuples(index=False):
                yield pd.DataFrame(list(make(p, bytes(content))), columns=names)

    return found.select("path", "content").mapInPandas(run, schema.replace(";", ","))


def formats_of(found: DataFrame, header_rows: int = 1) -> DataFrame:
    """What reports take over of each sheet (R7): book, sheet, formats (as ``ooxml.Formats`` writes them)."""

    def make(p: str, content: bytes) -> Iterator[tuple]:
        book = ooxml.Workbook(content, p)
        for name in book.sheet_names:
            yield p, name, book.formats(name, header_rows).to_json()

    return _each_file(found, make, "book string, sheet string, formats string")


def sheet_meta(spark: SparkSession, path: str) -> DataFrame:
    return meta_of(files(spark, path, "*.xlsx"))


def parts_of(found: DataFrame) -> DataFrame:
    """XML parts of documents (path, content) (S20): path, document, styles."""

    def make(p: str, content: bytes) -> Iterator[tuple]:
        if error := ooxml.head_error(content, p):
            raise ValueError(error)
        z = zipfile.ZipFile(io.BytesIO(content))
        yield p, z.read("word/document.xml").decode(), z.read("word/styles.xml").decode() if "word/styles.xml" in z.namelist() else None

    return _each_file(found, make, "path string, document string, styles string")


def document_parts(spark: SparkSession, path: str) -> DataFrame:
    return parts_of(files(spark, path, "*.docx"))


def document_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    return paragraphs_of(document_parts(spark, path))


def paragraphs_of(parts: DataFrame) -> DataFrame:
    """Plain paragraphs of documents (path, document) (S19): doc, para_no, text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for p, document in f.itertuples(index=False):
                texts = markup.docx_texts(document)
                yield pd.DataFrame({"doc": p, "para_no": range(len(texts)), "text": texts})

    return parts.select("path", "document").mapInPandas(run, "doc string, para_no int, text string")


def decoded(pages: DataFrame, content: str = "content", charset: str = "charset", into: str = "text") -> DataFrame:
    """Bytes decoded by each row's charset (S24); unknown ones as utf-8, bad bytes replaced."""

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for raw, name in zip(f[content], f[charset], strict=True):
                try:
                    out.append(None if raw is None else bytes(raw).decode(name or "utf-8", "replace"))
                except LookupError:
                    out.append(bytes(raw).decode("utf-8", "replace"))
            yield f.assign(**{into: out})

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema), f"`{into}` string"])
    return pages.mapInPandas(decode, schema)


class XlsxSource(DataSource):
    """``spark.read.format("tessera_xlsx").load(path)``: a workbook or a folder of them, in any store that Arrow knows.

    Options: ``sheet``, ``maxRows`` (per sheet), ``columns`` (numbers from 1,
    parted by commas). Each sheet is a partition; of a file only the parts of
    its sheet are read, as far as needed.
    """

    @classmethod
    def name(cls) -> str:
        return "tessera_xlsx"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema) -> DataSourceReader:
        return _XlsxReader(self.options)


class _Part(InputPartition):
    def __init__(self, file: str, sheet: str | None) -> None:
        self.file, self.sheet = file, sheet


class _XlsxReader(DataSourceReader):
    #: Files beyond which the sheets of a file share a partition, so that planning does not open every file.
    MANY = 256

    def __init__(self, options) -> None:
        self.path, self.sheet = options["path"], options.get("sheet")
        self.rows = int(options["maxRows"]) if options.get("maxRows") else None
        self.columns = {int(c) for c in options["columns"].split(",")} if options.get("columns") else None

    def _files(self) -> list[str]:
        from pyarrow import fs

        store, root = opened(self.path)
        if store.get_file_info(root).type != fs.FileType.Directory:
            return [root]
        return sorted(i.path for i in store.get_file_info(fs.FileSelector(root, recursive=True)) if i.is_file and i.extension.lower() == "xlsx")

    def partitions(self) -> list[_Part]:
        found = self._files()
        if self.sheet or len(found) > self.MANY:
            return [_Part(f, self.sheet) for f in found]
        store, _ = opened(self.path)
        out = []
        for f in found:
            with store.open_input_file(f) as data:
                out += [_Part(f, name) for name in ooxml.Workbook(data, f).sheet_names]
        return out

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("book", pa.string()), ("sheet", pa.string()), ("row_no", pa.int32()), ("col_no", pa.int32()), ("text", pa.string())])
        store, _ = opened(self.path)
        with store.open_input_file(partition.file) as data:
            book = ooxml.Workbook(data, partition.file)
            for name in [partition.sheet] if partition.sheet else book.sheet_names:
                cells = ((partition.file, name, r, c, text) for r, row in book.rows(name, self.rows, self.columns) for c, text in row.items())
                for rows in batched(cells, BATCH):
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(XlsxSource)


def sheet_configs(old: DataFrame, new: DataFrame) -> DataFrame:
    """What to compare of two workbooks' previews (T11): sheet, header_start, header_end, only_old.

    The sheets of both, the header guessed on the new side; a sheet that only
    the old one has starts at its first row.
    """
    a, b = old.select("sheet").distinct().withColumn("is_old", F.lit(True)), guessed_headers(new).select("sheet", "header_row")
    both = b.join(a, "sheet", "full_outer")
    start = F.coalesce("header_row", F.lit(1))
    return both.select("sheet", start.alias("header_start"), start.alias("header_end"), F.col("header_row").isNull().alias("only_old"))


def header_range(start: Column, end: Column, legacy_row: Column) -> Column:
    """struct<start, end> of a configured header (T9): rows from 1; the legacy row counts from 0; the end is no earlier than the start."""
    first = F.coalesce(F.when(start >= 1, start), F.when(legacy_row >= 0, legacy_row + 1), F.lit(1))
    return F.struct(first.alias("start"), F.when(end >= first, end).otherwise(first).alias("end"))

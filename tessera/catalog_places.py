"""Queries on places: marks on items, positions of paragraphs, pages cut to their container."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .catalog import query, table
from .catalog_texts import _MARKS, event_pairs, event_rows, thinned
from .functions import text as T
from .operators import interval, rows, text_diff, views


def lines_of(texts: DataFrame) -> DataFrame:
    """Lines with text of texts (pair_id, side, text), numbered from 1: pair_id, side, line, whole."""
    return rows.lines(texts).where("line <> ''").select("pair_id", "side", F.col("line_no").alias("line"), F.col("line").alias("whole"))


def items_of(size: int):
    """Items of ``size`` characters of a line, 40 lines to a page."""
    num = lambda c: c.cast("double")
    line = F.col("line")

    def item(s, k):
        place = F.array(F.lit(12.0), F.lit(0.0), F.lit(0.0), F.lit(12.0), num(k * size * 6), num(800 - 14 * (line % 40)))
        return F.struct(F.floor(line / 40).cast("int").alias("page"), (k * size).alias("col"), s.alias("str"), place.alias("transform"), num(F.length(s) * 6).alias("width"), F.lit(False).alias("ocr"))

    return F.transform(F.regexp_extract_all("whole", F.lit(f"(?s).{{1,{size}}}"), F.lit(0)), item)


_BOX = "round((6 * (col + \"begin\"))::DOUBLE, 6) AS x, round((800 - 14 * (line % 40) + 12 * 0.465 - 6)::DOUBLE, 6) AS y, round((6 * (\"end\" - \"begin\"))::DOUBLE, 6) AS width, 12.0::DOUBLE AS height"


def boxes(df: DataFrame) -> DataFrame:
    return df.select("pair_id", "side", "line", "page", "col", "cls", "begin", "end", *[F.round(c, 6).alias(c) for c in ("x", "y", "width", "height")])


@query(
    _MARKS + f", c AS (SELECT *, k * 5 AS col FROM (SELECT *, n + CASE WHEN type = 'change' AND side = 'right' THEN 1 ELSE 0 END AS size FROM (SELECT * FROM (SELECT m.* EXCLUDE (n), coalesce(n, length((SELECT any_value(d.right_text) FROM d WHERE d.pair_id = m.pair_id AND d.ri + 1 = m.line))) AS n FROM m))), range(0, 100) g(k) WHERE k * 5 < size), "
    "b AS (SELECT pair_id, side, line, (line // 40)::INT AS page, col::INT AS col, cls, CASE WHEN type = 'change' THEN n - col ELSE 0 END::INT AS \"begin\", CASE WHEN type = 'change' THEN n - col + 1 ELSE least(5, size - col) END::INT AS \"end\" FROM c WHERE CASE WHEN type = 'change' THEN side = 'right' AND n >= col AND n < col + 5 ELSE true END) "
    f"SELECT *, {_BOX} FROM b"
)
def marked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks of compared event texts on items of five characters."""
    pairs = event_pairs(spark, sf_dir)
    side = lambda s: F.struct(F.lit(s).alias("side"), F.col(s).alias("text"))
    texts = pairs.select("pair_id", F.inline(F.array(side("left"), side("right"))))
    return boxes(interval.marked_items(text_diff.marks(event_rows(spark, sf_dir)), lines_of(texts), items_of(5)))


@query(
    "WITH l AS (SELECT pair_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM (SELECT conv_id * 1000 + turn AS pair_id, text FROM conversations WHERE text IS NOT NULL)), "
    "s AS (SELECT *, string_split_regex(t, '[aeiou0-9]+') AS gaps, regexp_extract_all(t, '[aeiou0-9]+') AS hits FROM l), "
    "r AS (SELECT pair_id, line, t, list_sum(list_transform(gaps[1:k], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(hits[1:k - 1], lambda x: length(x))), 0)::BIGINT AS start, length(hits[k]) AS n FROM s, range(1, 100000) g(k) WHERE k <= len(hits)), "
    "c AS (SELECT pair_id, 'left' AS side, line::INT AS line, (line // 40)::INT AS page, (8 * k)::INT AS col, 'rm' AS cls, (greatest(start, 8 * k) - 8 * k)::INT AS \"begin\", (least(start + n, 8 * k + 8) - 8 * k)::INT AS \"end\" FROM r, range(0, 100000) g(k) WHERE 8 * k < length(t) AND start < 8 * k + 8 AND 8 * k < start + n) "
    f"SELECT *, {_BOX} FROM c"
)
def flow_marked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn against itself without vowels and digits, as whole texts; the marks on items of eight characters."""
    c = thinned(text_diff.dealt(table(spark, sf_dir, "conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn")), "id"), "id", "text")
    flow = text_diff.diff_flow(c, limit=None)
    return boxes(interval.marked_items(interval.flow_marks(flow), lines_of(c.select("pair_id", F.lit("left").alias("side"), F.col("left").alias("text"))), items_of(8)))


# --- positions of paragraphs -------------------------------------------------------------------------------


def numbered_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the number of each paragraph before it, so that no two are equal."""
    number = F.transform(F.split("text", "\n\n", -1), lambda p, i: F.concat(i.cast("string"), F.lit(" "), p))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(number, "\n\n").alias("text"))


@query(
    "WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS p, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) - 1 AS i FROM documents), "
    "h AS (SELECT *, length(p) - length(replace(p, chr(10), '')) AS n FROM p), "
    "q AS (SELECT doc_id, i, 1 + coalesce(sum(n + 2) OVER w, 0)::BIGINT AS line, coalesce(sum(18 * (n + 1) + 6) OVER w, 0)::DOUBLE AS top, (18 * (n + 1))::DOUBLE AS height FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), "
    "a AS (SELECT *, lag(line) OVER o AS l0, lag(top) OVER o AS t0, lead(line) OVER o AS l1, lead(top) OVER o AS t1 FROM q WINDOW o AS (PARTITION BY doc_id ORDER BY i)) "
    "SELECT doc_id, line, round(CASE WHEN i % 5 <> 3 THEN top WHEN l1 IS NULL THEN t0 + (line - l0) ELSE t0 + (line - l0) * (t1 - t0) / (l1 - l0) END, 6) AS top, CASE WHEN i % 5 <> 3 THEN height ELSE 0.0 END::DOUBLE AS height, i % 5 <> 3 AS measured FROM a "
    "UNION ALL SELECT doc_id, 0, 0.0, height, true FROM q WHERE i = 0"
)
def paragraph_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose rendered form differs in every fifth paragraph; lines and gaps have fixed heights."""
    texts = numbered_paragraphs(spark, sf_dir)
    cut = rows.paragraphs(texts, "doc_id").withColumn("height", (18 * (T.newlines(F.col("paragraph")) + 1)).cast("double"))
    number = F.col("para_no")
    above = Window.partitionBy("doc_id").orderBy("para_no").rowsBetween(Window.unboundedPreceding, -1)
    measured = cut.select("doc_id", number.alias("i"), F.when(number % 5 == 3, F.concat("paragraph", F.lit("!"))).otherwise(F.col("paragraph")).alias("text"), F.coalesce(F.sum(F.col("height") + 6).over(above), F.lit(0.0)).alias("top"), "height")
    return views.paragraph_positions(measured, texts, "doc_id").withColumn("top", F.round("top", 6))


@query()
def page_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of every page, 20 units apart, against the text of its blocks without every third."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "html")
    found = views.blocks(pages).withColumnRenamed("n", "i")
    texts = found.where("i % 3 <> 2").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("i", "text"))).alias("b")).select("id", F.array_join(F.transform("b", lambda x: x["text"]), "\n\n").alias("text"))
    measured = found.select("id", "i", "text", (F.col("i") * 20.0).alias("top"), F.lit(18.0).alias("height"))
    return views.paragraph_positions(measured, texts, "id")


# --- containers ---------------------------------------------------------------------------------------------


@query(
    "SELECT page_id AS id, CASE WHEN html LIKE '%<article>%</article>%' THEN regexp_extract(html, '(?s)^(.*?<body[^>]*>)', 1) || '<article class=\"web-page\">' || regexp_extract(html, '(?s)<article>(.*?</article>)', 1) || '</body></html>' ELSE html END AS html FROM pages"
)
def trimmed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page cut to its article."""
    return views.trimmed(table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "html"), tag="article")

"""Operators over ordered rows: runs, hunks, counters, lines, offsets.

Every window is partitioned by a document or pair, so no sort spans the table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import scratch


def runs(df: DataFrame, by: list[str], order: list[str], value: Column, into: str = "run") -> DataFrame:
    """Number maximal runs of equal ``value`` within a partition (gaps and islands)."""
    w = Window.partitionBy(*by).orderBy(*order)
    change = (~value.eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    # lag cannot stand inside another window function
    marked = df.withColumn("_change", change)
    return marked.withColumn(into, F.sum("_change").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_change")


def fold_runs(rows: DataFrame, by: list[str], order: str, equal: Column, least: int = 3) -> DataFrame:
    """Runs of at least ``least`` equal rows become one marker.

    Columns: by, order, folded, n; a marker stands at the first row of its run.
    """
    numbered = runs(rows.withColumn("_eq", equal), by, [order], F.col("_eq"))
    per = Window.partitionBy(*by, "run")
    sized = numbered.withColumn("_n", F.count(F.lit(1)).over(per)).withColumn("_first", F.min(order).over(per))
    fold = F.col("_eq") & (F.col("_n") >= least)
    kept = sized.where(~fold | (F.col(order) == F.col("_first")))
    return kept.select(*by, order, fold.alias("folded"), F.when(fold, F.col("_n")).otherwise(F.lit(1)).cast("long").alias("n"))


def change_hunks(rows: DataFrame, by: list[str], order: str, changed: Column, context: int = 3) -> DataFrame:
    """Runs of changed rows with context, merged where they touch (W3): by, start, stop.

    ``order`` counts from 0 without gaps.
    """
    per = Window.partitionBy(*by)
    last = rows.withColumn("_last", F.max(order).over(per)).withColumn("_c", changed)
    spans = runs(last, by, [order], F.col("_c")).where("_c").groupBy(*by, "run", "_last").agg(F.min(order).alias("a"), F.max(order).alias("b"))
    wide = spans.select(*by, F.greatest(F.col("a") - context, F.lit(0)).alias("a"), F.least(F.col("b") + context, F.col("_last")).alias("b"))
    w = Window.partitionBy(*by).orderBy("a")
    reach = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = wide.withColumn("_new", F.coalesce(F.col("a") > reach + 1, F.lit(True)).cast("int"))
    grouped = opened.withColumn("hunk", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*by, "hunk").agg(F.min("a").alias("start"), F.max("b").alias("stop"))


def running_counters(rows: DataFrame, by: list[str], order: list[str], left: Column, right: Column) -> DataFrame:
    """Numbers of left and right rows before each row."""
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    count = lambda c: F.coalesce(F.sum(c.cast("int")).over(before), F.lit(0)).cast("long")
    return rows.withColumn("left_before", count(left)).withColumn("right_before", count(right))


def lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per line, numbered from 1."""
    others = [c for c in docs.columns if c != text]
    return docs.select(*others, F.posexplode(T.split_lines(F.col(text))).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def line_offsets(docs: DataFrame, by: str, text: str = "text") -> DataFrame:
    """Start offset of each line-feed-separated line."""
    cut = docs.select(by, F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))
    w = Window.partitionBy(by).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return cut.select(by, (F.col("line_no") + 1).alias("line_no"), F.coalesce(F.sum(F.length("line") + 1).over(w), F.lit(0)).cast("long").alias("start"), F.length("line").alias("length"))


def paragraphs(docs: DataFrame, by: str, text: str = "text") -> DataFrame:
    """Paragraphs parted by blank lines with their first line (W6, D16); a last separator opens none."""
    t = F.regexp_replace(text, r"\n\n$", "")
    cut = docs.where(F.col(text) != "").select(by, F.posexplode(F.split(t, "\n\n", -1)).alias("para_no", "paragraph"))
    w = Window.partitionBy(by).orderBy("para_no").rowsBetween(Window.unboundedPreceding, -1)
    return cut.select(by, "para_no", "paragraph", (F.coalesce(F.sum(T.newlines(F.col("paragraph")) + 2).over(w), F.lit(0)) + 1).cast("long").alias("line"))


def sections(line_rows: DataFrame, by: str, heading: str) -> DataFrame:
    """Lines from one heading to the next as sections (P12); what precedes the first is dropped."""
    w = Window.partitionBy(by).orderBy("line_no")
    marked = line_rows.withColumn("section", F.sum(F.col("line").rlike(heading).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    per = marked.where("section > 0").groupBy(by, "section").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    label = F.left(T.collapse(F.col("l")[0]["line"]), F.lit(24))
    return per.select(by, "section", label.alias("label"), F.size("l").alias("n_lines"), F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("body"))


def flow_lines(segments: DataFrame, by: str, order: str) -> DataFrame:
    """Segments (text, cls) cut at line feeds, with running line numbers."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    at = segments.withColumn("_before", F.coalesce(F.sum(T.newlines(F.col("text"))).over(w), F.lit(0)))
    return at.select(by, order, "cls", "_before", F.posexplode(F.split("text", "\n", -1)).alias("part", "text")).select(by, (F.col("_before") + F.col("part") + 1).cast("long").alias("line_no"), order, "part", "cls", "text")


def merge_runs(rows: DataFrame, by: list[str], order: list[str], style: list[str], text: str = "text") -> DataFrame:
    """Neighbouring runs of equal style as one."""
    numbered = runs(rows, by, order, F.struct(*style))
    packed = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_t"))))
    return numbered.groupBy(*by, "run", *style).agg(packed.alias("_p")).select(*by, "run", *style, F.array_join(F.transform("_p", lambda x: x["_t"]), "").alias(text), F.size("_p").alias("n_merged"))


def weighted_mode(rows: DataFrame, by: list[str], order: list[str], value: str, weight: Column) -> DataFrame:
    """The value with most weight; of ties the one that reached its sum first."""
    w = Window.partitionBy(*by).orderBy(*order)
    at = rows.withColumn("_at", F.row_number().over(w)).withColumn("_w", weight).where(F.col(value).isNotNull() & (F.col("_w") > 0))
    tally = at.groupBy(*by, value).agg(F.sum("_w").alias("total"), F.max("_at").alias("_last"))
    best = F.min(F.struct((-F.col("total")).alias("a"), F.col("_last").alias("b"), F.col(value).alias("v"), F.col("total").alias("t")))
    return tally.groupBy(*by).agg(best.alias("m")).select(*by, F.col("m.v").alias(value), F.col("m.t").alias("total"))


def history(rows: DataFrame, by: list[str], order: list[str], same: list[str], most: int = 100) -> DataFrame:
    """Entries unlike their predecessor, the newest ``most``."""
    w = Window.partitionBy(*by).orderBy(*order)
    key = F.struct(*same)
    new = rows.withColumn("_new", ~key.eqNullSafe(F.lag(key).over(w)) | (F.row_number().over(w) == 1)).where("_new").drop("_new")
    back = Window.partitionBy(*by).orderBy(*[F.col(c).desc() for c in order])
    return new.withColumn("rank", F.row_number().over(back)).where(F.col("rank") <= most)


def latest(rows: DataFrame, by: list[str], order: list[str], most: int) -> DataFrame:
    """The newest ``most`` rows of each partition."""
    w = Window.partitionBy(*by).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def first_per_key(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def reading_order(items: DataFrame, by: str, top: str = "top", left: str = "left", height: str = "height") -> DataFrame:
    """Lines of a page in reading order (W10): a gap of over half the upper median height starts a line."""
    sizes = items.groupBy(by).agg(F.array_sort(F.collect_list(height)).alias("_h")).select(by, F.element_at("_h", (F.floor(F.size("_h") / 2) + 1).cast("int")).alias("_median"))
    w = Window.partitionBy(by).orderBy(top, left)
    gap = F.col(top) - F.lag(top).over(w) > F.col("_median") * 0.5
    marked = items.join(sizes, by).withColumn("_new", F.coalesce(gap, F.lit(False)).cast("int"))
    at = marked.withColumn("line", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return at.withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy("line", left, top))).drop("_median", "_new")


def text_positions(items: DataFrame, by: list[str], order: list[str], text: str = "str", eol: str = "has_eol") -> DataFrame:
    """Running line and column of text items (S22); a page boundary is a line end."""
    w = Window.partitionBy(*by).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    lined = items.withColumn("line", F.coalesce(F.sum(F.col(eol).cast("int")).over(before), F.lit(0)) + 1)
    inside = Window.partitionBy(*by, "line").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return lined.withColumn("col", F.coalesce(F.sum(F.length(text)).over(inside), F.lit(0)))


def all_terms(text: list[Column], query: Column) -> Column:
    """Every whitespace-separated term of the query is in one of the texts."""
    terms = F.filter(F.split(F.lower(query), T.JS_WS + "+"), lambda t: t != "")
    return F.forall(terms, lambda t: reduce(lambda a, b: a | b, [F.contains(F.lower(x), t) for x in text]))


def capped(df: DataFrame, order: list[str], most: int = 100) -> DataFrame:
    """The first ``most`` rows with ``total``, the number of all (P2), counted at once."""
    return df.orderBy(*order).limit(most).withColumn("total", F.lit(df.count()).cast("long"))


def numbered(df: DataFrame, by: list[str], order: list[str], into: str) -> DataFrame:
    """Gapless numbers from 0 in each group ``by``, in ``order``; rows equal in both get theirs in any order.

    One range sort, stored, gives every row a place; the counts of partitions
    give groups their offsets. So a group that holds most rows is numbered by
    as many tasks as it fills.
    """
    own, part, at, first = "_own", "_part", "_at", "_first"
    keys = [*by, *order, own]
    base = df.withColumn(own, F.monotonically_increasing_id())
    sorted_ = base.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(own)
    placed = scratch.stored(sorted_.withColumn(part, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id()), "numbered")
    counts = placed.groupBy(*by, part).agg(F.min(at).alias(first), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(c).alias(f"_by{k}") for k, c in enumerate(by)], F.col(part).alias("_by_part"), (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col(first)).alias(first))
    same = F.col(part) == F.col("_by_part")
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{k}"))
    return placed.join(offsets, same).withColumn(into, F.col(at) + F.col(first)).select(*df.columns, into)

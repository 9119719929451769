"""Comparison of pairs of texts.

The alignment itself has no relational form and runs per pair in Python; what
follows from it (counts, hunks, the unified text) is DataFrame work. Pairs are
independent rows, so nothing is shuffled for the alignment; ``spread`` deals
them by cost where a few long pairs would share a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernel import align
from ..options import NormOptions
from . import rows as R

SEGMENTS = "array<struct<text:string,cls:string>>"
ROWS = f"pair_id long, row_ord int, type string, li int, ri int, left_text string, right_text string, seg_l {SEGMENTS}, seg_r {SEGMENTS}"
FLOW = f"pair_id long, skipped boolean, removed_chars long, added_chars long, seg_l {SEGMENTS}, seg_r {SEGMENTS}"
#: Pairs whose results are handed over together.
BATCH = 64


def spread(pairs: DataFrame, partitions: int, key: str = "pair_id", left: str = "left", right: str = "right") -> DataFrame:
    """Deal pairs, or what they are made of, so that costs (the product of the lengths) are even."""
    cost = F.length(left).cast("double") * F.length(right)
    return pairs.repartition(partitions, F.floor(F.log2(cost + 1)), F.xxhash64(key))


def dealt(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Texts of which pairs are made, over more tasks than a small file has; only keys and texts move."""
    return spread(texts.select(key, text), 4 * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), key, text, text)


_TYPES = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), SEGMENTS: pa.list_(pa.struct([("text", pa.string()), ("cls", pa.string())]))}


def _per_pair(pairs: DataFrame, make, schema: str) -> DataFrame:
    """Rows made from every (left, right); a null text is the empty one."""
    fields = pa.schema([(c.split(" ")[0], _TYPES[c.split(" ")[1]]) for c in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BATCH):
                out = []
                for p, left, right in zip(*(c.to_pylist() for c in b.slice(at, BATCH).columns), strict=True):
                    out += [{"pair_id": p} | r for r in make(left or "", right or "")]
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=fields)

    return pairs.select(F.col("pair_id").cast("long").alias("pair_id"), "left", "right").mapInArrow(run, schema)


def diff_rows(pairs: DataFrame, o: NormOptions = NormOptions(), limit: int | None = align.PRODUCT_LIMIT, most_cells: int | None = align.MOST_CELLS, most_rest: int | None = align.MOST_REST, with_segments: bool = True) -> DataFrame:
    """Aligned lines of each pair (D1-D6): equal, change, remove, add in report order.

    No ``limit``: changed lines of any length are compared by character; no
    ``most_cells`` or ``most_rest``: changed regions of any size are paired.
    Without segments changed lines are paired, but not compared by character.
    """
    return _per_pair(pairs, lambda a, b: align.grid(a, b, o, with_segments, limit=limit, most_cells=most_cells, most_rest=most_rest), ROWS)


def diff_flow(pairs: DataFrame, o: NormOptions = NormOptions(ignore_newline=True), limit: int | None = align.PRODUCT_LIMIT) -> DataFrame:
    """Character comparison of whole texts (D7): one row per pair; no ``limit``: no pair is skipped."""
    return _per_pair(pairs, lambda a, b: [align.flow(a, b, o, limit)], FLOW)


def flow_stats(pairs: DataFrame, o: NormOptions = NormOptions(ignore_newline=True), limit: int | None = align.PRODUCT_LIMIT) -> DataFrame:
    """The counts of ``diff_flow`` (G2) without its segments, so without a trace."""
    return _per_pair(pairs, lambda a, b: [align.flow_counts(a, b, o, limit)], "pair_id long, skipped boolean, removed_chars long, added_chars long")


def line_stats(pairs: DataFrame, o: NormOptions = NormOptions()) -> DataFrame:
    """The counts of ``grid_stats`` in one pass over the pairs (G1)."""
    return _per_pair(pairs, lambda a, b: [align.grid_counts(a, b, o)], "pair_id long, equal long, modified long, added long, removed long")


def text_diff(pairs: DataFrame, o: NormOptions = NormOptions()) -> DataFrame:
    """The comparison the options ask for (D2): flow if newlines don't count, else the grid."""
    return diff_flow(pairs, o) if o.ignore_newline else diff_rows(pairs, o)


def grid_stats(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows by type for every pair, pairs without lines too (G1)."""
    names = {"equal": "equal", "modified": "change", "added": "add", "removed": "remove"}
    counts = rows.groupBy("pair_id").agg(*[F.count_if(F.col("type") == t).alias(n) for n, t in names.items()])
    return pairs.select("pair_id").join(counts, "pair_id", "left").fillna(0, list(names))


def anchors(pairs: DataFrame, o: NormOptions = NormOptions(ignore_newline=True), limit: int | None = align.PRODUCT_LIMIT) -> DataFrame:
    """Line and character anchors (D10, D11): pair_id, level, l, r, coverage (lines only); no ``limit``: characters of every pair."""

    def make(a: str, b: str) -> list[dict]:
        lines, coverage = align.line_anchors(a, b, o)
        out = [{"level": "line", "l": i, "r": j, "coverage": coverage} for i, j in lines]
        return out + [{"level": "char", "l": i, "r": j, "coverage": None} for i, j in align.char_anchors(a, b, o, limit) or []]

    return _per_pair(pairs, make, "pair_id long, level string, l int, r int, coverage double")


def anchor_stats(pairs: DataFrame, o: NormOptions = NormOptions(ignore_newline=True), limit: int | None = None) -> DataFrame:
    """How many ``anchors`` of each level a pair has, whatever its size, and the coverage of its lines: pair_id, level, n, coverage; levels without any have no row.

    A caller's ``limit`` leaves out the characters of larger pairs, as in ``anchors``.
    """

    def make(a: str, b: str) -> list[dict]:
        lines, coverage, chars = align.anchor_counts(a, b, o, limit)
        return [r for r in ({"level": "line", "n": lines, "coverage": coverage}, {"level": "char", "n": chars, "coverage": None}) if r["n"]]

    return _per_pair(pairs, make, "pair_id long, level string, n long, coverage double")


def similarities(pairs: DataFrame) -> DataFrame:
    """Similarity of each pair (D5, G9); equal texts need no Python."""
    same = F.lower(F.regexp_replace("left", r"[\t ]+", " ")) == F.lower(F.regexp_replace("right", r"[\t ]+", " "))
    quick = pairs.where(same).select("pair_id", F.lit(1.0).alias("similarity"))
    slow = _per_pair(pairs.where(~F.coalesce(same, F.lit(False))), lambda a, b: [{"similarity": align.similarity(a, b)}], "pair_id long, similarity double")
    return quick.unionByName(slow)


def redlines(rows: DataFrame) -> DataFrame:
    """Changed rows with both sides in one segment list."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"pair_id": f["pair_id"], "row_ord": f["row_ord"], "segs": [align.redline(list(a), list(b)) for a, b in zip(f["seg_l"], f["seg_r"], strict=True)]})

    changed = rows.where("type = 'change'").select("pair_id", "row_ord", "seg_l", "seg_r")
    return changed.mapInPandas(run, f"pair_id long, row_ord int, segs {SEGMENTS}")


def unified(rows: DataFrame, context: int = 3) -> DataFrame:
    """Unified diff of each pair that differs (D9): pair_id, unified."""
    hunks = R.change_hunks(rows, ["pair_id"], "row_ord", F.col("type") != "equal", context)
    counted = R.running_counters(rows, ["pair_id"], ["row_ord"], F.col("li") >= 0, F.col("ri") >= 0)
    inside = counted.join(hunks, "pair_id").where("row_ord BETWEEN start AND stop")
    minus, plus = F.concat(F.lit("-"), "left_text"), F.concat(F.lit("+"), "right_text")
    body = (
        F.when(F.col("type") == "equal", F.concat(F.lit(" "), "left_text"))
        .when(F.col("type") == "change", F.concat(minus, F.lit("\n"), plus))
        .when(F.col("type") == "remove", minus)
        .otherwise(plus)
    )
    per = inside.groupBy("pair_id", "hunk").agg(
        F.array_sort(F.collect_list(F.struct("row_ord", body.alias("t")))).alias("b"),
        (F.min("left_before") + 1).alias("ls"),
        (F.min("right_before") + 1).alias("rs"),
        F.count_if(F.col("li") >= 0).alias("lc"),
        F.count_if(F.col("ri") >= 0).alias("rc"),
    )
    span = lambda s, c: F.when(F.col(c) == 1, F.col(s).cast("string")).otherwise(F.concat_ws(",", s, c))
    head = F.concat(F.lit("@@ -"), span("ls", "lc"), F.lit(" +"), span("rs", "rc"), F.lit(" @@\n"))
    text = per.select("pair_id", "hunk", F.concat(head, F.array_join(F.transform("b", lambda x: x["t"]), "\n")).alias("t"))
    joined = text.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("hunk", "t"))).alias("h"))
    return joined.select("pair_id", F.concat(F.lit("--- a/原文\n+++ b/修改后\n"), F.array_join(F.transform("h", lambda x: x["t"]), "\n")).alias("unified"))


def marks(rows: DataFrame) -> DataFrame:
    """Marked lines of either side (D14): pair_id, side, line (from 1), cls, segs of changed lines."""
    side = lambda name, number, cls, segs: F.struct(F.lit(name).alias("side"), (F.col(number) + 1).alias("line"), F.lit(cls).alias("cls"), F.col(segs).alias("segs"))
    both = F.inline(F.array(side("left", "li", "rm", "seg_l"), side("right", "ri", "ad", "seg_r")))  # one pass: rows are dear
    return rows.where("type <> 'equal'").select("pair_id", both).where("line > 0")


def segment_ranges(df: DataFrame, by: list[str], segs: str = "segs") -> DataFrame:
    """Ranges [start, stop) of the segments that are not common."""
    sums = F.aggregate(
        F.col(segs),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int,cls:string>>").alias("out")),
        lambda acc, s: F.struct((acc["at"] + F.length(s["text"])).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), (acc["at"] + F.length(s["text"])).alias("stop"), s["cls"].alias("cls")))).alias("out")),
        lambda acc: F.filter(acc["out"], lambda r: r["cls"] != "eq"),
    )
    return df.select(*by, F.inline(sums))


def line_table(rows: DataFrame) -> DataFrame:
    """Pairs of line numbers (from 1) of rows with both sides."""
    return rows.where("li >= 0 AND ri >= 0").select("pair_id", (F.col("li") + 1).alias("l"), (F.col("ri") + 1).alias("r"))


def swapped(pairs: DataFrame) -> DataFrame:
    """The pairs with their sides exchanged."""
    return pairs.select(*[F.col({"left": "right", "right": "left"}.get(c, c)).alias(c) for c in pairs.columns])


def messages(stats: DataFrame) -> DataFrame:
    """A sentence per pair."""
    differs = F.col("modified") + F.col("added") + F.col("removed") > 0
    return stats.withColumn("message", F.when(differs, F.format_string("%d modified, %d added, %d removed, %d equal", "modified", "added", "removed", "equal")).otherwise("identical"))


def offset_maps(pairs: DataFrame) -> DataFrame:
    """For every offset of the left text, and its end, the offset in the right one (D17): pair_id, at, to."""
    return _per_pair(pairs, lambda a, b: [{"at": i, "to": j} for i, j in enumerate(align.offset_map(a, b))], "pair_id long, at int, to int")


def both_views(pairs: DataFrame, o: NormOptions = NormOptions(), limit: int | None = align.PRODUCT_LIMIT) -> DataFrame:
    """Counts of the tidied comparison beside those of the raw lines (D19): pair_id, removed_chars, added_chars, equal, modified, added, removed."""
    tidied, raw = replace(o, ignore_newline=True), replace(o, ignore_newline=False)

    def make(a: str, b: str) -> list[dict]:
        flow = align.flow_counts(a, b, tidied, limit)
        return [{k: flow[k] for k in ("removed_chars", "added_chars")} | align.grid_counts(a, b, raw)]

    return _per_pair(pairs, make, "pair_id long, removed_chars long, added_chars long, equal long, modified long, added long, removed long")


def side_by_side(rows: DataFrame) -> DataFrame:
    """Rows as two columns (X11): numbers from 1 and texts of either side, null where a side has no line."""
    number = lambda c: F.when(F.col(c) >= 0, F.col(c) + 1)
    return rows.select("pair_id", "row_ord", "type", number("li").alias("left_no"), "left_text", number("ri").alias("right_no"), "right_text")


def compared_again(panels: DataFrame, o: NormOptions = NormOptions()) -> DataFrame:
    """Counts for pairs of which a side's extracted text differs from the edited one.

    ``panels``: pair_id, left, right (extracted), left_edited, right_edited.
    """
    differs = ~(F.col("left").eqNullSafe(F.col("left_edited")) & F.col("right").eqNullSafe(F.col("right_edited")))
    return line_stats(panels.where(differs), o)

"""Joins of ranges, and what follows from them: marks on the items of a page."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import image


def _binned(df: DataFrame, span: tuple[str, str], width: int, first: str, bin_: str) -> DataFrame:
    """Rows repeated for every bin their range touches; empty ranges touch none."""
    start, stop = F.col(span[0]), F.col(span[1])
    low, high = F.floor(start / width).cast("long"), F.floor((stop - 1) / width).cast("long")
    return df.where(stop > start).withColumn(first, low).withColumn(bin_, F.explode(F.sequence(low, high)))


def overlapping(a: DataFrame, b: DataFrame, on: list[str], a_span: tuple[str, str], b_span: tuple[str, str], width: int = 64) -> DataFrame:
    """Rows of a and b with equal ``on`` whose half-open integer ranges overlap, each pair once.

    Both sides go to the bins of ``width`` that their ranges touch, and meet
    by an equality join on keys and bin; a pair counts in the first bin that
    both touch. So work follows the overlaps, not the product of a key's
    rows, and a key with many rows is spread over its bins. ``width`` should
    be about the usual length of a range. Empty ranges, and null keys or
    ends, meet nothing. The columns besides ``on`` must have different names.
    """
    left, right = _binned(a, a_span, width, "_first_a", "_bin"), _binned(b, b_span, width, "_first_b", "_bin")
    met = left.join(right, [*on, "_bin"]).where(F.col("_bin") == F.greatest("_first_a", "_first_b"))
    both = met.where((F.col(a_span[0]) < F.col(b_span[1])) & (F.col(b_span[0]) < F.col(a_span[1])))
    return both.drop("_bin", "_first_a", "_first_b")


SEGMENT = pa.struct([("text", pa.string()), ("cls", pa.string())])
RANGE = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("cls", pa.string())])
#: Rows whose segments are taken apart together; characters of a line that share a list of ranges.
BATCH, STRETCH = 256, 64


def _numbers(values: pa.Array) -> np.ndarray:
    return pc.fill_null(values, 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _parts(segs: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Rows, texts and classes of all segments of a column of lists."""
    text, cls = segs.flatten().flatten()
    return np.repeat(np.arange(len(segs)), _numbers(pc.list_value_length(segs))), text, cls


def _marked(cls: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.not_equal(cls, "eq"), False).to_numpy(zero_copy_only=False)


def _lists(counts: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            yield batch.slice(at, BATCH)


def _marked_lines(segs: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Segments cut at line feeds: row, line and segments of every line that has a mark."""
    row, text, cls = _parts(segs)
    cut = pc.split_pattern(text, "\n")
    n = _numbers(pc.list_value_length(cut))
    of = np.repeat(np.arange(len(n)), n)
    part, prow = cut.flatten(), row[of]
    opens = np.cumsum(np.diff(of, prepend=-1) == 0)  # parts behind a line feed, from the start
    first = np.searchsorted(prow, np.arange(len(segs)))
    line = opens - np.append(opens, 0)[first][prow] + 1
    some = pc.not_equal(part, "").to_numpy(zero_copy_only=False)
    part, kind, prow, line = part.filter(pa.array(some)), cls.take(pa.array(of[some])), prow[some], line[some]
    starts = np.flatnonzero(np.append(True, (np.diff(prow) != 0) | (np.diff(line) != 0))[: len(prow)])
    if not len(starts):
        return prow, line, pa.array([], pa.list_(SEGMENT))
    sizes = np.diff(np.append(starts, len(prow)))
    hit = np.logical_or.reduceat(_marked(kind), starts)
    kept = pa.array(np.repeat(hit, sizes))
    lists = _lists(sizes[hit], pa.StructArray.from_arrays([part.filter(kept), kind.filter(kept)], fields=list(SEGMENT)))
    return prow[starts][hit], line[starts][hit], lists


def flow_marks(flow: DataFrame) -> DataFrame:
    """Marked lines of character comparisons of whole texts, a row per pair: pair_id, side, line (from 1), cls, segs.

    The segments of either side are cut at line feeds; lines of common text only have no mark.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            for side, cls, segs in (("left", "rm", b.column("seg_l")), ("right", "ad", b.column("seg_r"))):
                row, line, lists = _marked_lines(segs)
                same = lambda x: pa.array([x] * len(row), pa.string())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([b.column("pair_id").take(pa.array(row)), same(side), pa.array(line, pa.int32()), same(cls), lists], ["pair_id", "side", "line", "cls", "segs"])

    schema = f"pair_id {flow.schema['pair_id'].dataType.simpleString()}, side string, line int, cls string, segs array<struct<text:string,cls:string>>"
    return flow.where("NOT skipped").select("pair_id", "seg_l", "seg_r").mapInArrow(run, schema)


def _by_stretch(segs: pa.Array) -> pa.Array:
    """The ranges of marked segments as a list over the stretches of their line, each with those that touch it."""
    row, text, cls = _parts(segs)
    n = _numbers(pc.utf8_length(text))
    stop = np.cumsum(n)
    first = np.searchsorted(row, np.arange(len(segs)))
    stop -= np.append(stop - n, 0)[first][row]
    kept = np.flatnonzero(_marked(cls) & (n > 0))
    row, start, stop = row[kept], (stop - n)[kept], stop[kept]
    low, high = start // STRETCH, (stop - 1) // STRETCH
    each = high - low + 1
    again = np.repeat(np.arange(len(kept)), each)
    touched = low[again] + np.arange(len(again)) - np.repeat(np.cumsum(each) - each, each)
    many = np.zeros(len(segs), np.int64)
    np.maximum.at(many, row, high + 1)
    inner = np.bincount((np.cumsum(many) - many)[row[again]] + touched, minlength=int(many.sum()))
    ranges = pa.StructArray.from_arrays([pa.array(start[again], pa.int32()), pa.array(stop[again], pa.int32()), cls.take(pa.array(kept[again]))], fields=list(RANGE))
    return _lists(many, _lists(inner, ranges))


def _stretched(marks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, _cls, _whole and, for marks with segments, their ranges by stretch as _by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            segs = b.column("segs")
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in [*keys, "cls"]), segs.is_null(), _by_stretch(segs)], [*keys, "_cls", "_whole", "_by"])

    own = ", ".join(f"{k} {marks.schema[k].dataType.simpleString()}" for k in keys)
    return marks.select(*keys, "cls", "segs").mapInArrow(run, f"{own}, _cls string, _whole boolean, _by array<array<struct<start:int,stop:int,cls:string>>>")


def marked_items(marks: DataFrame, items: DataFrame, cut: Column | None = None) -> DataFrame:
    """Marks laid over the text items of their lines (J10), with the rectangle of each.

    ``marks``: pair_id, side, line, cls, segs, as ``text_diff.marks`` or
    ``flow_marks`` give them; without segments a line is marked as a whole.
    ``items``: pair_id, side, page, line, col (offset in the line, from 0), str,
    transform, width, ocr; or, with ``cut``, lines (pair_id, side, line and
    what the column needs), of which ``cut`` makes an array of items (page to
    ocr) once a line has met its marks, so that lines move, not items, and
    only marked ones are cut. Gives pair_id, side, page, line, col, cls, begin
    and end within the item, and x, y, width, height. Items without text
    have no marks; marks of lines without items are on no page.

    One join on the line; an item finds its ranges by the stretches it
    touches, so work follows the overlaps and each item moves once.
    """
    keys = ["pair_id", "side", "line"]
    met = items.join(_stretched(marks, keys), keys)
    if cut is not None:
        met = met.select(*keys, "_cls", "_whole", "_by", F.inline(cut))
    start, stop = F.col("col").cast("int"), (F.col("col") + F.length("str")).cast("int")
    met = met.withColumn("_start", start).withColumn("_stop", stop).where("_stop > _start")
    first, last = (F.floor(c / STRETCH).cast("int") for c in (F.greatest("_start", F.lit(0)), F.col("_stop") - 1))
    near = F.when(first == last, F.get("_by", first)).otherwise(F.array_distinct(F.flatten(F.slice("_by", first + 1, F.greatest(last - first + 1, F.lit(0))))))
    inside = F.transform(
        F.filter(near, lambda r: (r["start"] < F.col("_stop")) & (r["stop"] > F.col("_start"))),
        lambda r: F.struct((F.greatest(r["start"], "_start") - F.col("_start")).alias("begin"), (F.least(r["stop"], "_stop") - F.col("_start")).alias("end"), r["cls"].alias("cls")),
    )
    whole = F.array(F.struct(F.lit(0).alias("begin"), (F.col("_stop") - F.col("_start")).alias("end"), F.col("_cls").alias("cls")))
    both = met.select(*keys, "page", "col", F.struct("str", "transform", "width", "ocr").alias("item"), F.inline(F.when(F.col("_whole"), whole).otherwise(inside)))
    box = image.highlight("item", F.col("begin"), F.col("end"))
    return both.select(*keys, "page", "col", "cls", "begin", "end", *[c.alias(k) for k, c in box.items()])

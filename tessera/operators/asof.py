"""As-of joins and interpolation between anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _swept(both: DataFrame, values: list[str], ahead: bool, width: float | None) -> DataFrame:
    """Rows (_by, _x, _kind: 0 for anchors) with the last anchor's ``values`` at or before each, and with ``ahead`` the first one's after it.

    One sweep per group; with ``width`` one per stretch of x so wide, where
    the last and first anchors of the other stretches are carried over. So a
    long group is as many tasks as it has stretches.
    """
    cell = F.lit(0) if width is None else F.floor(F.col("_x") / width)
    given = both.withColumn("_cell", cell.cast("long"))
    w = Window.partitionBy("_by", "_cell").orderBy("_x", "_kind")
    anchor = F.when(F.col("_kind") == 0, F.struct(*values))
    out = given.withColumn("_before", F.last(anchor, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    if ahead:
        out = out.withColumn("_after", F.first(anchor, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    if width is None:
        return out
    place = F.when(F.col("_kind") == 0, F.col("_x"))
    cells = given.groupBy("_by", "_cell").agg(F.max_by(anchor, place).alias("_last"), F.min_by(anchor, place).alias("_first"))
    order = Window.partitionBy("_by").orderBy("_cell")  # as many rows as stretches
    cells = cells.select(
        F.col("_by").alias("_of"), F.col("_cell").alias("_at"),
        F.last("_last", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_earlier"),
        F.first("_first", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("_later"),
    )
    met = out.join(cells, F.col("_by").eqNullSafe(F.col("_of")) & F.col("_cell").eqNullSafe(F.col("_at"))).withColumn("_before", F.coalesce("_before", "_earlier"))
    return met.withColumn("_after", F.coalesce("_after", "_later")) if ahead else met


def interpolate(points: DataFrame, anchors: DataFrame, by: str, x: str = "x", source: str = "l", target: str = "r", into: str = "y", width: float | None = None) -> DataFrame:
    """Place of ``x`` on the other side (J8): linear between the anchors around it, slope 1 outside.

    Both tables are united and swept once per group, so there is no range
    join: each point sees the last anchor at or before it and the first after.
    Without anchors a point keeps its place. ``width`` cuts long groups into
    stretches of x that are swept apart.
    """
    a = anchors.select(F.col(by).alias("_by"), F.col(source).cast("double").alias("_x"), F.col(source).cast("double").alias("_l"), F.col(target).cast("double").alias("_r"), F.lit(0).alias("_kind"), F.lit(None).cast(points.schema.simpleString()).alias("_row"))
    p = points.select(F.col(by).alias("_by"), F.col(x).cast("double").alias("_x"), F.lit(None).cast("double").alias("_l"), F.lit(None).cast("double").alias("_r"), F.lit(1).alias("_kind"), F.struct(*points.columns).alias("_row"))
    met = _swept(a.unionByName(p), ["_l", "_r"], True, width).where("_kind = 1")
    return met.select("_row.*", between(F.col("_x"), F.col("_before._l"), F.col("_before._r"), F.col("_after._l"), F.col("_after._r")).alias(into))


def between(x: Column, l0: Column, r0: Column, l1: Column, r1: Column) -> Column:
    """Image of x given the anchors before and after it, either of which may be missing."""
    inside = r0 + (x - l0) * (r1 - r0) / F.nullif(l1 - l0, F.lit(0.0))
    return F.when(l0.isNotNull() & l1.isNotNull(), inside).when(l0.isNotNull(), r0 + (x - l0)).when(l1.isNotNull(), r1 + (x - l1)).otherwise(x)


def last_at_or_before(points: DataFrame, entries: DataFrame, by: str, x: str, at: str, value: str, width: float | None = None) -> DataFrame:
    """The entry with the largest ``at`` <= x (J9), as ``value``; null before the first. ``width`` as in ``interpolate``."""
    a = entries.select(F.col(by).alias("_by"), F.col(at).cast("double").alias("_x"), F.col(value).alias("_v"), F.lit(0).alias("_kind"), F.lit(None).cast(points.schema.simpleString()).alias("_row"))
    p = points.select(F.col(by).alias("_by"), F.col(x).cast("double").alias("_x"), F.lit(None).cast(a.schema["_v"].dataType).alias("_v"), F.lit(1).alias("_kind"), F.struct(*points.columns).alias("_row"))
    return _swept(a.unionByName(p), ["_v"], False, width).where("_kind = 1").select("_row.*", F.col("_before._v").alias(value))


def translate_line(points: DataFrame, line_anchors: DataFrame, char_anchors: DataFrame, by: str, coverage: str = "coverage", least: float = 0.3) -> DataFrame:
    """Place of a line on the other side.

    Below 1 nothing moves; outside the line anchors they extrapolate; with a
    coverage of at least ``least`` they decide, else the character anchors, if
    there are any.
    """
    bounds = line_anchors.groupBy(by).agg(F.min("l").alias("_lo"), F.max("l").alias("_hi"), F.max(coverage).alias("_cov"))
    has_chars = char_anchors.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    got = interpolate(interpolate(points, line_anchors, by, into="_line"), char_anchors, by, into="_char").join(bounds, by, "left").join(has_chars, by, "left")
    outside = (F.col("x") < F.col("_lo")) | (F.col("x") > F.col("_hi"))
    use_line = outside | (F.col("_cov") >= least) | F.col("_n").isNull()
    y = F.when(F.col("x") < 1, F.col("x").cast("double")).when(F.coalesce(use_line, F.lit(False)), F.col("_line")).otherwise(F.col("_char"))
    return got.select(*points.columns, y.alias("y"))


def overlap(start: Column, stop: Column, at: Column, length: Column) -> tuple[Column, Column]:
    """Part of [start, stop) inside [at, at + length), relative to ``at`` (J11); empty if begin >= end."""
    return F.greatest(start, at) - at, F.least(stop, at + length) - at


def translated(panel: Column, editor: Column, mixed: Column, same_text: Column, fallback: Column) -> Column:
    """A place on the other side (X24): by the panels' table, the editors', a mixed one only if the texts are equal, else by line."""
    return F.coalesce(panel, editor, F.when(same_text, mixed), fallback)

"""Batch tasks: from a description to pairs, volumes, results and totals."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import batch, rows, text_diff
from ..options import NormOptions
from ..sources import loaders, office, scratch


@dataclass(frozen=True)
class Task:
    """Either explicit ``pairs`` or a ``source`` (left_dir, right_dir, glob; or root, left, right to walk)."""

    title: str
    output: str
    pairs: tuple[tuple[str, str], ...] = ()
    source: dict = field(default_factory=dict)
    options: NormOptions = NormOptions()
    most_pairs: int = 10

    def __post_init__(self) -> None:
        if bool(self.pairs) == bool(self.source):
            raise ValueError("a task has either pairs or a source")
        if self.most_pairs < 1:
            raise ValueError("a report holds at least one pair")


def listing(spark: SparkSession, path: str) -> DataFrame:
    """Files below a path: path, dir relative to it, name."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    root = F.lit(path.rstrip("/").removeprefix("file://"))
    inside = F.ltrim(F.element_at(F.split("path", root, 2), -1), F.lit("/"))
    return found.select("path", F.regexp_replace(inside, "/?[^/]*$", "").alias("dir"), F.element_at(F.split("path", "/"), -1).alias("name"))


def planned(spark: SparkSession, task: Task, files: DataFrame | None = None) -> DataFrame:
    """Pairs of a task with volumes and outputs (B1, B2): dir, left, right, warning, volume, output."""
    base = F.when(F.col("dir") == "", F.lit(task.output)).otherwise(F.concat(F.lit(task.output + "/"), "dir"))
    if task.pairs:
        pairs = spark.createDataFrame(list(task.pairs), "left string, right string").withColumn("dir", F.lit("")).withColumn("warning", F.lit(None).cast("string"))
    elif "root" in task.source:
        files = files if files is not None else listing(spark, task.source["root"])
        usable = files.where(~F.col("name").rlike("(?i)\\.html?$"))
        left = batch.name_matches(F.col("name"), task.source["left"]) if "left" in task.source else batch.last_segment_has(F.col("name"))
        right = batch.name_matches(F.col("name"), task.source["right"]) if "right" in task.source else F.lit(True)
        return batch.cross_volumes(usable.withColumn("base", base), ["dir", "base"], "name", left, right, task.most_pairs, "base").withColumn("warning", F.lit(None).cast("string")).drop("base")
    else:
        pattern = batch.glob_pattern(task.source.get("glob", "*"))
        side = lambda k: listing(spark, task.source[k]).where(F.col("name").rlike(pattern))
        pairs = batch.folder_pairs(side("left_dir"), side("right_dir")).withColumn("dir", F.lit(""))
    good = pairs.where("warning IS NULL")
    return batch.volumes(good.withColumn("base", base), ["dir"], ["left", "right"], task.most_pairs, "base").drop("base")


def run(pairs: DataFrame, options: NormOptions, compare: Callable[[DataFrame, NormOptions], DataFrame] | None = None) -> DataFrame:
    """Counts per pair of texts (pair_id, volume, left, right), all pairs in parallel."""
    found = (compare or text_diff.diff_rows)(pairs, options)
    return pairs.select("pair_id", "volume").join(text_diff.grid_stats(pairs, found), "pair_id")


def contents(spark: SparkSession, path: str) -> DataFrame:
    """Files below a path with their bytes: dir (relative), name, path, content."""
    root = F.lit(path.rstrip("/").removeprefix("file://"))
    inside = F.ltrim(F.element_at(F.split("path", root, 2), -1), F.lit("/"))
    return office.files(spark, path).select(F.regexp_replace(inside, "/?[^/]*$", "").alias("dir"), "name", "path", "content")


def compared_files(spark: SparkSession, task: Task, readers: dict[str, loaders.Reader] | None = None, files: DataFrame | None = None) -> DataFrame:
    """Every planned pair of files from bytes to counts (B3, B4): dir, left, right, volume, equal, modified, added, removed, error.

    ``files``: dir, name, path, content; by default what the task's source
    has (``root``, or ``left_dir`` and ``right_dir``, whose files then are in
    the folders ``left`` and ``right``). Every file is loaded once, whatever
    pairs it is in. A file that is missing or cannot be read makes its pairs
    rows with an error and no counts; a failure of the environment also stops
    the pairs behind it in its volume, in order of their names.
    """
    split = "root" not in task.source
    if files is None:
        if task.pairs:
            raise ValueError("explicit pairs need their files")
        if split:
            side = lambda k: contents(spark, task.source[f"{k}_dir"]).withColumn("dir", F.lit(k))
            files = side("left").unionByName(side("right"))
        else:
            files = contents(spark, task.source["root"])
    plan = planned(spark, task) if split else planned(spark, task, files.select("path", "dir", "name"))
    plan = plan.select("dir", "left", "right", "volume", "output")
    found = loaders.loaded(files, readers, ("path", "dir", "name"))
    texts = scratch.stored(found.select("dir", "name", "text", "error", "environment"), "loaded")

    def of(side: str) -> DataFrame:
        place = texts if not split or task.pairs else texts.where(F.col("dir") == side).withColumn("dir", F.lit(""))
        return place.select("dir", F.col("name").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("text", "error", "environment")], F.lit(True).alias(f"is_{side}"))

    met = rows.numbered(plan, [], ["dir", "left", "right"], "pair_id").join(of("left"), ["dir", "left"], "left").join(of("right"), ["dir", "right"], "left")
    missing = lambda k: F.when(F.col(f"is_{k}").isNull(), F.concat(k, F.lit(": no such file")))
    error = F.concat_ws("; ", missing("left"), "error_left", missing("right"), "error_right")
    broken = F.coalesce("environment_left", F.lit(False)) | F.coalesce("environment_right", F.lit(False))
    so_far = Window.partitionBy("output").orderBy("pair_id").rowsBetween(Window.unboundedPreceding, -1)  # a volume has few pairs
    told = met.withColumn("own", F.nullif(error, F.lit(""))).withColumn("stop", F.first(F.when(broken, error), ignorenulls=True).over(so_far))
    told = scratch.stored(told.select("pair_id", "dir", "left", "right", "volume", F.col("text_left").alias("l"), F.col("text_right").alias("r"), F.when(F.col("stop").isNotNull(), F.concat(F.lit("stopped: "), "stop")).otherwise(F.col("own")).alias("error")), "pairs")
    good = told.where("error IS NULL").select("pair_id", F.col("l").alias("left"), F.col("r").alias("right"))
    stats = text_diff.line_stats(text_diff.spread(good, int(spark.conf.get("spark.sql.shuffle.partitions"))), task.options)
    return told.drop("l", "r").join(stats, "pair_id", "left").select("dir", "left", "right", "volume", "equal", "modified", "added", "removed", "error")


def totals(stats: DataFrame) -> DataFrame:
    """Roll-up over volumes and all."""
    return batch.roll_up(stats, "volume", ["equal", "modified", "added", "removed"])

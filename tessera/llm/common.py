"""Shared parts: table access, scratch tables in the shared folder, row numbers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: ``[^\x20\x09-\x0D]+``: the words of every operator of this subpackage.
WORD = r"[^\x20\x09-\x0D]+"

_SETTING = "spark.checkpoint.dir"
_own_dir: list[str] = []
_written: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it.

    Only where the setting is absent and everything runs in one JVM (tests,
    bench) a temporary folder of this process takes its place.
    """
    named = spark.conf.get(_SETTING, None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError(f"{_SETTING} must name a folder that all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="tessera-"))
        atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
    return f"file://{_own_dir[0]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage: a lost executor costs the tasks that read its shuffle
    files, never the steps before. The file names are unique to the call.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, by: list[str]) -> DataFrame:
    """As ``stored``, dealt by ``by`` into as many files as shuffles have partitions, so that joins on it need not move the table again."""
    spark = df.sparkSession
    unique = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/tessera/{spark.sparkContext.applicationId}/{unique}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(parts, *by).sortBy(*by).option("path", path).option("compression", "zstd").saveAsTable(unique)
    _written.append(path)
    return spark.table(unique)


def discard(*frames: DataFrame) -> None:
    """Delete the scratch tables that ``stored`` or ``bucketed`` gave as ``frames``, which no later step reads."""
    for df in frames:
        spark = df.sparkSession
        jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(hadoop).delete(p, True)


def written() -> int:
    """How many scratch tables this process has written so far, as a mark for ``release``."""
    return len(_written)


def release(spark: SparkSession, since: int) -> None:
    """Delete the scratch tables written after the mark ``since``, but for the last one.

    For callers that have just stored their result and need no table before it.
    """
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in _written[since:-1]:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(hadoop).delete(p, True)
    del _written[since:-1]


def id_text(col: str | Column) -> Column:
    """An id as text; null counts as the empty text."""
    return F.coalesce((F.col(col) if isinstance(col, str) else col).cast("string"), F.lit(""))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that clash with none of ``df``'s."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def numbered(df: DataFrame, key: list[str], into: str, by: list[str] | None = None, ties: list[str] | None = None, buckets: int | Column = 8192) -> tuple[DataFrame, DataFrame]:
    """Gapless row numbers from 0, over all rows or in each group ``by``.

    Rows are dealt into ``buckets`` (a number, or a column of them that is
    the same in a group) by a hash of key and ties and numbered there; counts
    of the buckets give each its offset. The number depends on the
    rows only, not on partitions, and no step brings a group together: a
    group, or a key, that holds most rows is spread over all buckets. Rows
    equal in key and ties share a bucket and may swap numbers. The offsets have at most buckets x groups
    rows, so their broadcast is bounded by the callers' choice of both.
    Returns the numbered frame and the counts (by, n).
    """
    by = by or []
    b, off, n = fresh(df, "bucket", "offset", "n")
    dealt = df.withColumn(b, F.pmod(F.xxhash64(*key, *(ties or [])), F.lit(buckets) if isinstance(buckets, int) else buckets).cast("int"))
    counts = dealt.groupBy(*by, b).agg(F.count(F.lit(1)).alias(n))
    before = Window.partitionBy(*by).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, b, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(off))
    within = Window.partitionBy(*by, b).orderBy(*key, *(ties or []))
    out = (
        dealt.withColumn(into, F.row_number().over(within).cast("long") - 1)
        .join(F.broadcast(offsets), [*by, b])
        .withColumn(into, F.col(into) + F.col(off))
        .drop(b, off)
    )
    return out, counts.groupBy(*by).agg(F.sum(n).alias("n"))


#: Rows of one key beyond which it is dealt over several tasks.
PER_TASK = 1024
#: At most so many keys can be hot, whatever the table's size: a key is hot only with over 1 / MOST_HOT of all rows.
MOST_HOT = 50_000


def hot_keys(counts: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """(keys, salts) of the keys that hold many of all ``total`` rows; at most ``MOST_HOT``, so it may be broadcast.

    One key of zeros, with one salt, is always there, so that plans are the
    same with and without hot keys; that key itself is never salted.
    """
    most = max(PER_TASK, total // MOST_HOT)
    zeros = [F.lit("" if t == "string" else 0).cast(t).alias(c) for c, t in counts.select(*keys).dtypes]
    zero = reduce(and_, [F.col(c) == z for c, z in zip(keys, zeros, strict=True)])
    found = counts.where((F.col(n) > most) & ~zero).select(*keys, F.ceil(F.col(n) / PER_TASK).cast("int").alias("salts"))
    return stored(found.unionByName(counts.sparkSession.range(1).select(*zeros, F.lit(1).alias("salts"))), "hot_keys")


def salted(df: DataFrame, hot: DataFrame, keys: list[str], by: str, salt: str = "salt") -> DataFrame:
    """Add ``salt``: rows of a hot key are dealt by a hash of ``by``, others have 0."""
    dealt = F.pmod(F.xxhash64(F.lit(7), by), F.col("salts")).cast("int")
    return df.join(F.broadcast(hot), keys, "left").withColumn(salt, F.coalesce(dealt, F.lit(0))).drop("salts")


def for_salts(df: DataFrame, hot: DataFrame, keys: list[str], salt: str = "salt") -> DataFrame:
    """A row per key, repeated for every salt of a hot key."""
    last = F.coalesce(F.col("salts"), F.lit(1)) - 1
    return df.join(F.broadcast(hot), keys, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), last))).drop("salts")


def slices(sizes: np.ndarray, step: int, most: int) -> list[tuple[int, int]]:
    """Cuts (start, length) of rows with these sizes: at most ``step`` rows and, but for single rows, ``most`` bytes."""
    out, at, held = [], 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > at and (i - at >= step or held + n > most):
            out.append((at, i - at))
            at, held = i, 0
        held += n
    return [*out, (at, len(sizes) - at)] if len(sizes) > at else out


def per_text(docs: DataFrame, judge, fields: str, text: str, keep: list[str] | None = None, step: int = 1000, most: int = 1 << 23) -> DataFrame:
    """``keep`` (default: all columns) as they are, plus columns made from each text.

    ``judge`` takes a list of texts (None for null) and returns one list per
    field of ``fields`` (a DDL string). Columns that are kept never leave
    Arrow, so nulls, large ids and nested values pass unchanged. Texts are
    turned into Python strings ``step`` at a time, and no more than ``most``
    bytes of them unless one alone is longer. A field with the name of a kept
    column takes its place.
    """
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = docs.columns if keep is None else keep
    new = StructType.fromDDL(fields)
    names = {f.name.lower() for f in new}
    stay = [c for c in kept if c.lower() not in names]
    (t,) = fresh(docs, "t")
    frame = docs.select(*[F.col(f"`{c}`") for c in stay], F.col(f"`{text}`").alias(t))
    schema = StructType([*frame.schema.fields[:-1], *new.fields])
    types = to_arrow_schema(new).types

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False)
            for at, rows in slices(sizes, step, most):
                part = batch.slice(at, rows)
                made = judge(part.column(part.num_columns - 1).to_pylist())
                arrays = [*part.columns[:-1], *(pa.array(m, k) for m, k in zip(made, types, strict=True))]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return frame.mapInArrow(run, schema)

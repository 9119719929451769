"""A keyed table that is kept up: new entries take the place of old ones, stale and broken ones go."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import batch


class Cache:
    """A cache of entries by key in a folder (S30, S31), in any store that Spark writes.

    Every change writes a new generation beside the current one and publishes
    it by creating the next numbered marker, which only one writer can; a
    writer that comes second merges again on top of the first one's result.
    So retries and lost executors leave the current generation as it is, and
    readers see one generation or the other. The last two stay; older ones
    are deleted.

    ``valid`` tells good entries from broken ones (null counts as broken);
    broken ones are never stored and never found.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, valid: Column | None = None, fetched: str = "fetched_at") -> None:
        self.spark, self.path, self.key, self.fetched = spark, path.rstrip("/"), key, fetched
        self.valid = F.lit(True) if valid is None else F.coalesce(valid, F.lit(False))

    def _store(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def generations(self) -> dict[int, str]:
        """Published generations: number to folder."""
        jvm, store = self._store()
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/published")
        if not store.exists(folder):
            return {}
        names = [s.getPath().getName() for s in store.listStatus(folder)]
        return {int(n.partition("-")[0]): n.partition("-")[2] for n in names if n[0].isdigit()}

    def entries(self) -> DataFrame | None:
        """The valid entries of the current generation; None before the first."""
        found = self.generations()
        if not found:
            return None
        return self.spark.read.parquet(f"{self.path}/data/{found[max(found)]}").where(self.valid)

    def _publish(self, number: int, name: str) -> bool:
        """Make a generation the current one, unless another took its number."""
        jvm, store = self._store()
        path = jvm.org.apache.hadoop.fs.Path
        if not store.mkdirs(path(f"{self.path}/taken")) or not store.mkdirs(path(f"{self.path}/published")):
            raise OSError(f"{self.path}: cannot write")
        try:
            store.create(path(f"{self.path}/taken/{number}"), False).close()
        except Exception:
            return False
        store.create(path(f"{self.path}/published/{number}-{name}"), False).close()
        return True

    def upsert(self, entries: DataFrame, oldest: Column | None = None, attempts: int = 5) -> None:
        """Store entries: for every key the one fetched last, of equal times a new one before a stored one.

        With ``oldest``, entries fetched before it go. Null keys and times are broken entries.
        """
        good = entries.where(self.valid & F.col(self.key).isNotNull() & F.col(self.fetched).isNotNull())
        for _ in range(attempts):
            known = self.generations()
            number = max(known, default=0) + 1
            held = good.withColumn("_new", F.lit(1))
            if known:
                held = held.unionByName(self.spark.read.parquet(f"{self.path}/data/{known[number - 1]}").where(self.valid).withColumn("_new", F.lit(0)))
            # of equal entries any will do; otherwise the order by all columns decides
            last = F.max_by(F.struct(*entries.columns), F.struct(F.col(self.fetched), F.col("_new"), F.xxhash64(*entries.columns)))
            kept = held.groupBy(F.col(self.key).alias("_key")).agg(last.alias("e")).select("e.*")
            if oldest is not None:
                kept = kept.where(F.col(self.fetched) >= oldest)
            name = uuid.uuid4().hex
            kept.write.parquet(f"{self.path}/data/{name}")
            if self._publish(number, name):
                self._clean(known)
                return
            self._drop(f"data/{name}")
        raise RuntimeError(f"{self.path}: other writers were first {attempts} times")

    def _drop(self, name: str) -> None:
        jvm, store = self._store()
        store.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"), True)

    def _clean(self, known: dict[int, str]) -> None:
        """Delete all but the generation just before the new one."""
        for n in sorted(known)[:-1]:
            self._drop(f"published/{n}-{known[n]}")
            self._drop(f"data/{known[n]}")

    def lookup(self, wanted: DataFrame, now: Column, hours: float = 24.0, bypass: Column | None = None) -> DataFrame:
        """``wanted`` (with the key) and what is stored of it; ``hit`` if that is valid and not older than ``hours``."""
        found = self.entries()
        if found is None:
            return wanted.withColumn(self.fetched, F.lit(None).cast("timestamp")).withColumn("hit", F.lit(False))
        return batch.cached(wanted, found, self.key, now, hours, self.fetched, bypass)

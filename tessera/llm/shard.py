"""Sharding by a Feistel permutation with cycle walking.

Native: DataFrame functions only.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, numbered

ROUNDS = 6


class Feistel:
    """A keyed permutation of 0..n-1.

    Numbers are written as L * b + R with 0 <= L < a, 0 <= R < b, where a is
    the rounded-up root of n and a * b the least such product >= n. Each round
    adds a hash of one half to the other, modulo the other's range. What lands
    outside 0..n-1 walks on; fewer than a points lie there.
    """

    def __init__(self, n: int, seed: int) -> None:
        self.n, self.seed = n, seed
        self.a = max(1, isqrt(max(n - 1, 0)) + 1)
        self.b = max(1, -(-n // self.a))

    def step(self, x: Column) -> Column:
        # the division is exact: the dividend is a multiple below 2 ** 53
        left, right = ((x - x % self.b) / self.b).cast("long"), x % self.b
        for i in range(ROUNDS):
            if i % 2 == 0:
                left = (left + self._hash(right, i, self.a)) % self.a
            else:
                right = (right + self._hash(left, i, self.b)) % self.b
        return left * self.b + right

    def inverse_step(self, y: Column) -> Column:
        left, right = ((y - y % self.b) / self.b).cast("long"), y % self.b
        for i in reversed(range(ROUNDS)):
            if i % 2 == 0:
                left = F.pmod(left - self._hash(right, i, self.a), F.lit(self.a))
            else:
                right = F.pmod(right - self._hash(left, i, self.b), F.lit(self.b))
        return left * self.b + right

    def _hash(self, half: Column, i: int, modulus: int) -> Column:
        return F.pmod(F.xxhash64(half.cast("long"), F.lit(i), F.lit(self.seed)), F.lit(modulus))

    def walks(self, spark, tries: int = 64) -> int:
        """The most steps that a walk from inside needs, found on the < a points outside.

        A point that is still outside after as many steps as there are such
        points is on a cycle of its own, which no walk from inside enters.
        """
        outside = self.a * self.b - self.n
        tries = min(tries, outside)
        while outside:
            walked = F.aggregate(
                F.sequence(F.lit(1), F.lit(tries)),
                F.struct(F.col("id").alias("at"), F.lit(0).alias("steps")),
                lambda acc, _: F.when(acc["at"] < self.n, acc).otherwise(F.struct(self.step(acc["at"]).alias("at"), (acc["steps"] + 1).alias("steps"))),
            )
            ended = F.col("w.at") < self.n
            got = spark.range(self.n, self.a * self.b).select(walked.alias("w")).agg(F.max(F.when(ended, F.col("w.steps"))).alias("most"), F.count_if(~ended).alias("open")).first()
            if not got["open"] or tries == outside:
                return got["most"] or 0
            tries = min(2 * tries, outside)
        return 0

    def permuted(self, x: Column, walks: int) -> Column:
        return self._walk(x, walks, self.step)

    def restored(self, y: Column, walks: int) -> Column:
        """The row number that has place ``y``: the permutation undone."""
        return self._walk(y, walks, self.inverse_step)

    def _walk(self, x: Column, walks: int, step) -> Column:
        out = step(x)
        if walks:
            out = F.aggregate(F.sequence(F.lit(1), F.lit(walks)), out, lambda acc, _: F.when(acc < self.n, acc).otherwise(step(acc)))
        return out


def shard_rows(df: DataFrame, shards: int, seed: int = 17, key: list[str] | None = None, ties: list[str] | None = None, buckets: int = 8192) -> DataFrame:
    """Add ``row`` (global number), ``place`` (its permuted number), ``shard`` and ``slot``.

    shard = place mod shards and slot = place div shards: shards differ by one
    row at most, slots have no gap, and the place of a row follows from its
    number, the row count and the seed alone. Law: ``rows``.

    Null keys are numbered like a value; rows equal in key and ties may swap
    places; an empty table stays empty. New columns get underscores in front
    where the input has their name.
    """
    key = key or ["doc_id"]
    row, place, shard, slot = fresh(df, "row", "place", "shard", "slot")
    rows, counts = numbered(df, key, row, ties=ties, buckets=buckets)
    n = counts.agg(F.sum("n")).first()[0] or 0
    feistel = Feistel(n, seed)
    walks = feistel.walks(df.sparkSession) if n else 0
    return (
        rows.withColumn(place, feistel.permuted(F.col(row), walks))
        .withColumn(shard, (F.col(place) % shards).cast("int"))
        .withColumn(slot, ((F.col(place) - F.col(place) % shards) / shards).cast("long"))
    )


def sharded_documents(docs: DataFrame, shards: int = 8, seed: int = 17) -> DataFrame:
    """Digest of ``shard_rows`` over documents: the columns of query op2.

    A null text has no bytes: size 1 and the checksum of nothing, 0.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    slim = docs.select("doc_id", (F.octet_length(raw).cast("long") + 1).alias("size"), F.crc32(raw).alias("text_crc32"))
    out = shard_rows(slim, shards, seed, ["doc_id"], ["text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row", "place")

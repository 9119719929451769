"""Mixing sources to target weights by Poisson replication.

Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, id_text, stored

#: A mean above this is split into equal parts whose Poisson counts are added.
PART = 16.0
#: Terms of the distribution of one part; the tail beyond is under 1e-16.
TERMS = 80
#: Sources up to this many are broadcast (a row has a name and two doubles).
MOST_BROADCAST = 10_000
SALTS = 64


def unit(*parts: Column) -> Column:
    """A uniform number in [0, 1) from the md5 of the parts: 52 bits."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def poisson_count(rate: Column, cdf: Column, seed: int, key: Column) -> Column:
    """Inverse of the Poisson distribution at hash-seeded points, for ``poisson_table``'s cdf."""
    parts = F.greatest(F.lit(1), F.ceil(rate / PART).cast("int"))
    draws = F.transform(F.sequence(F.lit(1), parts), lambda i: unit(F.lit(str(seed)), key, i.cast("string")))
    return F.aggregate(draws, F.lit(0), lambda acc, u: acc + F.size(F.filter(cdf, lambda c: c <= u)))


def poisson_table(rate: Column) -> Column:
    """Cumulative probabilities 0..TERMS-1 of one part of the mean ``rate``."""
    part = rate / F.greatest(F.lit(1), F.ceil(rate / PART))
    start = F.struct(F.exp(-part).alias("p"), F.array(F.exp(-part)).alias("cdf"))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS - 1)),
        start,
        lambda acc, j: F.struct((acc["p"] * part / j).alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + acc["p"] * part / j)).alias("cdf")),
        lambda acc: acc["cdf"],
    )


def rates(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, epochs: float = 1.0) -> DataFrame:
    """One row per source: bytes, rate, cdf.

    The target weights come from ``weights`` (sources not named get none) or,
    without it, are proportional to bytes ** temperature. The mean repetition
    rate of a source is its target share of ``epochs`` corpora over its bytes.
    """
    size = F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long") + 1
    per = docs.groupBy(F.coalesce("source", F.lit("")).alias("src")).agg(F.sum(size).alias("bytes"))
    if weights is None:
        weight = F.pow(F.col("bytes").cast("double"), F.lit(float(temperature)))
    else:
        named = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else F.lit(None).cast("map<string,double>")
        weight = F.coalesce(named[F.col("src")].cast("double"), F.lit(0.0))
    per = per.withColumn("weight", weight)
    total = per.agg(F.sum("bytes").alias("all_bytes"), F.sum("weight").alias("all_weight"))
    rate = F.when(F.col("all_weight") > 0, F.col("weight") / F.col("all_weight") * F.col("all_bytes") * epochs / F.col("bytes")).otherwise(0.0)
    # total is one row
    return per.join(F.broadcast(total)).select("src", "bytes", rate.alias("rate")).withColumn("cdf", poisson_table(F.col("rate")))


def poisson_mix(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, epochs: float = 1.0, seed: int = 29, keep: list[str] | None = None) -> DataFrame:
    """Every document as often as its Poisson count says, in one global random order.

    Adds ``copies``, ``copy`` (from 1), ``rate`` and ``shuffle_key``, each with
    underscores in front where the input has that name; the rows are
    range-partitioned and sorted by (shuffle_key, doc_id, copy). Counts
    depend on seed and doc_id alone, so repeated rows get equal counts. Null
    and empty sources are one source; a null text has size 1; an empty table
    stays empty.
    """
    src, cdf, salt, copies, copy, rate, order = fresh(docs, "src", "cdf", "salt", "copies", "copy", "rate", "shuffle_key")
    of = stored(rates(docs, weights, temperature, epochs).select(F.col("src").alias(src), F.col("rate").alias(rate), F.col("cdf").alias(cdf)), "rates")
    rows = docs.select(*(keep or docs.columns), F.coalesce("source", F.lit("")).alias(src))
    if of.select(src).limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        joined = rows.join(F.broadcast(of), src)
    else:
        # as many rows per source as salts, so a source with most rows is spread
        salted = of.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn(salt, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, [src, salt]).drop(salt)
    counted = joined.withColumn(copies, poisson_count(F.col(rate), F.col(cdf), seed, id_text("doc_id")))
    copied = counted.where(F.col(copies) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).drop(src, cdf)
    mixed = copied.withColumn(order, (unit(F.lit(str(seed + 1)), id_text("doc_id"), F.col(copy).cast("string")) * float(2**52)).cast("long"))
    return mixed.orderBy(order, "doc_id", copy)


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS source, strlen(coalesce(text, '')) + 1 AS size FROM documents),
per AS (SELECT source, sum(size) AS bytes, sqrt(sum(size)::DOUBLE) AS weight FROM d GROUP BY source),
r AS (SELECT source, weight / (sum(weight) OVER ()) * (sum(bytes) OVER ())::DOUBLE / bytes::DOUBLE AS rate FROM per),
parts AS (SELECT source, rate, greatest(1, ceil(rate / {PART})::INT) AS parts FROM r),
term AS (SELECT source, j, exp(-rate / parts + j * ln(rate / parts) - lgamma(j + 1)) AS p FROM parts, range(0, {TERMS}) t(j)),
cdf AS (SELECT source, list(c ORDER BY j) AS cdf FROM (SELECT source, j, sum(p) OVER (PARTITION BY source ORDER BY j) AS c FROM term) GROUP BY source),
drawn AS (SELECT doc_id, d.source, rate, ('0x' || substr(md5('29:' || doc_id || ':' || i), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u, cdf
  FROM d JOIN parts USING (source) JOIN cdf USING (source), range(1, 1000) g(i) WHERE i <= parts),
counted AS (SELECT doc_id, source, rate, sum(len(list_filter(cdf, lambda c: c <= u)))::INT AS copies FROM drawn GROUP BY doc_id, source, rate)
SELECT doc_id, source, copies, i::INT AS copy, round(rate, 6) AS rate, ('0x' || substr(md5('30:' || doc_id || ':' || i), 1, 13))::BIGINT AS shuffle_key
FROM counted, range(1, 100000) g(i) WHERE i <= copies
"""


def mixed_documents(docs: DataFrame) -> DataFrame:
    """Query op8: every source's share follows the root of its bytes."""
    out = poisson_mix(docs.select("doc_id", "text", "source"), keep=["doc_id", "source"])
    return out.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "copies", "copy", F.round("rate", 6).alias("rate"), "shuffle_key")

"""Whitening of embeddings by principal components from an exact integer scatter.

Entries become integers, from which a shift is subtracted. Sums and cross
products are added up as integers of any size, and n·XᵀX - SSᵀ, which no
shift changes, is formed exactly. Only then come floating point numbers and
``eigh``. So the components are the same whatever the partitions, and no
digits are lost to large means.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh

SCALE = 1024
SHIFT = 100_000
MOST = 8
#: Limbs of sums on their way through Spark: base 2 ** 40, so a long holds the sum of eight million of them.
LIMB = 40
LIMBS = 6
LONG = 1 << 63


def integers(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * c) + SHIFT as longs, at the ends of their range where it lies beyond."""
    y = np.floor(values * float(SCALE))
    inside = np.abs(y) < 2.0**62
    x = np.where(inside, y, 0).astype(np.int64) + SHIFT
    return np.where(inside, x, np.where(y > 0, LONG - 1, -LONG))


def scatter(y: np.ndarray) -> tuple[list[int], list[list[int]]]:
    """Sums and cross products of integer rows, exact.

    Products of small entries add up in doubles without rounding (below
    2 ** 53); larger ones are Python integers.
    """
    largest = max(int(y.max(initial=0)), -int(y.min(initial=0)))
    if largest * largest * max(len(y), 1) < 1 << 53:
        z = y.astype(np.float64)
        return [int(v) for v in z.sum(0)], [[int(v) for v in row] for row in z.T @ z]
    big = y.astype(object)
    return [int(v) for v in big.sum(0)], [[int(v) for v in row] for row in big.T @ big]


def limbs(value: int) -> list[int]:
    """``value`` in base 2 ** LIMB, the last limb signed."""
    out = []
    for _ in range(LIMBS - 1):
        out.append(value & ((1 << LIMB) - 1))
        value >>= LIMB
    return [*out, value]


def whole(parts: list[int]) -> int:
    return sum(int(v) << (LIMB * k) for k, v in enumerate(parts))


@dataclass
class Fit:
    """What the fit list says: count, sums S of x, components (columns), their eigenvalues and shares."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dims)


def usable(vectors: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is not null, not empty and holds finite numbers only."""
    v = F.col(f"`{vector}`")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.where(v.isNotNull() & (F.size(v) > 0) & finite)


def exact_scatter(vectors: DataFrame, vector: str, dims: int) -> tuple[int, list[int], list[list[int]]]:
    """(n, sums, cross products) of x - SHIFT. Partitions hand on dims² numbers each; Spark adds them up by place."""
    fields = ", ".join(f"l{k} long" for k in range(LIMBS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, cross = 0, [0] * dims, [[0] * dims for _ in range(dims)]
        for batch in batches:
            y = integers(_matrix(batch.column(0), dims)).astype(np.int64)
            y = y - SHIFT if y.min(initial=0) > -LONG + SHIFT else y.astype(object) - SHIFT
            s, c = scatter(y)
            n += len(y)
            sums = [a + b for a, b in zip(sums, s, strict=True)]
            cross = [[a + b for a, b in zip(p, q, strict=True)] for p, q in zip(cross, c, strict=True)]
        rows = [(-1, -1, n), *((-1, i, v) for i, v in enumerate(sums)), *((i, j, cross[i][j]) for i in range(dims) for j in range(i, dims))]
        i, j, v = zip(*rows, strict=True)
        yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32())} | {f"l{k}": pa.array(c, pa.int64()) for k, c in enumerate(zip(*map(limbs, v), strict=True))})

    parts = vectors.select(F.col(f"`{vector}`").cast("array<double>").alias("v")).mapInArrow(run, f"i int, j int, {fields}")
    total = {(r["i"], r["j"]): whole([r[f"l{k}"] for k in range(LIMBS)]) for r in parts.groupBy("i", "j").agg(*[F.sum(f"l{k}").alias(f"l{k}") for k in range(LIMBS)]).collect()}
    get = lambda i, j: total.get((i, j), 0)
    return get(-1, -1), [get(-1, i) for i in range(dims)], [[get(min(i, j), max(i, j)) for j in range(dims)] for i in range(dims)]


def fit(n: int, sums: list[int], cross: list[list[int]], most: int = MOST) -> Fit:
    """Components by falling eigenvalue, at most ``most``, of the covariance (n·XᵀX - SSᵀ) / n²."""
    dims = len(sums)
    exact = [[n * cross[i][j] - sums[i] * sums[j] for j in range(dims)] for i in range(dims)]
    covariance = np.array([[v / (n * n) for v in row] for row in exact], np.float64)
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:most]
    values, vectors = values[order], vectors[:, order]
    trace = sum(exact[i][i] for i in range(dims)) / (n * n)
    # one sign for all rows and runs: the largest entry is positive
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(len(order))] < 0, -1.0, 1.0)
    values = np.where(values > trace * dims * np.finfo(float).eps, values, 0.0)
    return Fit(n, [s + n * SHIFT for s in sums], vectors, values, values / trace if trace else np.zeros(len(order)))


def whiten(vectors: DataFrame, vector: str = "embedding", most: int = MOST) -> DataFrame:
    """All columns but the vector, a row per component 1, 2 ... up to ``most``, of every usable vector.

    Adds component, n (vectors fitted), deviation (sum over dimensions of
    (n·x - S)², an exact decimal, null beyond 38 digits), whitened, explained and identity_error.
    Vectors that are null or empty or hold null or non-finite entries are
    dropped, as are those of another length than most have (the smaller
    length where equally many do). Repeated rows and ids count as often as
    they are there. Components without variance (one vector, equal vectors,
    fewer vectors than components) have whitened null and explained 0, and
    take no part in identity_error, which is null if there are no others.
    An empty table gives an empty one. Columns named like the new ones are
    replaced. What passes the driver is dims² numbers.
    """
    good = usable(vectors, vector)
    sizes = good.groupBy(F.size(f"`{vector}`").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    dims = sizes["dims"] if sizes else 1
    good = good.where(F.size(f"`{vector}`") == dims)
    n, sums, cross = exact_scatter(good, vector, dims)
    fitted = fit(n, sums, cross, most) if n else Fit(0, [0], np.ones((1, 1)), np.zeros(1), np.zeros(1))
    kept = [c for c in vectors.columns if c != vector and c not in NEW]
    (hidden,) = fresh(vectors, "vector")
    frame = good.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{vector}`").cast("array<double>").alias(hidden))
    mean = np.array([s / n for s in fitted.sums]) if n else np.zeros(1)
    # x - S/n with the mean split into whole and rest, so that nothing is rounded before the difference
    base = [s // n for s in fitted.sums] if n else [0]
    rest = np.array([(s - b * n) / n for s, b in zip(fitted.sums, base, strict=True)]) if n else mean
    live = fitted.values > 0
    scale = np.where(live, 1 / np.sqrt(np.where(live, fitted.values, 1)), np.nan)

    def projected(x: np.ndarray) -> np.ndarray:
        centred = (x.astype(object) - np.array(base, object)).astype(np.float64) if np.abs(x).max(initial=0) > 1 << 52 else (x - np.array(base, np.int64)).astype(np.float64)
        return ((centred - rest) @ fitted.components) * scale

    def deviations(x: np.ndarray) -> list[int]:
        largest = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + max(map(abs, base)) + 1
        if (largest * n) ** 2 * dims < LONG:
            d = x * n - np.array(fitted.sums, np.int64)
            return (d * d).sum(1).tolist()
        d = x.astype(object) * n - np.array(fitted.sums, object)
        return [int(v) for v in (d * d).sum(1)]

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(scale)
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = np.nan_to_num(projected(integers(_matrix(batch.column(0), dims))))
            first += w.sum(0)
            second += w.T @ w
        at = [(i, j) for i in range(k) for j in range(i, k)]
        yield pa.RecordBatch.from_pydict({"i": pa.array([-1] * k + [i for i, _ in at], pa.int32()), "j": pa.array([*range(k), *(j for _, j in at)], pa.int32()), "v": pa.array([*first.tolist(), *(float(second[p]) for p in at)])})

    error = None
    if n and live.any():
        got = {(r["i"], r["j"]): r["v"] for r in frame.select(hidden).mapInArrow(moments, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()}
        alive = np.flatnonzero(live).tolist()
        error = max(abs(got[i, j] / n - got[-1, i] / n * (got[-1, j] / n) - (i == j)) for i in alive for j in alive if i <= j)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = integers(_matrix(batch.column(batch.num_columns - 1), dims))
            w = projected(x)
            columns = [*batch.columns[:-1], pa.array([v if v < 10**38 else None for v in deviations(x)], pa.decimal128(38, 0)), pa.array(w.tolist(), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    schema = frame.select(*[F.col(f"`{c}`") for c in kept], F.lit(None).cast("decimal(38,0)").alias("deviation"), F.lit(None).cast("array<double>").alias(hidden)).schema
    k = len(scale) if n else 0
    parts = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("component"), F.nanvl(F.get(hidden, F.lit(i)), F.lit(None).cast("double")).alias("whitened"), F.lit(float(fitted.explained[i])).alias("explained")) for i in range(k)] or [F.struct(F.lit(0).alias("component"), F.lit(0.0).alias("whitened"), F.lit(0.0).alias("explained"))]))
    out = frame.mapInArrow(told, schema).select(*[F.col(f"`{c}`") for c in kept], "deviation", parts.alias("made"))
    return out.select(*[F.col(f"`{c}`") for c in kept], "made.component", F.lit(n).cast("long").alias("n"), "deviation", "made.whitened", "made.explained", F.lit(error).cast("double").alias("identity_error"))


NEW = ["component", "n", "deviation", "whitened", "explained", "identity_error"]


def whitened_embeddings(vectors: DataFrame) -> DataFrame:
    """vec_id and the columns of ``whiten``; a deviation beyond a long is null."""
    return whiten(vectors.select("vec_id", "embedding")).withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))

"""Whitening against exact fractions and a plain decomposition."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest
from tessera.llm import queries, whiten

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, most=8):
    """vec_id to (deviation, whitened up to sign), and n, explained."""
    good = [(i, v) for i, v in rows if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)]
    n, dims = len(good), len(good[0][1])
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in good]
    sums = [sum(r[k] for r in x) for k in range(dims)]
    cov = np.array([[float(sum((Fraction(r[i]) - Fraction(sums[i], n)) * (Fraction(r[j]) - Fraction(sums[j], n)) for r in x) / n) for j in range(dims)] for i in range(dims)])
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:most]
    centred = np.array([[float(Fraction(c) - Fraction(s, n)) for c, s in zip(r, sums)] for r in x])
    white = centred @ vectors[:, order] / np.sqrt(values[order])
    return n, [sum((n * c - s) ** 2 for c, s in zip(r, sums)) for r in x], white, values[order] / np.trace(cov), [i for i, _ in good]


def check(got, rows, most=8, atol=1e-9):
    n, deviation, white, explained, ids = plain(rows, most)
    by = {(r["vec_id"], r["component"]): r for r in got}
    assert len(got) == len(by) == len(ids) * white.shape[1]
    for c in range(white.shape[1]):
        column = np.array([by[i, c + 1]["whitened"] for i in ids])
        sign = np.sign(column @ white[:, c])
        assert np.allclose(column * sign, white[:, c], atol=atol)
        for k, i in enumerate(ids):
            r = by[i, c + 1]
            assert (r["n"], int(r["deviation"])) == (n, deviation[k])
            assert abs(r["explained"] / explained[c] - 1) < 1e-9
            assert abs(r["identity_error"]) < 1e-9


def test_query_equals_fractions(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    check(queries.QUERIES["op12_integer_whitening"](spark, sf_dir).collect(), rows)


def test_small_tables(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.standard_normal(5) * [5, 3, 2, 1, 0.5] + 1e3).tolist()) for i in range(40)]
    rows += [(100, None), (101, [float("nan")] * 5), (102, [1.0, None, 1.0, 1.0, 1.0]), (103, [float("-inf")] + [0.0] * 4), (104, [])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(3)
    check(whiten.whitened_embeddings(df).collect(), rows, atol=1e-7)
    other = spark.createDataFrame([(200, [1.0, 2.0], 0), (201, [3.0, 2.0], 0)], SCHEMA)
    check(whiten.whitened_embeddings(df.union(other)).collect(), rows, atol=1e-7)


def test_huge_entries_stay_exact(spark):
    rows = [(i, [float(v) for v in np.random.default_rng(i).integers(-(2**45), 2**45, 3)]) for i in range(12)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    n, sums, cross = whiten.exact_scatter(df, "embedding", 3)
    x = [[math.floor(1024 * c) for c in v] for _, v in rows]
    assert (n, sums) == (12, [sum(r[k] for r in x) for k in range(3)])
    assert cross == [[sum(r[i] * r[j] for r in x) for j in range(3)] for i in range(3)]
    assert all(r["deviation"] is None for r in whiten.whitened_embeddings(df).collect())


@pytest.mark.parametrize("v", [0, 1, -1, 2**40, -(2**40), 2**200 + 17, -(2**199) - 3])
def test_limbs(v):
    assert whiten.whole(whiten.limbs(v)) == v and all(-(2**63) <= x < 2**63 for x in whiten.limbs(v))


def test_without_variance(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0], 0)], SCHEMA)
    got = whiten.whitened_embeddings(one).collect()
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in sorted(got, key=lambda r: r["component"])] == [(1, 1, 0, None, 0.0, None), (2, 1, 0, None, 0.0, None)]
    flat = spark.createDataFrame([(k, [float(k), 2.0 * k, 5.0], 0) for k in range(7)] * 2, SCHEMA)
    got = whiten.whitened_embeddings(flat).collect()
    assert len(got) == 42 and {r["component"] for r in got if r["whitened"] is not None} == {1} and max(r["identity_error"] for r in got) < 1e-12
    assert whiten.whitened_embeddings(spark.createDataFrame([], SCHEMA)).count() == 0


def test_other_columns_stay(spark):
    df = spark.createDataFrame([(k, [float(k), 1.0 - k * k], None, "x") for k in range(5)], "id long, v array<float>, n long, vector string")
    got = whiten.whiten(df, "v", most=1)
    assert got.columns == ["id", "vector", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert {(r["id"], r["n"], r["vector"]) for r in got.collect()} == {(k, 5, "x") for k in range(5)}

"""The manifest against a plain tree, level by level."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessera.llm import merkle, queries
from test_operators import SCHEMA, odd_rows

H = lambda s: hashlib.sha256(s.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(nodes, at, fanout):
    """Root of ``nodes`` and the siblings of node ``at`` with its place, level by level."""
    path = []
    while len(nodes) > 1:
        run = at // fanout * fanout
        others = nodes[run : run + fanout]
        path.append((at - run, "".join(others[: at - run] + others[at - run + 1 :])))
        nodes = [H("".join(nodes[k : k + fanout])) for k in range(0, len(nodes), fanout)]
        at //= fanout
    return nodes[0], path


def plain(rows, fanout=2):
    """rows: (doc_id, source, lang, n_chars, text); gives sorted results as the query's."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0], H("".join(map(field, r))), r))
    for members in groups.values():
        members.sort(key=lambda m: (m[0] is not None, m[0] or 0, m[1]))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    roots = [climb([m[1] for m in groups[g]], 0, fanout)[0] for g in order]
    out = []
    for g, (name, subroot) in enumerate(zip(order, roots)):
        root, above = climb(roots, g, fanout)
        leaves = [m[1] for m in groups[name]]
        for k, (i, leaf, r) in enumerate(groups[name]):
            path = climb(leaves, k, fanout)[1] + above
            wrong = i is not None and zlib.crc32(str(i).encode()) % 7 == 0 and r[3] is not None
            digest = H("".join(map(field, (*r[:3], r[3] + 1, r[4])))) if wrong else leaf
            for place, others in path:
                digest = H(others[: place * 64] + digest + others[place * 64 :])
            out.append((i, leaf, subroot, root, H("".join(o for _, o in path)), digest, digest == root))
    return out


NAMES = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def told(df):
    return sorted((tuple(r[c] for c in NAMES) for r in df.collect()), key=repr)


@pytest.mark.parametrize("block", [4096, 8])
def test_query_equals_a_plain_tree(spark, sf_dir, block, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK", block)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = plain([tuple(r) for r in docs.select(*merkle.COLUMNS).collect()])
    got = told(queries.QUERIES["op11_merkle_manifest"](spark, sf_dir))
    assert got == sorted(want, key=repr)
    assert 0 < sum(not r[-1] for r in got) < len(got) / 3


def test_odd_rows(spark):
    df = spark.createDataFrame(odd_rows(), SCHEMA)
    want = plain([tuple(r) for r in df.select(*merkle.COLUMNS).collect()])
    assert told(merkle.verified_documents(df)) == sorted(want, key=repr)


@pytest.mark.parametrize("n,fanout", [(1, 2), (9, 3), (10, 10), (28, 3), (100, 10), (27, 2)])
def test_any_size_and_fanout(spark, n, fanout, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK", 10)
    leaves = [H(str(k)) for k in range(n)]
    rows = [(k, "x", leaf, "taken", k) for k, leaf in enumerate(leaves)]
    df = spark.createDataFrame(rows, "i long, g string, leaf string, root string, part long").repartition(3)
    made = merkle.manifest(df, F.col("leaf"), "g", "i", fanout).orderBy("i").collect()
    assert set(df.columns) < set(made[0].asDict())
    for k, r in enumerate(made):
        root, path = climb(leaves, k, fanout)
        assert (r["number"], r["root"], r["subroot"], r["part"]) == (k, root, root, k)
        assert [(s["place"], s["others"]) for s in r["steps"]] == path
        assert merkle.folded(leaves[k], path) == root


def test_no_rows(spark):
    assert told(merkle.verified_documents(spark.createDataFrame([], SCHEMA))) == []


def test_one_row_many_times_spreads(spark):
    df = spark.range(20_000).select(F.lit(7).alias("doc_id"), F.lit("a").alias("source"), F.lit("en").alias("lang"), F.lit(1).alias("n_chars"), F.lit("t").alias("text"))
    got = merkle.verified_documents(df)
    assert got.count() == 20_000 and got.where("verified").count() == (20_000 if zlib.crc32(b"7") % 7 else 0)
    assert got.select("proof_sha256").distinct().count() > 1


def test_level_of_a_matrix():
    nodes = np.frombuffer("".join(H(str(k)) for k in range(7)).encode(), np.uint8).reshape(-1, 64)
    up = merkle.level_up(nodes, 3)
    text = nodes.tobytes().decode()
    assert up.tobytes().decode() == H(text[:192]) + H(text[192:384]) + H(text[384:])

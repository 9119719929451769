"""Removal of repeated strings against all strings of all texts."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessera.llm import bwt, queries, suffix
from test_operators import SCHEMA, odd_rows


def plain(texts, least):
    """(bytes, removed, runs, digest of the rest) per text."""
    raw = [(t or "").encode() for t in texts]
    met = Counter(r[k : k + least] for r in raw for k in range(len(r) - least + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r) + 1, bool)
        for k in range(len(r) - least + 1):
            if met[r[k : k + least]] > 1:
                gone[k : k + least] = True
        edges = np.flatnonzero(np.diff(gone.astype(int), prepend=0))
        rest = bytes(b for b, g in zip(r, gone) if not g)
        out.append((len(r), int(gone.sum()), len(edges) // 2, hashlib.sha256(rest).hexdigest()))
    return out


def told(df):
    return [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()]


def texts_of(seed, n=60):
    rng = random.Random(seed)
    words = ["ab", "é", "zeta", "\U0001f600", "-", "q"]
    said = lambda k: "".join(rng.choice(words) + rng.choice([" ", "", "\n"]) for _ in range(k))
    shared = [said(rng.randint(5, 60)) for _ in range(6)]
    out = ["".join(rng.choice([said(rng.randint(0, 40)), rng.choice(shared)]) for _ in range(rng.randint(0, 5))) for _ in range(n)]
    return [*out, "x" * 500, "xy" * 300, None, "", out[3], out[3]]


@pytest.mark.parametrize("least,per_task", [(12, 1), (40, 1024), (200, 1)])
def test_equals_all_strings(spark, least, per_task, monkeypatch):
    monkeypatch.setattr(suffix, "PER_TASK", per_task)
    texts = texts_of(least)
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string").repartition(3)
    got = suffix.repeated_spans(df, least=least).orderBy("i")
    assert told(got) == plain(texts, least)
    assert any(n for _, n, _, _ in told(got))
    for r in suffix.kept_bytes(got).collect():
        assert hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"]


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in queries.QUERIES["op13_interval_repeats"](spark, sf_dir).collect()}
    assert got == dict(zip([r["doc_id"] for r in docs], plain([r["text"] for r in docs], 200)))


def test_odd_rows(spark):
    rows = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA).withColumn("n_spans", F.lit("taken")).withColumn("a", F.lit(1)).withColumn("key", F.lit(2))
    got = suffix.repeated_spans(df, least=30)
    assert set(got.columns) == set(df.columns) | set(suffix.RESULT)
    assert sorted(told(got)) == sorted(plain([r[1] for r in rows], 30))


def test_no_rows(spark):
    assert told(suffix.repeated_spans(spark.createDataFrame([], SCHEMA))) == []
    assert told(suffix.repeated_spans(spark.createDataFrame([(1, "short")], "i long, text string"))) == [(5, 0, 0, hashlib.sha256(b"short").hexdigest())]


def test_texts_over_several_chunks(spark, monkeypatch):
    """A passage that crosses a chunk's end, and one text larger than several chunks."""
    monkeypatch.setattr(suffix, "CHUNK", 1000)
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz "
    big = "".join(rng.choice(letters) for _ in range(5000))
    texts = [big, "head" + big[700:1500] + "tail", big[900:1101], "".join(rng.choice(letters) for _ in range(800)), big[:150]]
    data, ends = np.frombuffer(big.encode(), np.uint8), np.full(5000, 5000)
    start, starts, *_ = suffix.pieces_of(data, ends, 200, 32)
    assert sorted(np.concatenate([np.arange(s, s + n) for s, n in zip(start, starts)]).tolist()) == list(range(4801))
    for cut in [suffix._pieces]:
        df = spark.createDataFrame([(k, k, 1, bytearray(t.encode())) for k, t in enumerate(texts)], "a long, b long, weight long, text binary").coalesce(1)
        rows = cut(df, 200).collect()
        for k, t in enumerate(texts):
            held = sorted(p for r in rows if r["a"] == k for p in range(r["start"], r["start"] + r["starts"]))
            assert held == list(range(max(len(t) - 199, 0)))
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    assert told(suffix.repeated_spans(df).orderBy("i")) == plain(texts, 200)


@pytest.mark.parametrize("step", [16, 1])
def test_cutting_again_keeps_all_starts(step):
    rng = np.random.default_rng(step)
    data = rng.integers(97, 101, 4000).astype(np.uint8)
    start, starts, anchor, _, _ = suffix.pieces_of(data, np.full(4000, 4000), 200, 32)
    source, begin, n, far, key, digest = suffix.cut_again(data, start, starts, anchor, step, 200)
    assert n.max() <= step and (begin + far == (start + anchor)[source]).all()
    for p in range(len(start)):
        held = np.concatenate([np.arange(b, b + w) for b, w in zip(begin[source == p], n[source == p])])
        assert sorted(held.tolist()) == list(range(start[p], start[p] + starts[p]))
    # equal strings at another place get equal keys
    twice = np.concatenate([data[500:900], data[100:1500]])
    s2 = suffix.pieces_of(twice, np.where(np.arange(1800) < 400, 400, 1800), 200, 32)
    again = suffix.cut_again(twice, *s2[:3], step, 200)
    keys = {}
    for b, w, k in zip(again[1], again[2], again[4]):
        for q in range(b, b + w):
            keys.setdefault(bytes(twice[q : q + 200]), set()).add(k)
    assert all(len(v) == 1 for v in keys.values()) and len(keys) == 1201


def test_intervals_tell_common_prefixes():
    rng = random.Random(1)
    for trial in range(40):
        most = rng.choice([1, 2, 3, 5, 8, 20])
        text = b"".join(bytes(rng.choice(b"ab" if trial % 2 else b"abcdefg") for _ in range(rng.randint(1, 60))) + b"\xff" for _ in range(rng.randint(1, 12)))
        order = bwt.suffix_order(np.frombuffer(text, np.uint8), most)
        found = bwt.common_prefixes(bwt.transform(np.frombuffer(text, np.uint8), order), most)
        padded = text + bytes(most)
        for i in range(1, len(order)):
            x, y = (padded[order[k] : order[k] + most] for k in (i - 1, i))
            shared = next((k for k in range(most) if x[k] != y[k]), most)
            assert x <= y and (0xFF in x[:shared] or found[i] == shared)


def test_repeated_strings_by_weight():
    rng = random.Random(2)
    for _ in range(40):
        least = rng.choice([1, 2, 5, 9])
        parts = [bytes(rng.choice(b"abc") for _ in range(rng.randint(least, 50))) for _ in range(rng.randint(1, 9))]
        starts = np.array([rng.randint(1, len(p) - least + 1) for p in parts])
        counts = np.array([rng.choice([1, 1, 2]) for _ in parts])
        met = Counter()
        for p, s, w in zip(parts, starts, counts):
            for k in range(s):
                met[p[k : k + least]] += w
        got = {(p, k) for p, a, b in zip(*bwt.repeated(parts, counts, starts, least)) for k in range(a, b)}
        assert got == {(n, k) for n, (p, s) in enumerate(zip(parts, starts)) for k in range(s) if met[p[k : k + least]] > 1}

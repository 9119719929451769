"""Removal of byte strings that occur elsewhere in the corpus, by suffix order.

A string of ``least`` bytes is repeated if it starts at two places or more,
of one text or of several. Every byte that some repeated string covers goes.

How places that share a string meet. A string holds ``least - GRAM + 1`` grams
of ``GRAM`` bytes; the one of least hash (the leftmost, among equals) is its
anchor, which depends on the string alone. Neighbouring starts mostly share
their anchor, so a text falls into pieces: runs of starts with one anchor.
Pieces of one key (the anchor's hash) may hold equal strings, others cannot.
Pieces whose key is found once are dropped; equal pieces become one weighted
piece; those of one key meet in a task. There a threshold-bounded interval
expansion over the Burrows-Wheeler transform of the pieces (``bwt``) derives
their common prefixes by increasing value, stops at ``least``, and so tells
which strings occur twice.

A key with many unequal pieces (a short passage in very many surroundings) is
hot. Its pieces are cut again at places fixed by the anchor, into runs of 16
starts, then of single ones, and get the hash of all bytes that the run's
strings share as their key. Each cut drops what is found once; a run of one
start leaves one piece to a key, so no group grows with the table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bwt
from .common import PER_TASK, bucketed, discard, for_salts, fresh, hot_keys, salted, slices, stored

#: Bytes of a gram.
GRAM = 32
#: Starts per piece when a hot key's pieces are cut again, round by round.
CUTS = (16, 1)
#: Bytes of pieces that a task sorts at a time, and more than one key ever has.
TOGETHER = 1 << 19
#: Bytes of text hashed at a time; positions in it take as many bits.
CHUNK = 1 << 20
POSITION = 20

_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2 ** 64."""
    return tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, x, np.uint64))]) for x in (base, pow(base, -1, 1 << 64)))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


class Hashes:
    """Polynomial hashes of any range of a byte array, from prefix sums."""

    powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, base: int) -> None:
        known = self.powers.get(base)
        if known is None or len(known[0]) <= len(data):
            known = self.powers[base] = _powers(base, max(len(data), 2 * CHUNK))
        up, self.down = known
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def grams(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return _mixed((self.sums[size:] - self.sums[:n]) * self.down[:n] + np.uint64(size))


def window_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` successive values."""
    n = len(values)
    blocks = np.concatenate([values, np.full(-n % width, np.iinfo(values.dtype).max, values.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def pieces_of(data: np.ndarray, ends: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, ...]:
    """(start, starts, anchor, key, digest) of the pieces of texts joined to one array.

    ``ends`` tells the text to which each place belongs by where it ends.
    ``start`` counts from the array's beginning, ``anchor`` from ``start``.
    """
    none = np.zeros(0, np.int64)
    if len(data) < least:
        return none, none, none, none, none
    first = Hashes(data, _BASES[0])
    mask = np.uint64((1 << POSITION) - 1)
    n = len(data) - gram + 1
    marked = (first.grams(gram) & ~mask) | np.arange(n, dtype=np.uint64)
    anchor = (window_least(marked, least - gram + 1) & mask).astype(np.int64)
    inside = np.arange(len(anchor)) + least <= ends[: len(anchor)]
    opens = inside.copy()
    opens[1:] &= (anchor[1:] != anchor[:-1]) | ~inside[:-1]
    shuts = inside.copy()
    shuts[:-1] &= (anchor[1:] != anchor[:-1]) | ~inside[1:]
    start, last = np.flatnonzero(opens), np.flatnonzero(shuts)
    at = anchor[start]
    digest = Hashes(data, _BASES[1]).of(start, last + least)
    return start, last - start + 1, at - start, first.of(at, at + gram).view(np.int64), digest.view(np.int64)


def cut_again(data: np.ndarray, start: np.ndarray, starts: np.ndarray, anchor: np.ndarray, step: int, least: int) -> tuple[np.ndarray, ...]:
    """Pieces of at most ``step`` starts: (source, start, starts, anchor, key, digest).

    Cuts lie at multiples of ``step`` before the anchor, so equal strings fall in equal runs.
    """
    away_last = anchor - (starts - 1)  # of the last start, the nearest to the anchor (0 or more)
    runs = anchor // step - away_last // step + 1
    source = np.repeat(np.arange(len(start)), runs)
    k = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs) + (away_last // step)[source]
    near = np.maximum(k * step, away_last[source])
    far = np.minimum((k + 1) * step - 1, anchor[source])
    at = start[source] + anchor[source]
    begin, n = at - far, far - near + 1
    inner = at - k * step  # the nearest start that the run could have, whatever this piece has of it
    shared = inner + least - step + 1
    first, second = Hashes(data, _BASES[0]), Hashes(data, _BASES[1])
    key = first.of(inner, shared) ^ _mixed(k.astype(np.uint64) + np.uint64(step << 32))
    return source, begin, n, far, key.view(np.int64), second.of(begin, begin + n - 1 + least).view(np.int64)


#: A piece: its text (two halves of a digest), first start, number of starts, the anchor's distance from it.
_PIECE = "a long, b long, start long, starts int, anchor int, key long, digest long"


def _batches(spark: SparkSession, fields: str):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(fields)
    arrow = to_arrow_schema(schema)
    return schema, lambda columns: pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, arrow, strict=True)], schema=arrow)


def _pieces(texts: DataFrame, least: int) -> DataFrame:
    """The pieces of all texts, with the weight of their texts."""
    gram = min(GRAM, max(1, least // 4))
    schema, batch_of = _batches(texts.sparkSession, f"{_PIECE}, weight long")

    def cut(raw: bytes, begins: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(text, start in it, starts, ...) of the texts between ``begins`` and ``ends``."""
        data = np.frombuffer(raw, np.uint8)
        for lo in range(0, len(data), CHUNK - least):
            hi = min(lo + CHUNK, len(data))
            where = np.repeat(np.arange(len(ends)), np.clip(ends, lo, hi) - np.clip(begins, lo, hi))
            # strings that start in a chunk's last bytes belong to the next one
            limit = hi - lo - (hi < len(data))
            start, *rest = pieces_of(data[lo:hi], np.minimum(ends[where] - lo, limit), least, gram)
            yield (where[start], start + lo - begins[where[start]], *rest)
            if hi == len(data):
                return

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, weight = (batch.column(k).to_numpy() for k in range(3))
            sizes = pc.binary_length(batch.column(3)).to_numpy().astype(np.int64)
            for at, n in slices(sizes, len(sizes), CHUNK - 1):
                ends = np.cumsum(sizes[at : at + n])
                raw = b"".join(batch.column(3).slice(at, n).to_pylist())
                for text, *columns in cut(raw, ends - sizes[at : at + n], ends):
                    row = text + at
                    yield batch_of([a[row], b[row], *columns, weight[row]])

    return texts.select("a", "b", "weight", "text").mapInArrow(run, schema)


def _per_text(texts: DataFrame, lists: DataFrame, work, fields: str) -> DataFrame:
    """``work(text bytes, list of structs)`` gives columns of rows, for texts that have a list (a, b, items)."""
    schema, batch_of = _batches(texts.sparkSession, f"a long, b long, {fields}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, text, items = (batch.column(k) for k in range(4))
            for k in range(batch.num_rows):
                made = work(text[k].as_py(), items[k].values)
                n = len(made[0])
                if n:
                    yield batch_of([np.full(n, a[k].as_py()), np.full(n, b[k].as_py()), *made])

    return texts.join(lists, ["a", "b"]).select("a", "b", "text", "items").mapInArrow(run, schema)


def _found_twice(pieces: DataFrame) -> DataFrame:
    """Pieces whose key weighs two or more, stored."""
    counts = stored(pieces.groupBy("key").agg(F.sum("weight").alias("n"), F.count(F.lit(1)).alias("rows")).where("n > 1"), "suffix_keys")
    hot = hot_keys(counts, ["key"], "rows", pieces.count())
    met = salted(pieces, hot, ["key"], "a").join(for_salts(counts.select("key"), hot, ["key"]), ["key", "salt"]).drop("salt")
    out = stored(met, "suffix_pieces")
    discard(counts, hot)
    return out


def _distinct(pieces: DataFrame) -> DataFrame:
    """One piece for each content of a key, with the weight of all."""
    place = F.struct("a", "b", "start", "starts", "anchor")
    return pieces.groupBy("key", "digest").agg(F.sum("weight").alias("n"), F.count(F.lit(1)).alias("rows"), F.min(place).alias("p")).select("key", "digest", "n", "rows", "p.*")


def _cut_hot(texts: DataFrame, pieces: DataFrame, kinds: DataFrame, step: int, least: int) -> tuple[DataFrame, DataFrame]:
    """Cut the pieces of hot keys again; the rest stays. Gives pieces and their kinds, stored."""
    crowd = kinds.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > min(PER_TASK, TOGETHER // (2 * least)))
    hot = stored(crowd.select("key"), "suffix_hot")
    if hot.isEmpty():
        discard(hot)
        return pieces, kinds

    # few keys by definition: each has over PER_TASK contents
    again = pieces.join(hot, "key", "left_semi")
    lists = again.groupBy("a", "b").agg(F.collect_list(F.struct("start", "starts", "anchor", "weight")).alias("items"))

    def work(text: bytes, items: pa.StructArray) -> list[np.ndarray]:
        start, starts, anchor, weight = (items.field(k).to_numpy().astype(np.int64) for k in range(4))
        made = []
        for at in range(0, len(start), 4096):
            part = slice(at, at + 4096)
            ends = np.cumsum(starts[part] - 1 + least)
            begins = ends - (starts[part] - 1 + least)
            joined = b"".join(text[s:e] for s, e in zip(start[part].tolist(), (start[part] + starts[part] - 1 + least).tolist(), strict=True))
            source, begin, *columns = cut_again(np.frombuffer(joined, np.uint8), begins, starts[part], anchor[part], step, least)
            made.append([begin - begins[source] + start[part][source], *columns, weight[part][source]])
        return [np.concatenate(c) for c in zip(*made, strict=True)]

    cut = stored(_per_text(texts, lists, work, "start long, starts int, anchor int, key long, digest long, weight long"), "suffix_cut")
    twice = _found_twice(cut)
    out = stored(pieces.join(hot, "key", "left_anti").unionByName(twice), "suffix_pieces")
    new = stored(_distinct(out), "suffix_kinds")
    discard(hot, cut, twice, pieces, kinds)
    return out, new


def _repeats(texts: DataFrame, kinds: DataFrame, least: int) -> DataFrame:
    """(key, digest, runs): for each kind, the runs of its starts whose strings occur twice."""
    lists = kinds.groupBy("a", "b").agg(F.collect_list(F.struct("start", "starts", "key", "digest", "n")).alias("items"))

    def contents(text: bytes, items: pa.StructArray) -> list:
        start, starts, key, digest, n = (items.field(k).to_numpy() for k in range(5))
        return [key, digest, n, starts, [text[s : s + w - 1 + least] for s, w in zip(start.tolist(), starts.tolist(), strict=True)]]

    held = _per_text(texts, lists, contents, "key long, digest long, n long, starts int, content binary").drop("a", "b")
    schema, batch_of = _batches(texts.sparkSession, "key long, digest long, runs array<int>")

    def judge(rows: list[tuple]) -> pa.RecordBatch:
        key, digest, n, starts, content = zip(*rows, strict=True)
        part, begin, end = bwt.repeated(content, np.array(n), np.array(starts), least)
        first = np.flatnonzero(np.diff(part, prepend=-1))
        met = part[first]
        runs = pa.ListArray.from_arrays(pa.array(2 * np.append(first, len(part)), pa.int32()), pa.array(np.stack([begin, end], 1).ravel(), pa.int32()))
        return batch_of([np.array(key, np.int64)[met], np.array(digest, np.int64)[met], runs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = keyed = 0  # bytes held; rows before the last key's first
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and rows[-1][0] != row[0]:
                    keyed = len(rows)
                if size + len(row[4]) + 1 > TOGETHER and keyed:
                    yield judge(rows[:keyed])
                    rows = rows[keyed:]
                    size, keyed = sum(len(r[4]) + 1 for r in rows), 0
                rows.append(row)
                size += len(row[4]) + 1
        if rows:
            yield judge(rows)

    tasks = texts.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return held.repartition(int(tasks), "key").sortWithinPartitions("key", "digest").mapInArrow(run, schema)


def _spans(pieces: DataFrame, kinds: DataFrame, found: DataFrame, least: int) -> DataFrame:
    """(a, b, items): for each text, the ranges (from, to) that repeated strings cover, as far as pieces tell."""
    keys = ["key", "digest"]
    hot = hot_keys(kinds, keys, "rows", pieces.count())
    met = salted(pieces, hot, keys, "a").join(for_salts(found, hot, keys), [*keys, "salt"])
    covered = F.transform(
        F.sequence(F.lit(0), F.size("runs") - 2, F.lit(2)),
        lambda k: F.struct((F.col("start") + F.get("runs", k)).alias("from"), (F.col("start") + F.get("runs", k + 1) - 1 + least).alias("to")),
    )
    return met.select("a", "b", F.explode(covered).alias("c")).groupBy("a", "b").agg(F.collect_list("c").alias("items"))


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges in any order, joined where they overlap or touch."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    opens = np.concatenate([[True], start[1:] > reach[:-1]])
    return start[opens], reach[np.concatenate([opens[1:], [True]])]


def rest_of(text: bytes, edges: list[int]) -> Iterator[bytes]:
    """What lies outside the ranges (from, to, from, to ...)."""
    for a, b in zip([0, *edges[1::2]], [*edges[::2], len(text)], strict=True):
        yield text[a:b]


def _half(col: Column, at: int) -> Column:
    """Eight bytes of a hex digest as a long."""
    return F.conv(F.substring(col, at, 16), 16, -10).cast("long")


def repeated_spans(docs: DataFrame, text: str = "text", least: int = 200) -> DataFrame:
    """``docs`` with the ranges of each text, as UTF-8 bytes, that repeated strings of ``least`` bytes cover.

    Adds n_bytes, n_removed, n_spans (maximal ranges), spans (their edges:
    from, to, from, to ...) and kept_sha256 (of the rest, joined). Null
    counts as the empty text. Texts shorter than ``least`` bytes lose
    nothing; equal texts of that size, whatever their ids, lose everything.
    Rows that repeat stay and count as often as they are there. An empty
    table gives an empty one. Columns of ``docs`` with these names are
    replaced; all others stay. Texts of any length are cut in chunks. All
    steps work on classes of equal texts, told apart by half a SHA-256.
    """
    own, digest, a, b, salt = fresh(docs.select(*docs.columns, *[F.lit(0).alias(c) for c in RESULT]), "own", "digest", "a", "b", "salt")
    raw = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    known = docs.withColumns({digest: F.sha2(raw, 256), own: F.monotonically_increasing_id(), "n_bytes": F.octet_length(raw).cast("long")})
    known = known.withColumns({a: _half(F.col(digest), 1), b: _half(F.col(digest), 17)})
    large = known.where(F.col("n_bytes") >= least).select(F.col(a).alias("a"), F.col(b).alias("b"), raw.alias("text"))
    texts = bucketed(large.groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight"), F.first("text").alias("text")), "suffix_texts", ["a", "b"])
    pieces = stored(_pieces(texts, least), "suffix_all")
    twice = _found_twice(pieces)
    discard(pieces)
    kinds = stored(_distinct(twice), "suffix_kinds")
    for step in sorted({min(step, max(1, least // 4)) for step in CUTS}, reverse=True):
        twice, kinds = _cut_hot(texts, twice, kinds, step, least)
    found = stored(_repeats(texts, kinds, least), "suffix_found")

    def rest(content: bytes, items: pa.StructArray) -> list:
        start, end = merged(*(items.field(k).to_numpy() for k in range(2)))
        edges = np.stack([start, end], 1).ravel().tolist()
        digest = hashlib.sha256()
        for part in rest_of(content, edges):
            digest.update(part)
        return [[int((end - start).sum())], [len(start)], [edges], [digest.hexdigest()]]

    made = _per_text(texts, _spans(twice, kinds, found, least), rest, "n_removed long, n_spans long, spans array<long>, kept_sha256 string")
    made = stored(made.join(texts.select("a", "b", "weight"), ["a", "b"]), "suffix_rest")
    discard(texts, twice, kinds, found)
    to = {"a": a, "b": b, "salt": salt}
    hot = hot_keys(made, ["a", "b"], "weight", made.agg(F.sum("weight")).first()[0] or 0).withColumnsRenamed(to)
    made = for_salts(made.select(F.col("a").alias(a), F.col("b").alias(b), *RESULT[1:]), hot, [a, b], salt)
    out = salted(known.drop(*RESULT[1:]), hot, [a, b], own, salt).join(made, [a, b, salt], "left")
    zero = {"n_removed": F.coalesce("n_removed", F.lit(0).cast("long")), "n_spans": F.coalesce("n_spans", F.lit(0).cast("long")), "spans": F.coalesce("spans", F.array().cast("array<long>")), "kept_sha256": F.coalesce("kept_sha256", digest)}
    return out.withColumns(zero).drop(a, b, salt, own, digest)


RESULT = ["n_bytes", "n_removed", "n_spans", "spans", "kept_sha256"]


def kept_bytes(marked: DataFrame, text: str = "text", into: str = "kept") -> DataFrame:
    """Add what is left of each text of a table with ``spans``: binary, as a string of bytes may begin within a character."""
    raw = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")

    @F.pandas_udf("binary")
    def rest(content: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([b"".join(rest_of(bytes(t), list(e))) for t, e in zip(content, spans, strict=True)], dtype=object)

    return marked.withColumn(into, rest(raw, "spans"))


def digest_columns(docs: DataFrame) -> DataFrame:
    return repeated_spans(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")

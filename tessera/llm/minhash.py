"""MinHash near-duplicates with b-bit signatures.

Texts with equal words are one class, and a class is one node. Bands of
minima give candidates, packed low bits of the minima estimate each
candidate's similarity with the chance collisions taken out, and pairs that
may reach the threshold are compared on their full shingle sets, kept as
sorted arrays of 64-bit hashes of words, so of shingles.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import for_salts, fresh, hot_keys, per_text, salted, stored
from .components import components

BANDS, ROWS, BITS = 32, 5, 4
MINIMA = BANDS * ROWS
PER_LONG = 64 // BITS
#: Standard deviations by which an estimate may fall short of the threshold.
SIGMAS = 6.0
#: Rounds in which every bucket compares its members with one of them only.
STAR_ROUNDS = 2
#: Buckets up to this size pair their members by a join, so a member has fewer pairs than this.
SMALL = 32
#: Members, and shingles, of a chunk in expectation, where larger buckets are compared chunk by chunk.
CHUNK, CHUNK_SHINGLES = 1024, 1 << 20
#: Bytes beyond which a word is hashed on its own.
LONG_WORD = 256
#: Rows of a chunk that meet the other chunk at a time.
STRIP = 64

_rng = np.random.default_rng(20240607)
_A = _rng.integers(0, 2**32, MINIMA, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 2**32, MINIMA, dtype=np.uint32)
_W = [np.uint64(int(x) | 1) for x in _rng.integers(2**32, 2**63, 8)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return h ^ (h >> np.uint64(29))


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all texts' A-Z lower-cased words in order, and the number of words of each text.

    In UTF-8 every byte of the contract's blanks is that blank, and lower-
    casing bytes changes A-Z alone, so the texts are taken as one array of
    bytes; words are hashed eight bytes at a time.
    """
    raw = [t.encode("utf-8", "surrogatepass").lower() if t else b"" for t in texts]
    one = np.frombuffer(b" ".join([*raw, bytes(8)]), np.uint8)
    blank = _BLANK[one]
    blank[-8:] = True
    edge = np.flatnonzero(np.diff(np.r_[True, blank].view(np.int8)))
    start, end = edge[0::2], edge[1::2]
    eight = np.ndarray(len(one) - 7, "<u8", one.data, 0, (1,))
    h = (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    live, at = np.arange(len(start)), start
    for i in live[end - start > LONG_WORD].tolist():
        h[i] = xxhash.xxh64_intdigest(one[start[i] : end[i]].data)
    live, at = live[end - start <= LONG_WORD], at[end - start <= LONG_WORD]
    while len(live):
        left = np.minimum(end[live] - at, 8)
        part = np.where(left < 8, eight[at] & ((np.uint64(1) << (left.astype(np.uint64) % np.uint64(8) * np.uint64(8))) - np.uint64(1)), eight[at])
        h[live] = _mix((h[live] ^ part) * np.uint64(0xD1B54A32D192ED03))
        more = end[live] - at > 8
        live, at = live[more], at[more] + 8
    ends = np.searchsorted(start, np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1))
    return h, np.diff(np.r_[0, ends])


def shingle_sets(flat: np.ndarray, lens: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles; the whole text is one if it is shorter.

    All texts are hashed as one array; shingles that reach into the next text are left out.
    """
    ends = np.cumsum(lens)

    def hashed(starts: np.ndarray, span: int) -> np.ndarray:
        out = np.full(len(starts), np.uint64(span))
        for i in range(span):
            out = _mix(out + flat[starts + i] * _W[i % len(_W)])
        return out

    long = lens >= size
    whole = np.where(long, np.maximum(lens - size + 1, 0), 0)
    own = np.repeat(np.arange(len(lens)), whole)
    first = np.cumsum(whole) - whole
    h = hashed((ends - lens)[own] + np.arange(len(own)) - first[own], size)
    out = [np.zeros(0, np.uint64)] * len(lens)
    for i, n in enumerate(lens.tolist()):
        if long[i]:
            s = np.sort(h[first[i] : first[i] + whole[i]])
            out[i] = s[np.r_[True, s[1:] != s[:-1]]]
        elif n:
            out[i] = hashed(np.array([ends[i] - n]), n)
    return out


def minima(h: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a non-empty set of hashes."""
    low = (h >> np.uint64(16)).astype(np.uint32)
    out = np.full(MINIMA, np.uint32(0xFFFFFFFF))
    for at in range(0, len(low), 1024):
        part = low[at : at + 1024, None] * _A
        part += _B
        np.minimum(out, part.min(0), out=out)
    return out


def signature(least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and packed low bits (int64 each) of rows of minima."""
    # mixed, so that the low bits of different minima are independent, and keys of different bands differ
    mixed = _mix(least.astype(np.uint64) + (np.arange(MINIMA, dtype=np.uint64) << np.uint64(32)))
    grid = mixed.reshape(-1, BANDS, ROWS)
    key = np.zeros(grid.shape[:2], np.uint64)
    for r in range(ROWS):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + grid[:, :, r])
    low_bits = (mixed & np.uint64(2**BITS - 1)).reshape(len(mixed), -1, PER_LONG)
    packed = (low_bits << (np.arange(PER_LONG, dtype=np.uint64) * np.uint64(BITS))).sum(2, dtype=np.uint64)
    return key.view(np.int64), packed.view(np.int64)


def digests(flat: np.ndarray, lens: np.ndarray) -> list[np.ndarray]:
    """Two longs of the md5 of each text's words; zeros without words."""
    out = np.zeros((len(lens), 2), np.int64)
    for i, (n, end) in enumerate(zip(lens.tolist(), np.cumsum(lens).tolist(), strict=True)):
        if n:
            out[i] = np.frombuffer(hashlib.md5(flat[end - n : end].tobytes()).digest(), np.int64)
    return [out[:, 0], out[:, 1]]


def rows_for(docs: DataFrame, text: str, id_col: str, keep: list[str]) -> DataFrame:
    """(id, at, kept columns, text); ``at`` hashes id and text, so it tells rows apart that are not equal in both."""
    i, t = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text}`")
    return docs.select(i.alias("id"), F.xxhash64(i, t).alias("at"), *[F.col(f"`{c}`") for c in keep], t.alias("text"))


def signatures(rows: DataFrame, size: int) -> DataFrame:
    """All columns but ``text``, and n_shingles, d1, d2, bands, bits; d1, d2 digest the words."""

    def sign(texts: list[str | None]) -> list:
        flat, lens = word_hashes(texts)
        sets = shingle_sets(flat, lens, size)
        some = [i for i, s in enumerate(sets) if len(s)]
        bands, bits = [None] * len(sets), [None] * len(sets)
        if some:
            for i, key, low in zip(some, *signature(np.array([minima(sets[i]) for i in some])), strict=True):
                bands[i], bits[i] = key, low
        return [[len(s) for s in sets], *digests(flat, lens), bands, bits]

    return per_text(rows, sign, "n_shingles long, d1 long, d2 long, bands array<long>, bits array<long>", "text", keep=[c for c in rows.columns if c != "text"])


def full_sets(rows: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(node, grams) of the nodes ``wanted`` (node, at, d1, d2): sorted shingle hashes from whole texts."""

    def hashed(texts: list[str | None]) -> list:
        flat, lens = word_hashes(texts)
        return [*digests(flat, lens), [s.view(np.int64) for s in shingle_sets(flat, lens, size)]]

    found = rows.select("at", "text").join(wanted.select("at").distinct(), "at", "left_semi").dropDuplicates(["at", "text"])
    made = per_text(found, hashed, "d1 long, d2 long, grams array<long>", "text", keep=["at"])
    return made.join(wanted, ["at", "d1", "d2"]).select("node", "grams")


def estimate(left: Column, right: Column) -> Column:
    """Similarity from two packed signatures, corrected for chance agreement of the low bits."""
    low = 0x1111111111111111

    def differing(pair: Column) -> Column:
        x = pair["l"].bitwiseXOR(pair["r"])
        folded = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3))
        return F.bit_count(folded.bitwiseAND(F.lit(low)))

    off = F.aggregate(F.arrays_zip(left.alias("l"), right.alias("r")), F.lit(0), lambda acc, p: acc + differing(p))
    chance = 2.0**-BITS
    return (1 - off / float(MINIMA) - chance) / (1 - chance)


def least_estimate(threshold: float) -> float:
    """An estimate that similar pairs fall below with a chance of about 1e-9."""
    chance = 2.0**-BITS
    p = threshold + (1 - threshold) * chance
    return threshold - SIGMAS * (p * (1 - p) / MINIMA) ** 0.5 / (1 - chance)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union."""
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("grams").alias("gb")), "b").join(sets.select(F.col("node").alias("a"), F.col("grams").alias("ga")), "a")
    common = F.size(F.array_intersect("ga", "gb"))
    return both.withColumn("common", common).where(F.col("common") * 100 >= (F.size("ga") + F.size("gb") - F.col("common")) * percent).select("a", "b")


def near_links(nodes: DataFrame, rows: DataFrame, size: int, percent: int) -> DataFrame:
    """Links that join every class of near duplicates among ``nodes``.

    A bucket holds the members of one band key. First each bucket's members
    meet one of them only, a different one in every round, and what is linked
    becomes one component. Then members that lie in different components meet,
    so no component is missed that full comparison would join; pairs inside a
    component need no comparison, which spares large groups of copies theirs.
    Small buckets meet by a join; in larger ones chunks meet chunks inside a
    task, which hands on links only. Estimates prune all candidates. Members
    of hot buckets are salted, so that none is one task.
    """
    spark = nodes.sparkSession
    least = least_estimate(percent / 100)
    few = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    bands = nodes.select("node", "n_shingles", F.explode("bands").alias("key"))
    sizes = stored(bands.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("shingles")).where("n > 1"), "bucket_sizes")
    hot = hot_keys(sizes, ["key"], "n", nodes.count() * BANDS)
    shared = for_salts(sizes.select("key"), hot, ["key"])
    members = stored(salted(bands.select("key", "node"), hot, ["key"], "node").join(shared, ["key", "salt"]), "buckets")
    open_nodes = members.select("node").distinct()
    sets = stored(full_sets(rows, nodes.join(open_nodes, "node", "left_semi").select("node", "at", "d1", "d2"), size), "shingle_sets")
    slim = nodes.select("node", "n_shingles", "bits")

    def pruned(pairs: DataFrame) -> DataFrame:
        with_a = pairs.join(slim.select(F.col("node").alias("a"), F.col("n_shingles").alias("na"), F.col("bits").alias("ba")), "a")
        with_b = with_a.join(slim.select(F.col("node").alias("b"), F.col("n_shingles").alias("nb"), F.col("bits").alias("bb")), "b")
        return with_b.where(few & (estimate(F.col("ba"), F.col("bb")) >= least)).select("a", "b")

    links = spark.createDataFrame([], "a long, b long")
    tried = links
    labelled = members.withColumn("component", F.col("node"))
    for i in range(STAR_ROUNDS):
        order = F.struct(F.xxhash64(F.lit(i), "node").alias("o"), F.col("node").alias("c"), F.col("component").alias("cc"))
        centre = labelled.groupBy("key").agg(F.min(order).alias("m")).select("key", F.col("m.c").alias("c"), F.col("m.cc").alias("cc"))
        met = labelled.join(for_salts(centre, hot, ["key"]), ["key", "salt"]).where("component <> cc").select("node", "c")
        new = met.select(F.least("node", "c").alias("a"), F.greatest("node", "c").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
        candidates = stored(pruned(new), "candidates")
        found = stored(verified(candidates, sets, percent), "near_links")
        tried = tried.unionByName(candidates)
        if not found.limit(1).count():
            continue
        links = links.unionByName(found)
        label = components(links)
        joined = labelled.drop("component").join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
        # buckets that lie in one component are done
        open_ = joined.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
        labelled = stored(joined.join(for_salts(open_, hot, ["key"]), ["key", "salt"]), "open_buckets")
    small = for_salts(sizes.where(F.col("n") <= SMALL).select("key"), hot, ["key"])
    few_members = labelled.join(small, ["key", "salt"])
    other = few_members.select("key", F.col("node").alias("c"), F.col("component").alias("cc"))
    met = few_members.join(other, "key").where("component < cc").select(F.least("node", "c").alias("a"), F.greatest("node", "c").alias("b")).distinct()
    candidates = stored(pruned(met.join(tried, ["a", "b"], "left_anti")), "candidates")
    found = stored(verified(candidates, sets, percent), "near_links")
    chunks = F.ceil(F.greatest(F.col("n") / CHUNK, F.col("shingles") / CHUNK_SHINGLES)).cast("int")
    large = for_salts(sizes.where(F.col("n") > SMALL).select("key", chunks.alias("chunks")), hot, ["key"])
    many = labelled.join(large, ["key", "salt"]).select("key", "node", "component", "chunks")
    return links.unionByName(found).unionByName(stored(block_links(many, nodes, sets, percent, least), "block_links"))


def _columns(f: pd.DataFrame, name: str, kind: type) -> np.ndarray:
    return np.array(f[name].tolist(), np.int64).view(kind)


def open_pairs(one: pd.DataFrame, two: pd.DataFrame, same: bool, key: int, percent: int, least: float) -> np.ndarray:
    """Matrix of the pairs of two chunks that the bucket of ``key`` must compare.

    Those lie in different components, may be similar by size and estimate,
    and have no earlier band in common, where they meet otherwise.
    """
    bits, other_bits = _columns(one, "bits", np.uint64), _columns(two, "bits", np.uint64)
    bands, other_bands = _columns(one, "bands", np.int64), _columns(two, "bands", np.int64)
    band = int((bands[0] == key).argmax())
    chance = 2.0**-BITS
    n, m = one["n_shingles"].to_numpy()[:, None], two["n_shingles"].to_numpy()
    ok = (np.minimum(n, m) * 100 >= np.maximum(n, m) * percent) & (one["component"].to_numpy()[:, None] != two["component"].to_numpy())
    for at in range(0, len(one), STRIP):
        part = slice(at, at + STRIP)
        x = bits[part, None, :] ^ other_bits
        x |= x >> np.uint64(1)
        x |= x >> np.uint64(2)
        off = np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(-1)
        ok[part] &= (1 - off / MINIMA - chance) / (1 - chance) >= least
        ok[part] &= (bands[part, None, :] == other_bands).argmax(-1) == band
    return np.triu(ok, 1) if same else ok


def chunk_edges(ok: np.ndarray, one: list[np.ndarray], two: list[np.ndarray], labels: np.ndarray, other_labels: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs of ``ok`` (row, column) with similar sets, as many as join what they all would.

    Rows are taken one by one; columns that an earlier link has joined with
    the row need no comparison any more.
    """
    flat, sizes = np.concatenate(two), np.fromiter(map(len, two), np.int64, len(two))
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], np.repeat(np.arange(len(two)), sizes)[order]
    every, place = np.unique(np.r_[labels, other_labels], return_inverse=True)
    rows, columns = place[: len(labels)], place[len(labels) :]
    root, edges = np.arange(len(every)), []
    for r in np.flatnonzero(ok.any(1)):
        todo = ok[r] & (root[columns] != root[rows[r]])
        if not todo.any():
            continue
        x = one[r]
        low, high = np.searchsorted(flat, x, "left"), np.searchsorted(flat, x, "right")
        hits = high - low
        at = np.repeat(low - np.cumsum(hits) + hits, hits) + np.arange(hits.sum())
        common = np.bincount(owner[at], minlength=len(two))
        for c in np.flatnonzero(todo & (100 * common >= percent * (len(x) + sizes - common))):
            if root[columns[c]] != root[rows[r]]:
                edges.append((int(r), int(c)))
                root[root == root[columns[c]]] = root[rows[r]]
    return edges


def sides(f: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, bool]:
    same = bool(f["i"].iloc[0] == f["j"].iloc[0])
    one = f[f["side"] == 0]
    return one, one if same else f[f["side"] == 1], same


def block_links(many: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int, least: float) -> DataFrame:
    """Links (a, b) between components inside large buckets.

    A bucket is cut into chunks by a hash, as many as bound the members and
    the shingles of one, and every two chunks meet in a task of their own. A
    first pass over the signatures tells which members have open pairs in a
    task; only their sets are sent there, and a second pass compares them.
    """
    mine = many.withColumn("mine", F.pmod(F.xxhash64(F.lit(5), "node"), F.col("chunks")).cast("int"))
    met = mine.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    task = ["key", "i", "j"]
    dealt = met.select("node", "component", "key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") > F.col("other")).cast("int").alias("side"))
    signed = dealt.join(nodes.select("node", "n_shingles", "bands", "bits"), "node")

    def mark(f: pd.DataFrame) -> pd.DataFrame:
        one, two, same = sides(f)
        if not len(one) or not len(two):
            return f.iloc[:0]
        ok = open_pairs(one, two, same, int(f["key"].iloc[0]), percent, least)
        if same:
            return one[ok.any(1) | ok.any(0)]
        return pd.concat([one[ok.any(1)], two[ok.any(0)]])

    marked = stored(signed.groupBy(*task).applyInPandas(mark, signed.schema), "open_members")
    full = marked.join(sets, "node")

    def compare(f: pd.DataFrame) -> pd.DataFrame:
        one, two, same = sides(f)
        edges = []
        if len(one) and len(two):
            ok = open_pairs(one, two, same, int(f["key"].iloc[0]), percent, least)
            edges = chunk_edges(ok, one["grams"].tolist(), two["grams"].tolist(), one["component"].to_numpy(), two["component"].to_numpy(), percent)
        a, b = one["node"].to_numpy(), two["node"].to_numpy()
        return pd.DataFrame({"a": [int(a[r]) for r, _ in edges], "b": [int(b[c]) for _, c in edges]})

    return full.groupBy(*task).applyInPandas(compare, "a long, b long")


def near_classes(docs: DataFrame, size: int, percent: int, text: str, id_col: str, keep: list[str]) -> DataFrame:
    """One row per row of ``docs``: id, kept columns, n_shingles, cluster, component_id.

    Texts with equal words have one cluster number, and so have those that
    links join; texts without words have none. ``component_id`` is the
    smallest id of the cluster.
    """
    rows = rows_for(docs, text, id_col, keep)
    sig = stored(signatures(rows, size), "signatures")
    words_ = ["d1", "d2"]
    grouped = sig.where("n_shingles > 0").groupBy(*words_).agg(
        F.min("id").alias("rep"), F.min("at").alias("at"), F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in ("n_shingles", "bands", "bits")]
    )
    # numbered as written, so every class is a node of its own whatever ids its rows have
    nodes = stored(grouped.withColumn("node", F.monotonically_increasing_id()), "classes")
    label = components(near_links(nodes, rows, size, percent))
    clusters = nodes.select("node", "rep", "copies", *words_).join(label, "node", "left").withColumn("cluster", F.coalesce("component", "node"))
    clusters = stored(clusters.select("rep", "copies", "cluster", *words_), "clusters")
    least = clusters.groupBy("cluster").agg(F.min("rep").alias("component_id"))
    of_class = clusters.join(least, "cluster").select(*words_, "cluster", "component_id")
    hot = hot_keys(clusters, words_, "copies", nodes.count())
    out = salted(sig.select("id", "at", *keep, "n_shingles", *words_), hot, words_, "at").join(for_salts(of_class, hot, words_), [*words_, "salt"], "left")
    return out.select("id", *keep, "n_shingles", "cluster", "component_id")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept.

    Documents are linked if their sets of ``size``-word shingles (A-Z lower-
    cased) have at least ``percent`` of their union in common. The component
    is the smallest id reachable; only that document is kept. Null and empty
    texts and those without words have no shingles and no links. Rows are
    grouped by their words, never by id: different texts of one id keep their
    own links, and a null id is in a component without naming it. An empty
    table gives an empty result.
    """
    out = near_classes(docs, size, percent, text, id_col, [])
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id")).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each group the row of the smallest id stays.

    Rows are told apart by a number of their own, so repeated ids, null ids
    and repeated rows need no special rule: one row of a group stays, and all
    rows without words, which belong to none. Null ids come last. Columns are
    as they were.
    """
    (row,) = fresh(docs, "row")
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    judged = near_classes(numbered, size, percent, text, id_col, [row])
    first = judged.where("cluster IS NOT NULL").groupBy("cluster").agg(F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col(row))).alias("least"))
    keep = first.select(F.col(f"least.{row}").alias(row)).unionByName(judged.where("cluster IS NULL").select(row))
    return numbered.join(keep, row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])

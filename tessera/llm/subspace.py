"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors are rotated and split into blocks of few dimensions. Two vectors
within the squared distance of the threshold are, in at least one block,
within that block's share of it. A range join per block, on the block's
coordinates alone, finds the pairs so near in it; the union over the blocks
is verified on the full vectors. Along the ring of blocks there is even one
from which on every run of blocks keeps the sum of its shares; runs of one
and two blocks are tested where pairs meet, which spares nearly all chance
neighbours the verification. A pair counts in the first block that passes, so
the union needs no further aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import for_salts, hot_keys, salted, stored
from .components import components, forest

BLOCK = 8
#: Vectors in one chunk, in expectation; a task compares two chunks.
CHUNK = 1024
#: Rows that meet the others in their band of the third coordinate at a time.
STRIP = 64
#: Near pairs per row beyond which a task hands on no pairs, but compares the full vectors itself.
DENSE = 32
#: Relative slack of the budgets, far above rounding and far below any gap that matters.
SLACK = 1e-9


def rotation(dims: int, seed: int = 5) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def rotated(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """x @ q, summed in a fixed order, so that equal rows give equal bits in any batch."""
    out = np.zeros((len(x), q.shape[1]))
    for k in range(len(q)):
        out += x[:, k, None] * q[k]
    return out


def unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # keeps the squares in range
    square = np.zeros(len(x))
    for k in range(x.shape[1]):
        square += x[:, k] ** 2
    return x / np.sqrt(square)[:, None]


def blocks(dims: int) -> list[tuple[int, int]]:
    return [(s, min(s + BLOCK, dims)) for s in range(0, dims, BLOCK)]


def budget(dims: int, block: tuple[int, int], cosine: float) -> float:
    """The block's share of the squared distance, in proportion to its dimensions."""
    return (2 - 2 * cosine) * (1 + SLACK) * (block[1] - block[0]) / dims + SLACK


def place(vectors: DataFrame, dims: int) -> DataFrame:
    """(node, label, weight, x, y): the unit vector and its rotation."""
    q = rotation(dims)

    def turn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), 2000):
                part = f.iloc[at : at + 2000]
                x = unit(np.array(part["v"].tolist(), np.float64))
                yield part.drop(columns="v").assign(x=list(x), y=list(rotated(x, q)))

    return vectors.select("node", "label", "weight", "v").mapInPandas(turn, "node long, label string, weight long, x array<double>, y array<double>")


def tiles(placed: DataFrame, dims: int, cosine: float) -> DataFrame:
    """(node, c, d, role, label, block, hx, hy, i, j): the rows of each task of the range joins, with the next block's coordinates d.

    A grid spans the block's first two dimensions; its side is the root of the
    budget, so partners lie in the same or an adjoining cell. A task belongs
    to a home cell: its rows (role 0) meet each other and those of the four
    later neighbours (role 1); role 2 is both. Where a cell and its guests
    are many, chunk i of the home rows meets chunk j of all rows. A hot cell
    is dealt by salts when rows learn the numbers of chunks.
    """
    spans = blocks(dims)
    side = [float(np.sqrt(budget(dims, b, cosine))) for b in spans]
    block = F.explode(
        F.array(*[
            F.struct(F.lit(k).alias("block"), F.slice("y", s + 1, e - s).alias("c"), F.slice("y", spans[(k + 1) % len(spans)][0] + 1, spans[(k + 1) % len(spans)][1] - spans[(k + 1) % len(spans)][0]).alias("d"), F.floor(F.get("y", F.lit(s)) / side[k]).cast("int").alias("cx"), (F.floor(F.get("y", F.lit(s + 1)) / side[k]).cast("int") if e - s > 1 else F.lit(0)).alias("cy"))
            for k, (s, e) in enumerate(spans)
        ])
    )
    rows = placed.select("node", "label", block.alias("b")).select("node", "label", "b.*")
    cell = ["label", "block", "hx", "hy"]
    homes = F.explode(F.array(*[F.struct((F.col("cx") - x).alias("hx"), (F.col("cy") - y).alias("hy"), F.lit((x, y) == (0, 0)).alias("own")) for x, y in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))]))
    sent = rows.withColumn("h", homes).select("node", "label", "block", "c", "d", "h.*")
    sizes = sent.groupBy(*cell).agg(F.count_if("own").alias("own_n"), F.count(F.lit(1)).alias("n")).where("own_n > 0 AND n > 1")
    sizes = stored(sizes.select(*cell, "n", F.ceil(F.col("own_n") / CHUNK).cast("int").alias("ni"), F.ceil(F.col("n") / CHUNK).cast("int").alias("nj")), "cell_sizes")
    hot = hot_keys(sizes, cell, "n", placed.count() * len(spans))
    known = salted(sent, hot, cell, "node").join(for_salts(sizes, hot, cell), [*cell, "salt"])
    i, j = (F.pmod(F.xxhash64(F.lit(3), "node"), F.col(n)).cast("int") for n in ("ni", "nj"))
    every_j = F.transform(F.sequence(F.lit(0), F.col("nj") - 1), lambda k: F.struct(i.alias("i"), k.alias("j"), F.lit(0).alias("role")))
    every_i = F.transform(F.sequence(F.lit(0), F.col("ni") - 1), lambda k: F.struct(k.alias("i"), j.alias("j"), F.lit(1).alias("role")))
    both = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(2).alias("role")))
    task = F.when(~F.col("own"), every_i).when((F.col("ni") == 1) & (F.col("nj") == 1), both).otherwise(F.concat(every_j, every_i))
    return known.withColumn("t", F.explode(task)).select("node", "c", "d", "own", *cell, "t.*")


TASK = ["label", "block", "hx", "hy", "i", "j"]


def two_sides(f: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    return f[f["role"] != 1], f[f["role"] != 0]


def in_range(home: np.ndarray, other: np.ndarray, next_home: np.ndarray, next_other: np.ndarray, most: float, next_most: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers (home, other) of the pairs that keep the block's budget, and with the next block both budgets.

    Both sides are swept along one coordinate: a strip of home rows meets
    only the rows of its band there.
    """
    axis = min(2, home.shape[1] - 1)
    ho, oo = np.argsort(home[:, axis], kind="stable"), np.argsort(other[:, axis], kind="stable")
    along, squares = other[oo, axis], (other**2).sum(1)[oo]
    reach = float(np.sqrt(most)) + 1e-9
    for at in range(0, len(ho), STRIP):
        mine = ho[at : at + STRIP]
        x = home[mine]
        low, high = np.searchsorted(along, x[0, axis] - reach, "left"), np.searchsorted(along, x[-1, axis] + reach, "right")
        d = (x**2).sum(1)[:, None] + squares[low:high] - 2 * x @ other[oo[low:high]].T
        r, c = np.nonzero(d <= most + 1e-9)
        near, r, c = d[r, c], mine[r], oo[low + c]
        ok = near + ((next_home[r] - next_other[c]) ** 2).sum(1) <= most + next_most + 1e-8
        yield r[ok], c[ok]


def budgets(dims: int, block: int, cosine: float) -> tuple[float, float]:
    """The block's budget and that of the next one on the ring."""
    spans = blocks(dims)
    return budget(dims, spans[block], cosine), budget(dims, spans[(block + 1) % len(spans)], cosine)


def columns_of(home: pd.DataFrame, other: pd.DataFrame) -> list[np.ndarray]:
    return [np.array(f[c].tolist()) for c in ("c", "d") for f in (home, other)]


def near_pairs(placed_tiles: DataFrame, dims: int, cosine: float) -> DataFrame:
    """Candidates (a, b, block), a row per pair that passes in the block; or, of a dense task, its key alone (dense)."""

    def meet(f: pd.DataFrame) -> pd.DataFrame:
        home, other = two_sides(f)
        key = f[TASK].iloc[:1]
        a, b = [], []
        if len(home) and len(other):
            mine, theirs, same = home["node"].to_numpy(), other["node"].to_numpy(), other["own"].to_numpy()
            held = 0
            for r, c in in_range(*columns_of(home, other), *budgets(dims, int(key["block"].iloc[0]), cosine)):
                ok = ~same[c] | (mine[r] < theirs[c])  # rows of the home cell meet once
                a.append(mine[r[ok]])
                b.append(theirs[c[ok]])
                held += int(ok.sum())
                if held > DENSE * len(f):
                    return key.assign(a=0, b=0, dense=True)
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        return pd.DataFrame({c: key[c].iloc[0] for c in TASK}, index=range(len(a))).assign(a=a, b=b, dense=False)

    return placed_tiles.groupBy(*TASK).applyInPandas(meet, "label string, block int, hx int, hy int, i int, j int, a long, b long, dense boolean")


def linked(x: np.ndarray, z: np.ndarray, dims: int, block: np.ndarray, cosine: float) -> np.ndarray:
    """Which pairs of rows (x, z) of unit vectors reach the cosine and have ``block`` as the first that passes.

    A block passes if it keeps its budget, and with the next one on the ring both.
    """
    q, spans = rotation(dims), blocks(dims)
    square = (rotated(x, q) - rotated(z, q)) ** 2
    d = np.zeros((len(spans), len(x)))
    for k, (s, e) in enumerate(spans):
        for m in range(s, e):
            d[k] += square[:, m]
    ok = np.zeros(len(x), bool)
    open_ = np.ones(len(x), bool)
    for k in range(len(spans)):
        own, after = budgets(dims, k, cosine)
        passes = open_ & (d[k] <= own) & (d[k] + d[(k + 1) % len(spans)] <= own + after)
        ok |= passes & (block == k)
        open_ &= ~passes
    return ok & (np.einsum("ij,ij->i", x, z) >= cosine)


def sparse_links(pairs: DataFrame, placed: DataFrame, dims: int, cosine: float) -> DataFrame:
    """Rows (a, b, n) of the verified candidates: the edge with n 0, and each end's links (b null)."""
    side = lambda c: placed.select(F.col("node").alias(c), F.col("x").alias(f"x{c}"), F.col("weight").alias(f"w{c}"))

    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield f.loc[linked(np.array(f["xa"].tolist()), np.array(f["xb"].tolist()), dims, f["block"].to_numpy(), cosine), ["a", "b", "wa", "wb"]]

    found = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "block", "wa", "wb", "xa", "xb").mapInPandas(check, "a long, b long, wa long, wb long")
    three = F.array(*[F.struct(F.col(a).alias("a"), (F.col(b) if b else F.lit(None).cast("long")).alias("b"), n.alias("n")) for a, b, n in (("a", "b", F.lit(0).cast("long")), ("a", None, F.col("wb")), ("b", None, F.col("wa")))])
    return found.select(F.inline(three))


def dense_links(rows: DataFrame, dims: int, cosine: float) -> DataFrame:
    """The same rows from tasks that hold full vectors; edges are a spanning forest, so no group gives all its pairs."""

    def meet(f: pd.DataFrame) -> pd.DataFrame:
        home, other = two_sides(f)
        none = pd.DataFrame({"a": [], "b": [], "n": []})
        if not len(home) or not len(other):
            return none
        k = int(f["block"].iloc[0])
        x, z = np.array(home["x"].tolist()), np.array(other["x"].tolist())
        mine, theirs, same = home["node"].to_numpy(), other["node"].to_numpy(), other["own"].to_numpy()
        links = np.zeros((len(x), len(z)), bool)
        for r, c in in_range(*columns_of(home, other), *budgets(dims, k, cosine)):
            ok = ~same[c] | (mine[r] < theirs[c])
            r, c = r[ok], c[ok]
            for at in range(0, len(r), 20_000):
                p, o = r[at : at + 20_000], c[at : at + 20_000]
                good = linked(x[p], z[o], dims, np.full(len(p), k), cosine)
                links[p[good], o[good]] = True
        if not links.any():
            return none
        counts = pd.DataFrame({"a": np.r_[mine, theirs], "n": np.r_[links @ other["weight"].to_numpy(), links.T @ home["weight"].to_numpy()]})
        edges = forest(links, False)
        counts = counts[counts["n"] > 0].assign(b=pd.NA)
        return pd.concat([counts, pd.DataFrame({"a": [mine[r] for r, _ in edges], "b": [theirs[c] for _, c in edges], "n": 0})])[["a", "b", "n"]].astype({"b": "Int64"})

    return rows.groupBy(*TASK).applyInPandas(meet, "a long, b long, n long")


def vector_links(vectors: DataFrame, dims: int, cosine: float) -> DataFrame:
    """Rows (a, b, n): n links of a (b null), or an edge a-b (n 0); edges join what the links join."""
    placed = stored(place(vectors, dims), "placed")
    dealt = tiles(placed, dims, cosine)
    found = stored(near_pairs(dealt, dims, cosine), "near_pairs")
    out = stored(sparse_links(found.where("NOT dense").select("a", "b", "block"), placed, dims, cosine), "sparse_links")
    dense = found.where("dense").select(*TASK)
    if dense.limit(1).count():
        rows = dealt.join(dense, TASK, "left_semi").join(placed.select("node", "weight", "x"), "node")
        out = out.unionByName(stored(dense_links(rows, dims, cosine), "dense_links"))
    return out


def near_vectors(vectors: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Vectors of equal, non-null labels are linked if their cosine in double
    precision is at least ``cosine`` (above 0). Null and zero vectors, and
    those with null or non-finite components, have no links. Exact copies
    (label, values) are one node with a weight; rows are told apart by label
    and values, never by id, so rows that repeat an id have links of their
    own, and a null id is in a component without naming it. Vectors of
    different lengths are no partners. An empty table gives an empty result.
    """
    v = F.col("v")
    sound = F.col("label").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    label = F.col(f"`{label_col}`").cast("string")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), label.alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    rows = rows.withColumn("label", F.when(F.col("label").isNotNull(), F.concat_ws(":", F.size("v").cast("string"), "label")))
    rows = rows.withColumn("ok", F.coalesce(sound, F.lit(False))).withColumn("k1", F.xxhash64(F.lit(1), "label", "v")).withColumn("k2", F.xxhash64(F.lit(2), "label", "v"))
    keys = ["k1", "k2"]
    grouped = rows.where("ok").groupBy(*keys).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.first("label").alias("label"), F.first("v").alias("v"))
    nodes = stored(grouped.withColumn("node", F.monotonically_increasing_id()), "vector_classes")
    links = None
    for dims in sorted(r[0] for r in nodes.select(F.size("v")).distinct().collect()):
        part = vector_links(nodes.where(F.size("v") == dims), dims, cosine)
        links = part if links is None else links.unionByName(part)
    if links is None:
        links = vectors.sparkSession.createDataFrame([], "a long, b long, n long")
    counts = links.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    of = nodes.select(*keys, "node", "rep", "weight").join(counts, "node", "left").join(components(links.where("b IS NOT NULL").select("a", "b")), "node", "left")
    clusters = stored(of.select(*keys, "rep", "weight", (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("cluster")), "vector_clusters")
    least = clusters.groupBy("cluster").agg(F.min("rep").alias("component"))
    per = clusters.join(least, "cluster").select(*keys, "n_links", "component")
    hot = hot_keys(clusters, keys, "weight", nodes.count())
    out = salted(rows.select("id", "ok", *keys), hot, keys, "id").join(for_salts(per, hot, keys), [*keys, "salt"], "left")
    return out.select(
        F.col("id").alias(id_col),
        F.when(F.col("ok"), F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("ok"), F.col("component")).otherwise(F.col("id")).alias("component_id"),
    ).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))

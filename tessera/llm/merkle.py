"""Merkle manifest of a dataset: a root per group, one over all groups, and a proof per row.

Digests are 64 hex characters. Aligned blocks of ``BLOCK`` nodes are matrices
of bytes, ``fanout`` digests to a row; each level hashes the rows, and the
place of a sibling on every level follows from the node's number alone. Blocks
of block roots follow until one node is left, so no task holds more than one
block and nothing goes through the driver.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, stored

#: Nodes of an aligned block at most: the largest power of the fanout within it.
BLOCK = 4096
HEX = 64


def field(col: str | Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    said = (F.col(f"`{col}`") if isinstance(col, str) else col).cast("string")
    return F.coalesce(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said), F.lit("-"))


def leaf(*cols: str | Column) -> Column:
    return F.sha2(F.concat(*map(field, cols)), 256)


def hashed_rows(matrix: np.ndarray) -> np.ndarray:
    """One digest (64 hex bytes) per row of a byte matrix."""
    raw, width = matrix.tobytes(), matrix.shape[1]
    made = b"".join(hashlib.sha256(raw[k : k + width]).hexdigest().encode() for k in range(0, len(raw), width))
    return np.frombuffer(made, np.uint8).reshape(-1, HEX)


def level_up(nodes: np.ndarray, fanout: int) -> np.ndarray:
    """The parents of a level: runs of ``fanout`` digests hashed together, the last run as long as it is."""
    whole = len(nodes) // fanout * fanout
    up = [hashed_rows(nodes[:whole].reshape(-1, fanout * HEX))] if whole else []
    if whole < len(nodes):
        up.append(hashed_rows(nodes[whole:].reshape(1, -1)))
    return np.concatenate(up)


def siblings(sizes: list[int], at: np.ndarray, fanout: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per level: for nodes ``at`` of the lowest one, the first number of their run, its length and their place in it."""
    out = []
    for n in sizes:
        first = at // fanout * fanout
        out.append((first, np.minimum(fanout, n - first), at - first))
        at = at // fanout
    return out


def climb(nodes: np.ndarray, levels: int, fanout: int) -> list[np.ndarray]:
    """The levels of a block, from ``nodes`` to its root."""
    out = [nodes]
    for _ in range(levels):
        out.append(level_up(out[-1], fanout))
    return out


def paths(levels: list[np.ndarray], fanout: int) -> list[list[tuple[int, str]]]:
    """For each node of the lowest level its steps up: place in the run, and the run's others as text."""
    n = len(levels[0])
    steps = siblings([len(x) for x in levels[:-1]], np.arange(n), fanout)
    texts = [x.tobytes().decode() for x in levels]
    out: list[list[tuple[int, str]]] = [[] for _ in range(n)]
    for text, (first, size, place) in zip(texts, steps, strict=False):
        for k, (f, s, p) in enumerate(zip(first.tolist(), size.tolist(), place.tolist(), strict=True)):
            out[k].append((p, text[f * HEX : (f + p) * HEX] + text[(f + p + 1) * HEX : (f + s) * HEX]))
    return out


def folded(digest: str, steps: list[tuple[int, str]]) -> str:
    """The root that follows from a digest and its siblings level by level."""
    for place, others in steps:
        cut = place * HEX
        digest = hashlib.sha256((others[:cut] + digest + others[cut:]).encode()).hexdigest()
    return digest


def levels_of(n: int, fanout: int) -> int:
    """Levels above ``n`` nodes until one is left."""
    k = 0
    while n > 1:
        n, k = -(-n // fanout), k + 1
    return k


_STEPS = "array<struct<place:int,others:string>>"


def _block_of(fanout: int) -> tuple[int, int]:
    depth = 1
    while fanout ** (depth + 1) <= BLOCK:
        depth += 1
    return fanout**depth, depth


def _levels(table: pa.Table, fanout: int, size: int, depth: int) -> list[np.ndarray]:
    """The levels of a block of nodes (number, total, digest) in order of number."""
    total = table["total"][0].as_py()
    digests = np.frombuffer("".join(table["digest"].to_pylist()).encode(), np.uint8).reshape(-1, HEX)
    return climb(digests, depth if total > size else levels_of(total, fanout), fanout)


def _tops(nodes: DataFrame, fanout: int) -> DataFrame:
    """(grp, number, digest): the roots of all blocks of nodes (grp, block, number, total, digest)."""
    block = _block_of(fanout)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        top = _levels(table.sort_by("number"), fanout, *block)[-1].tobytes().decode()
        return pa.table({"grp": pa.array([key[0].as_py()]), "number": pa.array([key[1].as_py()]), "digest": pa.array([top])})

    return nodes.select("grp", "block", "number", "total", "digest").groupBy("grp", "block").applyInArrow(run, "grp string, number long, digest string")


def _paths(nodes: DataFrame, blocks: DataFrame, fanout: int) -> DataFrame:
    """``nodes`` with their steps: those within the block and then the block's own, as well as what else ``blocks`` say.

    ``blocks``: grp, block, above and other columns. Nodes and their blocks
    meet in one task; only digests and the columns of ``nodes`` are moved.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    own, more = nodes.columns, [c for c in blocks.columns if c not in ("grp", "block", "above")]
    schema = nodes.withColumn("steps", F.lit(None).cast(_STEPS)).join(blocks.select("grp", *more), "grp").select(*own, "steps", *more).schema
    kind = to_arrow_schema(schema)
    step, block = kind.field("steps").type, _block_of(fanout)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return kind.empty_table()
        left = left.sort_by("number")
        above = [(s["place"], s["others"]) for s in right["above"][0].as_py()]
        made = [[{"place": p, "others": o} for p, o in [*path, *above]] for path in paths(_levels(left, fanout, *block), fanout)]
        held = {c: left[c] for c in own} | {"steps": pa.array(made, step)} | {c: pa.array([right[c][0].as_py()] * len(made), kind.field(c).type) for c in more}
        return pa.table(held, schema=kind)

    return nodes.groupBy("grp", "block").cogroup(blocks.groupBy("grp", "block")).applyInArrow(run, schema)


def _blocked(nodes: DataFrame, fanout: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("number") / _block_of(fanout)[0]).cast("long"))


def _tree(nodes: DataFrame, fanout: int, most: int) -> tuple[DataFrame, DataFrame]:
    """For blocked nodes: the paths (grp, block, above) of their blocks, and the roots (grp, root); ``most`` is the largest group's size."""
    size, _ = _block_of(fanout)
    tops = stored(_tops(nodes, fanout), "merkle_tops")
    if most <= size:
        return tops.select("grp", F.col("number").alias("block"), F.array().cast(_STEPS).alias("above")), tops.select("grp", F.col("digest").alias("root"))
    totals = nodes.groupBy("grp").agg(F.ceil(F.max("total") / size).cast("long").alias("total"))
    upper = stored(_blocked(tops.join(totals, "grp"), fanout), "merkle_upper")
    blocks, roots = _tree(upper, fanout, -(-most // size))
    made = stored(_paths(upper, blocks, fanout), "merkle_above")
    return made.select("grp", F.col("number").alias("block"), F.col("steps").alias("above")), roots


def manifest(docs: DataFrame, digest: Column, by: str, order: str, fanout: int = 2) -> DataFrame:
    """``docs`` with leaf, number (in its group), steps (the proof: place and siblings per level), subroot and root.

    The leaf is ``digest`` (64 hex characters, as ``leaf`` makes of columns);
    leaves of one value of ``by`` ascend by ``order``, then by themselves;
    rows equal in both may swap. Null in
    ``by`` is a group of its own, the first; null in ``order`` comes first. A
    lone leaf is its group's root. Groups' roots in order of ``by`` (UTF-8
    bytes) make the tree above them in the same way. An empty table gives an
    empty one. Columns of ``docs`` stay but for those named like the new ones and
    grp, block, total and digest. Rows are numbered by one range sort; blocks
    are groups of tasks, first for their roots, then for their rows' paths.
    """
    new = ["leaf", "grp", "number", "block", "total", "digest", "steps", "subroot", "root"]
    own, part, at, rank, first = fresh(docs.select(*docs.columns, *[F.lit(0).alias(c) for c in new]), "own", "part", "at", "rank", "first")
    base = docs.withColumns({"leaf": digest, "grp": F.coalesce(F.concat(F.lit("="), F.col(f"`{by}`").cast("string")), F.lit("")), rank: F.col(f"`{order}`"), own: F.monotonically_increasing_id()}).drop("number", "block", "total", "digest", "steps", "subroot", "root")
    keys = ["grp", rank, "leaf", own]
    sorted_ = base.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # one stored order: numbers cannot change when a task runs again
    rows = stored(sorted_.withColumns({part: F.spark_partition_id(), at: F.monotonically_increasing_id()}).drop(own, rank), "merkle_rows")
    counts = rows.groupBy("grp", part).agg(F.min(at).alias(first), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("grp").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("grp", part, (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col(first)).alias(first), F.sum("n").over(Window.partitionBy("grp")).alias("total"))
    numbered = rows.join(offsets, ["grp", part]).withColumn("number", F.col(at) + F.col(first)).withColumn("digest", F.col("leaf")).drop(at, part, first)
    placed = stored(_blocked(numbered, fanout), "merkle_numbered")
    most = placed.agg(F.max("total")).first()[0] or 0
    above, subroots = _tree(placed, fanout, most)
    subroots = stored(subroots, "merkle_subroots")
    groups = subroots.count()
    ranked = subroots.repartitionByRange("grp").sortWithinPartitions("grp").select("grp", "root", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    ranked = stored(ranked, "merkle_groups")
    firsts = ranked.groupBy("part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    heads = ranked.join(firsts.drop("n"), "part").select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.col("root").alias("digest"), (F.col("at") - F.col("first") + F.col("offset")).alias("number"), F.lit(groups).cast("long").alias("total"))
    heads = stored(_blocked(heads, fanout), "merkle_heads")
    over, root = _tree(heads, fanout, groups)
    top = root.select("root").first()
    crown = _paths(heads, over, fanout).select(F.col("name").alias("grp"), F.col("digest").alias("subroot"), F.col("steps").alias("crown"))
    blocks = above.join(crown, "grp").select("grp", "block", F.concat("above", "crown").alias("above"), "subroot", F.lit(top[0] if top else None).cast("string").alias("root"))
    return _paths(placed, stored(blocks, "merkle_blocks"), fanout).drop("grp", "block", "total", "digest")


def proved(rows: DataFrame, digest: str) -> DataFrame:
    """Add folded_root (from column ``digest`` and the row's steps) and proof_sha256 (of all siblings, joined)."""
    @F.pandas_udf("folded_root string, proof_sha256 string")
    def fold(digests: pd.Series, steps: pd.Series) -> pd.DataFrame:
        made = [(folded(d, [(s["place"], s["others"]) for s in path]), hashlib.sha256("".join(s["others"] for s in path).encode()).hexdigest()) for d, path in zip(digests, steps, strict=True)]
        return pd.DataFrame(made, columns=["folded_root", "proof_sha256"])

    return rows.withColumn("folded", fold(F.col(digest), "steps")).select("*", "folded.*").drop("folded")


COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def tampered(docs: DataFrame) -> Column:
    """Leaf of a row whose n_chars grows by one where 7 divides the CRC-32 of the id; a null id or n_chars changes nothing."""
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    return leaf("doc_id", "source", "lang", changed, "text")


def verified_documents(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    rows = docs.select("doc_id", "lang", leaf(*COLUMNS).alias("leaf"), tampered(docs).alias("changed"))
    made = proved(manifest(rows, F.col("leaf"), "lang", "doc_id"), "changed")
    return made.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))

"""Connected components of a graph of links, by contraction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every end of a link (a, b): the smallest node reachable.

    Each round hooks every label to its smallest neighbouring label, follows
    that pointer twice, and maps the links to the new labels; links inside one
    label vanish. Paths stay connected under the map and the smallest label of
    a component never moves, so the labels left at the end are the components.
    Only minima per label are aggregated, so a node with most links is no
    group of its own; every round is stored in the shared folder.
    """
    links = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "links")
    labels = stored(links.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node")), "labels")
    while links.limit(1).count():
        # every larger end points at its smallest smaller neighbour
        up = stored(links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("to")), "pointers")
        two = up.select(F.col("node").alias("to"), F.col("to").alias("further"))
        jump = stored(up.join(two, "to", "left").select("node", F.coalesce("further", "to").alias("to")), "pointers")
        links = stored(
            links.join(jump.withColumnRenamed("node", "a").withColumnRenamed("to", "ta"), "a", "left")
            .join(jump.withColumnRenamed("node", "b").withColumnRenamed("to", "tb"), "b", "left")
            .select(F.coalesce("ta", "a").alias("x"), F.coalesce("tb", "b").alias("y"))
            .where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .distinct(),
            "links",
        )
        labels = stored(labels.join(jump.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("to", "component").alias("component")), "labels")
    return labels


def forest(links: np.ndarray, same: bool) -> list[tuple[int, int]]:
    """Edges (row, column) that connect what the links connect, fewer than rows plus columns."""
    edges, rows_left, columns_left = [], links.any(1), links.any(0)
    while rows_left.any():
        todo = [int(rows_left.argmax())]
        rows_left[todo[0]] = False
        if same:
            columns_left[todo[0]] = False
        while todo:
            r = todo.pop()
            for c in np.flatnonzero(links[r] & columns_left):
                edges.append((r, int(c)))
                columns_left[c] = False
                if same:
                    if rows_left[c]:
                        rows_left[c] = False
                        todo.append(int(c))
                else:
                    for r2 in np.flatnonzero(links[:, c] & rows_left):
                        edges.append((int(r2), int(c)))
                        rows_left[r2] = False
                        todo.append(int(r2))
    return edges

"""Connected components of a graph kept in a table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, spill

#: Rows of a node from which on it may be a hub, and how many hubs there are at most.
HUB, HUBS = 256, 50_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component) that connect what the edges (a, b) do; one for each node but the smallest."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    at = at.reshape(-1)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        for end in (x, y, root[x], root[y]):
            np.minimum.at(new, end, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    keep = root != np.arange(len(nodes))
    return nodes[keep], nodes[root[keep]]


def _met(rows: DataFrame, low: DataFrame, total: int) -> DataFrame:
    """rows(a, b) with m of low(k, m, n), one row for each a with the number n of its rows, total in all. Hubs have more than total / HUBS
    rows, so there are fewer than HUBS of them, which are sent to their rows; the rows of other nodes are few and meet in a shuffle."""
    most = max(HUB, total // HUBS)
    hubs = F.broadcast(low.where(F.col("n") > most).select(F.col("k").alias("hub"), "m"))
    tagged = rows.join(hubs, F.col("a") == F.col("hub"), "left")
    few = tagged.where("hub is null").select("a", "b").join(low.where(F.col("n") <= most), F.col("a") == F.col("k")).select("a", "b", "m")
    return tagged.where("hub is not null").select("a", "b", "m").unionByName(few)


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) of all nodes of edges(a, b) that aren't roots.

    Large-star and small-star rounds, each written to the shared folder, until nothing changes; the number of rounds grows with the
    logarithm of the largest component. Minima and numbers of rows are aggregated before they are shuffled; the rows of a hub
    stay where they are. Loops and repeated edges don't matter; an empty table gives an empty one.
    """
    edges = spill(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    of_node = (F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    seen = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == seen or not state[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(*of_node).select(F.col("a").alias("k"), F.least("a", "m").alias("m"), "n")
        large = spill(_met(both.where("b > a"), low, 2 * state[0]).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        low = large.groupBy("a").agg(*of_node).withColumnRenamed("a", "k")
        pairs = F.explode(F.array(F.struct(F.col("a"), F.col("m")), F.struct(F.col("b").alias("a"), F.col("m"))))
        small = _met(large, low, state[0]).select(pairs.alias("e")).select(F.col("e.a").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct()
        before, edges = edges, spill(small)
        drop(before)
        drop(large)

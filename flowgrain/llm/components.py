"""Connected components of an edge table, in Spark (large-star / small-star) and within a task (numpy)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize


def local_roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For nodes 0 to n - 1, the smallest node that each one reaches; hooking with pointer jumping."""
    label = np.arange(n)
    while True:
        a, b = label[u], label[v]
        low, high = np.minimum(a, b), np.maximum(a, b)
        apart = low != high
        if not apart.any():
            return label
        np.minimum.at(label, high[apart], low[apart])
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges with the same components as the pairs (a, b), at most one less than there are nodes."""
    if not len(a):
        return a, b
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = local_roots(len(nodes), at[: len(a)], at[len(a) :])
    child = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[child], nodes[root[child]]


def lightest_forest(u: np.ndarray, v: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Positions of the edges of a minimum spanning forest, by rounds in which every component takes its lightest edge.

    Ties go to the smaller (u, v), so forests of overlapping sets of edges agree where they can.
    """
    order = np.lexsort((v, u, weight))
    nodes, at = np.unique(np.concatenate([u[order], v[order]]), return_inverse=True)
    a, b, edge = at[: len(u)], at[len(u) :], np.arange(len(u))
    label, taken = np.arange(len(nodes)), [edge[:0]]
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return order[np.concatenate(taken)]
        a, b, x, y, edge = a[apart], b[apart], x[apart], y[apart], edge[apart]
        best = np.full(len(nodes), len(u))
        np.minimum.at(best, x, edge)
        np.minimum.at(best, y, edge)
        pick = np.unique(best[best < len(u)])
        taken.append(pick)
        own = np.searchsorted(edge, pick)
        label = local_roots(len(nodes), x[own], y[own])[label]


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Rows (node, root) for every node with an edge, root being the smallest node of its component.

    edges: columns ``u`` and ``v`` (bigint); loops, repeats and nulls do no harm. Each round is two
    aggregations by minimum and two joins, which Spark can split on a hot node; a star of any size
    never meets in one task as a list. Rounds grow with the logarithm of the component's size.
    """
    current = materialize(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    before = None
    for _ in range(most_rounds):
        state = current.agg(F.count("*"), F.sum(F.shiftright(F.xxhash64("u", "v"), 16))).first()
        if state == before or not state[0]:
            break
        before = state
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        small = large.join(down, F.col("u") == F.col("w")).select("u", "v", "m")
        small = small.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select(F.col("w").alias("u"), F.col("m").alias("v")))
        old, current = current, materialize(small.distinct(), "edges")
        discard(old)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return current.select(F.col("u").alias("node"), F.col("v").alias("root"))

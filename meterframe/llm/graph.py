"""Connected components: within a task on arrays, and across tasks on edge tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterframe.session import materialize


def find(parent: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    roots = parent[nodes]
    while True:
        above = parent[roots]
        if np.array_equal(above, roots):
            return roots
        roots = above


def unite(parent: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Joins the sets of each pair in `parent`; a root is the smallest member of its set."""
    while len(left):
        a, b = find(parent, left), find(parent, right)
        apart = a != b
        if not apart.any():
            return
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of the undirected edges (a, b): the smallest node reachable.

    Alternating large-star and small-star steps: each node hands its larger (then its
    smaller) neighbours to the smallest one it knows, until nothing changes. Every step moves
    each edge a fixed number of times; the written steps survive lost executors. A hub's edges
    are spread by the skew handling of the join.
    """
    edges = materialize(_larger_first(edges), "edges")
    before = None
    while True:
        edges = materialize(_small_star(_large_star(edges)), "edges")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return nodes.unionByName(roots)


def _larger_first(edges: DataFrame) -> DataFrame:
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return pairs.filter(F.col("a") != F.col("b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("hub")).agg(F.min("b").alias("m"))
    least = least.select("hub", F.least("hub", "m").alias("m"))
    moved = both.join(least, F.col("a") == F.col("hub")).filter(F.col("b") > F.col("a"))
    return _larger_first(moved.select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy(F.col("a").alias("hub")).agg(F.min("b").alias("m"))
    moved = edges.join(least, F.col("a") == F.col("hub")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    kept = least.select(F.col("hub").alias("a"), F.col("m").alias("b"))
    return _larger_first(moved.unionByName(kept))

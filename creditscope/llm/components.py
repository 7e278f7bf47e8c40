"""Connected components of an edge table by repeated contraction.

Nodes are long ids, seen through a bijective 64-bit hash so that their order is
random.  In each round every node moves to its least neighbour and the edges follow;
a constant share of nodes disappears each round, so rounds grow with the logarithm
of the longest path.  Edges and labels of a round are written tables.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditscope.llm.tables import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (columns a, b: long); nodes have the
    same label if and only if a path of edges joins them."""
    hashed = edges.select("a", "b").where("a is not null and b is not null")
    nodes = hashed.select(F.col("a").alias("node")).unionByName(hashed.select(F.col("b").alias("node"))).distinct()
    labels = nodes.select("node", F.xxhash64("node").alias("label"))
    current = stored(hashed.where("a <> b").select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b"))
                     .distinct(), "edges")
    while not current.isEmpty():
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        moved = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(
            F.col("a").alias("u"), F.least("a", "m").alias("to")), "moves")
        other = moved.select(F.col("u").alias("v"), F.col("to").alias("vto"))
        labels = stored(labels.join(moved, F.col("label") == F.col("u"), "left").select(
            "node", F.coalesce("to", "label").alias("label")), "labels")
        current = stored(current.join(moved, F.col("a") == F.col("u")).join(other, F.col("b") == F.col("v"))
                         .select(F.least("to", "vto").alias("a"), F.greatest("to", "vto").alias("b"))
                         .where("a <> b").distinct(), "edges")
    return labels


def local_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Least node reachable from each of the nodes 0 to n - 1 (inside a task)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            higher = root[root]
            if (higher == root).all():
                break
            root = higher
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root

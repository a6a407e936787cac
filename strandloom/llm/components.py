"""Connected components of an edge table by alternating large and small stars.

Each round is two aggregations and joins; the smallest neighbour of a node is found with partial aggregation, so a
hub's neighbours are never gathered. Rounds are written to the shared folder; the number of rounds grows with the
logarithm of the longest path.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm import _io


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each node's component, for nodes 0..n-1 and edges a[i], b[i]."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root != root[root]).any():
            root = root[root]
        if (root == before).all():
            break
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v: long) -> node, root for every node of an edge; root is the smallest node of its component."""
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, last = _io.stored(edges, "edges"), None
    while True:
        n, check = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (n, check) == last:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        last = (n, check)
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = _io.stored(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
        edges = _io.stored(small.where("u <> v").distinct(), "small-star")

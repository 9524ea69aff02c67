"""Connected components of a distributed edge table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cut


def contract(n: int, a: np.ndarray, b: np.ndarray, parent: np.ndarray | None = None) -> np.ndarray:
    """The least index reachable from each of ``n`` indices over edges (a, b); starts from ``parent`` if given."""
    parent = np.arange(n) if parent is None else parent
    while True:
        ra, rb = parent[a], parent[b]
        differ = ra != rb
        if not differ.any():
            return parent
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            jumped = parent[parent]
            if (jumped == parent).all():
                break
            parent = jumped


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b: long): root is the least node reachable.

    Alternating star contraction: in a round every node's smaller neighbours are joined to its least
    neighbour, then its larger ones; minima are pre-aggregated, so a node that a third of all edges
    touch costs one row a task. Each round's edges are written to shared storage, which ends lineage.
    Self-loops, repeated edges and either direction are fine; null ends are dropped; no edges give an
    empty table.
    """
    edges = edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = Cut(edges, "edges")
    mark = None
    for _ in range(max_rounds):
        seen = now.df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if not seen[0] or seen == mark:
            break
        mark = seen
        # Small star: neighbours below u, and u, go to the least of them.
        low = now.df.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = now.df.join(low, F.col("a") == F.col("u")).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()
        half = Cut(small, "edges")
        now.drop()
        # Large star: neighbours above u go to the least of u and its neighbours.
        both = half.df.unionByName(half.df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        now = Cut(large, "edges")
        half.drop()
    else:
        raise RuntimeError("components did not settle")
    # Settled edges are stars: every node but a root has its root as only lower neighbour.
    own = now.df.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return own.unionByName(now.df.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .routing import join_hot


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each node's component; nodes 0 to n - 1 in memory."""
    p = np.arange(n)
    while True:
        q = p.copy()
        np.minimum.at(q, a, p[b])
        np.minimum.at(q, b, p[a])
        np.minimum.at(q, p[a], q[b])
        np.minimum.at(q, p[b], q[a])
        while (q[q] != q).any():
            q = q[q]
        if (q == p).all():
            return p
        p = q


def _digest(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v") % F.lit(1 << 40)).alias("h")).first()
    return r["n"], r["h"] or 0


#: Edges of a node from which its least neighbour is broadcast to them instead of shuffling them.
HUB = 100_000


def components(edges: DataFrame) -> DataFrame:
    """``id``, ``root`` of every node in edges (u, v) but the roots; a root is its component's least id.

    Edges may repeat and come in either direction; loops and nulls are dropped.
    Each round is written to the shared folder. Edges of nodes with more than
    HUB of them stay where they are; such nodes are broadcast.
    """
    edges = edges.where("u is not null and v is not null and u <> v")
    edges = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    last = None
    while (now := _digest(edges)) != last:
        last = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = join_hot(both, least, ["u"], "n", HUB).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = join_hot(large, least, ["u"], "n", HUB).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))

"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import cut

ROUNDS_MOST = 60


def local_roots(n: int, pairs: np.ndarray) -> np.ndarray:
    """The least row connected to each of n rows by the pairs."""
    root = np.arange(n)
    while len(pairs):
        least = np.minimum(root[pairs[:, 0]], root[pairs[:, 1]])
        before = root.copy()
        np.minimum.at(root, root[pairs[:, 0]], least)
        np.minimum.at(root, root[pairs[:, 1]], least)
        root = root[root]
        if (root == before).all():
            break
    return root


def _pointed(rows: DataFrame, least: DataFrame) -> DataFrame:
    """rows (a, b) with m, the least neighbour of a. Both sides are read from tables, so a hub's rows are one skewed
    partition of a plain join, which adaptive execution splits; an aggregation in the same stage would keep it whole."""
    return rows.join(least, "a")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in edges (a, b); component is the least id of its component.

    Each round points the larger neighbours of an id, then the id and its smaller neighbours, at the least
    neighbour. Edges become stars around the least ids in a few rounds. Each half round is written to the shared folder.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(ROUNDS_MOST):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        edges = cut(_pointed(both.where("b > a"), least).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = cut(edges.groupBy("a").agg(F.min("b").alias("m")))
        small = _pointed(edges, least).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        edges = cut(small.where("a <> b").distinct())
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS_MOST} rounds")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())

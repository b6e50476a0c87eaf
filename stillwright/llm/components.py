"""Connected components by alternating large-star and small-star steps, in joins and minima."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stillwright.llm.common import discard, materialize


#: Rows of a matrix that are looked at together.
ROWS = 256


def labels(linked: np.ndarray) -> np.ndarray:
    """Of each row of a symmetric 0/1 matrix the least row that a chain of ones reaches."""
    n = len(linked)
    root = np.arange(n)
    while True:  # labels fall to the least linked one until they stay
        low = [np.where(linked[k : k + ROWS], root[None, :], n).min(axis=1, initial=n) for k in range(0, n, ROWS)]
        new = np.minimum(root, np.concatenate(low)) if low else root
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b) with a > b. Large: neighbours above a node join the least of its neighbourhood.
    Small: a node and its neighbours below join the least of them."""
    # the minima are written first: the join then has nothing but shuffles below it, so Spark can split
    # a node that a third of all edges meet at, or send the minima to every task where they are few
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least", free=False)
        out = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    else:
        least = materialize(edges.groupBy("a").agg(F.min("b").alias("m")), "least", free=False)
        moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = moved.unionByName(least.select("a", F.col("m").alias("b")))
    out = materialize(out.distinct(), "edges", free=False)
    discard(least)
    discard(edges)
    return out


def _settled(edges: DataFrame) -> bool:
    """Whether all edges (a, b) are stars around b: no node has two such, or is one and has one."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root (the least node of its component) of every node that has an edge; edges: a, b (long).

    Ends when each component is a star around its least node. Each round is written to the shared
    folder, so a lost executor costs one round at most; the round before is deleted.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", free=False)
    for _ in range(most_rounds):
        if _settled(now):
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        now = _star(_star(now, True), False)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")

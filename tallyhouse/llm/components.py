"""Connected components by alternating star contraction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tallyhouse.llm.staging import Stage


def forest(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """Each of ``n`` nodes' least reachable node, for a few edges in memory."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _stars(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to its least neighbour (or itself)."""
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    moved = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.filter("a <> b").distinct()


def _roots(edges: DataFrame) -> DataFrame:
    """Each node's smaller neighbours, and itself, move to its least neighbour."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select("a", F.col("m").alias("b"))
    return moved.union(own).filter("a <> b").distinct()


def components(edges: DataFrame, stage: Stage, max_rounds: int = 60) -> DataFrame:
    """(a long, b long) -> (node, root): the least node reachable, for each node on an edge between two nodes.

    Large-star and small-star steps in turn until nothing changes, which takes
    a number of rounds logarithmic in the number of nodes. Every step is a
    minimum that combines before the shuffle and an equality join. A round is
    one job; a count and a checksum of its edges are observed on the way, and
    nothing else comes to the driver. Loops and repeated edges do nothing. The
    result is a staged table.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    before = last = None
    for _ in range(max_rounds):
        seen = Observation()
        after = _roots(_stars(edges)).observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s"))
        edges = stage.put(after)
        if last is not None:
            stage.drop(last)
        last = edges
        mark = (seen.get["n"], seen.get["s"])
        if mark == before:
            found = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
            out = stage.put(found.union(found.select("root", "root")).distinct())
            stage.drop(edges)
            return out
        before = mark
    raise RuntimeError("components did not settle")

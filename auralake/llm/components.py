"""Connected components of a table of links, by alternating large-star and small-star steps.

Every step is a group-by with a minimum and a join on the node, so a node with very many links is
pre-aggregated and its partition of the join can be split. The number of rounds grows with the
logarithm of the longest path.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links with the same components as the links (a, b), at most one for each node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[left], root[right]), np.maximum(root[left], root[right])
        if not (low != high).any():
            break
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    child = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[root[child]], nodes[child]


def _to_least(links: DataFrame, larger_only: bool) -> DataFrame:
    """For each node the least of itself and its neighbours, given to its neighbours."""
    down = links.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("other"))
    both = down if larger_only else down.unionByName(down.select(F.col("other").alias("node"), F.col("node").alias("other")))
    least = both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("least"))
    joined = both.join(least, "node")
    if larger_only:  # small star: the node and its smaller neighbours go under the least of them
        out = joined.select(F.explode(F.array("other", "node")).alias("b"), F.col("least").alias("a"))
    else:  # large star: only larger neighbours go under it
        out = joined.where(F.col("other") > F.col("node")).select(F.col("other").alias("b"), F.col("least").alias("a"))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node that has a link in ``links`` (a, b); root is the least of its component."""
    links = common.cut(links.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    before = None
    while True:
        state = tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if state == before or not state[0]:
            return links.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(links.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        before = state
        links = common.cut(_to_least(_to_least(links, False), True))

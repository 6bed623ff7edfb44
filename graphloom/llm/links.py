"""Connected components of links between rows, as Spark jobs.

Links come as a table of integer pairs.  Rounds of large-star and small-star
contraction (Kiveris et al., 2014) turn it into stars around each component's
smallest member; a node's neighbours are never gathered, only their minimum is,
so a hub with any number of links costs no task more than its share.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import remove, written


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the links (a, b); component is the smallest node reachable."""
    now = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    now, path = written(now, "links")
    if now.isEmpty():
        return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    sign = None
    for _ in range(most_rounds):
        # Large star: neighbours above a node link to the least of its neighbourhood.
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # Small star: neighbours below a node, and the node, link to the least of them.
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.col("a"), F.col("b"))).alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        (now, next_path), old = written(small, "links"), path
        path = next_path
        remove(now.sparkSession, old)
        # The same links again: every node hangs on its component's least member.
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (seen["n"], seen["h"]) == sign:
            break
        sign = (seen["n"], seen["h"])
    else:
        raise RuntimeError("components did not settle")
    members = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


class Forest:
    """Union-find over the rows of one task, to pass on few links in place of many pairs."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def root(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def roots(self) -> np.ndarray:
        p = self.parent
        while not np.array_equal(q := p[p], p):
            p = q
        self.parent = p
        return p

    def join(self, left: np.ndarray, right: np.ndarray) -> None:
        """Unites left[k] with right[k] for all k, whole arrays at a time."""
        while len(left):
            p = self.roots()
            a, b = p[left], p[right]
            apart = a != b
            left, right, a, b = left[apart], right[apart], a[apart], b[apart]
            if len(a):
                np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))

"""Connected components of many graphs at once, by rounds of DataFrame jobs."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.sources.shared import remove, written

#: Links of a range, and those that a task looks at together with its stars.
PART_LINKS = 1_000_000


def components(links: DataFrame) -> DataFrame:
    """(p, node, root) for every node of the links (p, a, b): the least node that it reaches within its graph p.

    Rounds take turns: every node hangs its greater neighbours, then its lesser ones, on
    the least node around it.  Only minima of neighbourhoods are gathered, so a hub is no
    task's burden; the rounds grow with the logarithm of the longest chain.  Ranges of
    links first become stars alone, so chains within a range cost no rounds.
    """
    down = links.filter("a <> b").select("p", F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, path = written(down, "links")
    spark, seen = now.sparkSession, None
    parts = max(1, math.ceil(now.count() / PART_LINKS))
    stars = now.repartitionByRange(parts, "p", "a", "b") if parts > 1 else now.coalesce(1)
    (now, next_path), old = written(stars.mapInArrow(_stars, now.schema), "links"), path
    remove(spark, old)
    path = next_path
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("p", "a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == seen or not state["n"]:
            break
        seen = state
        around = now.union(now.select("p", "b", "a"))
        least = around.groupBy("p", "a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        greater = around.filter("b > a").join(least, ["p", "a"]).select("p", F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = greater.groupBy("p", "a").agg(F.min("b").alias("m"))
        moved = greater.join(low, ["p", "a"]).filter("b <> m").select("p", F.col("b").alias("a"), F.col("m").alias("b"))
        (now, next_path), old = written(moved.union(low.select("p", "a", F.col("m").alias("b"))).distinct(), "links"), path
        remove(spark, old)
        path = next_path
    return now.select("p", F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("p", F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _stars(batches):
    """Links (p, node, least node that it reaches in this partition); no more is held than the stars and a chunk."""
    held, n = [], 0

    def joined() -> pa.RecordBatch:
        p, a, b = (np.concatenate([x.column(c).to_numpy() for x in held]) for c in "pab")
        graphs, g = np.unique(p, return_inverse=True)
        ids, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
        nodes, ends = np.unique(np.concatenate([g, g]) * len(ids) + ends, return_inverse=True)
        x, y, root = ends[: len(a)], ends[len(a) :], np.arange(len(nodes))
        while len(x):
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(root, further := root[root]):
                root = further
            apart = root[x] != root[y]
            x, y = root[x[apart]], root[y[apart]]
        far = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(c).cast(t) for c, t in zip((graphs[nodes[far] // len(ids)], ids[nodes[far] % len(ids)], ids[nodes[root[far]] % len(ids)]), held[0].schema.types, strict=True)], schema=held[0].schema)

    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= PART_LINKS:
            held, n = [joined()], 0
    if held:
        yield joined()

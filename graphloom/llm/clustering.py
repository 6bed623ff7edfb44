"""Exact centroid clustering with an annulus search.

A centroid's distance to a vector is at least the difference of their norms.  Centroids
are sorted by norm; a vector's own norm is found among them by binary search, and the
centroids around it are visited outwards, nearest norm first.  The distance to the best one
so far is the upper bound, which narrows the annulus of norms that may still hold a nearer
one, ties included; the walk ends when both sides leave it.  Distances are exact integers,
so norms only ever decide which centroids need no comparing, with room for rounding.

Each round is one pass over the written vectors; tasks send one row of sums for each
centroid.  The driver holds the centroids and nothing else.

Components become floor(scale * x).  Where one may reach 2**27, tasks calculate with Python's
integers; distances and sums that a long does not hold are null in the result.

Defined results: vectors that are null, of another length, or hold null or non-finite
components, as scaled, are left out; fewer vectors than centroids give as many centroids as vectors;
repeated rows count each; the seeds are rows, so equal vectors or ids may seed more than
one centroid, and the smaller number wins; rows without id are clustered, and seed
last; an empty table gives no rows; other columns may have any name.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import remove, written

#: Components below this in absolute value keep every distance and partial sum within 64 bits.
SMALL = 1 << 27
LONGEST = (1 << 63) - 1
#: First level of the sums of all tasks, so that no group has a row of every task.
FANS = 64


def seeds(ids: DataFrame, k: int, seed: int) -> list[tuple]:
    """The k rows whose id has the least SHA-256 of ``seed:id``, by ascending hash; rows without id come last."""
    hashed = ids.select("vec_id", "vector", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"))
    return hashed.orderBy(F.col("h").asc_nulls_last(), "vec_id", "vector").limit(k).collect()


def quantised(df: DataFrame, dims: int, scale: float) -> DataFrame:
    """(vec_id, vector, top): kept vectors as floor(scale * x) in doubles, and their largest component."""
    x = F.col("embedding").cast("array<double>")
    whole = F.size(x) == dims
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v * F.lit(scale)) < float("inf")))
    q = F.transform("x", lambda v: _floor(v * F.lit(scale)))
    kept = df.select("vec_id", x.alias("x")).filter(whole & fine)
    return kept.select("vec_id", q.alias("vector")).withColumn("top", F.array_max(F.transform("vector", F.abs)))


def _floor(x):
    """floor as a double; those beyond 2**53 are whole already, and a long may not hold them."""
    return F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)


class Centroids:
    """Centroids sorted by norm, and the annulus search among them."""

    def __init__(self, values: list[list[int]], small: bool):
        self.kind = np.int64 if small else object
        self.values = np.array(values, dtype=self.kind).reshape(len(values), -1)
        norms = self.norms(self.values)
        self.order = np.argsort(norms, kind="stable")
        self.sorted_norms = norms[self.order]

    @staticmethod
    def norms(x: np.ndarray) -> np.ndarray:
        if x.dtype != object:
            return np.sqrt((x.astype(np.float64) ** 2).sum(1))
        return np.array([math.hypot(*map(float, row)) for row in x])

    def distances(self, x: np.ndarray, which: np.ndarray) -> np.ndarray:
        d = x - self.values[which]
        return (d * d).sum(1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number and squared distance of each vector's nearest centroid (ties: the smaller number), and how many were compared."""
        n, k = len(x), len(self.values)
        norms = self.norms(x)
        right = np.searchsorted(self.sorted_norms, norms)
        left = right - 1
        best = np.full(n, k)
        bound = np.zeros(n, dtype=self.kind)
        compared, live = 0, np.arange(n)
        while len(live):
            # The next centroid of each vector: that of the nearer norm on either side.
            low = np.where(left[live] >= 0, norms[live] - self.sorted_norms[np.maximum(left[live], 0)], np.inf)
            high = np.where(right[live] < k, self.sorted_norms[np.minimum(right[live], k - 1)] - norms[live], np.inf)
            down = low <= high
            gap = np.abs(np.where(down, low, high))
            reach = np.where(best[live] < k, np.sqrt(bound[live].astype(np.float64)), np.inf)
            # Rounding never takes a centroid out of the annulus; one whose gap cannot be told stays in.
            inside = ~(gap > reach * (1 + 1e-9) + norms[live] * 1e-9 + 1e-6) & ((left[live] >= 0) | (right[live] < k))
            live, down = live[inside], down[inside]
            # Where both gaps are infinite or not to be told, the side that has centroids left.
            down = np.where(left[live] < 0, False, np.where(right[live] >= k, True, down))
            which = self.order[np.where(down, np.maximum(left[live], 0), np.minimum(right[live], k - 1))]
            d = self.distances(x[live], which)
            compared += len(live)
            nearer = (best[live] == k) | (d < bound[live]) | ((d == bound[live]) & (which < best[live]))
            nearer = nearer.astype(bool)
            best[live[nearer]], bound[live[nearer]] = which[nearer], d[nearer]
            left[live[down]] -= 1
            right[live[~down]] += 1
        return best, bound, compared


def _vectors(batch: pa.RecordBatch, dims: int, small: bool) -> np.ndarray:
    flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    return flat.astype(np.int64) if small else np.array([[int(v) for v in row] for row in flat], dtype=object).reshape(-1, dims)


def _sums(vectors: DataFrame, centroids: list[list[int]], small: bool) -> dict[int, tuple[int, list[int]]]:
    """Centroid -> number of its vectors and their exact sums."""
    dims, k = len(centroids[0]), len(centroids)

    def run(batches):
        own = Centroids(centroids, small)
        sums, counts = np.zeros((k, dims), dtype=object), np.zeros(k, np.int64)
        for batch in batches:
            x = _vectors(batch, dims, small)
            best, *_ = own.nearest(x)
            for c in np.unique(best):
                mine = x[best == c]
                sums[c] += mine.sum(0).astype(object)
                counts[c] += len(mine)
        for c in np.flatnonzero(counts):
            yield pa.RecordBatch.from_pydict({"cluster": pa.array([c], pa.int32()), "n": pa.array([counts[c]], pa.int64()), "sums": pa.array([[str(v) for v in sums[c]]], pa.list_(pa.string()))})

    def add(table: pa.Table) -> pa.Table:
        total = [sum(map(int, column)) for column in zip(*table.column("sums").to_pylist(), strict=True)]
        return pa.table({"cluster": pa.array([table.column("cluster")[0].as_py()], pa.int32()), "n": pa.array([sum(table.column("n").to_pylist())], pa.int64()), "sums": pa.array([[str(v) for v in total]], pa.list_(pa.string()))})

    schema = "cluster int, n bigint, sums array<string>"
    parts = vectors.select("vector").mapInArrow(run, schema).withColumn("fan", F.spark_partition_id() % FANS)
    rows = parts.groupBy("cluster", "fan").applyInArrow(add, schema).groupBy("cluster").applyInArrow(add, schema).collect()  # at most one for each centroid
    return {r["cluster"]: (r["n"], [int(v) for v in r["sums"]]) for r in rows}


def cluster(df: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: float = 1024.0, seed: int = 3) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid (array of decimal strings) for every kept vector of df(vec_id, embedding)."""
    spark = df.sparkSession
    vectors, path = written(quantised(df.select("vec_id", "embedding"), dims, scale), "vectors")
    small = (vectors.agg(F.max("top")).first()[0] or 0) < SMALL
    vectors = vectors.select("vec_id", "vector")
    schema = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid array<string>"
    centroids = [[int(v) for v in r["vector"]] for r in seeds(vectors, k, seed)]
    if not centroids:
        return spark.createDataFrame([], schema)
    for _ in range(rounds):
        before = centroids
        found = _sums(vectors, centroids, small)
        centroids = [[v // found[c][0] for v in found[c][1]] if c in found else old for c, old in enumerate(before)]
        if centroids == before:
            break  # all later rounds are the same

    def assign(batches):
        own = Centroids(centroids, small)
        for batch in batches:
            best, d, _ = own.nearest(_vectors(batch, dims, small))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(best, pa.int32()), pa.array([str(v) for v in d], pa.string())], names=["vec_id", "cluster", "distance"])

    assigned, _ = written(vectors.mapInArrow(assign, "vec_id bigint, cluster int, distance string"), "clusters")
    remove(spark, path)
    # 39 digits of a decimal are not enough for every double, so totals are null where they overflow.
    exact = F.col("distance").try_cast("decimal(38,0)")
    long_or_null = lambda c: c.try_cast("bigint")
    sums = assigned.groupBy("cluster").agg(F.try_sum(exact).alias("s"), F.count_if(exact.isNull()).alias("lost")).collect()  # one row for each centroid
    told = {r["cluster"]: None if r["lost"] or r["s"] is None or int(r["s"]) > LONGEST else int(r["s"]) for r in sums}
    total = None if None in told.values() or sum(told.values()) > LONGEST else sum(told.values())
    rows = [(c, told.get(c), total, [str(v) for v in values]) for c, values in enumerate(centroids)]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid array<string>")
    return assigned.select("vec_id", "cluster", long_or_null(F.col("distance")).alias("distance")).join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def seed_hash(vec_id: int, seed: int = 3) -> str:
    """The hash that seeds are sorted by, as text."""
    return hashlib.sha256(f"{seed}:{vec_id}".encode()).hexdigest()

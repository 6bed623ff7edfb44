"""SimHash near-duplicates: a forest of vantage-point trees over fingerprints.

Two 64-bit fingerprints that differ in at most ``radius`` bits differ in at most
``radius // blocks`` bits in one of ``blocks`` blocks of bits.  Hamming distance
within a block is a metric of its own, so each block gets a vantage-point tree with
that small radius: a node keeps the distance of each fingerprint to its vantage point,
near ones go inside and others outside.  Triangle bounds prune: only an inside
fingerprint whose distance is within the radius of the border can have a partner
outside, so it is also sent there, as a guest.  Each pair of stored fingerprints thus
meets in the shard of the outer one, and shards compare their stored fingerprints
with each other and with their guests over all 64 bits.

The trees are fitted on a bounded sample that grows with the fingerprints, which
affects the sizes of shards only; every fingerprint is stored in every tree.  A task
grows a tree of its own over a shard that is still large, so shards are not compared
all against all; a shard with more than ``most`` members is dealt by blocks of them to
separate tasks.  Tasks pass on a spanning forest of what they find linked, never all
pairs.  With very many fingerprints, blocks of 21 bits would be crowded, so there are
then two blocks of 32 bits, with radius 2 each; no choice changes the result.

Defined results: a null text has no words; a text without words has fingerprint
zero, which is linked like any other; equal texts and repeated rows have equal
fingerprints and so one component; a component without any id has a null
component_id; texts of any length are hashed whole, in steps; an empty table gives no
rows.  Only the id and the text are read, whatever other columns are called.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import spread_join, written
from graphloom.llm.links import Forest, components
from graphloom.llm.tokens import slices

SAMPLE, MOST_SAMPLE = 50_000, 1 << 20  # fingerprints to which the trees are fitted: at least, at most
LEAF = 4_000  # fingerprints that a shard should store
MOST = 1 << 18  # members of a shard in one task
LOCAL, INNER = 300, 100  # members that are compared without a tree of their own, and what its shards should store
CROWDED = 1 << 27  # fingerprints from which on there are two blocks


def fingerprint(text: bytes, width: int = 4, seed: int = 42) -> int:
    """SimHash of a text's shingles of ``width`` words, each repeated as often as it occurs."""
    words = text.lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = np.array([xxhash.xxh64_intdigest(joined, seed)], dtype="<u8")
    else:
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate([[0], ends[:-width] + 1])
        h = xxhash.xxh64_intdigest
        hashes = np.array([h(joined[a:b], seed) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist(), strict=True)], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[k : k + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """doc_id and the fingerprint as a signed 64-bit integer."""

    def run(batches):
        for batch in batches:
            for a, b in slices(batch, "text"):
                part = batch.slice(a, b - a)
                prints = np.array([fingerprint(t or b"", width) for t in part.column("text").to_pylist()], dtype=np.uint64)
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "fp": pa.array(prints.view(np.int64), pa.int64())})

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, fp bigint")


def block_masks(radius: int, blocks: int) -> tuple[list[int], int]:
    """Bit masks that share out 64 bits, and the radius within a block."""
    bounds = [64 * k // blocks for k in range(blocks + 1)]
    return [((1 << (z - a)) - 1) << a for a, z in zip(bounds[:-1], bounds[1:], strict=True)], radius // blocks


def distance(a, b):
    return np.bitwise_count(a ^ b)


def grow(sample: np.ndarray, mask: int, leaf: int, seed: int = 7) -> list[tuple[int, int, int, int]]:
    """Nodes (vantage point, border, inside, outside) of a tree; a child below zero is a shard.

    The border is the distance, within the block, up to which members go inside; among
    a few candidates the vantage point with the most even split at its median is taken.
    """
    rng, nodes, shards = np.random.default_rng(seed), [], 0
    m = np.uint64(mask)

    def build(points: np.ndarray, depth: int) -> int:
        nonlocal shards
        best = None
        if len(points) > leaf and depth < 24:
            for v in rng.integers(0, 1 << 63, 6, dtype=np.uint64) * np.uint64(2) ^ points[rng.integers(0, len(points), 6)]:
                d = distance(points & m, v & m)
                border = int(np.median(d))
                for at in (border - 1, border):
                    inside = int((d <= at).sum())
                    # Guests are what a split costs: members just inside the border.
                    cost = max(inside, len(points) - inside) + int((d == at).sum())
                    if 0 < inside < len(points) and (best is None or cost < best[0]):
                        best = (cost, int(v), at, d <= at)
        if best is None or best[0] >= len(points):
            shards += 1
            return -shards
        k = len(nodes)
        nodes.append((0, 0, 0, 0))
        inner, outer = build(points[best[3]], depth + 1), build(points[~best[3]], depth + 1)
        nodes[k] = (best[1], best[2], inner, outer)
        return k

    root = build(sample, 0)
    return nodes if root >= 0 else [(0, 64, -1, -2)]


def route(points: np.ndarray, nodes: list, mask: int, radius: int, guest: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shard, is guest): where each point is stored, and the shards it visits.

    Points that are guests from the start are stored nowhere.
    """
    m, done = np.uint64(mask), []
    v = np.array([n[0] for n in nodes], np.uint64) & m
    border = np.array([n[1] for n in nodes], np.int64)
    child = np.array([[n[2], n[3]] for n in nodes], np.int64)
    row, node = np.arange(len(points)), np.zeros(len(points), np.int64)
    guest = np.zeros(len(points), bool) if guest is None else guest
    own = points & m
    while len(row):
        d = distance(own[row], v[node]).astype(np.int64)
        b = border[node]
        home = (d > b).astype(np.int64)  # 0 inside, 1 outside
        # A stored point seeks partners across the border from the inside only; a guest
        # seeks whatever is stored on either side within its reach.
        cross = np.where(home == 0, d + radius > b, guest & (d - radius <= b))
        row, guest, node = np.concatenate([row, row[cross]]), np.concatenate([guest, np.ones(int(cross.sum()), bool)]), np.concatenate([child[node, home], child[node[cross], 1 - home[cross]]])
        end = node < 0
        done.append((row[end], -node[end] - 1, guest[end]))
        row, node, guest = row[~end], node[~end], guest[~end]
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*done, strict=True)) if done else (np.zeros(0, np.int64),) * 3


def linked_pairs(stored: np.ndarray, other: np.ndarray, radius: int, chunk: int = 512):
    """Index pairs within the radius, a few rows at a time."""
    for k in range(0, len(stored), chunk):
        i, j = np.nonzero(distance(stored[k : k + chunk, None], other[None, :]) <= radius)
        if len(i):
            yield i + k, j


def meetings(home: np.ndarray, visit: np.ndarray, mask: int, radius: int, leaf: int = INNER, local: int = LOCAL):
    """Index arrays (of home, of home and visit) of members that must be compared, all against all in each."""
    if len(home) <= local:
        yield np.arange(len(home)), np.arange(len(home) + len(visit))
        return
    nodes = grow(home[:: max(1, len(home) // 65_536)], mask, leaf)
    row, shard, guest = route(np.concatenate([home, visit]), nodes, mask, radius, np.arange(len(home) + len(visit)) >= len(home))
    order = np.lexsort((guest, shard))
    row, shard, guest = row[order], shard[order], guest[order]
    head = np.flatnonzero(np.diff(shard, prepend=-1))
    for a, z in zip(head, np.append(head[1:], len(row)), strict=True):
        stored = row[a : a + int((~guest[a:z]).sum())]
        if len(stored):
            yield stored, row[a:z]


def near_links(distinct: DataFrame, radius: int = 4, blocks: int | None = None, sample: int = SAMPLE, leaf: int = LEAF, most: int = MOST, local: int = LOCAL, inner: int = INNER) -> DataFrame:
    """Links (a, b) between different fingerprints (column fp) that span all pairs within the radius."""
    spark = distinct.sparkSession
    n = distinct.count()
    blocks = blocks or (3 if n < CROWDED else 2)
    masks, r = block_masks(radius, blocks)
    # Four sampled fingerprints for a shard at least.
    share = min(1.0, min(max(sample, 4 * n // leaf), MOST_SAMPLE) / max(n, 1))
    # A bounded sample: the hash keeps about ``sample`` fingerprints of any number.
    picked = distinct.filter(F.pmod(F.xxhash64("fp", F.lit(1)), F.lit(1_000_000)) < int(share * 1_000_000)).limit(2 * MOST_SAMPLE)
    seen = np.sort(np.array([x["fp"] for x in picked.collect()], dtype=np.int64)).view(np.uint64)
    # Shards hold about as many fingerprints as a task compares quickly, whatever n is.
    fit = max(4, min(len(seen), round(leaf * share)) or 4)
    trees = spark.sparkContext.broadcast([grow(seen, m, fit) for m in masks])

    def place(batches):
        for batch in batches:
            fp = np.asarray(batch.column("fp").to_numpy(zero_copy_only=False), np.int64).view(np.uint64)
            for t, m in enumerate(masks):
                row, shard, guest = route(fp, trees.value[t], m, r)
                yield pa.RecordBatch.from_pydict({"shard": pa.array(shard * blocks + t, pa.int64()), "fp": pa.array(fp[row].view(np.int64), pa.int64()), "guest": pa.array(guest, pa.bool_())})

    placed, _ = written(distinct.select("fp").mapInArrow(place, "shard bigint, fp bigint, guest boolean"), "simhash-placed")
    sizes = placed.groupBy("shard").count().filter(F.col("count") > most).withColumn("parts", F.ceil(F.col("count") / most).cast("int"))
    # Shards beyond a task's measure: every pair of their parts meets in a task of its own.
    part = placed.join(sizes.select("shard", "parts"), "shard", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = part.withColumn("p", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    spread = part.select("shard", "fp", "guest", "p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("q"))
    spread = spread.select("shard", F.least("p", "q").alias("lo"), F.greatest("p", "q").alias("hi"), "fp", "guest")

    def compare(key, table):
        fp = table.column("fp").to_numpy().view(np.uint64)
        guest = table.column("guest").to_numpy(zero_copy_only=False).astype(bool)
        home, visit = np.unique(fp[~guest]), np.unique(fp[guest])
        both = np.concatenate([home, visit])
        all_ = np.unique(both)
        forest, at = Forest(len(all_)), np.searchsorted(all_, both)
        for left, right in meetings(home, visit, masks[key[0].as_py() % blocks], r, inner, local):
            for i, j in linked_pairs(both[left], both[right], radius):
                forest.join(at[left[i]], at[right[j]])
        root = forest.roots()
        tied = np.flatnonzero(root != np.arange(len(all_)))
        return pa.table({"a": all_[tied].view(np.int64), "b": all_[root[tied]].view(np.int64)})

    return spread.groupBy("shard", "lo", "hi").applyInArrow(compare, "a bigint, b bigint").distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, width: int = 4, **how) -> DataFrame:
    """doc_id, fp, component_id: the smallest id reachable over fingerprints within the radius."""
    prints, _ = written(fingerprints(df, id_col, text_col, width), "simhash-prints")
    # Copies meet here, by partial minima; what follows sees each fingerprint once.
    distinct, _ = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-distinct")
    comps = components(near_links(distinct.select("fp"), radius, **how))
    # Components of fingerprints carry their least document.
    of = distinct.join(comps.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"), "least", "n")
    of, _ = written(of, "simhash-components")
    least, _ = written(of.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("k")), "simhash-least")
    final, _ = written(spread_join(of, least, "component").select("fp", "component_id", F.col("n").alias("k")), "simhash-classes")
    return spread_join(prints, final, "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """df without the rows whose component has a smaller id; of rows with the same id all stay."""
    gone = near_duplicates(df, id_col, text_col, **how).filter("doc_id <> component_id").select("doc_id").distinct()
    # The row travels as one column, so that its names are free.
    whole = df.select(F.struct("*").alias("row"), F.col(id_col).alias("doc_id"))
    return whole.join(gone, "doc_id", "left_anti").select("row.*")

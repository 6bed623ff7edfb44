"""Values of nodes that settle by rounds, each node's from the values beside it.

Nodes are cut in ranges of about equally many links, and a range's links are written once,
as places in the list of those nodes that it knows.  In a round every range takes the
values that the others sent, goes on alone until its own values stay, and sends to each
other range those of its nodes that this one knows, as one array.  So neither links nor
values of single nodes are shuffled, and chains within a range cost no rounds.

The rules here only ever lower (or only ever raise) a value, and from any bound on that
side, values of other ranges that are rounds old included, they come to the same end.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from graphloom.sources.shared import bucketed, remove, swept, written

#: Links of a range, as a bound on its memory and where less is not worth a task.
PART_LINKS, LEAST_LINKS = 3_000_000, 250_000
UNKNOWN = np.iinfo(np.int32).max
STATE = "part int, sender int, moved bigint, vals array<int>"


@dataclass(frozen=True)
class HIndex:
    """The greatest h such that h links pass on h at least; from the number of links or ``most`` down."""

    most: int = UNKNOWN
    unknown: int = UNKNOWN

    def start(self, n: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.minimum(n, self.most)

    def next(self, passed: np.ndarray, n: np.ndarray, now: np.ndarray, x: np.ndarray) -> np.ndarray:
        """passed has n[k] values for each node k, one after another; now is an upper bound."""
        row = np.repeat(np.arange(len(n)), n)
        base = np.cumsum(now + 1) - (now + 1)
        counts = np.bincount(base[row] + np.minimum(passed, now[row]), minlength=int((now + 1).sum()))
        upto = np.cumsum(counts)
        level = np.arange(len(counts)) - np.repeat(base, now + 1)
        reach = np.repeat(upto[base + now], now + 1) - upto + counts  # links of the node that pass on this level at least
        return np.maximum.reduceat(np.where(reach >= level, level, 0), base)


@dataclass(frozen=True)
class Layer:
    """One more than the x-th least value beside a node, 1 if x is not positive; from 1 up."""

    unknown: int = 1

    def start(self, n: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.ones(len(n), np.int64)

    def next(self, passed: np.ndarray, n: np.ndarray, now: np.ndarray, x: np.ndarray) -> np.ndarray:
        span = int(passed.max(initial=0)) + 1
        inside = np.sort(np.repeat(np.arange(len(n)), n) * span + passed) % span
        at = np.cumsum(n) - n + np.maximum(x, 1) - 1
        return np.where(x > 0, inside[at] + 1, 1)


def too_long(links: DataFrame) -> bool:
    """Whether a node has more links than a range should hold."""
    with swept(links.sparkSession):
        return (links.groupBy("a").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) > PART_LINKS


def settled(links: DataFrame, rule: HIndex | Layer, name: str) -> DataFrame:
    """(node, value) of all nodes a of the links (a, o0, ...), read several times, which list a link from each of its nodes; it passes on the least value of the others.

    A column x, the same in all links of a node, goes to the rule.
    """
    spark = links.sparkSession
    others = [c for c in links.columns if c[0] == "o"]
    width, n = len(others), links.count()
    entries = n * width
    parts = max(1, math.ceil(entries / PART_LINKS), min(spark.sparkContext.defaultParallelism, math.ceil(entries / LEAST_LINKS)))
    # As many buckets as a shuffle has partitions at least, or Spark would shuffle the links anew.
    buckets = max(parts, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged, ranged_path = bucketed(links.repartitionByRange(parts, "a").withColumn("part", F.spark_partition_id()), f"{name}-ranged", buckets, "part")
    ranges = sorted((r["low"], r["part"]) for r in ranged.groupBy("part").agg(F.min("a").alias("low")).collect())  # one row for each range
    lows, numbers = np.array([r[0] for r in ranges], np.int64), np.array([r[1] for r in ranges], np.int64)

    def place(table: pa.Table) -> pa.Table:
        a = table.column("a").to_numpy()
        order = np.argsort(a, kind="stable")
        o = np.column_stack([table.column(c).to_numpy() for c in others])[order].ravel()
        ids, first, count = np.unique(a[order], return_index=True, return_counts=True)
        x = table.column("x").to_numpy()[order][first] if "x" in table.column_names else np.zeros(len(ids), np.int64)
        known, at = np.unique(o, return_inverse=True)
        own = np.minimum(np.searchsorted(known, ids), len(known) - 1)
        own = np.where(known[own] == ids, own, -1)
        part = table.column("part")[0].as_py()
        owner = np.searchsorted(lows, known, "right") - 1
        knows = np.unique(np.repeat(np.arange(len(ids)), count * width) * len(lows) + owner[at])
        knows = knows[numbers[knows % len(lows)] != part]
        to_first = np.searchsorted(knows, np.arange(len(ids) + 1) * len(lows))
        offsets = np.concatenate([[0], np.cumsum(count * width)])
        list_ = lambda off, v: pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(v, pa.int32()))
        return pa.table({"part": pa.array(np.full(len(ids), part), pa.int32()), "node": ids, "own": pa.array(own, pa.int32()), "x": pa.array(x, pa.int64()), "at": list_(offsets, at), "to": list_(to_first, numbers[knows % len(lows)])})

    placed = ranged.groupBy("part").applyInArrow(place, "part int, node bigint, own int, x bigint, at array<int>, to array<int>")
    lists, _ = bucketed(placed, f"{name}-lists", buckets, "part")
    remove(spark, ranged_path)

    def step(lists: pa.Table, state: pa.Table) -> pa.Table:
        return _step(lists, state, rule, width)

    state, path = spark.createDataFrame([], STATE), None
    while True:
        seen = Observation()
        nxt = lists.groupBy("part").cogroup(state.groupBy("part")).applyInArrow(step, STATE).observe(seen, F.coalesce(F.sum("moved"), F.lit(0)).alias("moved"))
        (state, next_path), old = written(nxt, f"{name}-state"), path
        if old:
            remove(spark, old)
        path = next_path
        if not seen.get["moved"]:
            break
    own = state.filter("sender = part")
    return lists.select("part", "node").groupBy("part").cogroup(own.groupBy("part")).applyInArrow(_values, "node bigint, value bigint")


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The length of each list, and the lists one after another."""
    whole = column.combine_chunks()
    if isinstance(whole, pa.ChunkedArray):
        whole = pa.concat_arrays(whole.chunks)
    return pc.list_value_length(whole).to_numpy(zero_copy_only=False).astype(np.int64), pc.list_flatten(whole).to_numpy(zero_copy_only=False).astype(np.int64)


def _values(lists: pa.Table, own: pa.Table) -> pa.Table:
    values = _flat(own.column("vals"))[1]
    return pa.table({"node": np.sort(lists.column("node").to_numpy()), "value": values})


def _step(lists: pa.Table, state: pa.Table, rule: HIndex | Layer, width: int) -> pa.Table:
    """The state that a range sends: its own values to itself, and to each other range those that it knows."""
    lists = lists.sort_by("node")
    part = lists.column("part")[0].as_py()
    own, x = lists.column("own").to_numpy().astype(np.int64), lists.column("x").to_numpy()
    (n, at), (n_to, to) = _flat(lists.column("at")), _flat(lists.column("to"))
    first = np.cumsum(n) - n
    far = np.ones(int(at.max()) + 1, bool)
    far[own[own >= 0]] = False
    values = np.full(len(far), rule.unknown, np.int64)
    if len(state):
        state = state.sort_by("sender")
        theirs = np.array(state.column("sender").to_pylist()) == part
        lengths, sent = _flat(state.column("vals"))
        mine = np.repeat(theirs, lengths)
        now = sent[mine]
        values[far] = sent[~mine]  # ranges ascend with their numbers, and so do the nodes known of each
    else:
        now = rule.start(n // width, x)
    values[own[own >= 0]] = now[own >= 0]
    before, active = now.copy(), np.arange(len(n))
    while len(active):
        if len(active) == len(n):
            beside = at
        else:
            m = n[active]
            beside = at[np.arange(m.sum()) + np.repeat(first[active] - (np.cumsum(m) - m), m)]
        passed = values[beside].reshape(-1, width).min(axis=1)
        new = rule.next(passed, n[active] // width, now[active], x[active])
        changed = active[new != now[active]]
        now[active] = new
        changed = changed[own[changed] >= 0]
        values[own[changed]] = now[changed]
        touched = np.zeros(len(values), bool)
        touched[own[changed]] = True
        active = np.flatnonzero(np.logical_or.reduceat(touched[at], first)) if len(changed) else changed
    moved = int(((now != before) & (n_to > 0)).sum()) if len(state) else len(to)
    order = np.argsort(to, kind="stable")
    goes, firsts = np.unique(to[order], return_index=True)
    sent = now[np.repeat(np.arange(len(n)), n_to)[order]]
    offsets = np.concatenate([[0], len(now) + np.append(firsts, len(sent))])
    vals = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([now, sent]), pa.int32()))
    return pa.table({"part": pa.array(np.append(part, goes), pa.int32()), "sender": pa.array(np.full(1 + len(goes), part), pa.int32()), "moved": pa.array([moved] + [0] * len(goes), pa.int64()), "vals": vals})

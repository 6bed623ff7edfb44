"""Numbers of cliques, and the tree of nuclei, of large graphs.

For (r, s) = (1, 2), (2, 3) or (3, 4), a clique of r vertices has the largest k at which
some set of r-cliques holds it in which each lies in at least k s-cliques of the set: core
numbers, truss numbers (by triangles) and numbers by 4-cliques.  Every r-clique starts with
the number of its s-cliques and takes, round by round, the h-index of what these pass on,
the least value of their other members.

An s-clique joins its members at the least of their numbers.  The nuclei at level k are
the components by joins at k or more; one is told where its level adds something.  The
tree comes from bisecting the levels: the joins of a range's upper half are contracted
for its lower half, and all ranges of one size are solved in one job, so the rounds grow
with the logarithm of the number of levels, not with the number.  Before that, each range
of joins keeps a spanning forest of its strongest ones, so rounds go over about as many
rows as there are nodes.

Defined results: cliques in no s-clique have the number 0 and no nucleus; a graph without
s-cliques has no nuclei.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.operators import peeling, rounds
from graphloom.operators.components import components
from graphloom.sources.graphs import PropertyGraph
from graphloom.sources.shared import remove, written

#: Joins of a range, and those that a task looks at together with what it has kept.
PART_JOINS, CHUNK_JOINS = 3_000_000, 1_000_000


@dataclass(frozen=True)
class Incidence:
    """cliques(node, v0, v1, ...) with their vertices in order, and whole(n0, n1, ...): the members of each s-clique, written."""

    r: int
    cliques: DataFrame
    whole: DataFrame

    @property
    def vertices(self) -> list[str]:
        return [f"v{k}" for k in range(self.r)]


def incidence(g: PropertyGraph, r: int) -> Incidence:
    """The r-cliques of a graph and the (r + 1)-cliques that they lie in.

    Members are numbered where their s-clique is found, so they are not joined by their vertices.
    """
    if r == 1:
        ends = g.once().select(F.col("src").alias("n0"), F.col("dst").alias("n1"))
        return Incidence(1, g.vertices.select(F.col("id").alias("node"), F.col("id").alias("v0")), written(ends, "members")[0])
    if r not in (2, 3):
        raise ValueError("r must be 1, 2 or 3")
    spark = g.vertices.sparkSession
    e, path = peeling._oriented(g.once(), None)
    lists = peeling._lists(e)
    remove(spark, path)
    if r == 2:
        edges = peeling.numbered_edges(lists).select("node", F.least("a", "b").alias("v0"), F.greatest("a", "b").alias("v1"))
        return Incidence(2, edges, written(peeling.triangles_of(lists, "edges"), "s-cliques")[0])
    t, path = written(peeling.triangles_of(lists, "rows"), "triangles")
    nodes, whole = peeling.numbered_cliques(t)
    remove(spark, path)
    ordered = nodes.select("node", F.array_sort(F.array("x", "y", "z")).alias("c"))
    return Incidence(3, ordered.select("node", *[F.col("c")[k].alias(f"v{k}") for k in range(3)]), whole)


def _member_links(whole: DataFrame) -> DataFrame:
    """(a, o0, ...): each clique of whole(n0, n1, ...) from each of its members, with the others."""
    size = len(whole.columns)
    turns = [F.struct(*[F.col(f"n{(k + j) % size}").alias("a" if j == 0 else f"o{j - 1}") for j in range(size)]) for k in range(size)]
    return whole.select(F.explode(F.array(*turns)).alias("x")).select("x.*")


def numbers_of(i: Incidence, most: int = rounds.UNKNOWN) -> DataFrame:
    """(node, number) of all cliques that lie in an s-clique; numbers above ``most`` are told as that."""
    links = _member_links(i.whole)
    if not rounds.too_long(links):
        return rounds.settled(links, rounds.HIndex(max(most, 0)), "numbers").select("node", F.col("value").alias("number"))
    nodes = F.array(*[F.col(c).alias(c) for c in i.whole.columns])
    members, _ = written(i.whole.select(F.monotonically_increasing_id().alias("clique"), F.explode(nodes).alias("node")), "members")
    return _numbers_by_joins(members, most)


def _numbers_by_joins(members: DataFrame, most: int) -> DataFrame:
    """The same from members(clique, node), by rounds of joins, for nodes that lie in very many cliques."""
    spark = members.sparkSession
    now, path = written(members.groupBy("node").agg(F.least(F.count("*"), F.lit(most)).cast("bigint").alias("number")), "numbers")
    before = -1
    while True:
        # A clique has r + 1 members, so its list is short; all but the least get the least, and that the second.
        held = members.join(now, "node").groupBy("clique").agg(F.array_sort(F.collect_list(F.struct("number", "node"))).alias("m"))
        least, second = F.col("m")[0]["number"], F.col("m")[1]["number"]
        passed = held.select(F.explode("m").alias("x"), least.alias("least"), second.alias("second"), F.col("m")[0]["node"].alias("low"))
        value = F.when(F.col("x.node") == F.col("low"), F.col("second")).otherwise(F.col("least"))
        counted = passed.select("x.node", value.alias("value")).groupBy("node", "value").agg(F.count("*").alias("n"))
        reach = F.sum("n").over(Window.partitionBy("node").orderBy(F.desc("value")))
        new = counted.select("node", F.least("value", reach).alias("h")).groupBy("node").agg(F.max("h").alias("number"))
        seen = Observation()
        (now, next_path), old = written(new.observe(seen, F.coalesce(F.sum("number"), F.lit(0)).alias("total")), "numbers"), path
        remove(spark, old)
        path, total = next_path, seen.get["total"]
        if before == total:  # values only ever fall
            return now
        before = total


def numbers(g: PropertyGraph, r: int) -> DataFrame:
    """(v0, ..., number) of every clique of r vertices; with r = 1 the core numbers, with r = 2 the truss numbers by triangles."""
    i = incidence(g, r)
    found = i.cliques.join(numbers_of(i), "node", "left")
    return found.select(*i.vertices, F.coalesce("number", F.lit(0)).cast("bigint").alias("number"))


def _joins(whole: DataFrame, number: DataFrame) -> DataFrame:
    """(a, b, w): each s-clique's first member with every other, at the least number of them all."""
    first, *others = whole.columns
    for c in whole.columns:
        whole = whole.join(number.select(F.col("node").alias(c), F.col("number").alias(f"w_{c}")), c)
    w = F.least(*[f"w_{c}" for c in (first, *others)])
    return whole.select(F.col(first).alias("a"), F.explode(F.array(*others)).alias("b"), w.cast("bigint").alias("w"))


def _core_joins(g: PropertyGraph) -> tuple[DataFrame, DataFrame]:
    """Joins (a, b, w) of the edges at the lesser core number of their ends, and (node, n): edges whose end of lesser number is node."""
    links = peeling._links(g)
    core, _ = written(peeling._cores_of(links), "cores")
    at = lambda end: core.select(F.col("id").alias(end), F.col("core").cast("bigint").alias(f"{end}_core"))
    valued, _ = written(links.select("a", F.col("o0").alias("b")).filter("a < b").join(at("a"), "a").join(at("b"), "b"), "core-joins")
    first = F.when(F.col("a_core") <= F.col("b_core"), F.col("a")).otherwise(F.col("b"))
    return valued.select("a", "b", F.least("a_core", "b_core").alias("w")), valued.groupBy(first.alias("node")).agg(F.count("*").alias("n"))


def _forest(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Places of a spanning forest of the joins in which no other join is stronger than the weakest on the path between its ends."""
    ids, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    order = np.argsort(-w, kind="stable")
    x, y = ends[: len(a)][order], ends[len(a) :][order]
    at, root, kept = np.arange(len(a)), np.arange(len(ids)), []
    while True:
        apart = root[x] != root[y]
        x, y, at = root[x[apart]], root[y[apart]], at[apart]
        if not len(x):
            return order[np.concatenate(kept)] if kept else order[:0]
        # Every component takes its first join; as joins are in one order, only two that take the same one meet in a ring.
        first = np.full(len(ids), len(x))
        np.minimum.at(first, x, np.arange(len(x)))
        np.minimum.at(first, y, np.arange(len(x)))
        takes = np.flatnonzero(first < len(x))
        taken = first[takes]
        kept.append(at[np.unique(taken)])
        root = np.arange(len(ids))
        root[takes] = x[taken] + y[taken] - takes
        ring = root[root[takes]] == takes
        low = takes[ring & (takes < root[takes])]
        root[low] = low
        while not np.array_equal(root, further := root[root]):
            root = further


def thinned(joins: DataFrame) -> DataFrame:
    """Joins (a, b, w), written, that have the same components at every level, about as many as nodes.

    Ranges of joins keep a spanning forest of the strongest each; what they keep is dealt
    to fewer ranges while that still drops half.
    """
    spark = joins.sparkSession
    now, path = written(joins.select("a", "b", "w"), "joins")
    n, before = now.count(), math.inf
    while n and 2 * n <= before:
        parts = max(math.ceil(n / PART_JOINS), min(spark.sparkContext.defaultParallelism, math.ceil(n / CHUNK_JOINS)))
        seen = Observation()
        kept = now.repartitionByRange(parts, "a", "b").mapInArrow(_kept, "a bigint, b bigint, w bigint").observe(seen, F.count("*").alias("n"))
        (now, next_path), old = written(kept, "joins"), path
        remove(spark, old)
        path, before, n = next_path, n, seen.get["n"]
    return now


def _kept(batches):
    """A partition's forest; joins are looked at chunk by chunk, so no more is held than a chunk and a forest."""
    held, n = [], 0

    def forest() -> pa.Table:
        a, b, w = (np.concatenate([x.column(c).to_numpy() for x in held]) for c in "abw")
        k = _forest(a, b, w)
        return pa.table({"a": a[k], "b": b[k], "w": w[k]})

    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= CHUNK_JOINS:
            held, n = [forest()], 0
    if held:
        yield from forest().to_batches()


def merges(joins: DataFrame) -> DataFrame:
    """(k, root, child) of joins(a, b, w): at level k the component of least node root takes in that of least node child, or the node itself.

    A component is told at the level where it gains something; root itself is a child too.
    """
    spark = joins.sparkSession
    levels = sorted(r["w"] for r in joins.select("w").distinct().collect())  # one row for each level
    if not levels:
        return spark.createDataFrame([], "k bigint, root bigint, child bigint")
    # A proven bound for the broadcast: one row for each level.
    ranks = spark.createDataFrame(list(enumerate(levels)), "rank bigint, w bigint")
    now, path = written(joins.join(F.broadcast(ranks), "w").select("rank", "a", "b"), "joins")
    depth = (len(levels) - 1).bit_length()
    for d in range(depth):
        low = depth - d - 1
        prefix, upper = F.shiftright("rank", low + 1), F.shiftright("rank", low).bitwiseAND(F.lit(1)) == 1
        roots = components(now.filter(upper).select(prefix.alias("p"), "a", "b"))
        roots, roots_path = written(roots, "roots")
        light = now.filter(~upper).withColumn("p", prefix)
        for end in ("a", "b"):
            of = roots.select("p", F.col("node").alias(end), F.col("root").alias("r"))
            light = light.join(of, ["p", end], "left").withColumn(end, F.coalesce("r", end)).drop("r")
        light = light.filter("a <> b").groupBy("p", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.max("rank").alias("rank"))
        (now, next_path), old = written(now.filter(upper).unionByName(light.select("rank", F.col("x").alias("a"), F.col("y").alias("b"))), "joins"), path
        remove(spark, old)
        remove(spark, roots_path)
        path = next_path
    # What is left of each level joins components of the levels above.
    last = components(now.select(F.col("rank").alias("p"), "a", "b"))
    return last.join(F.broadcast(ranks.withColumnRenamed("rank", "p")), "p").select(F.col("w").alias("k"), "root", F.col("node").alias("child"))


def nuclei(g: PropertyGraph, r: int) -> DataFrame:
    """(id, parent, k, n_vertices, n_edges, density) of every (r, r + 1) nucleus.

    id is ``k:`` and the vertices of the least r-clique, by order; parent is the least
    nucleus around it, null at the roots; density is that of the edges among its vertices
    (r = 1) or of its cliques' edges.
    """
    if r == 1:
        cliques = g.vertices.select(F.col("id").alias("node"), F.col("id").alias("v0"))
        i, (joins, ends) = Incidence(1, cliques, cliques.limit(0)), _core_joins(g)  # numbers come from the edges
    else:
        i = incidence(g, r)
        number, _ = written(numbers_of(i), "numbers")
        joins = _joins(i.whole, number)
    found, _ = written(merges(thinned(joins)), "merges")
    # A child that is a nucleus is the one of that root at the next level above; else it is a clique alone.
    told = found.select("k", "root").distinct()
    events = told.select(F.col("root").alias("child"), "k", F.col("k").alias("own"), F.lit(None).cast("bigint").alias("root")).unionByName(found.select("child", "k", F.lit(None).cast("bigint").alias("own"), "root"))
    # At one level the question comes before the nucleus; a root has as many rows as levels at most.
    above = Window.partitionBy("child").orderBy(F.desc("k"), F.col("own").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    asked, _ = written(events.select("child", "k", "root", "own", F.last("own", True).over(above).alias("child_k")).filter("own is null").drop("own"), "nuclei")
    parents = asked.filter("child_k is not null").select(F.col("child_k").alias("k"), F.col("child").alias("root"), F.col("k").alias("up_k"), F.col("root").alias("up_root"))
    own = asked.filter("child_k is null").select("k", "root", F.col("child").alias("node"))
    within = _ancestors(told, parents)
    inside = own.join(i.cliques, "node").select("k", "root", *i.vertices)
    points = F.explode(F.array(*i.vertices))
    n_vertices = _counted(inside.select("k", "root", points.alias("x")), within, "n_vertices", r > 1)
    if r == 1:
        # An edge belongs where its end of lesser number joins.
        n_edges = _summed(own.join(ends, "node").groupBy("k", "root").agg(F.sum("n").alias("n")), within, "n_edges")
    else:
        sides = [F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for n, a in enumerate(i.vertices) for b in i.vertices[n + 1 :]]
        n_edges = _counted(inside.select("k", "root", F.explode(F.array(*sides)).alias("x")), within, "n_edges", r > 2)
    # Numbers of cliques need not ascend with their vertices, so the least is looked for.
    least = inside.groupBy("k", "root").agg(F.min(F.struct(*i.vertices)).alias("c")).join(within, ["k", "root"]).groupBy(F.col("up_k").alias("k"), F.col("up_root").alias("root")).agg(F.min("c").alias("c"))
    names, _ = written(least.select("k", "root", F.concat_ws("-", *[F.col(f"c.{v}") for v in i.vertices]).alias("name")), "names")
    name = lambda k, n: F.concat(k.cast("string"), F.lit(":"), n)
    out = told.join(n_vertices, ["k", "root"]).join(n_edges, ["k", "root"]).join(parents, ["k", "root"], "left").join(names, ["k", "root"])
    out = out.join(names.select(F.col("k").alias("up_k"), F.col("root").alias("up_root"), F.col("name").alias("up_name")), ["up_k", "up_root"], "left")
    pairs = F.col("n_vertices") * (F.col("n_vertices") - 1)
    return out.select(name(F.col("k"), F.col("name")).alias("id"), name(F.col("up_k"), F.col("up_name")).alias("parent"), "k", "n_vertices", "n_edges", (2 * F.col("n_edges") / pairs).alias("density"))


def _ancestors(told: DataFrame, parents: DataFrame) -> DataFrame:
    """(k, root, up_k, up_root): every nucleus with itself and all around it, by doubling."""
    steps, path = written(parents.select("k", "root", "up_k", "up_root"), "ancestors")
    spark, n = told.sparkSession, -1
    while (size := steps.count()) != n:
        n = size
        further = steps.select("k", "root", F.col("up_k").alias("_k"), F.col("up_root").alias("_root")).join(steps.select(F.col("k").alias("_k"), F.col("root").alias("_root"), "up_k", "up_root"), ["_k", "_root"])
        (steps, next_path), old = written(steps.union(further.select("k", "root", "up_k", "up_root")).distinct(), "ancestors"), path
        remove(spark, old)
        path = next_path
    return steps.union(told.select("k", "root", F.col("k").alias("up_k"), F.col("root").alias("up_root")))


def _counted(own: DataFrame, within: DataFrame, name: str, shared: bool) -> DataFrame:
    """(k, root, count): what a nucleus and those inside it own; ``shared`` where several may own the same."""
    if not shared:
        return _summed(own.groupBy("k", "root").agg(F.count("*").alias("n")), within, name)
    each = own.distinct().join(within, ["k", "root"]).select("up_k", "up_root", "x").distinct()
    return each.groupBy(F.col("up_k").alias("k"), F.col("up_root").alias("root")).agg(F.count("*").alias(name))


def _summed(counts: DataFrame, within: DataFrame, name: str) -> DataFrame:
    """(k, root, sum) of counts(k, root, n) over a nucleus and those inside it."""
    summed: Column = F.sum("n")
    return counts.join(within, ["k", "root"]).groupBy("up_k", "up_root").agg(summed.alias(name)).select(F.col("up_k").alias("k"), F.col("up_root").alias("root"), name)

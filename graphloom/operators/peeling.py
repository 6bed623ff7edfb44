"""Cores, trusses and clique-based nuclei of large graphs, by rounds of DataFrame jobs.

Each round drops what has too little support; rounds go on until nothing is dropped.
The table of a round is written to the shared folder, which keeps plans short.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.operators import rounds
from graphloom.operators.components import components
from graphloom.operators.primitives import Ordered
from graphloom.sources.graphs import PropertyGraph, both_ways
from graphloom.sources.shared import new_path, remove, swept, written

#: Edges of a range of vertices and of a block of ranges, triangles of a task, wedges looked at at once.
PART_EDGES, BLOCK_EDGES, PART_TRIANGLES, WEDGES = 500_000, 2_000_000, 500_000, 2_000_000
#: Ranges from which on vertices go by what they hang together with, and neighbours in copied lists that one job may hold on disk.
LOCAL_PARTS, JOB_COPIES = 8, 200_000_000
#: Numbers that the edges of a range, or the triangles of a task, have for themselves.
PART_NUMBERS = 1 << 32


def _links(g: PropertyGraph) -> DataFrame:
    """(a, o0), written: every edge from both ends."""
    return written(g.edges.select(F.col("src").alias("a"), F.col("dst").alias("o0")), "core-links")[0]


def k_core(g: PropertyGraph, k) -> DataFrame:
    """(id, degree): vertices of the largest subgraph in which all have degree k at least, with their degree there.

    k may be a function of the numbers of links, two for each edge, and of vertices that have any.
    """
    links = _links(g)
    if callable(k):
        with swept(links.sparkSession):
            k = k(*links.groupBy("a").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first())
    keep, _ = written(_cores_of(links, k).filter(F.col("core") >= k).select("id"), "core")
    at = lambda end: keep.select(F.col("id").alias(end))
    return links.join(at("a"), "a", "left_semi").join(at("o0"), "o0", "left_semi").groupBy(F.col("a").alias("id")).agg(F.count("*").alias("degree"))


def core_numbers(g: PropertyGraph) -> DataFrame:
    """(id, core) for every vertex.

    Every vertex starts with its degree and takes, round by round, the h-index of its
    neighbours' values, which settles at the core numbers.  Ranges of vertices settle
    alone and tell each other their values (``rounds``), so a round costs one pass over
    the lists.  Where a vertex has more neighbours than a range should hold, neighbours
    are joined and count by value, so a hub costs no task more than its share.
    """
    now = _cores_of(_links(g))
    return g.vertices.select("id").join(now, "id", "left").select("id", F.coalesce("core", F.lit(0)).cast("bigint").alias("core"))


def _cores_of(links: DataFrame, most: int = rounds.UNKNOWN) -> DataFrame:
    """(id, core) of the vertices that have edges; cores above ``most`` are told as that."""
    if not rounds.too_long(links):
        return rounds.settled(links, rounds.HIndex(most), "cores").select(F.col("node").alias("id"), F.col("value").alias("core"))
    edges = links.select(F.col("a").alias("src"), F.col("o0").alias("dst"))
    start = edges.groupBy(F.col("src").alias("id")).agg(F.least(F.count("*"), F.lit(most)).cast("bigint").alias("core"))
    now, path = written(start, "core-numbers")
    total = now.agg(F.sum("core")).first()[0]
    while total:
        beside = edges.join(now.select(F.col("id").alias("dst"), "core"), "dst").groupBy("src", "core").agg(F.count("*").alias("n"))
        reach = F.sum("n").over(Window.partitionBy("src").orderBy(F.desc("core")))
        new = beside.select("src", F.least("core", reach).alias("h")).groupBy(F.col("src").alias("id")).agg(F.max("h").alias("core"))
        (now, next_path), old = written(new, "core-numbers"), path
        path = next_path
        remove(now.sparkSession, old)
        # Values only ever fall: the same sum means the same values.
        before, total = total, now.agg(F.sum("core")).first()[0]
        if before == total:
            break
    return now


def degeneracy_order(g: PropertyGraph) -> DataFrame:
    """(id, core, layer, position, later): an order in which each vertex has at most ``core`` neighbours after it.

    The vertices of one core number are a shell.  Within its shell a vertex goes in the
    first layer after whose predecessors no more than ``core`` of its neighbours are
    left, those of higher shells counted: with x neighbours too many in its shell, the
    layer after the x-th least of theirs.  All shells settle at once, by ranges of
    vertices (``rounds``), from edges within shells alone.  Positions, from 1 on, follow
    core number, layer and id; ``later`` counts the neighbours after a vertex.
    """
    spark = g.vertices.sparkSession
    # Edges are made once, and joins take them in one direction: what is said of an edge is said of both ends.
    one, _ = written(g.once().select("src", "dst"), "edges-once")
    g = PropertyGraph(g.vertices, both_ways(one), one=one)
    cores, _ = written(core_numbers(g), "cores")
    at = lambda end: cores.select(F.col("id").alias(end), F.col("core").alias(f"{end}_core"))
    edges, edges_path = written(one.join(at("src"), "src").join(at("dst"), "dst"), "shell-edges")
    lower = F.when(F.col("src_core") < F.col("dst_core"), F.col("src")).otherwise(F.col("dst"))
    above = edges.filter("src_core <> dst_core").groupBy(lower.alias("id")).agg(F.count("*").alias("above"))
    left, path = written(cores.join(above, "id", "left").select("id", "core", F.coalesce("above", F.lit(0)).alias("above")), "shell-left")
    inner, inner_path = written(both_ways(edges.filter("src_core = dst_core").select("src", "dst")), "shell-inner")
    remove(spark, edges_path)
    beside = inner.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("beside"))
    # So many neighbours within its shell go before a vertex.
    told = left.join(beside, "id", "left").withColumn("x", F.col("above") + F.coalesce("beside", F.lit(0)) - F.col("core"))
    told, _ = written(told.select("id", "core", "x"), "shell-told")
    links, _ = written(inner.select(F.col("src").alias("a"), F.col("dst").alias("o0")).join(told.select(F.col("id").alias("a"), "x"), "a"), "shell-links")
    if not told.head(1):
        return cores.select("id", "core", *[F.lit(0).cast("bigint").alias(c) for c in ("layer", "position", "later")])
    if rounds.too_long(links):
        layers = _peeled_layers(left, path, inner, inner_path)
    else:
        found = rounds.settled(links, rounds.Layer(), "layers").select(F.col("node").alias("id"), F.col("value").alias("layer"))
        layers = told.join(found, "id", "left").select("id", "core", F.coalesce("layer", F.lit(1)).cast("bigint").alias("layer"))
    placed = Ordered(layers, "core", "layer", "id").position("position")
    placed, _ = written(placed, "degeneracy")
    end = lambda c: placed.select(F.col("id").alias(c), F.col("position").alias(f"{c}_at"))
    first = F.when(F.col("src_at") < F.col("dst_at"), F.col("src")).otherwise(F.col("dst"))
    later = one.join(end("src"), "src").join(end("dst"), "dst").groupBy(first.alias("id")).agg(F.count("*").alias("later"))
    return placed.join(later, "id", "left").select("id", "core", "layer", "position", F.coalesce("later", F.lit(0)).cast("bigint").alias("later"))


def _peeled_layers(left: DataFrame, path: str, inner: DataFrame, inner_path: str) -> DataFrame:
    """(id, core, layer) by peeling layer after layer, for shells with vertices of very many neighbours."""
    spark = left.sparkSession
    base, layer = new_path(spark, "shell-layers"), 0
    while left.head(1):
        layer += 1
        beside = inner.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("beside"))
        told = left.join(beside, "id", "left").withColumn("goes", F.col("above") + F.coalesce("beside", F.lit(0)) <= F.col("core"))
        told, told_path = written(told, "shell-told")
        told.filter("goes").select("id", "core").write.parquet(f"{base}/layer={layer}")
        stay = told.filter(~F.col("goes")).select("id", "core", "above")
        ids = stay.select(F.col("id").alias("src"))
        (left, next_path), (inner, next_inner) = written(stay, "shell-left"), written(inner.join(ids, "src", "left_semi").join(ids.withColumnRenamed("src", "dst"), "dst", "left_semi").select("src", "dst"), "shell-inner")
        for old in (path, inner_path, told_path):
            remove(spark, old)
        path, inner_path = next_path, next_inner
    return spark.read.schema("id bigint, core bigint, layer bigint").parquet(base)


def oriented(edges: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """(a, b), written: each edge once, from the end of smaller degree, so that no vertex has many successors.

    The edges may be given in one direction (src < dst) or both.  With an order (id,
    position, later), as ``degeneracy_order`` gives it, edges go from the earlier end
    instead if the wedges of successors are fewer so.
    """
    return _oriented(edges, order)[0]


def _oriented(edges: DataFrame, order: DataFrame | None) -> tuple[DataFrame, str]:
    """The same with the table's path, for ``remove``."""
    spark = edges.sparkSession
    # One direction is enough to start from; it is written once, as three reads follow.
    one, path = written(edges.select("src", "dst").filter("src < dst"), "one-way")
    ends = one.select(F.col("src").alias("v")).union(one.select(F.col("dst").alias("v")))
    degree, degree_path = written(ends.groupBy("v").agg(F.count("*").alias("d")), "degrees")
    at = lambda of, end, v, d: of.select(F.col(v).alias(end), F.col(d).alias("ds" if end == "src" else "dd"))

    def from_first(of: DataFrame, v: str, d: str) -> tuple[DataFrame, str]:
        both = one.join(at(of, "src", v, d), "src").join(at(of, "dst", v, d), "dst")
        first = F.col("ds") <= F.col("dd")  # ties go by id, and src is the lesser
        return written(both.select(F.when(first, F.col("src")).otherwise(F.col("dst")).alias("a"), F.when(first, F.col("dst")).otherwise(F.col("src")).alias("b")), "oriented")

    out, out_path = from_first(degree, "v", "d")
    if order is not None:
        wedges = lambda n: F.coalesce(F.sum(F.col(n).cast("double") * (F.col(n) - 1)), F.lit(0.0))
        if order.agg(wedges("later")).first()[0] < out.groupBy("a").agg(F.count("*").alias("n")).agg(wedges("n")).first()[0]:
            remove(spark, out_path)
            out, out_path = from_first(order, "id", "position")
    for old in (path, degree_path):
        remove(spark, old)
    return out, out_path


def _lists(e: DataFrame) -> DataFrame:
    """(a, bs, first, part, block), written: the successors of each vertex in order, in ranges of vertices; a block is some parts side by side.

    An edge's number is ``first`` of its list and its place there.  In large graphs
    vertices go by what they hang together with before they go by id, so that few ranges
    know a vertex also where the ids of far vertices lie among each other.
    """
    spark = e.sparkSession
    n = e.count()
    parts = max(spark.sparkContext.defaultParallelism, math.ceil(n / PART_EDGES))
    lists, path = written(e.groupBy("a").agg(F.sort_array(F.collect_list("b")).alias("bs")), "lists")
    placed, by = lists, ["a"]
    if n > LOCAL_PARTS * PART_EDGES:
        # Two edges of a vertex tell enough; this is an order only, whatever its components miss.
        near = lists.select(F.lit(0).alias("p"), "a", F.explode(F.array(F.element_at("bs", 1), F.element_at("bs", -1))).alias("b"))
        roots = components(near).select(F.col("node").alias("a"), "root")
        placed, by = lists.join(roots, "a", "left"), ["root", "a"]
    ranged = placed.repartitionByRange(parts, *by).sortWithinPartitions(*by).select("a", "bs", F.spark_partition_id().alias("part"))
    ranged = ranged.mapInArrow(_counted, "a bigint, bs array<bigint>, part int, first bigint")
    out, _ = written(ranged.withColumn("block", F.floor(F.col("part") * F.lit(math.ceil(n / BLOCK_EDGES)) / parts).cast("int")), "ranged-lists")
    remove(spark, path)
    return out


def _counted(batches):
    """Lists with the number of their first edge: that of their part, and of the edges before it there."""
    upto = 0
    for batch in batches:
        n = pc.list_value_length(batch.column("bs")).to_numpy(zero_copy_only=False).astype(np.int64)
        first = batch.column("part").to_numpy().astype(np.int64) * PART_NUMBERS + upto + np.cumsum(n) - n
        upto += int(n.sum())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first)], [*batch.schema.names, "first"])


def numbered_edges(lists: DataFrame) -> DataFrame:
    """(node, a, b): the edges of lists with their numbers."""
    return lists.select("a", "first", F.posexplode("bs").alias("k", "b")).select((F.col("first") + F.col("k")).alias("node"), "a", "b")


def triangles(edges: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """(x, y, z): every triangle once, in the order of the orientation."""
    return _triangles(edges, order, "rows")


def _triangles(edges: DataFrame, order: DataFrame | None, what: str) -> DataFrame:
    """Triangles (x, y, z), or by ``what`` their numbers ("count")."""
    e, path = _oriented(edges, order)
    lists = _lists(e)
    remove(edges.sparkSession, path)
    return triangles_of(lists, what)


#: What is told of triangles: rows, the numbers of their edges (x, y), (x, z) and (y, z), or how many there are.
KINDS = {"rows": "x bigint, y bigint, z bigint", "edges": "n0 bigint, n1 bigint, n2 bigint", "count": "n bigint"}


def triangles_of(lists: DataFrame, what: str) -> DataFrame:
    """Triangles of the written lists: rows, edges or count, as KINDS says.

    Vertices are cut in ranges.  The lists of a range's vertices meet those of their
    successors, one block of these at a time, each list copied once for every range that
    has it as a successor's; wedges are made and closed there and never leave a task.
    Where so many ranges know a vertex that the copies would hold more than the wedges,
    these are joined.  Where copies are many, ranges go in several jobs, so that no more
    of them are on disk at once than one job's.
    """
    spark = lists.sparkSession
    starts = lists.select(F.col("a").alias("y"), "block", F.size("bs").cast("bigint").alias("size"))
    met = lists.select("part", F.explode("bs").alias("y")).groupBy("part", "y").agg(F.count("*").alias("times")).join(starts, "y")
    met, met_path = written(met.select("part", "block", "y", "size", "times"), "met-lists")
    cells, _ = written(met.groupBy("part", "block").agg(F.sum("size").alias("copied"), F.sum(F.col("size") * F.col("times")).alias("wedges")), "cells")
    sizes = lists.groupBy("part").agg(F.sum(F.size("bs")).alias("own"))
    costs = cells.join(sizes, "part").groupBy("part").agg(F.sum(F.col("copied") + F.col("own")).alias("copied"), F.sum("wedges").alias("wedges")).orderBy("part").collect()  # one row for each range
    if sum(r["copied"] for r in costs) > sum(r["wedges"] for r in costs):
        remove(spark, met_path)
        return _joined_wedges(numbered_edges(lists), what)

    def found(own: DataFrame, cells: DataFrame, met: DataFrame) -> DataFrame:
        own = own.select("part", "a", "bs", "first").join(cells.select("part", "block"), "part").select("part", "block", "a", "bs", "first")
        far = lists.select(F.col("a").alias("y"), F.col("bs").alias("zs"), F.col("first").alias("far"))
        beside = met.select(F.col("part").alias("part"), F.col("block").alias("block"), "y").join(far, "y").select("part", "block", "y", "zs", "far")
        cogroup = own.groupBy("part", "block").cogroup(beside.groupBy("part", "block"))
        if what == "count":
            return cogroup.applyInArrow(lambda x, y: pa.table({"n": pa.array([sum(len(b[0]) for b in _closed(x, y, what))], pa.int64())}), KINDS[what])
        names = [c.split()[0] for c in KINDS[what].split(", ")]
        return cogroup.applyInArrow(lambda x, y: _table(_closed(x, y, what), names), KINDS[what])

    jobs, upto = [[]], 0
    for r in costs:
        if jobs[-1] and upto + r["copied"] > JOB_COPIES:
            jobs.append([])
            upto = 0
        jobs[-1].append(r["part"])
        upto += r["copied"]
    if len(jobs) == 1:
        return found(lists, cells, met)
    paths = []
    for parts in jobs:
        inside = F.col("part").between(parts[0], parts[-1])
        paths.append(written(found(lists.filter(inside), cells.filter(inside), met.filter(inside)), "closed")[1])
    remove(spark, met_path)
    return spark.read.schema(KINDS[what]).parquet(*paths)


def _joined_wedges(e: DataFrame, what: str) -> DataFrame:
    """The same from the numbered edges, by joins."""
    at = lambda a, b, n: e.select(F.col("a").alias(a), F.col("b").alias(b), F.col("node").alias(n))
    whole = at("x", "y", "n0").join(at("x", "z", "n1"), "x").join(at("y", "z", "n2"), ["y", "z"])
    return whole.agg(F.count("*").alias("n")) if what == "count" else whole.select(*[c.split()[0] for c in KINDS[what].split(", ")])


def _table(blocks, names) -> pa.Table:
    """Blocks of columns as one table."""
    blocks = list(blocks)
    return pa.table({n: pa.array(np.concatenate([b[k] for b in blocks]) if blocks else np.zeros(0, np.int64), pa.int64()) for k, n in enumerate(names)})


def _flat(table: pa.Table):
    """Vertices in order, the length of each one's list, the lists one after another, and the numbers of their edges."""
    table = table.select(table.column_names[-3:]).rename_columns(["a", "bs", "first"]).sort_by("a").combine_chunks()
    bs = table.column("bs").combine_chunks()
    n = pc.list_value_length(bs).to_numpy(zero_copy_only=False).astype(np.int64)
    return table.column("a").to_numpy(), n, pc.list_flatten(bs).to_numpy(zero_copy_only=False), _spread(table.column("first").to_numpy(), n)


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[k], first[k] + 1, ... n[k] numbers for each k, one after another."""
    return np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)


def _cuts(n: np.ndarray):
    """Ranges (from, to) of the numbers with a sum of about WEDGES at most."""
    ends, at = np.cumsum(n), 0
    while at < len(n):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + WEDGES, "right")))
        yield at, upto
        at = upto


def _closed(own: pa.Table, beside: pa.Table, what: str):
    """Blocks (x, y, z), or of the numbers of their edges: x and its list are of own, y and its list of beside, y and z in x's list, z in y's."""
    if not len(own) or not len(beside):
        return
    (xs, n_x, ends, number), (ys, n_y, far, far_number) = _flat(own), _flat(beside)
    known = np.unique(ends)
    # Only those ends of y that some x has can close a wedge.
    at = np.minimum(np.searchsorted(known, far), len(known) - 1)
    stays = known[at] == far
    row = np.repeat(np.arange(len(ys)), n_y)[stays]
    at, first, far_number = at[stays], np.searchsorted(row, np.arange(len(ys) + 1)), far_number[stays]
    x = np.repeat(np.arange(len(xs)), n_x)
    codes = x * len(known) + np.searchsorted(known, ends)  # ascending, as x and each list are
    y = np.minimum(np.searchsorted(ys, ends), len(ys) - 1)
    base = np.flatnonzero(ys[y] == ends)
    x, y = x[base], y[base]
    n = first[y + 1] - first[y]
    for a, b in _cuts(n):
        last = _spread(first[y[a:b]], n[a:b])
        of = np.repeat(np.arange(a, b), n[a:b])
        code = x[of] * len(known) + at[last]
        third = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
        closes = codes[third] == code
        of, last, third = of[closes], last[closes], third[closes]
        if what == "edges":
            yield number[base[of]], number[third], far_number[last]
        else:
            yield xs[x[of]], ys[y[of]], known[at[last]]


def four_cliques(edges: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """(x, y, z, w): every clique of four vertices once."""
    return _four_cliques(edges, order, rows=True)


def _four_cliques(edges: DataFrame, order: DataFrame | None, rows: bool) -> DataFrame:
    return cliques_of(written(triangles(edges, order), "triangles")[0], rows)


def _dealt(t: DataFrame) -> DataFrame:
    """Triangles with the task (part) that all of a vertex x meet in, many vertices in each."""
    parts = max(t.sparkSession.sparkContext.defaultParallelism, math.ceil(t.count() / PART_TRIANGLES))
    return t.withColumn("part", F.pmod(F.xxhash64("x"), F.lit(parts)).cast("int"))


def cliques_of(t: DataFrame, rows: bool = True) -> DataFrame:
    """Cliques of four vertices, or with rows=False their numbers (n), from all triangles, written.

    The triangles of a vertex are edges among its successors, and the triangles of these
    are its cliques, so all triangles of a vertex meet in one task, many vertices in each.
    """
    dealt = _dealt(t).groupBy("part")
    if rows:
        return dealt.applyInArrow(lambda x: _table((b[:4] for b in _cliques(x)), "xyzw"), "x bigint, y bigint, z bigint, w bigint")
    return dealt.applyInArrow(lambda x: pa.table({"n": pa.array([sum(len(b[0]) for b in _cliques(x))], pa.int64())}), "n bigint")


def numbered_cliques(t: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Triangles (node, x, y, z), written, and of each clique of four vertices the nodes (n0, n1, n2, n3) of its triangles.

    Three of these begin with the clique's first vertex and are known where it is found;
    the fourth is looked up.
    """
    spark = t.sparkSession
    found = _dealt(t).groupBy("part").applyInArrow(_numbered, "part int, node bigint, x bigint, y bigint, z bigint")
    nodes, _ = written(found, "numbered-triangles")
    inside = nodes.groupBy("part").applyInArrow(lambda x: _table((b[1:] for b in _cliques(x)), ["x", "y", "z", "n0", "n1", "n2"]), "x bigint, y bigint, z bigint, n0 bigint, n1 bigint, n2 bigint")
    inside, path = written(inside, "inner-cliques")
    nodes = nodes.select("node", "x", "y", "z")
    whole, _ = written(inside.join(nodes.withColumnRenamed("node", "n3"), ["x", "y", "z"]).select("n0", "n1", "n2", "n3"), "s-cliques")
    remove(spark, path)
    return nodes, whole


def _numbered(t: pa.Table) -> pa.Table:
    """Triangles of a task with their numbers, in order."""
    t = t.sort_by([(c, "ascending") for c in "xyz"])
    part = t.column("part").to_numpy()
    return pa.table({"part": part, "node": part.astype(np.int64) * PART_NUMBERS + np.arange(len(t)), **{c: t.column(c) for c in "xyz"}})


def _cliques(t: pa.Table):
    """Blocks (x, y, z, w) of triangles (x, y, z), and the nodes of xyz, xzw and xyw where these have any."""
    x, y, z = (t.column(c).to_numpy() for c in "xyz")
    if not len(x):
        return
    ids, at = np.unique(np.concatenate([x, y, z]), return_inverse=True)
    x, y, z = np.split(at, 3)
    # A vertex y beside x is one number; its list holds the numbers of the z beside the same x.
    pairs, pair = np.unique(np.concatenate([x * len(ids) + y, x * len(ids) + z]), return_inverse=True)
    codes = pair[: len(x)] * len(pairs) + pair[len(x) :]
    order = np.argsort(codes)
    codes = codes[order]
    node = [t.column("node").to_numpy()[order]] if "node" in t.column_names else []
    a, b = codes // len(pairs), codes % len(pairs)
    first = np.searchsorted(a, np.arange(len(pairs) + 1))
    n = first[b + 1] - first[b]
    for i, j in _cuts(n):
        last = _spread(first[b[i:j]], n[i:j])
        of = np.repeat(np.arange(i, j), n[i:j])
        code = a[of] * len(pairs) + b[last]
        third = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
        closes = codes[third] == code
        of, last, third = of[closes], last[closes], third[closes]
        x, y, z, w = pairs[a[of]] // len(ids), pairs[a[of]] % len(ids), pairs[b[of]] % len(ids), pairs[b[last]] % len(ids)
        yield ids[x], ids[y], ids[z], ids[w], *(m for k in node for m in (k[of], k[last], k[third]))


def triangle_count(g: PropertyGraph) -> DataFrame:
    return _triangles(g.once(), None, "count").agg(F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("triangles"))


def four_clique_count(g: PropertyGraph) -> DataFrame:
    return _four_cliques(g.once(), None, rows=False).agg(F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("cliques"))


def k_truss(g: PropertyGraph, k) -> DataFrame:
    """(a, b): edges (a < b) of the largest subgraph in which each lies in at least k - 2 triangles.

    k may be a function of the numbers of triangles and of edges, which are counted on the way.
    """
    from graphloom.operators import hierarchy  # it builds on this module

    if not callable(k) and k <= 2:
        return g.once().select(F.col("src").alias("a"), F.col("dst").alias("b"))
    i = hierarchy.incidence(g, 2)
    if callable(k):
        k = k(i.whole.count(), i.cliques.count())
    if k > 2:
        held = hierarchy.numbers_of(i, k - 2).filter(F.col("number") >= k - 2)
        return i.cliques.join(held, "node", "left_semi").select(F.col("v0").alias("a"), F.col("v1").alias("b"))
    return i.cliques.select(F.col("v0").alias("a"), F.col("v1").alias("b"))


def nucleus34(g: PropertyGraph, k) -> DataFrame:
    """(x, y, z): triangles (x < y < z) of the largest set in which each lies in at least k four-cliques of the set.

    k may be a function of the numbers of four-cliques and of triangles, which are counted on the way.
    """
    from graphloom.operators import hierarchy  # it builds on this module

    i = hierarchy.incidence(g, 3)
    if callable(k):
        k = k(i.whole.count(), i.cliques.count())
    number = hierarchy.numbers_of(i, k).filter(F.col("number") >= k)
    return i.cliques.join(number, "node", "left_semi").select(*[F.col(v).alias(n) for v, n in zip(i.vertices, "xyz", strict=True)])

"""Candidate vertices and candidate edges of a pattern in a graph.

Relevant edges are cut down in three steps: by the labels of their ends, by the
neighbour labels that a pattern vertex needs, and by a semi-join reduction: an image
must have a candidate beside it for every edge of its pattern vertex.  The reduction
has a closed form, so one aggregation and two semi-joins do a whole round.

For matching, vertices that are out are written, not those that are in: where nearly all
stay, that table is small, so Spark broadcasts it and no edge is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.graph_stats import neighbour_labels
from graphloom.plans.pattern import Pattern
from graphloom.plans.planner import Stats
from graphloom.sources.graphs import PropertyGraph
from graphloom.sources.shared import remove, written


def relevant_edges(g: PropertyGraph, pattern: Pattern) -> DataFrame:
    """Edges whose end labels occur as the ends of a pattern edge."""
    pairs = sorted({(pattern.labels[u], pattern.labels[w]) for _, u, w in pattern.directed()})
    holds = F.lit(False)
    for a, b in pairs:
        holds = holds | ((F.col("ls") == a) & (F.col("ld") == b))
    return g.labelled_edges().filter(holds)


def candidates(g: PropertyGraph, pattern: Pattern) -> DataFrame:
    """cand(u, v): vertices with the label of u and the neighbour labels it needs.

    A relational division: of the needs of u, all must be met.
    """
    spark = g.vertices.sparkSession
    if not pattern.edges:
        return g.vertices.filter(F.col("label") == pattern.labels[0]).select(F.lit(0).alias("u"), F.col("id").alias("v"))
    # At most one row for each directed pattern edge: a proven bound for the broadcast.
    needs = spark.createDataFrame(pattern.label_needs(), "u int, ls bigint, ld bigint, need bigint")
    count = {u: 0 for u in range(len(pattern))}
    for u, *_ in pattern.label_needs():
        count[u] += 1
    met = neighbour_labels(relevant_edges(g, pattern)).join(F.broadcast(needs), ["ls", "ld"]).filter("n >= need")
    full = F.create_map(*[F.lit(x) for u, k in count.items() for x in (u, k)])
    return met.groupBy("u", "src").agg(F.count("*").alias("k")).filter(F.col("k") == full[F.col("u")]).select("u", F.col("src").alias("v"))


def candidate_counts(cand: DataFrame) -> DataFrame:
    """(u, n): candidates of each pattern vertex that has any."""
    return cand.groupBy("u").agg(F.count("*").alias("n"))


def candidate_edges(g: PropertyGraph, pattern: Pattern, cand: DataFrame | None = None) -> DataFrame:
    """ecand(qe, u, w, src, dst): edges between candidates, for every directed pattern edge."""
    cand = candidates(g, pattern) if cand is None else cand
    rows = [(k, u, w, pattern.labels[u], pattern.labels[w]) for k, u, w in pattern.directed()]
    q = g.vertices.sparkSession.createDataFrame(rows, "qe int, u int, w int, ls bigint, ld bigint")
    e = relevant_edges(g, pattern).join(F.broadcast(q), ["ls", "ld"]).select("qe", "u", "w", "src", "dst")
    return _between(e, cand)


def _between(e: DataFrame, cand: DataFrame) -> DataFrame:
    left = cand.select("u", F.col("v").alias("src"))
    right = cand.select(F.col("u").alias("w"), F.col("v").alias("dst"))
    return e.join(left, ["u", "src"], "left_semi").join(right, ["w", "dst"], "left_semi").select("qe", "u", "w", "src", "dst")


def refined(ecand: DataFrame, pattern: Pattern, rounds: int = 1) -> DataFrame:
    """Candidate edges whose ends have a candidate beside them for every pattern edge."""
    degree = F.create_map(*[F.lit(x) for u in range(len(pattern)) for x in (u, pattern.degree(u))])
    for _ in range(rounds):
        held = ecand.select("u", "src", "qe").distinct().groupBy("u", "src").agg(F.count("*").alias("k"))
        ecand = _between(ecand, held.filter(F.col("k") == degree[F.col("u")]).select("u", F.col("src").alias("v")))
    return ecand


def matching_edges(g: PropertyGraph, pattern: Pattern, refine_rounds: int = 0) -> DataFrame:
    """ecand(qe, u, w, src, dst), written in folders by qe: the rows of ``candidate_edges``, refined so many times, of pattern edges with u < w alone."""
    spark = g.vertices.sparkSession
    one = sorted(pattern.edges)
    e = relevant_edges(g, pattern)
    # At most one row for each directed pattern edge: a proven bound for the broadcasts.
    needs = F.broadcast(spark.createDataFrame(pattern.label_needs(), "u int, ls bigint, ld bigint, need bigint"))
    q = F.broadcast(spark.createDataFrame([(k, u, w, pattern.labels[u], pattern.labels[w]) for k, (u, w) in enumerate(one)], "qe int, u int, w int, ls bigint, ld bigint"))
    # Every vertex with an edge of a needed label pair has a row for each need; the counts are those of its relevant edges.
    met = neighbour_labels(e).join(needs, ["ls", "ld"]).groupBy("u", "src").agg(F.count_if(F.col("n") >= F.col("need")).alias("k"))
    count = {u: sum(x[0] == u for x in pattern.label_needs()) for u in range(len(pattern))}
    full = F.create_map(*[F.lit(x) for u, k in count.items() for x in (u, k)])
    out, out_path = written(met.filter(F.col("k") < full[F.col("u")]).select("u", F.col("src").alias("v")), "out")
    ecand, path = written(_without(e.join(q, ["ls", "ld"]).select("qe", "u", "w", "src", "dst"), out), "candidate-edges", "qe")
    remove(spark, out_path)
    degree = F.create_map(*[F.lit(x) for u in range(len(pattern)) for x in (u, pattern.degree(u))])
    for _ in range(refine_rounds):
        ends = ecand.select("u", F.col("src").alias("v"), "qe").union(ecand.select("w", "dst", "qe"))
        held = ends.groupBy("u", "v").agg(sum((F.max((F.col("qe") == k).cast("int")) for k in range(len(one))), F.lit(0)).alias("k"))
        out, out_path = written(held.filter(F.col("k") < degree[F.col("u")]).select("u", "v"), "out")
        if not out.head(1):
            remove(spark, out_path)
            break
        (ecand, next_path), old = written(_without(ecand, out), "candidate-edges", "qe"), path
        for done in (old, out_path):
            remove(spark, done)
        path = next_path
    return ecand


def _without(e: DataFrame, out: DataFrame) -> DataFrame:
    """Edges of which neither end is out(u, v)."""
    left = out.select("u", F.col("v").alias("src"))
    right = out.select(F.col("u").alias("w"), F.col("v").alias("dst"))
    return e.join(left, ["u", "src"], "left_anti").join(right, ["w", "dst"], "left_anti").select("qe", "u", "w", "src", "dst")


def first_candidates(ecand: DataFrame, u: int) -> DataFrame:
    """Images of u with which matching may start: they have a candidate on every edge of u."""
    return ecand.filter(F.col("u") == u).groupBy("src").agg(F.countDistinct("qe").alias("k"), F.first("u").alias("u")).select(F.col("src").alias("v"), "k")


def candidate_stats(ecand: DataFrame) -> DataFrame:
    """stats(qe, u, w, n_keys, n_pairs)."""
    return ecand.groupBy("qe", "u", "w").agg(F.countDistinct("src").alias("n_keys"), F.count("*").alias("n_pairs"))


def collected_stats(ecand: DataFrame) -> Stats:
    """About the same on the driver, for both directions of the edges of ``matching_edges``: one row for each pattern edge."""
    out = Stats()
    sizes = ecand.groupBy("u", "w").agg(F.count("*").alias("n"), F.approx_count_distinct("src").alias("s"), F.approx_count_distinct("dst").alias("d"))
    for r in sizes.collect():
        out.keys[r["u"], r["w"]], out.keys[r["w"], r["u"]] = r["s"], r["d"]
        out.pairs[r["u"], r["w"]] = out.pairs[r["w"], r["u"]] = r["n"]
    return out

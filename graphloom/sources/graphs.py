"""Labelled undirected graphs as DataFrames."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.sources.shared import remove, swept, written

#: Ids of the trade graph are label * SPAN + key.
SPAN = 1_000_000_000
MOST_ID = 4_294_967_295
#: Rows of a shuffle partition, on average: a join of distinct rows holds them up to four times, hashed and sorted, on top of each other.
PARTITION_ROWS = 250_000
#: Pairs that an item is in, as far as partitions are reckoned from items.
PAIRS = 3


@dataclass(frozen=True)
class PropertyGraph:
    """vertices(id, label) and edges(src, dst): symmetric, distinct, without loops.

    ``labelled``, where the source knows it, has (src, dst, ls, ld) and spares two joins;
    ``one`` has each edge once, from its lesser end, and spares making both directions.
    """

    vertices: DataFrame
    edges: DataFrame
    labelled: DataFrame | None = None
    one: DataFrame | None = None

    def once(self) -> DataFrame:
        """(src, dst): each edge once, src < dst."""
        return self.edges.filter("src < dst") if self.one is None else self.one

    def labelled_edges(self) -> DataFrame:
        if self.labelled is not None:
            return self.labelled
        v = self.vertices
        return self.edges.join(v.select(F.col("id").alias("src"), F.col("label").alias("ls")), "src").join(v.select(F.col("id").alias("dst"), F.col("label").alias("ld")), "dst").select("src", "dst", "ls", "ld")

    def labelled_by_steps(self) -> DataFrame:
        """The same, written: each edge gets its labels once, and what a join has shuffled goes before the next begins."""
        now, path = written(self.once(), "edges-once")
        for end, name in (("src", "ls"), ("dst", "ld")):
            (now, next_path), old = written(now.join(self.vertices.select(F.col("id").alias(end), F.col("label").alias(name)), end), "labelled-edges"), path
            remove(now.sparkSession, old)
            path = next_path
        return turned_too(now.select("src", "dst", "ls", "ld"))


def spread(df: DataFrame, n: int, *by: str) -> DataFrame:
    """df, of about n rows, in more partitions by the columns where Spark may give each more than PARTITION_ROWS.

    It puts small partitions together until about as many as cores are left, but none of a given number.
    """
    spark = df.sparkSession
    parts = math.ceil(n / PARTITION_ROWS)
    least = min(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(parts, *by) if parts > least else df


def once(pairs: DataFrame, n: int = 0) -> DataFrame:
    """(src, dst) from the lesser end, of which there are about n rows, without loops, nulls or repetitions."""
    return spread(pairs.filter("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")), n, "src", "dst").distinct()


def turned_too(labelled: DataFrame) -> DataFrame:
    """(src, dst, ls, ld) in both directions."""
    return labelled.union(labelled.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("ld").alias("ls"), F.col("ls").alias("ld")))


def both_ways(one: DataFrame) -> DataFrame:
    return one.union(one.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def symmetric(pairs: DataFrame, n: int = 0) -> DataFrame:
    """Both directions of (src, dst), of which there are about n rows, without loops, nulls or repetitions."""
    return both_ways(once(pairs, n))


def from_tables(vertices: DataFrame, edges: DataFrame, n: int = 0) -> PropertyGraph:
    """A graph of vertices(id, label) and edges(src, dst) in either direction, about n of these where that is known; null ids are left out."""
    v = vertices.select(F.col("id").cast("bigint").alias("id"), F.col("label").cast("bigint").alias("label")).filter("id is not null and label is not null").dropDuplicates(["id"])
    e = edges.select(F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst"))
    one = once(e, n)
    return PropertyGraph(v, both_ways(one), one=one)


def from_text(spark: SparkSession, path: str, strict: bool = False) -> PropertyGraph:
    """Reads records ``t N M``, ``v id label degree`` and ``e a b``, in any order.

    Repeated edges and loops are dropped and degrees are computed anew.  strict
    raises ValueError for them, for declared degrees or sizes that differ, for edges to
    missing vertices and for ids beyond 32 bits.
    """
    tokens = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("t")).filter("size(t) >= 3")
    field = lambda k: F.get("t", F.lit(k)).try_cast("bigint")
    v = tokens.filter("t[0] = 'v'").select(field(1).alias("id"), field(2).alias("label"), field(3).alias("degree"))
    e = tokens.filter("t[0] = 'e'").select(field(1).alias("src"), field(2).alias("dst"))
    graph = from_tables(v, e, spark.read.text(path).count())
    if strict:
        head = tokens.filter("t[0] = 't'").select(field(1).alias("n"), field(2).alias("m")).first()
        found = v.agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.max("id").alias("top"), F.sum(F.col("label").isNull().cast("int")).alias("odd")).first()
        n_edges = e.count()
        degree = graph.edges.groupBy("src").count()
        wrong = v.join(degree, v["id"] == degree["src"], "left").filter(F.coalesce("count", F.lit(0)) != F.coalesce("degree", F.lit(-1))).count()
        missing = graph.edges.join(v, F.col("src") == F.col("id"), "left_anti").count()
        for bad, what in (
            (found["n"] != found["ids"], "repeated or missing vertex ids"),
            (found["odd"], "vertices without label"),
            ((found["top"] or 0) > MOST_ID, "ids beyond 32 bits"),
            (graph.edges.count() != 2 * n_edges, "loops or repeated edges"),
            (missing, "edges to missing vertices"),
            (wrong, "degrees that differ from the edges"),
            (head is not None and (head["n"], head["m"]) != (found["n"], n_edges), "sizes that differ from the first line"),
        ):
            if bad:
                raise ValueError(f"{path}: {what}")
    return graph


def write_text(graph: PropertyGraph, path: str) -> None:
    """Writes the records that ``from_text`` reads; each part file, compressed so that it can be read, holds some of them."""
    degree = graph.edges.groupBy("src").agg(F.count("*").alias("d"))
    v = graph.vertices.join(degree, F.col("id") == F.col("src"), "left").select(F.concat_ws(" ", F.lit("v"), "id", "label", F.coalesce("d", F.lit(0))).alias("value"))
    e = graph.edges.filter("src < dst").select(F.concat_ws(" ", F.lit("e"), "src", "dst").alias("value"))
    sizes = graph.vertices.agg(F.count("*").alias("n")).crossJoin(graph.edges.agg((F.count("*") / 2).cast("bigint").alias("m")))  # one row each
    lines = sizes.select(F.concat_ws(" ", F.lit("t"), "n", "m").alias("value")).union(v).union(e)
    with swept(graph.vertices.sparkSession):
        lines.write.option("compression", "gzip").text(path)


def from_parquet(spark: SparkSession, vertices: str, edges: str) -> PropertyGraph:
    return from_tables(spark.read.parquet(vertices), spark.read.parquet(edges))


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trade_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Regions (0), nations (1), customers (2), suppliers (3), orders (4) and parts (5) of the star schema."""
    t = lambda name: _read(spark, sf_dir, name)
    node = lambda df, key, label: df.select((F.col(key).cast("bigint") + label * SPAN).alias("id"), F.lit(label).cast("bigint").alias("label"))
    vertices = node(t("region"), "r_regionkey", 0)
    for name, key, label in (("nation", "n_nationkey", 1), ("customer", "c_custkey", 2), ("supplier", "s_suppkey", 3), ("orders", "o_orderkey", 4), ("part", "p_partkey", 5)):
        vertices = vertices.union(node(t(name), key, label))
    labelled = None
    items = t("lineitem")
    n_items = items.count()
    for df, a, la, b, lb, unique in (
        (t("nation"), "n_nationkey", 1, "n_regionkey", 0, True),
        (t("customer"), "c_custkey", 2, "c_nationkey", 1, True),
        (t("supplier"), "s_suppkey", 3, "s_nationkey", 1, True),
        (t("orders"), "o_orderkey", 4, "o_custkey", 2, True),
        (items, "l_orderkey", 4, "l_partkey", 5, False),
        (items, "l_orderkey", 4, "l_suppkey", 3, False),
        (items, "l_partkey", 5, "l_suppkey", 3, False),
    ):
        pair = df.select((F.col(a).cast("bigint") + la * SPAN).alias("src"), (F.col(b).cast("bigint") + lb * SPAN).alias("dst")).filter("src is not null and dst is not null")
        pair = pair if unique else spread(pair, n_items, "src", "dst").distinct()
        one = pair.select("src", "dst", F.lit(la).cast("bigint").alias("ls"), F.lit(lb).cast("bigint").alias("ld"))
        other = pair.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(lb).cast("bigint").alias("ls"), F.lit(la).cast("bigint").alias("ld"))
        labelled = one.union(other) if labelled is None else labelled.union(one).union(other)
    return PropertyGraph(vertices, labelled.select("src", "dst"), labelled)


def coorder_graph(spark: SparkSession, sf_dir: str, least_quantity: float | None = None) -> PropertyGraph:
    """Parts, labelled by size mod 5, joined where one order holds both (in items of the least quantity)."""
    part = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 5).cast("bigint").alias("label"))
    items = _read(spark, sf_dir, "lineitem")
    if least_quantity is not None:
        items = items.filter(F.col("l_quantity") >= least_quantity)
    n = items.count()
    items = items.select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p"))
    known = spread(items, n, "p").join(part.select(F.col("id").alias("p"), F.col("label").alias("l")), "p")
    one, labelled = _pairs(items, n), _pairs(known, n, "l").select("src", "dst", F.col("l_src").alias("ls"), F.col("l_dst").alias("ld"))
    return PropertyGraph(part, both_ways(one), turned_too(labelled), one)


def _pairs(items: DataFrame, n: int, *more: str) -> DataFrame:
    """(src, dst, <more>_src, <more>_dst): parts p that one order o holds, of about n items, src < dst; more columns go along."""
    items = spread(items, n, "o").distinct()
    at = lambda end: items.select("o", F.col("p").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in more])
    # Orders have a handful of items, so pairs within an order stay few.
    one = at("src").join(at("dst"), "o").filter("src < dst").drop("o")
    return spread(one, n * PAIRS, "src", "dst").distinct()

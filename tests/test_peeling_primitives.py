import math
import random
from itertools import accumulate, groupby

import pytest
from pyspark.sql import functions as F

from graphloom import catalog
from graphloom.operators import peeling
from graphloom.operators import primitives as prim
from graphloom.plans import structure
from tests.graphs import frames, random_graph
from tests.test_plans import peeled


@pytest.fixture(scope="module")
def graph():
    return random_graph(5, n=11, p=0.55)


@pytest.fixture(scope="module")
def adj(graph):
    labels, edges = graph
    return {v: {b if a == v else a for a, b in edges if v in (a, b)} for v in labels}


def test_cores(spark, graph, adj):
    g, want = frames(spark, graph), {c[0]: k for c, k in peeled(adj, 1, 2).items()}
    assert {r["id"]: r["core"] for r in peeling.core_numbers(g).collect()} == want
    for k in (3, 5, 99):
        assert {r["id"] for r in peeling.k_core(g, k).collect()} == {v for v, x in want.items() if x >= k}


def test_truss_and_nucleus(spark, graph, adj):
    g = frames(spark, graph)
    truss, nucleus = peeled(adj, 2, 3), peeled(adj, 3, 4)
    assert {tuple(r) for r in peeling.k_truss(g, 4).collect()} == {e for e, k in truss.items() if k >= 2}
    for k in (1, 2):
        assert {tuple(r) for r in peeling.nucleus34(g, k).collect()} == {t for t, x in nucleus.items() if x >= k}
    assert peeling.triangle_count(g).first()[0] == len(structure.cliques(adj, 3))
    assert peeling.four_clique_count(g).first()[0] == len(structure.cliques(adj, 4))


def test_peeling_queries_take_the_whole_graph(spark, graph, adj, tmp_path):
    """Edges of items of small quantity count: none of these orders is in the sparse graph."""
    labels, edges = graph
    spark.createDataFrame([(v, v) for v in labels], "p_partkey bigint, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    items = [(o, v, 1.0) for o, e in enumerate(edges) for v in e]
    spark.createDataFrame(items, "l_orderkey bigint, l_partkey bigint, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    run = lambda q: catalog.QUERIES[q](spark, str(tmp_path)).collect()
    cores = {c[0]: k for c, k in peeled(adj, 1, 2).items()}
    assert {r["id"]: r["core"] for r in run("core_numbers")} == cores
    n = [len(structure.cliques(adj, k)) for k in range(5)]
    asked = [None, *(math.ceil(share * (r + 1) * n[r + 1] / n[r]) for r, share in ((1, catalog.CORE_SHARE), (2, catalog.CLIQUE_SHARE), (3, catalog.CLIQUE_SHARE)))]  # a share of the mean support
    assert {r["id"] for r in run("kcore")} == {v for v, k in cores.items() if k >= asked[1]}
    assert {tuple(r) for r in run("ktruss")} == {e for e, k in peeled(adj, 2, 3).items() if k >= asked[2]}
    assert {tuple(r) for r in run("nucleus34")} == {t for t, k in peeled(adj, 3, 4).items() if k >= asked[3]}
    assert run("clique4_count_coorder")[0][0] == len(structure.cliques(adj, 4))


def test_core_numbers_of_a_clique_with_a_long_tail(spark):
    edges = [(a, b) for a in range(7) for b in range(a)] + [(k, k + 1) for k in range(6, 40)]
    g = frames(spark, ({v: 0 for v in range(43)}, set(edges)))
    assert {r["id"]: r["core"] for r in peeling.core_numbers(g).collect()} == {v: 6 if v < 7 else 1 if v < 41 else 0 for v in range(43)}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    return [(k, rng.choice("aab") if k else None, rng.randrange(100)) for k in range(200)]


@pytest.fixture(scope="module")
def ordered(spark, rows):
    return prim.Ordered(spark.createDataFrame(rows, "k int, c string, n bigint").repartition(5), "k")


def by_k(df, *columns):
    return [tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in sorted(df.collect(), key=lambda r: r["k"])]


def test_scans(ordered, rows):
    sums = list(accumulate(r[2] for r in rows))
    assert by_k(ordered.scan_by(F.col("n"), "s"), "s") == list(accumulate((r[2] for r in rows), max))
    assert by_k(ordered.scan_by(F.col("n"), "s", F.min, inclusive=False), "s") == [None, *accumulate((r[2] for r in rows[:-1]), min)]
    assert by_k(ordered.after(F.col("n"), "b"), "b") == [*(r[2] for r in rows[1:]), None]
    by_key = [x for _, g in groupby(rows, key=lambda r: r[1]) for x in accumulate(r[2] for r in g)]
    assert by_k(ordered.scan_by_key("c", F.col("n"), "s"), "s") == by_key
    assert by_k(ordered.scan_by_key("c", F.col("n"), "s", inclusive=False), "s") == [x - r[2] for x, r in zip(by_key, rows, strict=True)]
    assert by_k(ordered.scan(F.col("n"), "s"), "s") == sums
    assert by_k(ordered.scan(F.col("n"), "s", inclusive=False), "s") == [0, *sums[:-1]]
    assert by_k(ordered.position("p"), "p") == list(range(1, 201))
    assert by_k(ordered.before(F.col("n"), "b"), "b") == [None, *(r[2] for r in rows[:-1])]


def test_runs(ordered, rows):
    want = [(c, len(list(g))) for c, g in groupby(r[1] for r in rows)]
    got = sorted(map(tuple, prim.run_lengths(ordered, "c").collect()))
    assert [(c, n) for _, c, n in got] == want and [r for r, _, _ in got] == list(range(1, len(want) + 1))
    assert prim.unique(ordered, "c").count() == len(want)
    sums = [sum(r[2] for r in g) for _, g in groupby(rows, key=lambda r: r[1])]
    assert [r["total"] for r in sorted(prim.reduce_by_key(ordered, "c", F.col("n")).collect(), key=lambda r: r["run"])] == sums


@pytest.fixture()
def parts(spark):
    """Several partitions even of few rows."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_scans_by_key_need_no_inverse(spark, parts):
    """A NaN or an infinity stays in its run, which may go over several partitions."""
    rng = random.Random(6)
    made = [(k, "abcde"[k // 97], [1.0, float("nan"), 2.0, float("inf"), -3.0][rng.randrange(5) if k < 97 else 2 * rng.randrange(3)], rng.randrange(100)) for k in range(400)]
    o = prim.Ordered(spark.createDataFrame(made, "k int, c string, x double, n bigint").repartition(3), "k")
    assert o.rows.select("_part").distinct().count() == 4
    by_key = lambda f, column: [x for _, g in groupby(made, key=lambda r: r[1]) for x in accumulate((r[column] for r in g), f)]
    assert list(map(str, by_k(o.scan_by_key("c", F.col("x"), "s"), "s"))) == list(map(str, by_key(lambda a, b: a + b, 2)))
    assert by_k(o.scan_by_key("c", F.col("n"), "s", reduce=F.max), "s") == by_key(max, 3)
    assert by_k(o.scan_by_key("c", F.col("n"), "s", reduce=F.min, inclusive=False), "s") == [None if k % 97 == 0 else min(r[3] for r in made[k // 97 * 97 : k]) for k in range(400)]
    assert by_k(o.scan_by(F.col("n"), "s", F.bit_xor), "s") == list(accumulate((r[3] for r in made), lambda a, b: a ^ b))
    # Any aggregate with what combines two of its results: here the longest text, which has no inverse.
    longest = lambda c: F.max_by(c, F.length(c))
    text = F.repeat(F.lit("x"), F.col("n").cast("int"))
    got = by_k(o.scan_by(text, "s", longest, combine=lambda a, b: F.when(F.length(a) >= F.length(b), a).otherwise(b)), "s")
    assert [len(x) for x in got] == list(accumulate((r[3] for r in made), max))


def test_a_large_segment_is_spread(spark, parts):
    made = [(0 if k % 10 else k, k * 7919 % 4001) for k in range(4000)]
    df = spark.createDataFrame(made, "g int, n int").repartition(3)
    got = sorted((r["g"], r["position"], r["n"]) for r in prim.segmented_sort(df, "g", F.desc("n")).collect())
    want = [(g, k + 1, n) for g in sorted({r[0] for r in made}) for k, n in enumerate(sorted((n for h, n in made if h == g), reverse=True))]
    assert got == want
    sizes = [r["count"] for r in prim.Ordered(df, "g", F.desc("n")).rows.groupBy("_part").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2 * 1000


def test_windows_read_rows_where_they_are(ordered):
    """The range shuffle is the only one: scans of the written rows exchange summaries alone."""
    plan = ordered.scan_by_key("c", F.col("n"), "s")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_part" not in plan


def test_empty_order(spark):
    o = prim.Ordered(spark.createDataFrame([], "k int, c string, n bigint"), "k")
    assert o.scan(F.col("n"), "s").collect() == [] and prim.run_lengths(o, "c").collect() == []


def test_tied_rows_are_kept(spark, tmp_path):
    """Rows that tie in order, line, flag and quantity, some of them equal in every column."""
    made = [(1, 1, "A", 5.0, p) for p in (7, 7, 7, 8)] + [(1, 2, "A", 5.0, 7)] + [(2, 1, "R", 3.0, p) for p in (9, 9)]
    rows = [(*r, 1, 1.0, 0.0, 0.0, "O", "d") for r in made]
    spark.createDataFrame(rows, ", ".join(f"{c} {t}" for c, t in zip(catalog._ALL, ["bigint", "int", "string", "double", "bigint", "bigint", "double", "double", "double", "string", "string"], strict=True))).write.parquet(str(tmp_path / "lineitem.parquet"))
    run = lambda q: catalog.QUERIES[q](spark, str(tmp_path)).collect()
    assert sorted(r["total"] for r in run("prim_inclusive_sum_all")) == [5, 10, 15, 20, 25, 28, 31]
    assert sorted(r["diff"] for r in run("prim_adjacent_diff_all")) == [-2, 0, 0, 0, 0, 0, 5]
    assert sorted((r["run"], r["length"]) for r in run("prim_rle_all")) == [(1, 5), (2, 2)]
    assert sorted((r["key"], r["total"]) for r in run("prim_reduce_by_key_all")) == [("A", 25), ("R", 6)]


def test_partition_returns_rows(spark, tmp_path):
    rows = [(1, 1, 9.0), (1, 2, 10.0), (1, 2, 10.0), (2, 1, 40.0)]
    spark.createDataFrame(rows, "l_orderkey bigint, l_linenumber int, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = catalog.QUERIES["prim_partition_rows"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(*r, part) for r, part in zip(rows, (0, 1, 1, 2), strict=True)]

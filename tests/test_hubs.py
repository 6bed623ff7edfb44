"""Hubs in join chains, and the degeneracy order."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from graphloom.operators import hubs, matching, peeling
from graphloom.operators.matching import match
from graphloom.plans.pattern import Pattern
from graphloom.plans.structure import cliques
from graphloom.sources.graphs import PropertyGraph
from tests.graphs import embeddings, frames, random_graph, random_pattern
from tests.test_plans import peeled


@pytest.fixture()
def shuffled(spark):
    """No broadcast of either side, no partitions put together or split at run time, and enough of them to compare."""
    own = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def sizes(df):
    return sorted(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())


def star(light=600, arms=300):
    """A hub with a third of all edges; every other centre has two neighbours, one of each label."""
    labels, edges = {0: 0}, set()
    for k in range(arms):
        labels[1 + k] = 1 + k % 2
        edges.add((0, 1 + k))
    for k in range(light // 2):
        c = 1_000 + 3 * k
        labels |= {c: 0, c + 1: 1, c + 2: 2}
        edges |= {(c, c + 1), (c, c + 2)}
    return labels, edges


def test_no_task_takes_a_hub_alone(spark, shuffled):
    labels, edges = star()
    g, pattern = frames(spark, (labels, edges)), Pattern([1, 0, 2], [(0, 1), (1, 2)])
    beside = Counter((c, labels[x]) for e in edges for c, x in (e, e[::-1]))
    want = sum(n * beside[c, 2] for (c, label), n in beside.items() if label == 1)
    plain = match(g, pattern, fold=False, filter=False, hubs=None).rows()
    cut = match(g, pattern, fold=False, filter=False, hubs=50).rows()
    assert plain.count() == cut.count() == want and not plain.exceptAll(cut).head(1)
    assert max(sizes(plain)) > 0.9 * want
    got = sizes(cut)
    assert len(got) == 8 and got[-1] < 2 * got[4]


def test_few_keys_of_many_pairs_go_to_all_tasks(spark, monkeypatch):
    """Lists far shorter than a hub's, but only two keys; Spark may broadcast and put partitions together here."""
    monkeypatch.setattr(matching, "MOST_PAIRS", 500)
    labels = {0: 1, 1: 1} | {v: 3 if v % 3 else 2 for v in range(2, 152)}
    g = frames(spark, (labels, {(v % 2, v) for v in range(2, 152)}))
    pattern = Pattern([3, 1, 2], [(0, 1), (1, 2)])
    plain, cut = match(g, pattern, hubs=None).rows(), match(g, pattern).rows()
    assert plain.count() == cut.count() == 2 * 50 * 25 and not plain.exceptAll(cut).head(1)
    got = sizes(cut)
    assert len(sizes(plain)) < 3 and len(got) == 4 and got[-1] < 0.5 * sum(got)


@pytest.mark.parametrize("seed", range(3))
def test_hubs_change_no_result(spark, shuffled, seed):
    graph, pattern = random_graph(seed, n=8, p=0.6, labels=2), random_pattern(seed, n=4, labels=2)
    m = match(frames(spark, graph), pattern, hubs=1)
    assert sorted(tuple(r[f"u{u}"] for u in range(4)) for r in m.rows().collect()) == embeddings(graph, pattern)


def test_grid_join_is_a_join(spark, shuffled):
    rng = random.Random(1)
    key = lambda: rng.choice([None, 0, 0, 0, 0, 1, 1, 2, rng.randrange(50)])
    left = spark.createDataFrame([(key(), rng.randrange(5)) for _ in range(400)], "k int, x int")
    right = spark.createDataFrame([(key(), rng.randrange(9)) for _ in range(300)], "k int, y int")
    got = hubs.grid_join(left, right, "k")
    assert Counter(got.collect()) == Counter(left.join(right, "k").collect())
    assert 0 < hubs.grid_of(left, right, "k", 0).count() < 8 * hubs.CELLS
    assert hubs.grid_join(left.limit(0), right, "k").collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_degeneracy_order(spark, seed):
    labels, edges = random_graph(seed, n=14, p=0.1 + 0.15 * seed)
    edges = edges | {(k, k + 1) for k in range(13, 22)}  # a tail of many layers
    labels = {v: 0 for v in range(25)}
    g, adj = frames(spark, (labels, edges)), {v: {b if a == v else a for a, b in edges if v in (a, b)} for v in labels}
    order, cores = peeling.degeneracy_order(g), {c[0]: k for c, k in peeled(adj, 1, 2).items()}
    rows = {r["id"]: r for r in order.collect()}
    assert sorted(r["position"] for r in rows.values()) == list(range(1, 26))
    for v, r in rows.items():
        after = sum(rows[w]["position"] > r["position"] for w in adj[v])
        assert r["core"] == cores[v] and r["later"] == after <= cores[v]
    assert {frozenset(t) for t in peeling.triangles(g.edges, order).collect()} == set(map(frozenset, cliques(adj, 3)))
    assert {frozenset(t) for t in peeling.four_cliques(g.edges, order).collect()} == set(map(frozenset, cliques(adj, 4)))


def test_degeneracy_beats_degree(spark):
    """A vertex of high degree whose neighbours hang on others of higher degree still."""
    edges = {(0, k) for k in range(1, 9)} | {(k, 9 + 12 * k + j) for k in range(1, 9) for j in range(12)}
    labels = {v: 0 for e in edges for v in e}
    g = frames(spark, (labels, edges))
    most = lambda e: e.groupBy("a").count().agg(F.max("count")).first()[0]
    assert most(peeling.oriented(g.edges)) == 8
    assert most(peeling.oriented(g.edges, peeling.degeneracy_order(g))) == 1


def test_degeneracy_order_of_nothing(spark):
    g = frames(spark, ({0: 0}, {(0, 1)}))
    none = PropertyGraph(g.vertices.limit(0), g.edges.limit(0))
    assert peeling.degeneracy_order(none).collect() == []

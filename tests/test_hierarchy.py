import random

import numpy as np
import pytest

from graphloom.operators import components as linked
from graphloom.operators import hierarchy
from graphloom.operators.components import components
from graphloom.plans import structure
from graphloom.sources.graphs import from_tables
from tests.graphs import frames, random_graph


def adjacency(graph):
    labels, edges = graph
    out = {v: set() for v in labels}
    for a, b in edges:
        out[a].add(b)
        out[b].add(a)
    return out


def blocks(seed):
    """Cliques of several sizes on a path, with a few more edges: nuclei within nuclei."""
    rng, edges, first = random.Random(seed), set(), 0
    for size in (5, 4, 6, 3, 4):
        edges |= {(a, b) for a in range(first, first + size) for b in range(a + 1, first + size)}
        if first:
            edges |= {(first - 1, first), (first - 2, first)}
        first += size
    for _ in range(12):
        a, b = sorted(rng.sample(range(first), 2))
        edges.add((a, b))
    return dict.fromkeys(range(first + 2), 0), edges


def side_by_side(*graphs):
    labels, edges = {}, set()
    for g in graphs:
        first = len(labels)
        labels |= {first + v: x for v, x in g[0].items()}
        edges |= {(first + a, first + b) for a, b in g[1]}
    return labels, edges


GRAPH = side_by_side(random_graph(2, n=10, p=0.7), blocks(1), random_graph(1, n=9, p=0.4))


def clique_numbers(adj, r):
    big = [set(structure.combinations(c, r)) for c in structure.cliques(adj, r + 1)]
    number = {c: sum(c in b for b in big) for c in structure.cliques(adj, r)}
    while True:
        new = {}
        for c, n in number.items():
            passed = sorted((min(number[x] for x in b if x != c) for b in big if c in b), reverse=True)
            new[c] = max((min(v, k + 1) for k, v in enumerate(passed)), default=0)
        if new == number:
            return number
        number = new


@pytest.mark.parametrize("r", [1, 2, 3])
def test_numbers_and_nuclei(spark, r):
    adj, g = adjacency(GRAPH), frames(spark, GRAPH)
    got = {tuple(x[f"v{k}"] for k in range(r)): x["number"] for x in hierarchy.numbers(g, r).collect()}
    assert got == clique_numbers(adj, r) and len(set(got.values())) > 2
    rows = hierarchy.nuclei(g, r).collect()
    by_id = {x["id"]: x for x in rows}
    assert len(by_id) == len(rows)
    assert sorted((x["k"], x["n_vertices"], x["n_edges"]) for x in rows) == sorted((n.k, len(n.vertices), n.n_edges) for n in structure.nuclei(adj, r, r + 1))
    for x in rows:
        assert x["density"] == pytest.approx(2 * x["n_edges"] / (x["n_vertices"] * (x["n_vertices"] - 1)))
        # The nearest level below at which the component of the least clique gains something.
        least = tuple(map(int, x["id"].split(":")[1].split("-")))
        up = [k for k in range(1, x["k"]) if k in reached(adj, got, least, k, r)]
        assert (by_id[x["parent"]]["k"] if x["parent"] else None) == max(up, default=None)
        if x["parent"]:
            top = tuple(map(int, x["parent"].split(":")[1].split("-")))
            assert top == min(reached(adj, got, least, by_id[x["parent"]]["k"], r, cliques=True))


def reached(adj, number, start, k, r, cliques=False):
    """The numbers (or the r-cliques) in the component of start by (r + 1)-cliques of k or more."""
    big = [set(structure.combinations(c, r)) for c in structure.cliques(adj, r + 1)]
    big = [b for b in big if min(number[c] for c in b) >= k]
    part = {start}
    while more := {c for b in big if b & part for c in b} - part:
        part |= more
    return part if cliques else {number[c] for c in part}


def test_no_cliques(spark):
    labels = dict.fromkeys(range(4), 0)
    path = frames(spark, (labels, {(0, 1), (1, 2)}))
    assert hierarchy.nuclei(path, 2).collect() == []
    assert {r["number"] for r in hierarchy.numbers(path, 2).collect()} == {0}
    empty = from_tables(spark.createDataFrame([], "id bigint, label bigint"), spark.createDataFrame([], "src bigint, dst bigint"))
    assert hierarchy.nuclei(empty, 1).collect() == [] and hierarchy.numbers(empty, 1).collect() == []


def test_components_of_many_graphs(spark):
    rng = random.Random(4)
    links = [(p, rng.randrange(60), rng.randrange(60)) for p in range(5) for _ in range(35)] + [(9, k, k + 1) for k in range(300)]
    got = {(r["p"], r["node"]): r["root"] for r in components(spark.createDataFrame(links, "p bigint, a bigint, b bigint")).collect()}
    want = {}
    for p in {x[0] for x in links}:
        adj = {}
        for q, a, b in links:
            if q == p and a != b:
                adj.setdefault(a, set()).add(b)
                adj.setdefault(b, set()).add(a)
        for part in structure.components(adj, set(adj)):
            want |= {(p, v): min(part) for v in part}
    assert got == want


def levels_of(joins):
    """The components, as sets, at every level."""
    out = {}
    for k in range(1, 6):
        adj = {}
        for a, b, w in joins:
            if w >= k:
                adj.setdefault(a, set()).add(b)
                adj.setdefault(b, set()).add(a)
        out[k] = sorted(map(sorted, structure.components(adj, set(adj))))
    return out


def test_thinned_joins_have_the_same_components(spark, monkeypatch):
    monkeypatch.setattr(hierarchy, "PART_JOINS", 300)
    monkeypatch.setattr(hierarchy, "CHUNK_JOINS", 100)
    rng = random.Random(3)
    joins = sorted({(*sorted(rng.sample(range(70), 2)), rng.randrange(1, 6)) for _ in range(1500)})
    got = [tuple(r) for r in hierarchy.thinned(spark.createDataFrame(joins, "a bigint, b bigint, w bigint")).select("a", "b", "w").collect()]
    assert set(got) <= set(joins) and len(got) < len(joins) / 3
    assert levels_of(got) == levels_of(joins)
    x, y, w = (np.array(c) for c in zip(*joins, strict=True))
    assert len(hierarchy._forest(x, y, w)) == 70 - len(levels_of(joins)[1])
    empty = spark.createDataFrame([], "a bigint, b bigint, w bigint")
    assert hierarchy.thinned(empty).count() == 0


def test_chains_within_a_range_cost_no_rounds(spark, monkeypatch):
    jobs = []
    monkeypatch.setattr(linked, "written", lambda df, name, *by, f=linked.written: (jobs.append(name), f(df, name, *by))[1])
    chain = spark.createDataFrame([(7, k, k + 1) for k in range(400)], "p bigint, a bigint, b bigint")
    assert {r["root"] for r in components(chain).collect()} == {0} and len(jobs) == 3
    jobs.clear()
    monkeypatch.setattr(linked, "PART_LINKS", 50)
    assert {(r["node"], r["root"]) for r in components(chain).collect()} == {(k, 0) for k in range(401)}

import pytest

from graphloom.operators import hierarchy, peeling, rounds
from tests.graphs import frames, random_graph
from tests.test_plans import peeled


@pytest.fixture
def many_ranges(monkeypatch):
    monkeypatch.setattr(rounds, "PART_LINKS", 60)
    monkeypatch.setattr(rounds, "LEAST_LINKS", 10)


def adjacency(graph):
    labels, edges = graph
    return {v: {b if a == v else a for a, b in edges if v in (a, b)} for v in labels}


def counted(monkeypatch, module=rounds):
    """The names of the tables that a module writes."""
    seen, whole = [], module.written
    monkeypatch.setattr(module, "written", lambda df, name, *by: (seen.append(name), whole(df, name, *by))[1])
    return seen


def test_cores_of_many_ranges(spark, many_ranges):
    graph = random_graph(8, n=40, p=0.3)
    g, want = frames(spark, graph), {c[0]: k for c, k in peeled(adjacency(graph), 1, 2).items()}
    assert {r["id"]: r["core"] for r in peeling.core_numbers(g).collect()} == want
    for k in (4, 6):
        left = {v for v, x in want.items() if x >= k}
        assert {r["id"]: r["degree"] for r in peeling.k_core(g, k).collect()} == {v: len(adjacency(graph)[v] & left) for v in left}


def test_a_chain_within_a_range_costs_no_rounds(spark, monkeypatch):
    seen = counted(monkeypatch)
    chain = ({v: 0 for v in range(41)}, {(v, v + 1) for v in range(40)})
    assert {r["core"] for r in peeling.core_numbers(frames(spark, chain)).collect()} == {1}
    assert seen.count("cores-state") <= 2


def test_a_vertex_with_too_many_neighbours(spark, monkeypatch):
    monkeypatch.setattr(rounds, "PART_LINKS", 8)
    graph = random_graph(9, n=20, p=0.6)
    assert {r["id"]: r["core"] for r in peeling.core_numbers(frames(spark, graph)).collect()} == {c[0]: k for c, k in peeled(adjacency(graph), 1, 2).items()}


def test_layers_of_many_ranges(spark, many_ranges, monkeypatch):
    seen = counted(monkeypatch, peeling)
    graph = random_graph(8, n=40, p=0.2)
    adj, got = adjacency(graph), {r["id"]: r for r in peeling.degeneracy_order(frames(spark, graph)).collect()}
    layers, left, layer = {}, set(adj), 0
    while left:  # shell by shell, all at once
        layer += 1
        goes = {v for v in left if sum(got[w]["core"] > got[v]["core"] or (got[w]["core"] == got[v]["core"] and w in left) for w in adj[v]) <= got[v]["core"]}
        layers |= dict.fromkeys(goes, layer)
        left -= goes
    assert {v: r["layer"] for v, r in got.items()} == layers and layer > 2
    assert seen.count("shell-told") == 1


def test_truss_and_nucleus_numbers_of_many_ranges(spark, many_ranges):
    graph = random_graph(8, n=16, p=0.6)
    adj, g = adjacency(graph), frames(spark, graph)
    for r in (2, 3):
        got = {tuple(row)[:-1]: row["number"] for row in hierarchy.numbers(g, r).collect()}
        assert got == peeled(adj, r, r + 1)
    assert {tuple(row) for row in peeling.nucleus34(g, 2).collect()} == {t for t, k in peeled(adj, 3, 4).items() if k >= 2}

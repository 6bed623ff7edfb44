from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.plans import structure
from graphloom.plans.pattern import Pattern
from graphloom.plans.planner import METHODS, Stats, plan
from tests.graphs import random_graph, random_pattern

SHAPES = {
    "edge": Pattern([0, 1], [(0, 1)]),
    "path": Pattern([0] * 4, [(0, 1), (1, 2), (2, 3)]),
    "star": Pattern([0] * 5, [(0, k) for k in range(1, 5)]),
    "triangle": Pattern([0] * 3, combinations(range(3), 2)),
    "tailed": Pattern([0] * 4, [(0, 1), (0, 2), (1, 2), (2, 3)]),
    "bowtie": Pattern([0] * 5, [(0, 1), (0, 2), (1, 2), (0, 3), (0, 4), (3, 4)]),
    "cycle4": Pattern([0] * 4, [(0, 1), (1, 2), (2, 3), (0, 3)]),
    "clique5": Pattern([0] * 5, combinations(range(5), 2)),
    "two nuclei": Pattern([0] * 9, [*combinations(range(4), 2), *combinations(range(5, 9), 2), (3, 4), (4, 5)]),
    "sixteen": Pattern([0] * 16, [(k, k + 1) for k in range(15)]),
}


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("method", METHODS)
@pytest.mark.parametrize("adaptive", [True, False])
def test_every_vertex_has_a_neighbour_before_it(shape, method, adaptive):
    p = SHAPES[shape]
    stats = Stats({(u, w): 10 * u + w + 1 for _, u, w in p.directed()}, {(u, w): u + w + 1 for _, u, w in p.directed()})
    for s in (None, stats):
        got = plan(p, s, method, adaptive)
        assert sorted(got.order) == list(range(len(p)))
        assert all(before for _, before in got.backward()[1:])


def test_groups_go_from_core_to_trees():
    got = plan(SHAPES["two nuclei"])
    assert set(got.groups[0] + got.groups[1]) == set(range(4)) or set(got.groups[0] + got.groups[1]) == set(range(5, 9))
    tail = plan(SHAPES["tailed"])
    assert tail.groups[-1] == [3] and tail.tree_groups[-1]
    assert all(len(g) == 1 for g in plan(SHAPES["bowtie"], method="BFS").groups)


def test_bad_patterns():
    for labels, edges in (([1, 2, 3], [(0, 1)]), ([0] * 17, [(k, k + 1) for k in range(16)]), ([1, 1], [(0, 0)]), ([], []), ([1], [(0, 1)])):
        with pytest.raises(ValueError):
            Pattern(labels, edges)
    assert len(Pattern([0] * 17, [(k, k + 1) for k in range(16)], most_vertices=20)) == 17


def test_orders():
    adj = SHAPES["tailed"].adjacency()
    assert structure.degeneracy_order(adj)[0] == 3
    assert structure.bfs_order(adj, 3) == [3, 2, 0, 1]


def peeled(adj, r, s):
    """Largest k of each r-clique, by trying every k."""
    small, big = structure.cliques(adj, r), [set(combinations(c, r)) for c in structure.cliques(adj, s)]
    out = dict.fromkeys(small, 0)
    for k in range(1, len(big) + 1):
        left = set(small)
        while low := {c for c in left if sum(c in b and b <= left for b in big) < k}:
            left -= low
        for c in left:
            out[c] = k
    return out


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10_000), st.sampled_from([(1, 2), (2, 3), (3, 4)]))
def test_nuclei(seed, rs):
    _, edges = random_graph(seed, n=8, p=0.6)
    adj = {v: {b if a == v else a for a, b in edges if v in (a, b)} for v in range(8)}
    found = structure.nuclei(adj, *rs)
    want = peeled(adj, *rs)
    for k in {n.k for n in found}:
        assert set().union(*(n.vertices for n in found if n.k >= k)) == {v for c, x in want.items() if x >= k for v in c}
    assert max((n.k for n in found), default=0) == max(want.values(), default=0)
    assert all(0 < n.density <= 1 for n in found)


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 3))
def test_k_core(seed, k):
    _, edges = random_graph(seed, n=9, p=0.35)
    adj = {v: {b if a == v else a for a, b in edges if v in (a, b)} for v in range(9)}
    assert structure.k_core(adj, k) == {c[0] for c, x in peeled(adj, 1, 2).items() if x >= k}


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10_000))
def test_components(seed):
    p = random_pattern(seed, n=7)
    parts = structure.components(p.adjacency(), set(range(1, 7)))
    assert set().union(*parts) == set(range(1, 7)) and sum(map(len, parts)) == 6

"""Graphs whose near vertices have far ids: copies stay few, and no job holds too many of them."""

import itertools
import random

import pytest

from graphloom.operators import hierarchy, peeling
from tests.graphs import frames


@pytest.fixture
def interleaved(spark, monkeypatch):
    """Six groups of 24 vertices, whose ids lie among each other."""
    rng = random.Random(4)
    for name, n in (("PART_EDGES", 120), ("BLOCK_EDGES", 240), ("LOCAL_PARTS", 1), ("JOB_COPIES", 1500)):
        monkeypatch.setattr(peeling, name, n)
    edges = {(a, b) for a, b in itertools.combinations(range(144), 2) if a % 6 == b % 6 and rng.random() < 0.8}
    return frames(spark, ({v: 0 for v in range(144)}, edges)), edges


def seen(monkeypatch):
    """The sizes of the tables that are written, by name."""
    found, whole = [], peeling.written

    def written(df, name, *by):
        out = whole(df, name, *by)
        found.append((name, out[0].count()))
        return out

    monkeypatch.setattr(peeling, "written", written)
    return found


def test_few_ranges_know_a_vertex_and_jobs_share_the_copies(interleaved, monkeypatch):
    g, edges = interleaved
    tables = seen(monkeypatch)
    want = sorted(t for t in itertools.combinations(range(144), 3) if all(p in edges for p in itertools.combinations(t, 2)))
    assert sorted(tuple(sorted(r)) for r in peeling.triangles(g.edges).collect()) == want
    # Every vertex is known to two ranges or three, not to nearly all.
    assert dict(tables)["met-lists"] <= 3 * 144
    assert len([n for n, _ in tables if n == "closed"]) > 1


def test_members_are_numbered_where_they_are_found(interleaved):
    g, edges = interleaved
    for r in (2, 3):
        i = hierarchy.incidence(g, r)
        node = {row[0]: tuple(row)[1:] for row in i.cliques.collect()}
        assert len(set(node.values())) == len(node)
        cliques = [set().union(*(node[x] for x in row)) for row in i.whole.collect()]
        want = [set(c) for c in itertools.combinations(range(144), r + 1) if all(p in edges for p in itertools.combinations(c, 2))]
        assert sorted(map(sorted, cliques)) == sorted(map(sorted, want)) and all(len(set(row)) == r + 1 for row in i.whole.collect())


def test_an_order_joins_each_edge_once(interleaved, monkeypatch):
    g, edges = interleaved
    tables = seen(monkeypatch)
    rows = {r["id"]: r for r in peeling.degeneracy_order(g).collect()}
    at = {v: r["position"] for v, r in rows.items()}
    assert sorted(at.values()) == list(range(1, 145))
    assert {v: r["later"] for v, r in rows.items()} == {v: sum(at[a if b == v else b] > at[v] for a, b in edges if v in (a, b)) for v in rows}
    assert all(r["later"] <= r["core"] for r in rows.values())
    assert dict(tables)["shell-edges"] == len(edges)

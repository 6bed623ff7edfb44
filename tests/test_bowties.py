"""Patterns of rings that share a vertex: counted and listed ring by ring."""

import pytest

from graphloom.operators import matching
from graphloom.operators.matching import match
from graphloom.plans.pattern import Pattern
from tests.graphs import embeddings, frames, random_graph


@pytest.fixture
def tables(monkeypatch):
    """The columns and rows of the tables that are written, by name."""
    seen, whole = [], matching.written

    def written(df, name, *by):
        out = whole(df, name, *by)
        seen.append((name, len(df.columns), out[0].count()))
        return out

    monkeypatch.setattr(matching, "written", written)
    return seen


EDGES = [(0, 1), (0, 2), (1, 2), (0, 3), (0, 4), (3, 4)]


@pytest.mark.parametrize("labels", ([0, 1, 2, 3, 4], [0, 1, 1, 2, 1]))
def test_rings_do_not_multiply(spark, tables, tmp_path, labels):
    graph = random_graph(2, n=14, p=0.7, labels=max(labels) + 1)
    g, pattern = frames(spark, graph), Pattern(labels, EDGES)
    want = embeddings(graph, pattern)
    assert match(g, pattern, replan=True).count().first()["matches"] == len(want) > 0
    if len(set(labels)) == 5:
        # No table holds rows of both rings.
        assert max(width for name, width, _ in tables if name == "partial-rows") == 3
    rows = match(g, pattern).rows_in_batches(f"file://{tmp_path}/out", 10)
    assert sorted(tuple(r) for r in rows.collect()) == want
    # Each ring is listed once, whatever the number of batches.
    assert len([1 for name, *_ in tables if name == "part-rows"]) == 2

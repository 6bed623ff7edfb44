"""Triangles and cliques closed within ranges of vertices."""

import itertools
import random

import pytest

from graphloom.operators import peeling
from tests.graphs import frames


@pytest.mark.parametrize(("width", "local"), [(8, True), (60, False)])
def test_wedges_are_closed_where_they_are_made(spark, monkeypatch, width, local):
    rng = random.Random(1)
    pairs = list(itertools.combinations(range(240), 2))
    # Dense among near ids, where lists travel to few ranges; or thin over all, where wedges are fewer than copies.
    edges = {(a, b) for a, b in pairs if b - a < width and rng.random() < (0.9 if local else 0.03)}
    g = frames(spark, ({v: 0 for v in range(240)}, edges))
    for name, n in (("PART_EDGES", 250), ("BLOCK_EDGES", 400), ("PART_TRIANGLES", 200), ("WEDGES", 100)):
        monkeypatch.setattr(peeling, name, n)
    found = peeling.triangles(g.edges)
    plan = found._jdf.queryExecution().logical().toString()
    assert ("FlatMapCoGroupsInArrow" in plan) == local
    for k, rows, count in ((3, found, peeling.triangle_count(g)), (4, peeling.four_cliques(g.edges), peeling.four_clique_count(g))):
        want = sorted((a, *c) for a in range(240) for c in itertools.combinations(range(a + 1, min(a + width, 240)), k - 1) if all(p in edges for p in itertools.combinations((a, *c), 2))) if local else None
        got = sorted(tuple(sorted(r)) for r in rows.collect())
        assert len(got) == len(set(got)) == count.first()[0]
        assert all(p in edges for c in got for p in itertools.combinations(c, 2))
        if local:
            assert got == want

import math

import pyarrow as pa
import pytest

from graphloom.operators import one_round
from graphloom.operators.matching import match
from graphloom.plans.pattern import Pattern
from tests.graphs import embeddings, frames, random_graph, random_pattern


@pytest.mark.parametrize("seed", range(6))
def test_one_shuffle_gives_the_same_embeddings(spark, seed, monkeypatch):
    monkeypatch.setattr(one_round, "BLOCK", 3)  # many blocks
    graph, pattern = random_graph(seed, n=8, p=0.6, labels=2), random_pattern(seed, n=3 + seed % 3, labels=2)
    want = embeddings(graph, pattern)
    m = match(frames(spark, graph), pattern, one_round=True, filter=seed % 2 == 0, fold=False)
    got = m.rows()
    assert sorted(tuple(r[f"u{u}"] for u in range(len(pattern))) for r in got.collect()) == want
    assert m.count().first()["matches"] == len(want)


def test_empty(spark):
    m = match(frames(spark, random_graph(1)), Pattern([7, 8, 9], [(0, 1), (1, 2), (0, 2)]), one_round=True)
    assert m.count().first()["matches"] == 0 and m.rows().collect() == []


def test_sides_copy_least():
    """The side that no large relation has is the cheap one to cut."""
    edges = [(0, 1), (1, 2), (0, 2)]
    assert one_round.sides(3, edges, dict.fromkeys(edges, 100), 8) == [2, 2, 2]
    assert one_round.sides(3, edges, {(0, 1): 1_000_000, (1, 2): 1, (0, 2): 1}, 8)[2] == 1
    assert one_round.copies([2, 3, 4], (0, 1)) == 4


def test_cells_hold_their_copies_too(monkeypatch):
    """Copies count: cells of four vertices, by edges alone, would hold several times what they may."""
    monkeypatch.setattr(one_round, "CELL_EDGES", 1000)
    edges = [(a, b) for a in range(4) for b in range(a + 1, 4)]
    for each in (100, 600, 3_000):
        sizes = dict.fromkeys(edges, each)
        shape = one_round.grid(4, sizes, 4)
        if shape is not None:
            cells, copied = math.prod(shape), sum(each * one_round.copies(shape, e) for e in edges)
            assert copied <= 1000 * cells and copied <= one_round.MOST_COPIES * 6 * each
    assert one_round.grid(4, dict.fromkeys(edges, 100), 4) is not None
    assert one_round.grid(4, dict.fromkeys(edges, 3_000), 4) is None
    # One shared vertex is cut without copies, so any size has a grid.
    assert one_round.grid(3, {(0, 1): 10**6, (0, 2): 10**6}, 4)[1:] == [1, 1]


def test_no_grid_gives_the_same_embeddings(spark, monkeypatch):
    monkeypatch.setattr(one_round, "CELL_EDGES", 1)
    graph, pattern = random_graph(2, n=8, p=0.6, labels=2), Pattern([0, 1, 0], [(0, 1), (1, 2), (0, 2)])
    m = match(frames(spark, graph), pattern, one_round=True)
    want = embeddings(graph, pattern)
    assert sorted(tuple(r) for r in m.rows().collect()) == want and m.count().first()["matches"] == len(want)
    assert m._grid() is None


def test_whole_rows_leave_a_cell_in_blocks(monkeypatch):
    """No task holds all rows of a cell at once."""
    monkeypatch.setattr(one_round, "BLOCK", 50)
    edges = [(0, 1), (0, 2), (1, 2)]
    ends = [(k, a, b) for k in range(3) for a in range(20) for b in range(20) if a != b]
    cell = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*ends, strict=True)], ["edge", "src", "dst"])
    sizes = [len(b) for b in one_round._found(iter([cell]), edges, [(0, []), (1, [0]), (2, [0, 1])], [], [0, 1, 2])]
    assert sum(sizes) == 20 * 19 * 18 and max(sizes) <= 50

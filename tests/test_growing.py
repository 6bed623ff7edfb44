"""Rows grown group by group: partial counts, orders chosen again, batches."""

import os

import pytest

from graphloom.operators import matching
from graphloom.operators.matching import Match, match
from graphloom.plans.pattern import Pattern
from tests.graphs import embeddings, frames, random_graph, random_pattern


def found(df, n):
    return sorted(tuple(r[f"u{u}"] for u in range(n)) for r in df.collect())


@pytest.mark.parametrize("seed", range(3))
def test_replanned_and_batches_give_all_rows(spark, seed, tmp_path):
    graph, pattern = random_graph(seed, n=8, p=0.5, labels=2), random_pattern(seed, n=4, labels=2)
    want, g = embeddings(graph, pattern), frames(spark, graph)
    assert found(match(g, pattern, replan=True).rows(), 4) == want
    assert match(g, pattern, replan=True).count().first()["matches"] == len(want)
    for budget in (5, 10_000):
        assert found(match(g, pattern).rows_in_batches(f"file://{tmp_path}/{budget}", budget), 4) == want
    last = max(match(g, pattern, method="BFS").partial_counts().collect(), key=lambda r: r["group"])
    assert (last["vertices"], last["rows"]) == (4, len(want))


def test_partial_counts_are_those_of_prefixes(spark):
    graph, pattern = random_graph(3, n=9, p=0.6, labels=1), Pattern([0, 0, 0, 0], [(0, 1), (1, 2), (0, 2), (2, 3)])
    m = match(frames(spark, graph), pattern, method="BFS", filter=False)
    order = m.plan.order
    for r in m.partial_counts().collect():
        if r["vertices"] > 1:
            kept = order[: r["vertices"]]
            part = Pattern([0] * len(kept), [(kept.index(a), kept.index(b)) for a, b in pattern.edges if a in kept and b in kept])
            assert r["rows"] == len(embeddings(graph, part))


def skewed():
    """Most vertices of label 0 have one neighbour of label 1; the few that have label 2 beside them have hundreds, and hardly one triangle closes."""
    labels, edges, n = {}, set(), 0

    def new(label):
        nonlocal n
        labels[n] = label
        n += 1
        return n - 1

    for _ in range(900):
        edges.add((new(0), new(1)))
    for k in range(10):
        hub, twos, ones = new(0), [new(2) for _ in range(5)], [new(1) for _ in range(200)]
        edges |= {(hub, x) for x in twos + ones}
        three = new(3)
        edges.add((twos[0], three))
        if k == 0:
            edges.add((hub, three))
    return labels, {tuple(sorted(e)) for e in edges}


def test_order_is_chosen_again_where_averages_mislead(spark):
    graph = skewed()
    pattern = Pattern([0, 1, 2, 3], [(0, 1), (0, 2), (2, 3), (0, 3)])
    g = frames(spark, graph)
    fixed = match(g, pattern, method="degree", filter=False)
    again = match(g, pattern, method="degree", filter=False, replan=True)
    assert fixed.count().first() == again.count().first() and again.count().first()["matches"] == 200
    # Vertex 1, which multiplies rows by hundreds, comes last.
    assert again.sizes[-1][0] == 1 and max(n for _, n in again.sizes[:-1]) <= 50


def test_a_stopped_run_goes_on(spark, tmp_path, monkeypatch):
    graph, pattern = random_graph(5, n=9, p=0.6, labels=1), Pattern([0, 0, 0], [(0, 1), (1, 2), (0, 2)])
    g, path = frames(spark, graph), f"file://{tmp_path}/out"
    whole, seen = Match._batch, []

    def failing(self, order, starts):
        if len(seen) == 2:
            raise RuntimeError("made failure")
        seen.append(1)
        return whole(self, order, starts)

    monkeypatch.setattr(Match, "_batch", failing)
    with pytest.raises(RuntimeError, match="made failure"):
        match(g, pattern).rows_in_batches(path, 60)
    done = {d: os.stat(f"{tmp_path}/out/rows/{d}/_SUCCESS").st_mtime_ns for d in os.listdir(f"{tmp_path}/out/rows")}
    assert len(done) == 2
    monkeypatch.setattr(Match, "_batch", whole)
    assert found(match(g, pattern).rows_in_batches(path, 60), 3) == embeddings(graph, pattern)
    assert len(os.listdir(f"{tmp_path}/out/rows")) > 2
    assert all(os.stat(f"{tmp_path}/out/rows/{d}/_SUCCESS").st_mtime_ns == t for d, t in done.items())


def test_jobs_do_not_grow_with_the_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(matching, "BATCH_JOBS", 2)
    graph, pattern = random_graph(5, n=9, p=0.6, labels=1), Pattern([0, 0, 0], [(0, 1), (1, 2), (0, 2)])
    path = f"file://{tmp_path}/out"
    assert found(match(frames(spark, graph), pattern).rows_in_batches(path, 20), 3) == embeddings(graph, pattern)
    assert len(os.listdir(f"{tmp_path}/out/rows")) <= 2 < spark.read.parquet(f"{path}/batches").select("batch").distinct().count()
    # A later run with another budget goes by the same cut.
    assert found(match(frames(spark, graph), pattern).rows_in_batches(path, 1000), 3) == embeddings(graph, pattern)

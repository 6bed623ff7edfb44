import pytest

from graphloom.operators import filtering
from graphloom.operators.matching import match
from graphloom.plans.pattern import Pattern
from graphloom.sources.graphs import from_text
from tests.graphs import embeddings, frames, random_graph, random_pattern

#: A triangle of three labels (2, 4, 5), an edge of one label twice (1-6), and two ends.
SAMPLE = """t 9 10
v 0 21 1
v 1 35 4
v 2 40 3
v 3 17 2
v 4 52 3
v 5 64 3
v 6 35 2
v 7 17 1
v 8 70 1
e 0 1
e 1 2
e 1 6
e 1 3
e 2 4
e 2 5
e 4 5
e 3 6
e 4 8
e 5 7
"""


@pytest.fixture()
def sample(spark, tmp_path):
    (tmp_path / "g.txt").write_text(SAMPLE)
    return from_text(spark, str(tmp_path / "g.txt"), strict=True)


def n(m):
    return m.count().first()["matches"]


def test_sample_graph(sample):
    assert sample.vertices.count() == 9 and sample.edges.count() == 20
    assert sorted(map(tuple, match(sample, Pattern([40, 52, 64], [(0, 1), (0, 2), (1, 2)])).rows().collect())) == [(2, 4, 5)]
    assert sorted(map(tuple, match(sample, Pattern([35, 35], [(0, 1)])).rows().collect())) == [(1, 6), (6, 1)]
    assert n(match(sample, Pattern([35], []))) == 2 and n(match(sample, Pattern([77, 35], [(0, 1)]))) == 0


@pytest.mark.parametrize("seed", range(5))
def test_against_permutations(spark, seed):
    graph, pattern = random_graph(seed), random_pattern(seed + 50, n=3 + seed % 2)
    want = embeddings(graph, pattern)
    g = frames(spark, graph)
    for filter_ in (True, False):
        assert sorted(map(tuple, match(g, pattern, filter=filter_).rows().collect())) == want
        assert n(match(g, pattern, filter=filter_)) == len(want)


@pytest.mark.parametrize("options", [{"method": "BFS", "filter": True}, {"method": "DFS"}, {"method": "degree"}, {"refine": False, "filter": True}, {"adaptive": False}, {"filter": False}, {"filter": True}, {"filter": True, "fold": False}, {"fold": False}, {"refine_rounds": 3, "filter": True}])
def test_options_do_not_change_the_result(spark, options):
    graph = random_graph(11, n=9, labels=2)
    pattern = Pattern([0, 1, 0, 1, 1], [(0, 1), (0, 2), (1, 2), (2, 3), (3, 4)])
    g = frames(spark, graph)
    assert n(match(g, pattern, **options)) == len(embeddings(graph, pattern))


def test_folded_trees(spark):
    graph = random_graph(21, n=9, p=0.6, labels=5)
    for pattern in (Pattern([0, 1, 2, 3], [(0, 1), (1, 2), (2, 3)]), Pattern([0, 1, 2, 0], [(0, 1), (1, 2), (1, 3)]), Pattern([4, 1, 2, 3, 0], [(0, 1), (0, 2), (2, 3), (2, 4)])):
        assert n(match(frames(spark, graph), pattern)) == len(embeddings(graph, pattern))


def test_filters_are_sound_and_exact(spark):
    for seed in (3, 4):
        graph, pattern = random_graph(seed, n=12, p=0.3), random_pattern(seed + 9)
        labels, edges = graph
        near = {v: {b if a == v else a for a, b in edges if v in (a, b)} for v in labels}
        cand = {(u, v) for u in range(len(pattern)) for v in labels if labels[v] == pattern.labels[u] and all(sum(labels[x] == label for x in near[v]) >= k for q, _, label, k in pattern.label_needs() if q == u)}
        g = frames(spark, graph)
        assert {tuple(r) for r in filtering.candidates(g, pattern).collect()} == cand
        e0 = {(u, w, v, x) for _, u, w in pattern.directed() for v in labels for x in near[v] if (u, v) in cand and (w, x) in cand}
        c1 = {(u, v) for u, v in cand if all(any((u, w, v, x) in e0 for x in near[v]) for w in pattern.neighbours(u))}
        e1 = {(u, w, v, x) for u, w, v, x in e0 if (u, v) in c1 and (w, x) in c1}
        ecand = filtering.candidate_edges(g, pattern)
        assert {(r.u, r.w, r.src, r.dst) for r in ecand.collect()} == e0
        assert {(r.u, r.w, r.src, r.dst) for r in filtering.refined(ecand, pattern).collect()} == e1
        for m in embeddings(graph, pattern):
            assert all((u, m[u]) in c1 for u in range(len(pattern)))


def test_limit_and_explain(spark):
    g = frames(spark, random_graph(1))
    m = match(g, Pattern([0, 1], [(0, 1)]))
    assert m.rows(limit=1).count() <= 1 and "group 0" in m.explain()
    with pytest.raises(ValueError):
        match(g, Pattern([0, 1], [(0, 1)]), method="nothing").count()


def test_text_reader(spark, tmp_path):
    loose = tmp_path / "loose.txt"
    loose.write_text("e 1 0\ne 0 1\nt 2 1\ne 1 1\nv 1 5 9\nv 0 5 1\n\n")
    g = from_text(spark, str(loose))
    assert sorted(map(tuple, g.edges.collect())) == [(0, 1), (1, 0)] and g.vertices.count() == 2
    for bad in (SAMPLE + "e 0 1\n", SAMPLE + "e 3 3\n", SAMPLE + "e 0 44\n", SAMPLE.replace("v 7 17 1", "v 7 17 2"), SAMPLE.replace("t 9", "t 8")):
        loose.write_text(bad)
        with pytest.raises(ValueError):
            from_text(spark, str(loose), strict=True)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        from_text(spark, str(tmp_path / "none.txt")).vertices.count()


def test_text_round_trip(spark, tmp_path, sample):
    from graphloom.sources.graphs import write_text

    write_text(sample, str(tmp_path / "out"))
    again = from_text(spark, str(tmp_path / "out"), strict=True)
    assert sorted(map(tuple, again.edges.collect())) == sorted(map(tuple, sample.edges.collect()))
    assert sorted(map(tuple, again.vertices.collect())) == sorted(map(tuple, sample.vertices.collect()))


@pytest.mark.parametrize("seed", range(3))
def test_wedges_against_permutations(spark, seed):
    """Rings and cliques, where wedges are cheaper than lists."""
    graph = random_graph(seed + 30, n=10, p=0.6, labels=2)
    g = frames(spark, graph)
    for pattern in (Pattern([0, 1, 0, 1], [(0, 1), (1, 2), (2, 3), (0, 3)]), Pattern([0, 1, 1, 0, 1], [(0, 1), (0, 2), (1, 2), (0, 3), (0, 4), (3, 4)])):
        want = embeddings(graph, pattern)
        m = match(g, pattern)
        assert sorted(map(tuple, m.rows().collect())) == want and n(match(g, pattern, method="BFS")) == len(want)
        assert seed or any(second is not None for _, _, second, *_ in m._steps(m.plan.backward()))


def test_partial_counts(spark):
    graph = random_graph(2, n=9, p=0.6, labels=2)
    pattern = Pattern([0, 1, 0], [(0, 1), (1, 2), (0, 2)])
    got = [tuple(r) for r in match(frames(spark, graph), pattern, method="BFS").partial_counts().orderBy("group").collect()]
    assert [g[:2] for g in got] == [(0, 1), (1, 2), (2, 3)] and got[-1][2] == len(embeddings(graph, pattern))


@pytest.mark.parametrize("filtered", [False, True])
@pytest.mark.parametrize("seed", range(2))
def test_leaves_of_one_label_are_folded_together(spark, seed, filtered):
    graph = random_graph(seed, n=11, p=0.5, labels=4)
    for pattern in (Pattern([0, 1, 1, 1], [(0, 1), (0, 2), (0, 3)]), Pattern([0, 1, 2, 1, 3], [(0, 1), (0, 2), (0, 3), (1, 4)])):
        m = match(frames(spark, graph), pattern, filter=filtered)
        assert m.count().first()["matches"] == len(embeddings(graph, pattern))
        order, weights = m._folded(m.plan.backward())
        assert [u for u, _ in order] == [0] and set(weights) == {0}


@pytest.mark.parametrize("seed", range(3))
def test_matching_edges_are_the_candidate_edges(spark, seed):
    g, p = frames(spark, random_graph(seed, n=14, p=0.3, labels=2)), random_pattern(seed, n=4, labels=2)
    want = filtering.candidate_edges(g, p)
    for rounds in (0, 1, 2):
        got = {(r["u"], r["w"], r["src"], r["dst"]) for r in filtering.matching_edges(g, p, rounds).collect()}
        assert all(u < w for u, w, *_ in got)
        both = got | {(w, u, b, a) for u, w, a, b in got}
        rows = (want if not rounds else filtering.refined(want, p, rounds)).collect()
        assert both == {(r["u"], r["w"], r["src"], r["dst"]) for r in rows}


def test_no_edge_is_shuffled_where_all_vertices_stay(spark):
    out = spark.createDataFrame([], "u int, v bigint").coalesce(1)
    e = spark.range(100).selectExpr("0 AS qe", "0 AS u", "1 AS w", "id AS src", "id + 1 AS dst")
    out, _ = filtering.written(out, "out")
    plan = filtering._without(e, out)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and plan.count("BroadcastHashJoin") == 2


@pytest.mark.parametrize(
    "labels, edges, left",
    [
        ([0, 1, 2, 3, 4], [(0, 1), (0, 2), (1, 2), (0, 3), (0, 4), (3, 4)], 3),  # two triangles at a vertex
        ([0, 1, 1, 2, 3], [(0, 1), (0, 2), (1, 2), (0, 3), (0, 4), (3, 4)], 3),  # one label twice inside a part
        ([0, 1, 2, 1, 2], [(0, 1), (0, 2), (1, 2), (0, 3), (0, 4), (3, 4)], 5),  # parts that may collide
        ([0, 1, 2, 3, 0, 4], [(0, 1), (0, 2), (1, 2), (2, 3), (3, 4), (2, 4), (3, 5)], 5),  # part and vertex share a label
        ([0, 1, 2, 3, 3, 4], [(0, 1), (0, 2), (1, 2), (2, 3), (3, 4), (2, 4), (3, 5)], 3),  # a part with a leaf
    ],
)
def test_parts_that_hang_on_a_vertex_are_folded(spark, labels, edges, left):
    """Rows of parts that cannot collide never multiply."""
    graph = random_graph(3, n=9, p=0.8, labels=5)
    pattern, g = Pattern(labels, edges), frames(spark, graph)
    want = len(embeddings(graph, pattern))
    m = match(g, pattern)
    assert len(m._folded(m.plan.backward())[0]) == left
    assert n(m) == want == n(match(g, pattern, fold=False))

from graphloom.sources import graphs
from tests.graphs import frames, random_graph


def test_text_is_small_and_labels_are_joined_once_an_edge(spark, tmp_path, monkeypatch):
    labels, edges = random_graph(3, n=12, p=0.5)
    graphs.write_text(frames(spark, (labels, edges)), f"file://{tmp_path}/out")
    assert all(f.name.endswith(".gz") for f in (tmp_path / "out").glob("part-*"))
    g, seen, whole = graphs.from_text(spark, f"file://{tmp_path}/out", strict=True), [], graphs.written

    def written(df, name, *by):
        out = whole(df, name, *by)
        seen.append(out[0].count())
        return out

    monkeypatch.setattr(graphs, "written", written)
    got = sorted(tuple(r) for r in g.labelled_by_steps().select("src", "dst", "ls", "ld").collect())
    assert got == sorted((a, b, labels[a], labels[b]) for e in edges for a, b in (e, e[::-1]))
    # No table holds both directions.
    assert seen == [len(edges)] * 3

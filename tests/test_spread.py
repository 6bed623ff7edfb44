import pytest

from graphloom.operators.matching import match
from graphloom.plans.pattern import Pattern
from graphloom.sources import graphs


@pytest.fixture
def orders(spark, tmp_path):
    """Part 4 has no size, part 5 is in no table of parts."""
    items = [(o, p, 1.0) for o, ps in enumerate([(1, 2, 3), (2, 3, 4), (1, 5), (2, 2, 3), (3, None)]) for p in ps]
    spark.createDataFrame([(1, 11), (2, 12), (3, 13), (4, None)], "p_partkey bigint, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    spark.createDataFrame(items, "l_orderkey bigint, l_partkey bigint, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("rows", (2, 2_000_000))
def test_labels_go_along_with_the_pairs(spark, orders, monkeypatch, rows):
    monkeypatch.setattr(graphs, "PARTITION_ROWS", rows)
    g = graphs.coorder_graph(spark, orders)
    one = {(1, 2), (1, 3), (2, 3), (2, 4), (3, 4), (1, 5)}
    label = {1: 1, 2: 2, 3: 3, 4: None}
    assert sorted(tuple(r) for r in g.edges.collect()) == sorted(one | {(b, a) for a, b in one})
    got = [tuple(r) for r in g.labelled_edges().select("src", "dst", "ls", "ld").collect()]
    assert sorted(got, key=str) == sorted([(a, b, label[a], label[b]) for e in one if 5 not in e for a, b in (e, e[::-1])], key=str)
    assert match(g, Pattern([1, 2, 3], [(0, 1), (1, 2), (0, 2)])).count().first()["matches"] == 1


def test_partitions_grow_with_the_rows(spark, orders, monkeypatch):
    assert int(spark.conf.get("spark.sql.shuffle.partitions")) == 4
    monkeypatch.setattr(graphs, "PARTITION_ROWS", 1)
    # 13 items: as many partitions of items, and PAIRS times as many of pairs, in both directions.
    assert graphs.coorder_graph(spark, orders).edges.rdd.getNumPartitions() == 2 * 13 * graphs.PAIRS
    assert graphs.symmetric(spark.range(9).selectExpr("id src", "id + 1 dst"), 9).rdd.getNumPartitions() == 18


def test_partitions_are_not_put_together(spark, monkeypatch):
    """Where the setting has enough partitions, Spark puts them together for the cores; a task's rows would grow with the input."""
    monkeypatch.setattr(graphs, "PARTITION_ROWS", 1)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        assert graphs.symmetric(spark.range(9).selectExpr("id src", "id + 1 dst"), 9).rdd.getNumPartitions() == 18
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_task_holds_few_rows(spark):
    """Joins of distinct rows keep four copies of a task's rows in memory."""
    assert graphs.spread(spark.range(10), 3_000_000, "id").rdd.getNumPartitions() >= 12

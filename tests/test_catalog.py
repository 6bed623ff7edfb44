import os

import duckdb
import pytest

import __spark_entry__ as entry
from graphloom import catalog

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(str(r[k]) for k in order) for r in data)


#: The smallest tables give the densest graph, with many cliques of four; test_hierarchy.py and test_peeling_primitives.py have these on small graphs.
DENSE = ("truss_numbers", "nucleus_numbers", "nuclei_truss", "nucleus34")


@pytest.mark.parametrize("name", [n for n in catalog.ORACLE_SQL if not n.startswith("mode_") and n not in DENSE])
def test_query_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    want = duck.execute(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).first()["matches"] == 22_649
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_works_without_the_data_operators(tmp_path):
    """The entry module, with the llm folders gone, still lists the graph queries."""
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in ("graphloom", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", f"{root}/{name}", str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "graphloom/llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'match_triangle' in q and not any(n.startswith('op') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})

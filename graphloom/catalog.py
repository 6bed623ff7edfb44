"""The graph queries and their SQL."""

from __future__ import annotations

import math
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import graph_stats
from graphloom.operators import filtering, hierarchy, peeling
from graphloom.operators import primitives as prim
from graphloom.operators.matching import match
from graphloom.plans.pattern import Pattern
from graphloom.sources.graphs import coorder_graph, from_text, trade_graph, write_text
from graphloom.sources.shared import new_path

SPARSE_QUANTITY = 40

# The graphs as SQL: v(id, label) and e(src, dst, ls, ld).
TRADE_SQL = """
v AS MATERIALIZED (
  SELECT CAST(r_regionkey AS BIGINT) AS id, CAST(0 AS BIGINT) AS label FROM region
  UNION ALL SELECT n_nationkey + 1000000000, 1 FROM nation UNION ALL SELECT c_custkey + 2000000000, 2 FROM customer
  UNION ALL SELECT s_suppkey + 3000000000, 3 FROM supplier UNION ALL SELECT o_orderkey + 4000000000, 4 FROM orders
  UNION ALL SELECT p_partkey + 5000000000, 5 FROM part),
one AS MATERIALIZED (
  SELECT n_nationkey + 1000000000 AS src, CAST(n_regionkey AS BIGINT) AS dst FROM nation
  UNION SELECT c_custkey + 2000000000, c_nationkey + 1000000000 FROM customer UNION SELECT s_suppkey + 3000000000, s_nationkey + 1000000000 FROM supplier
  UNION SELECT o_orderkey + 4000000000, o_custkey + 2000000000 FROM orders UNION SELECT l_orderkey + 4000000000, l_partkey + 5000000000 FROM lineitem
  UNION SELECT l_orderkey + 4000000000, l_suppkey + 3000000000 FROM lineitem UNION SELECT l_partkey + 5000000000, l_suppkey + 3000000000 FROM lineitem),
e AS MATERIALIZED (
  SELECT src, dst, src // 1000000000 AS ls, dst // 1000000000 AS ld FROM one
  UNION ALL SELECT dst, src, dst // 1000000000, src // 1000000000 FROM one)"""


def _coorder_sql(where: str = "true") -> str:
    return f"""
v AS (SELECT p_partkey AS id, CAST(p_size % 5 AS BIGINT) AS label FROM part),
i AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem WHERE {where}),
e AS MATERIALIZED (
  SELECT DISTINCT a.p AS src, b.p AS dst, x.label AS ls, y.label AS ld
  FROM i a JOIN i b ON a.o = b.o AND a.p <> b.p JOIN v x ON x.id = a.p JOIN v y ON y.id = b.p)"""


GRAPHS = {
    "trade": (trade_graph, TRADE_SQL),
    "coorder": (coorder_graph, _coorder_sql()),
    "sparse": (partial(coorder_graph, least_quantity=SPARSE_QUANTITY), _coorder_sql(f"l_quantity >= {SPARSE_QUANTITY}")),
}

PATTERNS = {
    "edge": ("trade", Pattern([4, 5], [(0, 1)])),
    "path3": ("trade", Pattern([3, 1, 2], [(0, 1), (1, 2)])),
    "path5": ("trade", Pattern([0, 1, 2, 4, 5], [(0, 1), (1, 2), (2, 3), (3, 4)])),
    "star3": ("trade", Pattern([4, 5, 5, 5], [(0, 1), (0, 2), (0, 3)])),
    "triangle": ("trade", Pattern([4, 5, 3], [(0, 1), (0, 2), (1, 2)])),
    "triangle_same_label": ("coorder", Pattern([0, 0, 0], [(0, 1), (0, 2), (1, 2)])),
    "triangle_labels": ("coorder", Pattern([0, 1, 2], [(0, 1), (0, 2), (1, 2)])),
    "cycle4": ("trade", Pattern([4, 5, 4, 3], [(0, 1), (1, 2), (2, 3), (0, 3)])),
    "cycle4_same_label": ("coorder", Pattern([0, 1, 0, 1], [(0, 1), (1, 2), (2, 3), (0, 3)])),
    "cycle4_sparse": ("sparse", Pattern([0, 1, 2, 3], [(0, 1), (1, 2), (2, 3), (0, 3)])),
    "cycle4_coorder": ("coorder", Pattern([0, 1, 2, 3], [(0, 1), (1, 2), (2, 3), (0, 3)])),
    "clique4": ("coorder", Pattern([0, 1, 2, 3], [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)])),
    "tailed_triangle": ("trade", Pattern([4, 5, 3, 1], [(0, 1), (0, 2), (1, 2), (2, 3)])),
    "tailed_triangle_sparse": ("sparse", Pattern([0, 1, 2, 3], [(0, 1), (0, 2), (1, 2), (2, 3)])),
    "tailed_triangle_coorder": ("coorder", Pattern([0, 1, 2, 3], [(0, 1), (0, 2), (1, 2), (2, 3)])),
    "bowtie": ("coorder", Pattern([0, 1, 2, 3, 4], [(0, 1), (0, 2), (1, 2), (0, 3), (0, 4), (3, 4)])),
    "tree5": ("trade", Pattern([1, 2, 3, 2, 4], [(0, 1), (0, 2), (0, 3), (1, 4)])),
    "empty": ("trade", Pattern([0, 5], [(0, 1)])),
    "absent_label": ("trade", Pattern([99, 4], [(0, 1)])),
}
ROWS = ("edge", "path3", "triangle", "cycle4_sparse", "tailed_triangle_sparse", "triangle_labels", "cycle4_coorder", "tailed_triangle_coorder")
MODES = {
    "mode_bfs": {"method": "BFS", "filter": True},
    "mode_dfs": {"method": "DFS", "filter": True},
    "mode_degree": {"method": "degree", "filter": True},
    "mode_nof3": {"refine": False, "filter": True},
    "mode_noao": {"adaptive": False, "filter": True},
    "mode_filter": {"filter": True},
    "mode_nofilter": {"filter": False},
    "mode_f3start": {"refine_start": 1, "filter": True},
    "mode_rounds3": {"refine_rounds": 3, "filter": True},
    "mode_nofold": {"fold": False},
}


ONE_ROUND = ("clique4", "cycle4", "cycle4_same_label")
REPLANNED = ("tailed_triangle", "bowtie")


def count_query(name: str, spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    graph, pattern = PATTERNS[name]
    return match(GRAPHS[graph][0](spark, sf_dir), pattern, **options).count()


def rows_query(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    graph, pattern = PATTERNS[name]
    return match(GRAPHS[graph][0](spark, sf_dir), pattern).rows()


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two triangles at a vertex, in batches of expected rows, counted by the image of that vertex."""
    m = match(coorder_graph(spark, sf_dir), PATTERNS["bowtie"][1])
    found = m.rows_in_batches(new_path(spark, "batches"), budget=4_000_000)
    return found.groupBy("u0").agg(F.count("*").alias("n"))


def pattern_sql(name: str, rows: bool = False) -> str:
    """Self-joins of the edge view, one for each pattern edge."""
    graph, p = PATTERNS[name]
    where = [f"e{k}.ls = {p.labels[a]} AND e{k}.ld = {p.labels[b]}" for k, (a, b) in enumerate(p.edges)]
    place: dict[int, str] = {}
    for k, (a, b) in enumerate(p.edges):
        for u, col in ((a, f"e{k}.src"), (b, f"e{k}.dst")):
            if u in place:
                where.append(f"{place[u]} = {col}")
            else:
                place[u] = col
    where += [f"{place[a]} <> {place[b]}" for a, b in p.same_label_pairs()]
    what = ", ".join(f"{place[u]} AS u{u}" for u in range(len(p))) if rows else "CAST(count(*) AS BIGINT) AS matches"
    return f"WITH {GRAPHS[graph][1]} SELECT {what} FROM {', '.join(f'e e{k}' for k in range(len(p.edges)))} WHERE {' AND '.join(where)}"


def _need(p: Pattern, u: int) -> str:
    return " AND ".join(f"(SELECT count(*) FROM e x WHERE x.src = v.id AND x.ld = {label}) >= {n}" for q, _, label, n in p.label_needs() if q == u)


def _cand_sql(p: Pattern) -> str:
    parts = []
    for u in range(len(p)):
        needs = [(label, n) for q, _, label, n in p.label_needs() if q == u]
        having = " AND ".join(f"count(*) FILTER (WHERE ld = {label}) >= {n}" for label, n in needs)
        parts.append(f"SELECT CAST({u} AS INTEGER) AS u, src AS v FROM e WHERE ls = {p.labels[u]} GROUP BY src HAVING {having}")
    return "cand AS (" + " UNION ALL ".join(parts) + ")"


def _ecand_sql(p: Pattern) -> str:
    values = ", ".join(f"({k}, {u}, {w}, {p.labels[u]}, {p.labels[w]})" for k, u, w in p.directed())
    degrees = " ".join(f"WHEN {u} THEN {p.degree(u)}" for u in range(len(p)))
    return f"""{_cand_sql(p)},
q(qe, u, w, lu, lw) AS (VALUES {values}),
ec AS (SELECT q.qe, q.u, q.w, e.src, e.dst FROM e JOIN q ON e.ls = q.lu AND e.ld = q.lw
       WHERE EXISTS (SELECT 1 FROM cand c WHERE c.u = q.u AND c.v = e.src) AND EXISTS (SELECT 1 FROM cand c WHERE c.u = q.w AND c.v = e.dst)),
c1 AS (SELECT u, src AS v FROM ec GROUP BY u, src HAVING count(DISTINCT qe) = CASE u {degrees} END),
er AS (SELECT ec.* FROM ec WHERE EXISTS (SELECT 1 FROM c1 WHERE c1.u = ec.u AND c1.v = ec.src) AND EXISTS (SELECT 1 FROM c1 WHERE c1.u = ec.w AND c1.v = ec.dst))"""


_P = PATTERNS["tailed_triangle_sparse"][1]
_SPARSE = GRAPHS["sparse"][1]
_COORDER = GRAPHS["coorder"][1]
_CLIQUES = "SELECT count(*) AS cliques FROM e a, e b, e c, e x, e y, e z WHERE a.src < a.dst AND a.dst = b.src AND b.src < b.dst AND b.dst = c.src AND c.src < c.dst AND x.src = a.src AND x.dst = b.dst AND y.src = a.src AND y.dst = c.dst AND z.src = a.dst AND z.dst = c.dst"


def _sparse(spark, sf_dir):
    return GRAPHS["sparse"][0](spark, sf_dir)


def _refined(spark, sf_dir, graph="sparse"):
    return filtering.refined(filtering.candidate_edges(GRAPHS[graph][0](spark, sf_dir), _P), _P)


def _items(spark, sf_dir, *columns):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", *columns)


def _ordered(spark, sf_dir, *columns):
    # Order and line number are not unique in this data, so every column takes part in the
    # order; rows equal in all of them all stay, and which comes first makes no difference.
    return prim.Ordered(_items(spark, sf_dir, *columns), "l_orderkey", "l_linenumber", *columns)


def _qty():
    return F.col("l_quantity").cast("bigint")


_QTY_ROWS = "(SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem)"
_FLAG_ROWS = "(SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity, row_number() OVER () AS _copy FROM lineitem)"
_QTY_ORDER = "l_orderkey, l_linenumber, l_quantity"
_FLAG_ORDER = "l_orderkey, l_linenumber, l_returnflag, l_quantity, _copy"
_RUNS = f"""r AS (SELECT *, CASE WHEN l_returnflag IS NOT DISTINCT FROM lag(l_returnflag) OVER (ORDER BY {_FLAG_ORDER})
                        AND row_number() OVER (ORDER BY {_FLAG_ORDER}) > 1 THEN 0 ELSE 1 END AS head FROM {_FLAG_ROWS}),
n AS (SELECT *, CAST(sum(head) OVER (ORDER BY {_FLAG_ORDER} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM r)"""


def _flags(spark, sf_dir):
    return _ordered(spark, sf_dir, "l_returnflag", "l_quantity")


# All columns take part in the order, so that no row is left out; rows equal in all of them are numbered.
_ALL = ("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax", "l_linestatus", "l_shipdate")
_ALL_ORDER = ", ".join(_ALL)
_ALL_ROWS = f"(SELECT {_ALL_ORDER}, row_number() OVER (PARTITION BY {_ALL_ORDER}) AS _copy FROM lineitem)"
_ALL_RUNS = _RUNS.replace(_FLAG_ROWS, _ALL_ROWS).replace(f"ORDER BY {_FLAG_ORDER}", f"ORDER BY {_ALL_ORDER}, _copy")
_KEY_SUM = "CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY run ORDER BY " + _ALL_ORDER + ", _copy ROWS BETWEEN UNBOUNDED PRECEDING AND {} PRECEDING), 0) AS BIGINT) AS total"
_ROW = "l_orderkey, l_linenumber, l_returnflag, l_quantity"


def _all(spark, sf_dir):
    return prim.Ordered(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*_ALL), *_ALL)


def _flagged(spark, sf_dir):
    return _items(spark, sf_dir, "l_quantity").withColumn("flag", (F.col("l_linenumber") % 3 == 0).cast("int"))


def _by_custkey(spark, sf_dir):
    orders = _orders(spark, sf_dir).select("o_custkey", "o_orderkey", "o_totalprice")
    return prim.Ordered(orders, "o_custkey", "o_orderkey")


def _text_round_trip(spark, sf_dir):
    """The trade graph through its text form and back."""
    path = new_path(spark, "graph-text")
    write_text(trade_graph(spark, sf_dir), path)
    return from_text(spark, path).labelled_by_steps()


#: Peels of vertices, and of edges and triangles, ask for this share of the mean support, which drops some and keeps some.
CORE_SHARE, CLIQUE_SHARE = 0.7, 0.5


def _kcore(spark, sf_dir):
    share = lambda links, vertices: math.ceil(CORE_SHARE * links / max(vertices, 1))
    return peeling.k_core(coorder_graph(spark, sf_dir), share)


def _ktruss(spark, sf_dir):
    """Edges in enough triangles, of which each has three."""
    share = lambda triangles, edges: 2 + math.ceil(CLIQUE_SHARE * 3 * triangles / max(edges, 1))
    return peeling.k_truss(coorder_graph(spark, sf_dir), share)


def _nucleus34(spark, sf_dir):
    """Triangles in enough cliques of four vertices, each of which has four."""
    share = lambda cliques, triangles: math.ceil(CLIQUE_SHARE * 4 * cliques / max(triangles, 1))
    return peeling.nucleus34(coorder_graph(spark, sf_dir), share)


# Peeling in SQL: each round keeps what still has support, and ends when a round drops nothing or all is dropped.
_KCORE_SQL = f"""WITH RECURSIVE {_COORDER},
k AS MATERIALIZED (SELECT CAST(ceil({CORE_SHARE} * count(*) / count(DISTINCT src)) AS BIGINT) AS k FROM e),
r(i, src, dst) AS (
  SELECT 0, src, dst FROM e
  UNION ALL
  SELECT i + 1, src, dst FROM (
    SELECT *, min(least(a, b)) OVER () AS low FROM (SELECT *, count(*) OVER (PARTITION BY src) AS a, count(*) OVER (PARTITION BY dst) AS b FROM r))
  WHERE low < (SELECT k FROM k) AND a >= (SELECT k FROM k) AND b >= (SELECT k FROM k)),
s AS MATERIALIZED (SELECT src AS id, count(*) AS degree FROM r WHERE i = (SELECT max(i) FROM r) GROUP BY src)
SELECT id, degree FROM s WHERE (SELECT min(degree) FROM s) >= (SELECT k FROM k)"""

# The h-index of the neighbours' values, until nothing changes.
_CORE_SQL = f"""WITH RECURSIVE {_COORDER},
r(i, id, core, changed) AS (
  SELECT 0, src, count(*), 1 FROM e GROUP BY src
  UNION ALL
  SELECT i + 1, id, h, CAST(sum(CASE WHEN h <> core THEN 1 ELSE 0 END) OVER () AS BIGINT) FROM (
    SELECT any_value(i) AS i, src AS id, any_value(own) AS core, max(least(value, place)) AS h FROM (
      SELECT r.i, e.src, o.core AS own, r.core AS value, row_number() OVER (PARTITION BY e.src ORDER BY r.core DESC) AS place
      FROM e JOIN r ON r.id = e.dst JOIN r o ON o.id = e.src WHERE r.changed > 0) GROUP BY src))
SELECT v.id, CAST(coalesce(l.core, 0) AS BIGINT) AS core FROM v LEFT JOIN (SELECT id, core FROM r WHERE i = (SELECT max(i) FROM r)) l ON l.id = v.id"""

# Shells of equal core number, peeled side by side: w holds, round by round, the vertices that are left with their neighbours of higher shells.
_DEGENERACY_SQL = f"""{_CORE_SQL[: _CORE_SQL.index("SELECT v.id")].rstrip()},
c AS MATERIALIZED ({_CORE_SQL[_CORE_SQL.index("SELECT v.id") :]}),
g AS MATERIALIZED (SELECT e.src, e.dst, a.core AS sc, b.core AS dc FROM e JOIN c a ON a.id = e.src JOIN c b ON b.id = e.dst),
w(layer, id, core, above, goes) AS (
  SELECT CAST(1 AS BIGINT), c.id, c.core, count(g.src) FILTER (g.dc > g.sc), count(g.src) FILTER (g.dc >= g.sc) <= c.core FROM c LEFT JOIN g ON g.src = c.id GROUP BY c.id, c.core
  UNION ALL
  SELECT l.layer + 1, l.id, l.core, any_value(l.above), any_value(l.above) + count(o.id) <= l.core
  FROM w l LEFT JOIN g ON g.src = l.id AND g.sc = g.dc LEFT JOIN w o ON o.id = g.dst AND NOT o.goes
  WHERE NOT l.goes GROUP BY l.layer, l.id, l.core),
p AS MATERIALIZED (SELECT id, core, layer, row_number() OVER (ORDER BY core, layer, id) AS position FROM w WHERE goes)
SELECT p.id, p.core, p.layer, p.position, count(q.id) AS later
FROM p LEFT JOIN e ON e.src = p.id LEFT JOIN p q ON q.id = e.dst AND q.position > p.position GROUP BY p.id, p.core, p.layer, p.position"""

_TRIANGLES = "t AS MATERIALIZED (SELECT a.src AS x, a.dst AS y, b.dst AS z FROM e a JOIN e b ON a.dst = b.src AND a.src < a.dst AND b.src < b.dst JOIN e c ON c.src = a.src AND c.dst = b.dst)"
_KTRUSS_SQL = f"""WITH RECURSIVE {_COORDER}, {_TRIANGLES},
k AS MATERIALIZED (SELECT CAST(ceil({CLIQUE_SHARE} * 3 * (SELECT count(*) FROM t) / (SELECT count(*) / 2 FROM e)) AS BIGINT) AS k),
r(i, x, y, z) AS (
  SELECT 0, x, y, z FROM t
  UNION ALL
  SELECT i + 1, x, y, z FROM (
    SELECT any_value(i) AS i, x, y, z, min(n) AS n, min(min(n)) OVER () AS low FROM (
      SELECT i, x, y, z, count(*) OVER (PARTITION BY p.a, p.b) AS n FROM (SELECT i, x, y, z, unnest([{{'a': x, 'b': y}}, {{'a': x, 'b': z}}, {{'a': y, 'b': z}}]) AS p FROM r))
    GROUP BY x, y, z)
  WHERE low < (SELECT k FROM k) AND n >= (SELECT k FROM k)),
last AS (SELECT unnest([{{'a': x, 'b': y}}, {{'a': x, 'b': z}}, {{'a': y, 'b': z}}]) AS p FROM r WHERE i = (SELECT max(i) FROM r)),
s AS MATERIALIZED (SELECT p.a AS a, p.b AS b, count(*) AS n FROM last GROUP BY 1, 2)
SELECT a, b FROM s WHERE (SELECT min(n) FROM s) >= (SELECT k FROM k)"""

_FOUR = "f AS MATERIALIZED (SELECT s.x, s.y, s.z, o.z AS w FROM t s JOIN t o ON s.x = o.x AND s.y = o.y AND s.z < o.z JOIN e ON e.src = s.z AND e.dst = o.z)"
_FACES = "unnest([{'a': x, 'b': y, 'c': z}, {'a': x, 'b': y, 'c': w}, {'a': x, 'b': z, 'c': w}, {'a': y, 'b': z, 'c': w}])"
_NUCLEUS_SQL = f"""WITH RECURSIVE {_COORDER}, {_TRIANGLES}, {_FOUR},
k AS MATERIALIZED (SELECT CAST(ceil({CLIQUE_SHARE} * 4 * (SELECT count(*) FROM f) / (SELECT count(*) FROM t)) AS BIGINT) AS k),
r(i, x, y, z, w) AS (
  SELECT 0, x, y, z, w FROM f
  UNION ALL
  SELECT i + 1, x, y, z, w FROM (
    SELECT any_value(i) AS i, x, y, z, w, min(n) AS n, min(min(n)) OVER () AS low FROM (
      SELECT i, x, y, z, w, count(*) OVER (PARTITION BY p) AS n FROM (SELECT i, x, y, z, w, {_FACES} AS p FROM r))
    GROUP BY x, y, z, w)
  WHERE low < (SELECT k FROM k) AND n >= (SELECT k FROM k)),
s AS MATERIALIZED (SELECT p.a AS x, p.b AS y, p.c AS z, count(*) AS n FROM (SELECT {_FACES} AS p FROM r WHERE i = (SELECT max(i) FROM r)) GROUP BY 1, 2, 3)
SELECT x, y, z FROM s WHERE (SELECT min(n) FROM s) >= (SELECT k FROM k)"""

# c(id, v0, ...): the r-cliques, numbered in the order of their vertices; m(q, id): those in each (r + 1)-clique.
_MEMBERS_SQL = {
    1: f"{_COORDER}, c AS (SELECT id, id AS v0 FROM v), m AS MATERIALIZED (SELECT q, unnest([src, dst]) AS id FROM (SELECT row_number() OVER () AS q, src, dst FROM e WHERE src < dst))",
    2: f"""{_COORDER}, {_TRIANGLES},
c AS MATERIALIZED (SELECT row_number() OVER (ORDER BY src, dst) AS id, src AS v0, dst AS v1 FROM e WHERE src < dst),
s AS (SELECT row_number() OVER () AS q, * FROM t),
m AS MATERIALIZED (SELECT q, c.id FROM (SELECT q, unnest([{{'a': x, 'b': y}}, {{'a': x, 'b': z}}, {{'a': y, 'b': z}}]) AS p FROM s) JOIN c ON c.v0 = p.a AND c.v1 = p.b)""",
    3: f"""{_COORDER}, {_TRIANGLES}, {_FOUR},
c AS MATERIALIZED (SELECT row_number() OVER (ORDER BY x, y, z) AS id, x AS v0, y AS v1, z AS v2 FROM t),
s AS (SELECT row_number() OVER () AS q, * FROM f),
m AS MATERIALIZED (SELECT q, c.id FROM (SELECT q, {_FACES} AS p FROM s) JOIN c ON c.v0 = p.a AND c.v1 = p.b AND c.v2 = p.c)""",
}
# The h-index of the least values of the other members, until nothing changes.
_ROUNDS_SQL = """r(i, id, n, changed) AS (
  SELECT 0, id, count(*), 1 FROM m GROUP BY id
  UNION ALL
  SELECT i + 1, id, h, CAST(sum(CASE WHEN h <> n THEN 1 ELSE 0 END) OVER () AS BIGINT) FROM (
    SELECT any_value(i) AS i, id, any_value(n) AS n, max(least(passed, place)) AS h FROM (
      SELECT i, id, n, passed, row_number() OVER (PARTITION BY id ORDER BY passed DESC) AS place FROM (
        SELECT i, id, n, CASE WHEN n = v[1] THEN v[2] ELSE v[1] END AS passed FROM (
          SELECT r.i, m.id, r.n, list_sort(list(r.n) OVER (PARTITION BY m.q)) AS v FROM m JOIN r ON r.id = m.id WHERE r.changed > 0))) GROUP BY id)),
n AS MATERIALIZED (SELECT id, n FROM r WHERE i = (SELECT max(i) FROM r))"""


def _numbers_sql(r: int) -> str:
    return f"WITH RECURSIVE {_MEMBERS_SQL[r]}, {_ROUNDS_SQL} SELECT {', '.join(f'c.v{k}' for k in range(r))}, CAST(coalesce(n.n, 0) AS BIGINT) AS number FROM c LEFT JOIN n ON n.id = c.id"


def _nuclei_sql(r: int) -> str:
    """Components at every level at once, by passing on the least id."""
    points = "UNION".join(f" SELECT l.k, l.root, c.v{k} AS x FROM l JOIN c ON c.id = l.id " for k in range(r))
    n_edges = "SELECT l.k, l.root, count(*) AS n_edges FROM j JOIN l ON l.id = j.a AND j.w >= l.k GROUP BY 1, 2" if r == 1 else "SELECT k, root, count(*) AS n_edges FROM l GROUP BY 1, 2"
    name = "concat_ws('-', " + ", ".join(f"c.v{k}" for k in range(r)) + ")"
    return f"""WITH RECURSIVE {_MEMBERS_SQL[r]}, {_ROUNDS_SQL},
g AS (SELECT q, min(m.id) AS a, min(n) AS w, list(m.id) AS ids FROM m JOIN n ON n.id = m.id GROUP BY q),
j AS MATERIALIZED (SELECT a, b, max(w) AS w FROM (SELECT a, unnest(ids) AS b, w FROM g) WHERE a <> b GROUP BY a, b),
both_ways AS MATERIALIZED (SELECT a, b, w FROM j UNION ALL SELECT b, a, w FROM j),
d(i, k, id, root, changed) AS (
  SELECT 0, k, id, id, 1 FROM (SELECT DISTINCT n AS k FROM n) JOIN n ON n.n >= k
  UNION ALL
  SELECT i + 1, k, id, new, CAST(sum(CASE WHEN new <> root THEN 1 ELSE 0 END) OVER () AS BIGINT) FROM (
    SELECT any_value(d.i) AS i, d.k, d.id, any_value(d.root) AS root, least(any_value(d.root), min(o.root)) AS new
    FROM d JOIN both_ways x ON x.a = d.id AND x.w >= d.k JOIN d o ON o.k = d.k AND o.id = x.b WHERE d.changed > 0 GROUP BY d.k, d.id)),
l AS MATERIALIZED (SELECT k, id, root FROM d WHERE i = (SELECT max(i) FROM d)),
u AS MATERIALIZED (SELECT l.k, l.root FROM l JOIN n ON n.id = l.id GROUP BY 1, 2 HAVING min(n.n) = l.k),
up AS (SELECT u.k, u.root, max(p.k) AS up_k, max_by(p.root, p.k) AS up_root FROM u JOIN l ON l.id = u.root AND l.k < u.k JOIN u p ON p.k = l.k AND p.root = l.root GROUP BY 1, 2),
nv AS (SELECT k, root, count(*) AS n_vertices FROM ({points}) GROUP BY 1, 2),
ne AS ({n_edges}),
names AS (SELECT c.id, {name} AS name FROM c)
SELECT u.k || ':' || a.name AS id, up.up_k || ':' || b.name AS parent, CAST(u.k AS BIGINT) AS k, n_vertices, n_edges, 2 * n_edges / (n_vertices * (n_vertices - 1)) AS density
FROM u JOIN nv ON nv.k = u.k AND nv.root = u.root JOIN ne ON ne.k = u.k AND ne.root = u.root JOIN names a ON a.id = u.root
LEFT JOIN up ON up.k = u.k AND up.root = u.root LEFT JOIN names b ON b.id = up.up_root"""


def _orders(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


QUERIES = {
    "graph_vertices": lambda s, d: trade_graph(s, d).vertices,
    "graph_edges": lambda s, d: trade_graph(s, d).edges,
    "graph_edges_coorder": lambda s, d: coorder_graph(s, d).labelled_edges(),
    "label_freq": lambda s, d: graph_stats.label_frequency(trade_graph(s, d)),
    "edge_label_freq": lambda s, d: graph_stats.edge_label_frequency(trade_graph(s, d)),
    "vertex_degree": lambda s, d: graph_stats.vertex_degree(trade_graph(s, d)),
    "max_degree": lambda s, d: graph_stats.max_degree(trade_graph(s, d)),
    "max_label_freq": lambda s, d: graph_stats.label_summary(trade_graph(s, d)),
    "nlf": lambda s, d: graph_stats.neighbour_labels(trade_graph(s, d).labelled_edges()),
    "cand_nlf": lambda s, d: filtering.candidates(_sparse(s, d), _P),
    "cand_edges": lambda s, d: filtering.candidate_edges(_sparse(s, d), _P),
    "cand_edges_refined": _refined,
    "cand_first": lambda s, d: filtering.first_candidates(_refined(s, d), 2),
    "cand_stats": lambda s, d: filtering.candidate_stats(_refined(s, d)),
    "cand_counts": lambda s, d: filtering.candidate_counts(filtering.candidates(_sparse(s, d), _P)),
    "cand_counts_coorder": lambda s, d: filtering.candidate_counts(filtering.candidates(coorder_graph(s, d), _P)),
    "match_partial_counts": lambda s, d: match(trade_graph(s, d), PATTERNS["triangle"][1], method="BFS", filter=False).partial_counts(),
    **{f"match_{n}_one_round": partial(count_query, n, one_round=True) for n in ONE_ROUND},
    **{f"match_{n}_replanned": partial(count_query, n, replan=True) for n in REPLANNED},
    "match_triangle_labels_one_round_rows": lambda s, d: match(coorder_graph(s, d), PATTERNS["triangle_labels"][1], one_round=True).rows(),
    "match_bowtie_batches": _batches,
    "graph_text_round_trip": _text_round_trip,
    "truss_numbers": lambda s, d: hierarchy.numbers(coorder_graph(s, d), 2),
    "nucleus_numbers": lambda s, d: hierarchy.numbers(coorder_graph(s, d), 3),
    "nuclei_core": lambda s, d: hierarchy.nuclei(coorder_graph(s, d), 1),
    "nuclei_truss": lambda s, d: hierarchy.nuclei(coorder_graph(s, d), 2),
    "cand_nlf_coorder": lambda s, d: filtering.candidates(coorder_graph(s, d), _P),
    "cand_edges_coorder": lambda s, d: filtering.candidate_edges(coorder_graph(s, d), _P),
    "cand_edges_refined_coorder": partial(_refined, graph="coorder"),
    "cand_first_coorder": lambda s, d: filtering.first_candidates(_refined(s, d, "coorder"), 2),
    "cand_stats_coorder": lambda s, d: filtering.candidate_stats(_refined(s, d, "coorder")),
    **{f"match_{n}": partial(count_query, n) for n in PATTERNS},
    **{f"match_{n}_rows": partial(rows_query, n) for n in ROWS},
    **{m: partial(count_query, "tailed_triangle", **o) for m, o in MODES.items()},
    "kcore": _kcore,
    "core_numbers": lambda s, d: peeling.core_numbers(coorder_graph(s, d)),
    "degeneracy_order": lambda s, d: peeling.degeneracy_order(coorder_graph(s, d)),
    "ktruss": _ktruss,
    "nucleus34": _nucleus34,
    "triangle_count": lambda s, d: peeling.triangle_count(coorder_graph(s, d)),
    "clique4_count": lambda s, d: peeling.four_clique_count(_sparse(s, d)),
    "clique4_count_coorder": lambda s, d: peeling.four_clique_count(coorder_graph(s, d)),
    "prim_select_if": lambda s, d: _items(s, d, "l_quantity").filter("l_quantity >= 40"),
    "prim_select_unique": lambda s, d: prim.unique(_flags(s, d), "l_returnflag"),
    "prim_exclusive_sum": lambda s, d: _ordered(s, d, "l_quantity").scan(_qty(), "total", inclusive=False),
    "prim_inclusive_sum": lambda s, d: _ordered(s, d, "l_quantity").scan(_qty(), "total"),
    "prim_sort_keys": lambda s, d: prim.Ordered(_orders(s, d).select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey").position("position"),
    "prim_reduce_sum": lambda s, d: _items(s, d, "l_quantity").agg(F.sum(_qty()).alias("total"), F.min(_qty()).alias("least"), F.max(_qty()).alias("most")),
    "prim_argmin": lambda s, d: _orders(s, d).agg(F.min_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("least"), F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("most")),
    "prim_reduce_by_key": lambda s, d: prim.reduce_by_key(_flags(s, d), "l_returnflag", _qty()),
    "prim_rle": lambda s, d: prim.run_lengths(_flags(s, d), "l_returnflag"),
    "prim_rle_nontrivial": lambda s, d: prim.run_lengths(_flags(s, d), "l_returnflag").filter("length > 1"),
    "prim_select_unique_all": lambda s, d: prim.unique(_all(s, d), "l_returnflag"),
    "prim_exclusive_sum_all": lambda s, d: _all(s, d).scan(_qty(), "total", inclusive=False),
    "prim_inclusive_sum_all": lambda s, d: _all(s, d).scan(_qty(), "total"),
    "prim_reduce_by_key_all": lambda s, d: prim.reduce_by_key(_all(s, d), "l_returnflag", _qty()),
    "prim_rle_all": lambda s, d: prim.run_lengths(_all(s, d), "l_returnflag"),
    "prim_rle_nontrivial_all": lambda s, d: prim.run_lengths(_all(s, d), "l_returnflag").filter("length > 1"),
    "prim_adjacent_diff_all": lambda s, d: _all(s, d).before(_qty(), "_b").select(*_ALL, (_qty() - F.coalesce("_b", F.lit(0))).alias("diff")),
    "prim_scan_max": lambda s, d: _all(s, d).scan_by(_qty(), "most"),
    "prim_scan_min": lambda s, d: _all(s, d).scan_by(_qty(), "least", F.min),
    "prim_scan_max_exclusive": lambda s, d: _all(s, d).scan_by(_qty(), "most", inclusive=False),
    "prim_inclusive_sum_by_key": lambda s, d: _all(s, d).scan_by_key("l_returnflag", _qty(), "total"),
    "prim_exclusive_sum_by_key": lambda s, d: _all(s, d).scan_by_key("l_returnflag", _qty(), "total", inclusive=False),
    "prim_max_by_key": lambda s, d: _all(s, d).scan_by_key("l_returnflag", _qty(), "most", reduce=F.max),
    "prim_min_by_key_exclusive": lambda s, d: _all(s, d).scan_by_key("l_returnflag", _qty(), "least", inclusive=False, reduce=F.min),
    "prim_sum_by_key_nan": lambda s, d: _all(s, d).scan_by_key("l_returnflag", F.when(F.col("l_orderkey") % 97 == 0, float("nan")).otherwise(F.col("l_quantity")), "total"),
    "prim_scan_xor": lambda s, d: _all(s, d).scan_by(F.col("l_partkey"), "mixed", F.bit_xor),
    "prim_segmented_sort_large": lambda s, d: prim.segmented_sort(_orders(s, d).select("o_orderpriority", "o_orderkey", "o_totalprice"), "o_orderpriority", F.desc("o_totalprice"), "o_orderkey"),
    "prim_sort_keys_descending": lambda s, d: prim.Ordered(_orders(s, d).select("o_orderkey", (-F.col("o_custkey")).alias("down"), "o_custkey"), "down", "o_orderkey").position("position").drop("down"),
    "prim_sort_pairs": lambda s, d: _by_custkey(s, d).position("position"),
    "prim_select_flagged": lambda s, d: prim.select_flagged(_flagged(s, d), "flag"),
    "prim_partition_flagged": lambda s, d: prim.partition_flagged(_flagged(s, d), "flag"),
    "prim_unique_by_key": lambda s, d: prim.unique(_by_custkey(s, d), "o_custkey"),
    "prim_right_diff": lambda s, d: _all(s, d).after(_qty(), "_a").select(*_ALL, (_qty() - F.coalesce("_a", F.lit(0))).alias("diff")),
    "prim_segmented_arg": lambda s, d: prim.segmented_arg(_orders(s, d), "o_custkey", "o_totalprice", "o_orderkey"),
    "prim_histogram_multi": lambda s, d: prim.histogram_multi(_items(s, d, "l_quantity", "l_discount"), {"quantity": (F.col("l_quantity"), 0.0, 50.0, 10), "line": (F.col("l_linenumber").cast("double"), 1.0, 5.0, 4)}),
    "prim_histogram": lambda s, d: prim.histogram_even(_items(s, d, "l_quantity"), F.col("l_quantity"), 0.0, 50.0, 10),
    "prim_histogram_range": lambda s, d: prim.histogram_range(_items(s, d, "l_quantity"), F.col("l_quantity"), [0.0, 5.0, 20.0, 40.0, 51.0]),
    "prim_partition": lambda s, d: prim.partition3(_items(s, d, "l_quantity"), F.col("l_quantity") < 10, F.col("l_quantity") < 40).groupBy("part").agg(F.count("*").alias("n")),
    "prim_partition_rows": lambda s, d: prim.partition3(_items(s, d, "l_quantity"), F.col("l_quantity") < 10, F.col("l_quantity") < 40),
    "prim_adjacent_diff": lambda s, d: _ordered(s, d, "l_quantity").before(_qty(), "_b").select("l_orderkey", "l_linenumber", "l_quantity", (_qty() - F.coalesce("_b", F.lit(0))).alias("diff")),
    "prim_segmented_reduce": lambda s, d: _items(s, d, "l_quantity").groupBy("l_orderkey").agg(F.sum(_qty()).alias("total"), F.min(_qty()).alias("least"), F.max(_qty()).alias("most")),
    "prim_segmented_sort": lambda s, d: prim.segmented_sort(_orders(s, d).select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", F.desc("o_totalprice"), "o_orderkey"),
    "prim_spmv": lambda s, d: prim.spmv(
        s.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("i"), F.col("l_partkey").alias("j"), _qty().alias("a")),
        s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("j"), F.col("p_size").cast("bigint").alias("x")),
    ),
}

_SQL = {
    "graph_vertices": f"WITH {TRADE_SQL} SELECT id, label FROM v",
    "graph_edges": f"WITH {TRADE_SQL} SELECT src, dst FROM e",
    "graph_edges_coorder": f"WITH {_coorder_sql()} SELECT src, dst, ls, ld FROM e",
    "label_freq": f"WITH {TRADE_SQL} SELECT label, count(*) AS n FROM v GROUP BY label",
    "edge_label_freq": f"WITH {TRADE_SQL} SELECT ls, ld, count(*) AS n FROM e GROUP BY ls, ld",
    "vertex_degree": f"WITH {TRADE_SQL} SELECT id, count(e.src) AS degree FROM v LEFT JOIN e ON e.src = v.id GROUP BY id",
    "max_degree": f"WITH {TRADE_SQL} SELECT max(n) AS max_degree FROM (SELECT count(*) AS n FROM e GROUP BY src)",
    "max_label_freq": f"WITH {TRADE_SQL} SELECT count(*) AS n_labels, max(n) AS max_frequency FROM (SELECT count(*) AS n FROM v GROUP BY label)",
    "nlf": f"WITH {TRADE_SQL} SELECT src, ls, ld, count(*) AS n FROM e GROUP BY src, ls, ld",
    "cand_nlf": f"WITH {_SPARSE}, {_cand_sql(_P)} SELECT u, v FROM cand",
    "cand_edges": f"WITH {_SPARSE}, {_ecand_sql(_P)} SELECT * FROM ec",
    "cand_edges_refined": f"WITH {_SPARSE}, {_ecand_sql(_P)} SELECT * FROM er",
    "cand_first": f"WITH {_SPARSE}, {_ecand_sql(_P)} SELECT src AS v, count(DISTINCT qe) AS k FROM er WHERE u = 2 GROUP BY src",
    "cand_stats": f"WITH {_SPARSE}, {_ecand_sql(_P)} SELECT qe, u, w, count(DISTINCT src) AS n_keys, count(*) AS n_pairs FROM er GROUP BY qe, u, w",
    "cand_counts": f"WITH {_SPARSE}, {_cand_sql(_P)} SELECT u, count(*) AS n FROM cand GROUP BY u",
    "cand_counts_coorder": f"WITH {_COORDER}, {_cand_sql(_P)} SELECT u, count(*) AS n FROM cand GROUP BY u",
    "graph_text_round_trip": f"WITH {TRADE_SQL} SELECT src, dst, ls, ld FROM e",
    "kcore": _KCORE_SQL,
    "core_numbers": _CORE_SQL,
    "degeneracy_order": _DEGENERACY_SQL,
    "ktruss": _KTRUSS_SQL,
    "nucleus34": _NUCLEUS_SQL,
    "truss_numbers": _numbers_sql(2),
    "nucleus_numbers": _numbers_sql(3),
    "nuclei_core": _nuclei_sql(1),
    "nuclei_truss": _nuclei_sql(2),
    "cand_nlf_coorder": f"WITH {_COORDER}, {_cand_sql(_P)} SELECT u, v FROM cand",
    "cand_edges_coorder": f"WITH {_COORDER}, {_ecand_sql(_P)} SELECT * FROM ec",
    "cand_edges_refined_coorder": f"WITH {_COORDER}, {_ecand_sql(_P)} SELECT * FROM er",
    "cand_first_coorder": f"WITH {_COORDER}, {_ecand_sql(_P)} SELECT src AS v, count(DISTINCT qe) AS k FROM er WHERE u = 2 GROUP BY src",
    "cand_stats_coorder": f"WITH {_COORDER}, {_ecand_sql(_P)} SELECT qe, u, w, count(DISTINCT src) AS n_keys, count(*) AS n_pairs FROM er GROUP BY qe, u, w",
    **{f"match_{n}": pattern_sql(n) for n in PATTERNS},
    **{f"match_{n}_one_round": pattern_sql(n) for n in ONE_ROUND},
    **{f"match_{n}_replanned": pattern_sql(n) for n in REPLANNED},
    "match_triangle_labels_one_round_rows": pattern_sql("triangle_labels", rows=True),
    "match_bowtie_batches": f"SELECT u0, count(*) AS n FROM ({pattern_sql('bowtie', rows=True)}) GROUP BY u0",
    # The order that BFS takes: the order, its few suppliers, the parts.
    "match_partial_counts": f"""WITH {TRADE_SQL}, {_cand_sql(PATTERNS["triangle"][1])}
SELECT CAST(0 AS INTEGER) AS "group", CAST(1 AS INTEGER) AS vertices, (SELECT count(*) FROM cand WHERE u = 0) AS rows
UNION ALL SELECT 1, 2, (SELECT count(*) FROM e WHERE ls = 4 AND ld = 3)
UNION ALL SELECT 2, 3, (SELECT count(*) FROM e a JOIN e b ON b.src = a.dst JOIN e c ON c.src = a.src AND c.dst = b.dst WHERE a.ls = 4 AND a.ld = 3 AND b.ld = 5 AND c.ld = 5)""",
    **{f"match_{n}_rows": pattern_sql(n, rows=True) for n in ROWS},
    **{m: pattern_sql("tailed_triangle") for m in MODES},
    "triangle_count": f"WITH {_coorder_sql()} SELECT count(*) AS triangles FROM e a, e b, e c WHERE a.src < a.dst AND a.dst = b.src AND b.src < b.dst AND c.src = a.src AND c.dst = b.dst",
    "clique4_count": f"WITH {_SPARSE} SELECT count(*) AS cliques FROM e a, e b, e c, e x, e y, e z WHERE a.src < a.dst AND a.dst = b.src AND b.src < b.dst AND b.dst = c.src AND c.src < c.dst AND x.src = a.src AND x.dst = b.dst AND y.src = a.src AND y.dst = c.dst AND z.src = a.dst AND z.dst = c.dst",
    "clique4_count_coorder": f"WITH {_COORDER} {_CLIQUES}",
    "prim_select_if": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 40",
    "prim_select_unique": f"WITH {_RUNS} SELECT {_ROW}, run FROM n WHERE head = 1",
    "prim_exclusive_sum": f"SELECT *, CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) OVER (ORDER BY {_QTY_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS total FROM {_QTY_ROWS}",
    "prim_inclusive_sum": f"SELECT *, CAST(sum(CAST(l_quantity AS BIGINT)) OVER (ORDER BY {_QTY_ORDER} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM {_QTY_ROWS}",
    "prim_sort_keys": "SELECT o_custkey, o_orderkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS position FROM orders",
    "prim_reduce_sum": "SELECT CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total, min(CAST(l_quantity AS BIGINT)) AS least, max(CAST(l_quantity AS BIGINT)) AS most FROM lineitem",
    "prim_argmin": "SELECT first(o_orderkey ORDER BY o_totalprice, o_orderkey) AS least, first(o_orderkey ORDER BY o_totalprice DESC, o_orderkey DESC) AS most FROM orders",
    "prim_reduce_by_key": f"WITH {_RUNS} SELECT run, any_value(l_returnflag) AS key, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total FROM n GROUP BY run",
    "prim_rle": f"WITH {_RUNS} SELECT run, any_value(l_returnflag) AS value, count(*) AS length FROM n GROUP BY run",
    "prim_rle_nontrivial": f"WITH {_RUNS} SELECT run, any_value(l_returnflag) AS value, count(*) AS length FROM n GROUP BY run HAVING count(*) > 1",
    "prim_select_unique_all": f"WITH {_ALL_RUNS} SELECT {_ALL_ORDER}, run FROM n WHERE head = 1",
    "prim_exclusive_sum_all": f"SELECT {_ALL_ORDER}, CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) OVER (ORDER BY {_ALL_ORDER}, _copy ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS total FROM {_ALL_ROWS}",
    "prim_inclusive_sum_all": f"SELECT {_ALL_ORDER}, CAST(sum(CAST(l_quantity AS BIGINT)) OVER (ORDER BY {_ALL_ORDER}, _copy ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM {_ALL_ROWS}",
    "prim_reduce_by_key_all": f"WITH {_ALL_RUNS} SELECT run, any_value(l_returnflag) AS key, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total FROM n GROUP BY run",
    "prim_rle_all": f"WITH {_ALL_RUNS} SELECT run, any_value(l_returnflag) AS value, count(*) AS length FROM n GROUP BY run",
    "prim_rle_nontrivial_all": f"WITH {_ALL_RUNS} SELECT run, any_value(l_returnflag) AS value, count(*) AS length FROM n GROUP BY run HAVING count(*) > 1",
    "prim_adjacent_diff_all": f"SELECT {_ALL_ORDER}, CAST(l_quantity AS BIGINT) - coalesce(lag(CAST(l_quantity AS BIGINT)) OVER (ORDER BY {_ALL_ORDER}, _copy), 0) AS diff FROM {_ALL_ROWS}",
    "prim_scan_max": f"SELECT {_ALL_ORDER}, max(CAST(l_quantity AS BIGINT)) OVER (ORDER BY {_ALL_ORDER}, _copy) AS most FROM {_ALL_ROWS}",
    "prim_scan_min": f"SELECT {_ALL_ORDER}, min(CAST(l_quantity AS BIGINT)) OVER (ORDER BY {_ALL_ORDER}, _copy) AS least FROM {_ALL_ROWS}",
    "prim_scan_max_exclusive": f"SELECT {_ALL_ORDER}, max(CAST(l_quantity AS BIGINT)) OVER (ORDER BY {_ALL_ORDER}, _copy ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS most FROM {_ALL_ROWS}",
    "prim_inclusive_sum_by_key": f"WITH {_ALL_RUNS} SELECT {_ALL_ORDER}, {_KEY_SUM.format(0).replace('0 PRECEDING', 'CURRENT ROW')} FROM n",
    "prim_exclusive_sum_by_key": f"WITH {_ALL_RUNS} SELECT {_ALL_ORDER}, {_KEY_SUM.format(1)} FROM n",
    "prim_max_by_key": f"WITH {_ALL_RUNS} SELECT {_ALL_ORDER}, max(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY run ORDER BY {_ALL_ORDER}, _copy) AS most FROM n",
    "prim_min_by_key_exclusive": f"WITH {_ALL_RUNS} SELECT {_ALL_ORDER}, min(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY run ORDER BY {_ALL_ORDER}, _copy ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS least FROM n",
    "prim_sum_by_key_nan": f"WITH {_ALL_RUNS} SELECT {_ALL_ORDER}, sum(CASE WHEN l_orderkey % 97 = 0 THEN CAST('nan' AS DOUBLE) ELSE l_quantity END) OVER (PARTITION BY run ORDER BY {_ALL_ORDER}, _copy ROWS UNBOUNDED PRECEDING) AS total FROM n",
    "prim_scan_xor": f"SELECT {_ALL_ORDER}, bit_xor(l_partkey) OVER (ORDER BY {_ALL_ORDER}, _copy ROWS UNBOUNDED PRECEDING) AS mixed FROM {_ALL_ROWS}",
    "prim_segmented_sort_large": "SELECT o_orderpriority, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS position FROM orders",
    "prim_sort_keys_descending": "SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_custkey DESC, o_orderkey) AS position FROM orders",
    "prim_sort_pairs": "SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS position FROM orders",
    "prim_select_flagged": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_linenumber % 3 = 0",
    "prim_partition_flagged": "SELECT l_orderkey, l_linenumber, l_quantity, CAST(CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE 1 END AS INTEGER) AS part FROM lineitem",
    "prim_unique_by_key": "SELECT o_custkey, min(o_orderkey) AS o_orderkey, first(o_totalprice ORDER BY o_orderkey) AS o_totalprice, row_number() OVER (ORDER BY o_custkey) AS run FROM orders GROUP BY o_custkey",
    "prim_right_diff": f"SELECT {_ALL_ORDER}, CAST(l_quantity AS BIGINT) - coalesce(lead(CAST(l_quantity AS BIGINT)) OVER (ORDER BY {_ALL_ORDER}, _copy), 0) AS diff FROM {_ALL_ROWS}",
    "prim_segmented_arg": "SELECT o_custkey, first(o_orderkey ORDER BY o_totalprice, o_orderkey) AS argmin, first(o_orderkey ORDER BY o_totalprice DESC, o_orderkey) AS argmax FROM orders GROUP BY o_custkey",
    "prim_histogram_multi": "SELECT 'quantity' AS channel, CAST(floor(l_quantity / 5) AS BIGINT) AS bin, count(*) AS n FROM lineitem WHERE l_quantity >= 0 AND l_quantity < 50 GROUP BY 2 UNION ALL SELECT 'line', CAST(l_linenumber - 1 AS BIGINT), count(*) FROM lineitem WHERE l_linenumber >= 1 AND l_linenumber < 5 GROUP BY 2",
    "prim_histogram": "SELECT CAST(floor(l_quantity / 5) AS BIGINT) AS bin, count(*) AS n FROM lineitem WHERE l_quantity >= 0 AND l_quantity < 50 GROUP BY 1",
    "prim_histogram_range": "SELECT CAST((l_quantity >= 5)::INT + (l_quantity >= 20)::INT + (l_quantity >= 40)::INT AS BIGINT) AS bin, count(*) AS n FROM lineitem WHERE l_quantity >= 0 AND l_quantity < 51 GROUP BY 1",
    "prim_partition": "SELECT CAST(CASE WHEN l_quantity < 10 THEN 0 WHEN l_quantity < 40 THEN 1 ELSE 2 END AS INTEGER) AS part, count(*) AS n FROM lineitem GROUP BY 1",
    "prim_partition_rows": "SELECT l_orderkey, l_linenumber, l_quantity, CAST(CASE WHEN l_quantity < 10 THEN 0 WHEN l_quantity < 40 THEN 1 ELSE 2 END AS INTEGER) AS part FROM lineitem",
    "prim_adjacent_diff": f"SELECT *, CAST(l_quantity AS BIGINT) - coalesce(lag(CAST(l_quantity AS BIGINT)) OVER (ORDER BY {_QTY_ORDER}), 0) AS diff FROM {_QTY_ROWS}",
    "prim_segmented_reduce": "SELECT l_orderkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total, min(CAST(l_quantity AS BIGINT)) AS least, max(CAST(l_quantity AS BIGINT)) AS most FROM lineitem GROUP BY l_orderkey",
    "prim_segmented_sort": "SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS position FROM orders",
    "prim_spmv": "SELECT l_orderkey AS i, CAST(sum(CAST(l_quantity AS BIGINT) * p_size) AS BIGINT) AS y FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey",
}
ORACLE_SQL = _SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangles of order, part and supplier."""
    return count_query("triangle", spark, sf_dir)

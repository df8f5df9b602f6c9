"""Queries over the code index and graphs: lookups, filters, closures, rankings, layers, containment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import relational as R
from .. import sources
from ..operators.text import accessor, is_test_path
from .codeindex import WITH, views
from .registry import query

#: A part's number as a node, so that it is none of a supplier's.
PARTS = 1_000_000_000
_SUPPLY = f"""
SELECT DISTINCT CASE WHEN l_linenumber % 2 = 1 THEN l_suppkey ELSE {PARTS} + l_partkey END AS src, CASE WHEN l_linenumber % 2 = 1 THEN {PARTS} + l_partkey ELSE l_suppkey END AS dst FROM lineitem"""


def supply(t):
    """Every line item as an edge between its supplier and its part: a graph with cycles between two kinds of nodes."""
    out, part = F.col("l_linenumber") % 2 == 1, PARTS + F.col("l_partkey")
    return t.lineitem.select(F.when(out, F.col("l_suppkey")).otherwise(part).alias("src"), F.when(out, part).otherwise(F.col("l_suppkey")).alias("dst")).distinct()


def seeds(t, ids):
    return t.spark.createDataFrame([(i,) for i in ids], "start long")


_CLOSURE = f"""
WITH RECURSIVE e AS ({_SUPPLY}), c AS (SELECT {{start}} AS node UNION SELECT {{to}} FROM c JOIN e ON {{frm}} = c.node)
SELECT node FROM c WHERE node <> {{start}}"""


@query("G02_bounded_bfs", f"""
WITH RECURSIVE e AS ({_SUPPLY}), c AS (SELECT 3 AS node, 0 AS depth UNION SELECT e.dst, c.depth + 1 FROM c JOIN e ON e.src = c.node WHERE c.depth < 2)
SELECT node, min(depth) AS depth FROM c WHERE node <> 3 GROUP BY node""")
def _(t):
    return G.closure(supply(t), seeds(t, [3]), 2).select("node", "depth")


@query("G03_dependencies", _CLOSURE.format(start=3, frm="e.src", to="e.dst"))
def _(t):
    return G.closure(supply(t), seeds(t, [3])).select("node")


@query("G04_blast_radius", _CLOSURE.format(start=PARTS + 61, frm="e.dst", to="e.src"))
def _(t):
    return G.closure(G.reversed_edges(supply(t)), seeds(t, [PARTS + 61])).select("node")


@query("G05_explore", f"""
WITH RECURSIVE e AS ({_SUPPLY}), c AS (SELECT s AS start, s AS node, 0 AS depth FROM (VALUES (1), (2), (1000000065)) v(s) UNION SELECT c.start, e.dst, c.depth + 1 FROM c JOIN e ON e.src = c.node WHERE c.depth < 1)
SELECT DISTINCT start, node FROM c WHERE node <> start""")
def _(t):
    return G.closure(supply(t), seeds(t, [1, 2, PARTS + 65]), 1).select("start", "node")


@query("G06_type_hierarchy", """
WITH RECURSIVE h AS (SELECT s_suppkey AS child, s_suppkey // 3 AS parent FROM supplier WHERE s_suppkey > 0), c AS (SELECT 80 AS node, 0 AS depth UNION SELECT h.parent, c.depth + 1 FROM c JOIN h ON h.child = c.node)
SELECT node, depth FROM c WHERE node <> 80""")
def _(t):
    h = t.supplier.filter("s_suppkey > 0").select(F.col("s_suppkey").alias("src"), F.floor(F.col("s_suppkey") / 3).cast("long").alias("dst"))
    return G.closure(h, seeds(t, [80])).select("node", "depth")


@query("G38_rooted_descendants", """
WITH RECURSIVE c AS (SELECT 2 AS node UNION SELECT s.s_suppkey FROM c JOIN supplier s ON s.s_suppkey // 3 = c.node AND s.s_suppkey > 0) SELECT node FROM c WHERE node <> 2""")
def _(t):
    h = t.supplier.filter("s_suppkey > 0").select(F.floor(F.col("s_suppkey") / 3).cast("long").alias("src"), F.col("s_suppkey").alias("dst"))
    return G.closure(h, seeds(t, [2])).select("node")


@query("Q19_map_path", f"""
WITH RECURSIVE e AS ({_SUPPLY}), c AS (SELECT CAST(3 AS BIGINT) AS node, [CAST(3 AS BIGINT)] AS path, 0 AS d UNION SELECT e.dst, list_append(c.path, e.dst), c.d + 1 FROM c JOIN e ON e.src = c.node WHERE c.d < 2)
SELECT node, array_to_string(min(path), '>') AS path FROM c WHERE d = (SELECT min(d) FROM c c2 WHERE c2.node = c.node) GROUP BY node""")
def _(t):
    return G.shortest_paths(supply(t), seeds(t, [3]), 2).select("node", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query("G15_foundational_files", f"""{WITH} SELECT f.id, f.path, count(DISTINCT from_file_id) AS dependents, count(*) AS fan_in FROM edges JOIN files f ON f.id = to_file_id WHERE resolved = 1
GROUP BY f.id, f.path ORDER BY bool_and(f.is_tooling_path), 3 DESC, 4 DESC, f.path LIMIT 40""")
def _(t):
    v = views(t)
    e = v["edges"].filter("resolved = 1").select(F.col("from_file_id").alias("src"), F.col("to_file_id").alias("dst"))
    return G.leaderboard(e, v["files"].select("id", "path", F.col("is_tooling_path").alias("data_only")), 40)


@query("G16_symbol_callers", f"""{WITH} SELECT e.to_entity_id AS target, f.path, 'n' || CAST(e.to_entity_id % 40 AS VARCHAR) AS name, count(DISTINCT e.from_file_id) AS breadth, count(*) AS total
FROM edges e JOIN files f ON f.id = e.to_file_id WHERE e.resolved = 1 AND e.to_entity_id % 9 <> 0 GROUP BY 1, 2, 3 ORDER BY breadth DESC, total DESC, path, name, target LIMIT 50""")
def _(t):
    v = views(t)
    calls = v["edges"].filter("resolved = 1").join(v["files"].select(F.col("id").alias("to_file_id"), "path"), "to_file_id")
    calls = calls.select(F.col("to_entity_id").alias("target"), "path", F.concat(F.lit("n"), (F.col("to_entity_id") % 40).cast("string")).alias("name"), F.col("from_file_id").alias("from_file"))
    return G.caller_leaderboard(calls, calls.filter("target % 9 = 0").select("target").distinct(), 50)


@query("G17_module_layers", f"""{WITH} SELECT split_part(a.path, '/', 1) || '/' || split_part(a.path, '/', 2) AS from_dir, split_part(b.path, '/', 1) || '/' || split_part(b.path, '/', 2) AS to_dir, count(DISTINCT (a.id, b.id)) AS pairs
FROM edges e JOIN files a ON a.id = e.from_file_id JOIN files b ON b.id = e.to_file_id WHERE e.resolved = 1 GROUP BY 1, 2 HAVING from_dir <> to_dir AND count(DISTINCT (a.id, b.id)) >= 3""")
def _(t):
    v = views(t)
    d = lambda c: F.concat_ws("/", F.split(c, "/")[0], F.split(c, "/")[1])
    e = v["edges"].filter("resolved = 1").select(F.col("from_file_id").alias("src"), F.col("to_file_id").alias("dst"))
    f = v["files"]
    e = e.join(f.select(F.col("id").alias("src"), F.col("path").alias("p")), "src").join(f.select(F.col("id").alias("dst"), F.col("path").alias("q")), "dst")
    return G.module_layers(e, d(F.col("p")), d(F.col("q")))


@query("G19_fan_metrics", f"""{WITH} SELECT f.id, coalesce(i.n, 0) AS fan_in, coalesce(o.n, 0) AS fan_out FROM files f LEFT JOIN (SELECT to_file_id AS id, count(*) AS n FROM edges WHERE to_file_id IS NOT NULL GROUP BY 1) i ON i.id = f.id
LEFT JOIN (SELECT from_file_id AS id, count(*) AS n FROM edges GROUP BY 1) o ON o.id = f.id""")
def _(t):
    v = views(t)
    return G.fan_metrics(v["files"], v["edges"].select(F.col("from_file_id").alias("src"), F.col("to_file_id").alias("dst")))


@query("G22_call_resolution", f"""{WITH}, c AS (SELECT e.id AS site, 1 AS pass, t.id AS target FROM edges e JOIN entities t ON t.file_id = e.from_file_id AND t.kind = 1 AND t.name = 'n' || CAST(e.to_entity_id % 40 AS VARCHAR) WHERE e.kind = 0
 UNION ALL SELECT e.id, 2, t.id FROM edges e JOIN entities t ON t.file_id = e.to_file_id AND t.kind = 1 AND t.name = 'n' || CAST(e.to_entity_id % 40 AS VARCHAR) WHERE e.kind = 0),
u AS (SELECT site, pass, min(target) AS target FROM c GROUP BY 1, 2 HAVING count(DISTINCT target) = 1)
SELECT site, arg_min(target, pass) AS target, min(pass) AS resolved_by FROM u GROUP BY 1""")
def _(t):
    v = views(t)
    e = v["edges"].filter("kind = 0").withColumn("name", F.concat(F.lit("n"), (F.col("to_entity_id") % 40).cast("string")))
    f = v["entities"].filter("kind = 1").select(F.col("id").alias("target"), "file_id", "name")
    near = e.join(f.withColumnRenamed("file_id", "from_file_id"), ["from_file_id", "name"]).select(F.col("id").alias("site"), F.lit(1).alias("pass"), "target")
    far = e.join(f.withColumnRenamed("file_id", "to_file_id"), ["to_file_id", "name"]).select(F.col("id").alias("site"), F.lit(2).alias("pass"), "target")
    return G.unique_targets(near.union(far), ["site"], "pass", "target")


@query("G23_hierarchy_resolution", f"""{WITH} SELECT c.id AS child, min(p.id) AS parent FROM entities c JOIN entities p ON p.kind = 3 AND p.name = c.owner_type || '_base' OR (p.kind = 3 AND p.file_id = c.file_id AND p.name = c.name) WHERE c.kind = 0 GROUP BY c.id HAVING count(*) = 1""")
def _(t):
    v = views(t)
    c, p = v["entities"].filter("kind = 0"), v["entities"].filter("kind = 3").select(F.col("id").alias("parent"), "file_id", "name")
    return c.join(p, ["file_id", "name"]).groupBy(F.col("id").alias("child")).agg(F.min("parent").alias("parent"), F.count("*").alias("_n")).filter("_n = 1").drop("_n")


@query("G18_module_cycles")
def _(t):
    return G.on_cycles(supply(t))


_DAG = "SELECT o_orderkey AS src, o_orderkey // 2 AS dst FROM orders WHERE o_orderkey > 0 UNION SELECT o_orderkey, o_orderkey // 3 FROM orders WHERE o_orderkey > 0"
_NODES = "SELECT o_orderkey AS node FROM orders"


def dag(t):
    """Every order depends on those of half and a third of its number."""
    o = t.orders.filter("o_orderkey > 0")
    return o.select(F.col("o_orderkey").alias("src"), F.expr("o_orderkey div 2").alias("dst")).union(o.select("o_orderkey", F.expr("o_orderkey div 3"))).distinct()


def dag_nodes(t):
    return t.orders.select(F.col("o_orderkey").alias("node"))


@query("G37_dependency_levels", f"""
WITH RECURSIVE e AS ({_DAG}), c AS (SELECT node, 0 AS level FROM ({_NODES}) UNION SELECT e.dst, c.level + 1 FROM c JOIN e ON e.src = c.node) SELECT node, max(level) AS level FROM c GROUP BY node""")
def _(t):
    return G.levels(dag_nodes(t), dag(t))


@query("G34_critical_path", f"""
WITH RECURSIVE e AS ({_DAG}), c AS (SELECT node, CAST(node % 7 + 1 AS DOUBLE) AS total FROM ({_NODES}) UNION SELECT e.dst, c.total + e.dst % 7 + 1 FROM c JOIN e ON e.src = c.node) SELECT max(total) AS critical_s FROM c""")
def _(t):
    return G.critical_path(dag_nodes(t).withColumn("duration", (F.col("node") % 7 + 1).cast("double")), dag(t))


@query("G35_is_chain", f"""
WITH RECURSIVE e AS ({_DAG}), c AS (SELECT node, 0 AS level FROM ({_NODES}) UNION SELECT e.dst, c.level + 1 FROM c JOIN e ON e.src = c.node), l AS (SELECT node, max(level) AS level FROM c GROUP BY node)
SELECT count(DISTINCT level) = count(*) AS is_chain, count(*) AS n, count(DISTINCT level) AS levels FROM l""")
def _(t):
    return G.is_chain(dag_nodes(t), dag(t))


@query("G33_blockers", f"""
WITH e AS ({_DAG}) SELECT DISTINCT src AS node, CASE WHEN dst % 5 = 0 THEN 'dependency_missing' ELSE 'dependency_incomplete' END AS kind FROM e WHERE (dst % 5 = 0 OR dst % 3 <> 0)""")
def _(t):
    return G.blockers(dag_nodes(t).filter("node % 5 != 0").withColumn("done", F.col("node") % 3 == 0), dag(t))


@query("G30_merkle_fingerprints", f"""
WITH e AS ({_DAG}), m0 AS (SELECT node, sha256(CAST(node % 9 AS VARCHAR)) AS d FROM ({_NODES})),
n1 AS (SELECT e.src AS node, string_agg(m0.d, ',' ORDER BY m0.d) AS s FROM e JOIN m0 ON m0.node = e.dst GROUP BY 1),
m1 AS (SELECT m0.node, sha256(m0.d || '|' || coalesce(s, '')) AS d FROM m0 LEFT JOIN n1 USING (node)),
n2 AS (SELECT e.src AS node, string_agg(m1.d, ',' ORDER BY m1.d) AS s FROM e JOIN m1 ON m1.node = e.dst GROUP BY 1)
SELECT m1.node, sha256(m1.d || '|' || coalesce(s, '')) AS digest FROM m1 LEFT JOIN n2 USING (node)""")
def _(t):
    return G.fingerprints(dag_nodes(t).withColumn("key", F.col("node") % 9), dag(t), 2)


@query("G27_fan_out_opaque", f"""{WITH} SELECT from_file_id AS id, count(DISTINCT CASE WHEN resolved = 1 THEN to_file_id END) + count(*) FILTER (WHERE resolved = 0) AS fan_out FROM edges GROUP BY 1""")
def _(t):
    e = views(t)["edges"]
    return e.groupBy(F.col("from_file_id").alias("id")).agg((F.countDistinct(F.when(F.col("resolved") == 1, F.col("to_file_id"))) + F.count_if(F.col("resolved") == 0)).alias("fan_out"))


@query("G29_tree_size", f"""
WITH RECURSIVE e AS ({_DAG}), c AS (SELECT src AS start, src AS node, 0 AS d FROM e UNION SELECT c.start, e.dst, c.d + 1 FROM c JOIN e ON e.src = c.node WHERE c.d < 3)
SELECT start, count(DISTINCT node) AS size FROM c WHERE node <> start GROUP BY 1""")
def _(t):
    e = dag(t)
    return G.closure_sizes(e, e.select(F.col("src").alias("start")).distinct(), 3)


@query("G32_reverse_dependent_scope", f"""
WITH e AS ({_DAG}) SELECT node FROM (SELECT 5 AS node UNION SELECT 17 UNION SELECT src FROM e WHERE dst IN (5, 17))""")
def _(t):
    base = seeds(t, [5, 17])
    return G.closure(G.reversed_edges(dag(t)), base, 1).select("node").union(base.select("start")).distinct()


@query("G39_orphans", f"""{WITH} SELECT id, path FROM files f WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.to_file_id = f.id AND e.kind = 2 AND e.resolved = 1)""")
def _(t):
    v = views(t)
    linked = v["edges"].filter("kind = 2 AND resolved = 1").select(F.col("to_file_id").alias("id"))
    return v["files"].join(linked, "id", "left_anti").select("id", "path")


@query("G08_innermost_container", f"""{WITH}, p AS (SELECT i.id, o.id AS o_id, o.end_byte - o.start_byte AS size FROM entities i JOIN entities o ON o.file_id = i.file_id AND o.kind = 1 AND o.start_byte <= i.start_byte AND o.end_byte >= i.end_byte WHERE i.kind = 4),
b AS (SELECT id, min(size) AS size FROM p GROUP BY 1) SELECT p.id, min(p.o_id) AS o_id FROM p JOIN b ON p.id = b.id AND p.size = b.size GROUP BY 1 HAVING count(*) = 1""")
def _(t):
    e = views(t)["entities"]
    inner = e.filter("kind = 4").select("id", "file_id", "start_byte", "end_byte")
    outer = e.filter("kind = 1").select("file_id", F.col("id").alias("o_id"), F.col("start_byte").alias("o_start"), F.col("end_byte").alias("o_end"))
    return R.innermost(R.contained(inner, outer, ["file_id"], "start_byte", "end_byte", "o_start", "o_end", 256), ["id"], "o_start", "o_end", "o_id")


@query("J06_span_containment", f"""{WITH} SELECT i.id, o.id AS o_id FROM entities i JOIN entities o ON o.file_id = i.file_id AND o.kind = 1 AND o.start_byte <= i.start_byte AND o.end_byte >= i.end_byte WHERE i.kind = 4""")
def _(t):
    e = views(t)["entities"]
    inner = e.filter("kind = 4").select("id", "file_id", "start_byte", "end_byte")
    outer = e.filter("kind = 1").select("file_id", F.col("id").alias("o_id"), F.col("start_byte").alias("o_start"), F.col("end_byte").alias("o_end"))
    return R.contained(inner, outer, ["file_id"], "start_byte", "end_byte", "o_start", "o_end", 256).select("id", "o_id")


@query("J05_theta_anti", f"""{WITH} SELECT i.id FROM entities i WHERE i.kind = 4 AND NOT EXISTS (SELECT 1 FROM entities o WHERE o.file_id = i.file_id AND o.kind = 1 AND o.start_byte <= i.start_byte AND o.end_byte >= i.end_byte)""")
def _(t):
    e = views(t)["entities"]
    i, o = e.filter("kind = 4").alias("i"), e.filter("kind = 1").alias("o")
    inside = (F.col("i.file_id") == F.col("o.file_id")) & (F.col("o.start_byte") <= F.col("i.start_byte")) & (F.col("o.end_byte") >= F.col("i.end_byte"))
    return i.join(o, inside, "left_anti").select("id")


@query("J01_inner", "SELECT n_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def _(t):
    return t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"))


@query("J02_left_outer", "SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def _(t):
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("orders"))


@query("J03_left_anti", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def _(t):
    return t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("J04_left_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def _(t):
    return t.customer.join(t.orders.filter("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("J07_swapped_self_join", f"""WITH e AS ({_SUPPLY}) SELECT a.src, a.dst FROM e a WHERE EXISTS (SELECT 1 FROM e b WHERE b.src = a.dst AND b.dst = a.src)""")
def _(t):
    e = supply(t)
    return e.join(G.reversed_edges(e), ["src", "dst"], "left_semi")


@query("J08_star_join", """
SELECT r_name, p_brand, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def _(t):
    j = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", "p_brand").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))


@query("J09_interval_overlap", "SELECT user_id FROM (SELECT user_id, min(ts) AS a, max(ts) AS b FROM events GROUP BY 1) WHERE a <= TIMESTAMP '2024-01-02' AND b >= TIMESTAMP '2024-01-30 12:00:00'")
def _(t):
    spans = t.events.groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return R.overlapping(spans, "a", "b", F.lit("2024-01-30 12:00:00").cast("timestamp"), F.lit("2024-01-02").cast("timestamp")).select("user_id")


@query("J10_as_of", """
SELECT o_orderkey, l.l_shipdate AS shipped FROM orders LEFT JOIN LATERAL (SELECT max(l_shipdate) AS l_shipdate FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate < o_orderdate) l ON true""")
def _(t):
    left = t.orders.select("o_orderkey", F.col("o_orderkey").alias("k"), "o_orderdate")
    right = t.lineitem.select(F.col("l_orderkey").alias("k"), "l_shipdate").withColumn("shipped", F.col("l_shipdate"))
    return R.as_of(left, right, ["k"], ["o_orderdate"], ["l_shipdate"], ["shipped"]).select("o_orderkey", "shipped")


@query("J12_union_all", "SELECT n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def _(t):
    return t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")).unionAll(t.region.select("r_regionkey", "r_name"))


@query("J13_multiset_compare", """
WITH a AS (SELECT l_returnflag AS f, l_linenumber AS n FROM lineitem WHERE l_linestatus = 'O'), b AS (SELECT l_returnflag AS f, l_linenumber AS n FROM lineitem WHERE l_linestatus = 'F')
SELECT f, n, CASE WHEN sum(s) > 0 THEN 'left' ELSE 'right' END AS side, CAST(abs(sum(s)) AS BIGINT) AS surplus FROM (SELECT f, n, 1 AS s FROM a UNION ALL SELECT f, n, -1 FROM b) GROUP BY 1, 2 HAVING sum(s) <> 0""")
def _(t):
    side = lambda s: t.lineitem.filter(F.col("l_linestatus") == s).select(F.col("l_returnflag").alias("f"), F.col("l_linenumber").alias("n"))
    return R.multiset_difference(side("O"), side("F"))


@query("J15_manifest_diff", """
WITH a AS (SELECT p_partkey AS path, p_size AS hash FROM part WHERE p_partkey % 10 <> 0), b AS (SELECT p_partkey AS path, CASE WHEN p_partkey % 7 = 0 THEN p_size + 1 ELSE p_size END AS hash FROM part WHERE p_partkey % 11 <> 0)
SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'new' WHEN b.path IS NULL THEN 'deleted' WHEN a.hash = b.hash THEN 'unchanged' ELSE 'changed' END AS status FROM a FULL JOIN b ON a.path = b.path""")
def _(t):
    a = t.part.filter("p_partkey % 10 != 0").select(F.col("p_partkey").alias("path"), F.col("p_size").alias("hash"))
    b = t.part.filter("p_partkey % 11 != 0").select(F.col("p_partkey").alias("path"), F.when(F.col("p_partkey") % 7 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("hash"))
    return sources.manifest_diff(a, b)


@query("Q01_symbols_in_file", f"""{WITH} SELECT id, kind, name FROM entities WHERE file_id = (SELECT min(id) FROM files WHERE path LIKE '%/bolt%' OR path LIKE '%bolt%') AND kind < 4 ORDER BY id""")
def _(t):
    v = views(t)
    first = v["files"].filter(F.col("path").contains("bolt")).agg(F.min("id").alias("file_id"))
    return v["entities"].filter("kind < 4").join(F.broadcast(first), "file_id").select("id", "kind", "name")


@query("Q03_get_symbol", f"""{WITH} SELECT name, id, kind FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY CASE kind WHEN 0 THEN 0 WHEN 3 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 4 END, id) AS r FROM entities) WHERE r = 1""")
def _(t):
    rank = F.when(F.col("kind").isin(0, 3), 0).when(F.col("kind") == 1, 1).when(F.col("kind") == 2, 2).otherwise(4)
    best = F.min(F.struct(rank.alias("rank"), "id", "kind"))
    return views(t)["entities"].groupBy("name").agg(best.alias("b")).select("name", "b.id", "b.kind")


@query("Q04_filter_symbols", f"""{WITH} SELECT e.id, e.name, f.path FROM entities e JOIN files f ON f.id = e.file_id WHERE e.kind = 1 AND f.language = 'go' AND coalesce(e.cyclomatic, 0) >= 15 ORDER BY e.id LIMIT 200""")
def _(t):
    v = views(t)
    e = v["entities"].filter("kind = 1 AND coalesce(cyclomatic, 0) >= 15")
    return e.join(v["files"].filter("language = 'go'").select(F.col("id").alias("file_id"), "path"), "file_id").orderBy("id").limit(200).select("id", "name", "path")


@query("Q05_find_imports", f"""{WITH} SELECT e.id, coalesce(f.path, '') AS path FROM edges e LEFT JOIN files f ON f.id = e.to_file_id WHERE e.kind = 1""")
def _(t):
    v = views(t)
    return v["edges"].filter("kind = 1").select("id", "to_file_id").join(v["files"].select(F.col("id").alias("to_file_id"), "path"), "to_file_id", "left").select("id", F.coalesce("path", F.lit("")).alias("path"))


@query("Q10_suffix_match", f"""{WITH} SELECT id, path FROM files WHERE path = 'brand1/x.py' OR path LIKE '%/red_widget1.go' OR path LIKE '%/red_widget1'""")
def _(t):
    p = F.col("path")
    return views(t)["files"].filter(R.suffix_matches(p, "brand1/x.py") | R.suffix_matches(p, "red_widget1.go") | R.suffix_matches(p, "red_widget1")).select("id", "path")


@query("Q12_paginate", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def _(t):
    return R.page(t.orders.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 20, 40)


@query("Q13_budget_fit", f"""{WITH}, s AS (SELECT id, language, complexity, sum(complexity) OVER (PARTITION BY language ORDER BY churn DESC, id ROWS UNBOUNDED PRECEDING) AS spent FROM files) SELECT id, language, CAST(spent AS BIGINT) AS spent FROM s WHERE spent <= 500""")
def _(t):
    return R.fit_budget(views(t)["files"], "language", [F.desc("churn"), "id"], "complexity", 500).select("id", "language", "spent")


@query("Q15_hotspots", f"""{WITH} SELECT path AS file, complexity, churn, complexity * churn AS score FROM files ORDER BY score DESC, file LIMIT 30""")
def _(t):
    return views(t)["files"].select(F.col("path").alias("file"), "complexity", "churn", (F.col("complexity") * F.col("churn")).alias("score")).orderBy(F.desc("score"), "file").limit(30)


@query("Q20_clusters", f"""{WITH} SELECT community_id, count(*) AS n, min(path) AS first_path FROM files GROUP BY 1""")
def _(t):
    return views(t)["files"].groupBy("community_id").agg(F.count("*").alias("n"), F.min("path").alias("first_path"))


@query("R36_test_paths", f"""{WITH} SELECT id FROM files WHERE regexp_matches(path, '(?i)(^|/)(tests?|__tests__|specs?|fixtures?)/|[.](test|spec)[.]|_test[.](go|py)$|(^|/)test_[^/]*[.]py$|tests?[.](java|kt|cs)$')""")
def _(t):
    return views(t)["files"].filter(is_test_path(F.col("path"))).select("id")


@query("SC03_language_of_path", f"""{WITH} SELECT id, CASE WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.go' THEN 'go' WHEN path LIKE '%.ts' THEN 'typescript' ELSE 'java' END AS language FROM files""")
def _(t):
    return views(t)["files"].select("id", sources.language(F.col("path")).alias("language"))


@query("SC07_churn", """
SELECT c_custkey AS id, count(o_orderkey) AS churn FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 90 DAY GROUP BY 1""")
def _(t):
    now = F.lit(t.orders.agg(F.max("o_orderdate")).first()[0])
    recent = t.orders.filter(F.col("o_orderdate") >= now - F.make_dt_interval(F.lit(90))).groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("churn"))
    return t.customer.select(F.col("c_custkey").alias("id")).join(recent, "id", "left").select("id", F.coalesce("churn", F.lit(0)).alias("churn"))


@query("T31_accessors", "SELECT s_suppkey, regexp_matches(CASE s_suppkey % 4 WHEN 0 THEN 'get' WHEN 1 THEN 'getter' WHEN 2 THEN 'isOpen' ELSE 'has_x' END, '^(get|set|is|has)($|_|[A-Z])') AS accessor FROM supplier")
def _(t):
    name = F.element_at(F.array(*map(F.lit, ("get", "getter", "isOpen", "has_x"))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return t.supplier.select("s_suppkey", accessor(name).alias("accessor"))


@query("G20_communities")
def _(t):
    e = supply(t)
    parts = G.components(e)
    return G.communities(e.join(G.side(parts, parts.count()), F.col("src") == F.col("node")).select("src", "dst", "component"))


@query("G26_module_depth")
def _(t):
    return G.module_depths(dag(t).withColumn("module", F.lit(0)))


@query("G28_dominated_helpers")
def _(t):
    e = dag(t)
    return G.dominated(e.select("src", "dst", (F.col("src") % 4 != 0).alias("src_private"), (F.col("dst") % 4 != 0).alias("dst_private"), (F.col("src") % 3).alias("module")))


@query("G10_flow_trees")
def _(t):
    e = dag(t).withColumn("module", F.lit(0))
    return G.flow_trees(e, dag_nodes(t).filter("node % 500 = 499").select((F.col("node") % 1).cast("int").alias("module"), "node"))


@query("G36_execution_waves")
def _(t):
    tasks = t.lineitem.groupBy((F.col("l_suppkey") % 25).alias("plan"), F.col("l_partkey").alias("task")).agg(F.collect_set((F.col("l_orderkey") % 50)).alias("reach"))
    return G.waves(tasks.select(F.col("plan").cast("long").alias("plan"), "task", "reach"), 6)


@query("G37_topological_order")
def _(t):
    e = dag(t).withColumn("plan", F.lit(0).cast("long"))
    return G.topological_order(e, dag_nodes(t).select(F.lit(0).cast("long").alias("plan"), "node"))


@query("G21_subsystem_names")
def _(t):
    f = views(t)["files"]
    return G.subsystem_names(f.select(F.col("community_id").alias("community"), F.concat_ws("/", F.split("path", "/")[0], F.split("path", "/")[1]).alias("dir"), F.element_at(F.split("path", "/"), -1).alias("stem")))

"""A code index laid over the star schema: files from part, entities and edges from lineitem.

The same portable SQL builds the views in Spark and in DuckDB, so queries over the index can be compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import spread
from .registry import Tables

FILES = """
SELECT p_partkey AS id,
  CASE p_size % 6 WHEN 0 THEN 'src/' WHEN 1 THEN 'lib/' WHEN 2 THEN 'src/tests/' WHEN 3 THEN 'src/vendor/' ELSE 'app/' END
  || lower(replace(p_brand, '#', '')) || '/' || replace(p_name, ' ', '_') || CAST(p_partkey AS STRING)
  || CASE p_partkey % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.go' WHEN 2 THEN '.ts' WHEN 3 THEN '_test.py' ELSE '.java' END AS path,
  CASE p_partkey % 5 WHEN 0 THEN 'python' WHEN 1 THEN 'go' WHEN 2 THEN 'typescript' WHEN 3 THEN 'python' ELSE 'java' END AS language,
  CAST(p_size AS BIGINT) AS complexity, p_partkey % 13 AS churn, p_partkey % 7 AS community_id,
  (p_size % 6 = 2 OR p_partkey % 5 = 3) AS is_test_path, (p_partkey % 17 = 0) AS is_tooling_path
FROM part"""
_ITEMS = """
SELECT l_orderkey * 8 + l_linenumber AS id, min(l_partkey) AS file_id, min(l_suppkey) AS s,
  CAST(min(l_quantity) AS BIGINT) AS q, CAST(floor(min(l_extendedprice)) AS BIGINT) AS x
FROM lineitem GROUP BY l_orderkey * 8 + l_linenumber"""
ENTITIES = f"""
SELECT id, file_id, CAST(id % 5 AS INT) AS kind, 'n' || CAST(s % 40 AS STRING) AS name,
  CASE WHEN x % 3 = 0 THEN 'owner' || CAST(s % 9 AS STRING) END AS owner_type,
  x % 1000 AS start_byte, x % 1000 + q * 8 AS end_byte, q AS line_span, q % 30 AS cyclomatic, x % 25 AS cognitive,
  CASE x % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence
FROM ({_ITEMS}) items"""
EDGES = f"""
SELECT id, file_id AS from_file_id, CASE WHEN q % 5 <> 0 THEN (x * 7 + s) % (SELECT count(*) FROM part) END AS to_file_id,
  CAST(x % 4 AS INT) AS kind, CASE WHEN q % 5 <> 0 THEN 1 ELSE 0 END AS resolved, id % 997 AS to_entity_id
FROM ({_ITEMS}) items"""
#: Which unit depends on which, and how certainly: from every order, a customer's number and one drawn from the order's, as files.
FACTS = """
SELECT o_orderkey AS source_id, o_custkey AS from_unit, (o_orderkey % 4096) * (o_orderkey % 4096) % (SELECT count(*) FROM customer) AS to_unit,
  CASE WHEN o_orderkey % 7 = 0 THEN 'possible' ELSE 'certified' END AS certainty
FROM orders"""
NAMES = {"files": FILES, "entities": ENTITIES, "edges": EDGES, "dependency_facts": FACTS}
#: In front of DuckDB SQL: the views as common tables.
WITH = "WITH " + ", ".join(f"{k} AS ({v})" for k, v in NAMES.items())
#: The same for SQL that needs recursion.
WITH_RECURSIVE = WITH.replace("WITH ", "WITH RECURSIVE ", 1)


def views(t: Tables) -> dict[str, DataFrame]:
    """files, entities, edges and dependency_facts; also registered as temporary views, for rules."""
    for name in ("part", "lineitem", "orders", "customer"):
        getattr(t, name).createOrReplaceTempView(name)
    # the same rows by what the items are grouped by, so that they are grouped in parts of bounded size
    items = F.expr("l_orderkey * 8 + l_linenumber")
    spread(t.lineitem, t.lineitem.count(), items).createOrReplaceTempView("lineitem_by_item")
    out = {k: t.spark.sql(v.replace("FROM lineitem ", "FROM lineitem_by_item ")) for k, v in NAMES.items()}
    for k, v in out.items():
        v.createOrReplaceTempView(k)
    return out

"""Queries of pattern rules, text audits, dependency facts and field searches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import patterns as P
from ..operators import text as T
from .codeindex import WITH, views
from .registry import query


@query("R37_debug_statements", r"""
WITH l AS (SELECT page_id, unnest(string_split(html, chr(10))) AS x, generate_subscripts(string_split(html, chr(10)), 1) AS line FROM pages) SELECT page_id, CAST(line AS INTEGER) AS line FROM l WHERE regexp_matches(x, '\btrack\s*\(')""")
def _(t):
    pages = t.pages.withColumn("language", F.lit("javascript"))
    return P.line_findings(pages, "page_id", "html", "language", ["track"], {"track": (("javascript", r"\btrack\s*\("),)}).select("page_id", "line")


def snippets(t):
    """One line of code for each supplier, by turns of every family."""
    lines = [("rust", "dbg!(x);"), ("go", "_ = err"), ("rust", "let _ = f();"), ("lua", "pcall(f)"), ("elixir", "rescue _ -> nil"), ("solidity", "try a.b() {} catch {}"), ("python", "except ValueError: pass"), ("python", "y = eval(x)"), ("python", "x = model.eval()"), ("go", "return err")]
    table = F.array(*(F.struct(F.lit(a).alias("language"), F.lit(b).alias("code")) for a, b in lines))
    return t.supplier.select("s_suppkey", F.element_at(table, (F.col("s_suppkey") % 10 + 1).cast("int")).alias("c")).select("s_suppkey", "c.*")


@query("R38_pattern_families", """
SELECT s_suppkey, list_extract(['debug_statement', 'error_swallow_go', 'error_swallow_rust', 'error_swallow_lua_bash', 'error_swallow_elixir_haskell', 'error_swallow_c_scala_solidity', 'empty_catch', 'eval_usage'], s_suppkey % 10 + 1) AS family FROM supplier WHERE s_suppkey % 10 < 8""")
def _(t):
    return P.line_findings(snippets(t), "s_suppkey", "code", "language").select("s_suppkey", F.split("rule", ":")[0].alias("family"))


@query("R44_dependency_facts", f"""{WITH}, q AS (SELECT DISTINCT 'u' || CAST(id % 50 AS VARCHAR) AS from_unit, CASE WHEN id % 3 = 0 THEN 'nowhere' || CAST(id % 20 AS VARCHAR) ELSE regexp_replace(split_part(path, '/', -1), '[.][^.]+$', '') END AS specifier FROM files),
p AS (SELECT path, regexp_replace(split_part(path, '/', -1), '[.][^./]+$', '') AS stem FROM files),
g AS (SELECT from_unit, specifier, count(path) AS n, min(path) AS to_unit FROM q LEFT JOIN p ON stem = specifier GROUP BY 1, 2)
SELECT from_unit, specifier, to_unit, CASE WHEN n = 1 THEN 'certified' ELSE 'missing' END AS certainty FROM g WHERE n < 2""")
def _(t):
    f = views(t)["files"]
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]+$", "")
    spec = F.when(F.col("id") % 3 == 0, F.concat(F.lit("nowhere"), (F.col("id") % 20).cast("string"))).otherwise(stem)
    imports = f.select(F.concat(F.lit("u"), (F.col("id") % 50).cast("string")).alias("from_unit"), spec.alias("specifier")).distinct()
    return P.dependency_facts(imports, f)


@query("T26_text_audit", r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '(?s)```.*?```', ' ', 'g') AS t FROM documents),
l AS (SELECT doc_id, t, list_filter(string_split(t, chr(10)), lambda x: trim(x) <> '') AS lines FROM d),
s AS (SELECT doc_id, t, lines, list_filter(string_split_regex(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1) || '|\n{2,}'), lambda x: trim(x) <> '') AS sentences FROM l),
w AS (SELECT *, coalesce(list_max([len(list_filter(regexp_split_to_array(x, '\s+'), lambda y: y <> '')) for x in sentences]), 0) AS longest, len(list_filter(lines, lambda x: regexp_matches(x, '^\s*([-*+]|\d+[.)])\s'))) AS bullets FROM s)
SELECT doc_id, len(list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> '')) AS words, len(sentences) AS sentences, longest, longest > 30 AS too_long, bullets, len(list_filter(lines, lambda x: regexp_matches(x, '^#{1,6}\s'))) AS headings, bullets * 2 > len(lines) AS list_like FROM w""")
def _(t):
    return t.documents.select("doc_id", P.text_audit(F.coalesce("text", F.lit(""))).alias("a")).select("doc_id", "a.*")


@query("T11_field_search", """
WITH q(term) AS (VALUES ('red'), ('bolt'), ('economy')), d AS (SELECT p_partkey AS id, p_name AS a, p_type AS b FROM part),
s AS (SELECT id, sum(3 * CASE WHEN list_contains(string_split(lower(a), ' '), term) THEN 1 ELSE 0 END + CASE WHEN list_contains(string_split(lower(b), ' '), term) THEN 1 ELSE 0 END) AS score FROM d, q GROUP BY 1)
SELECT id, CAST(score AS BIGINT) AS score FROM s WHERE score > 0 ORDER BY score DESC, id LIMIT 20""")
def _(t):
    hit = lambda c: F.size(F.array_intersect(F.split(F.lower(c), " "), F.array(*map(F.lit, ("red", "bolt", "economy")))))
    s = t.part.select(F.col("p_partkey").alias("id"), (3 * hit(F.col("p_name")) + hit(F.col("p_type"))).cast("long").alias("score"))
    return s.filter("score > 0").orderBy(F.desc("score"), "id").limit(20)


@query("T02_two_index_search", """
WITH n AS (SELECT DISTINCT p_name AS name FROM part), g AS (SELECT name, list_distinct([substr(name, i, 3) for i in range(1, length(name) - 1)]) AS g FROM n), q AS (SELECT 'red widgt' AS q),
a AS (SELECT name, row_number() OVER (ORDER BY s DESC, name) AS rank FROM (SELECT name, len(list_intersect(g, [substr(q, i, 3) for i in range(1, length(q) - 1)])) AS s FROM g, q) WHERE s > 0 QUALIFY rank <= 50),
b AS (SELECT name, row_number() OVER (ORDER BY s DESC, name) AS rank FROM (SELECT name, len(list_intersect(string_split(name, ' '), string_split(q, ' '))) AS s FROM n, q) WHERE s > 0 QUALIFY rank <= 50)
SELECT name, sum(1 / (60 + rank)) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1""")
def _(t):
    names, q = t.part.select(F.col("p_name").alias("name")).distinct(), F.lit("red widgt")
    # the names of a match are few: the top 50 of each index
    top = lambda s: names.withColumn("s", s).filter("s > 0").orderBy(F.desc("s"), "name").limit(50).select("name", F.row_number().over(Window.orderBy(F.desc("s"), "name")).alias("rank"))
    return T.fuse(top(F.size(F.array_intersect(T.trigrams(F.col("name")), T.trigrams(q)))).union(top(F.size(F.array_intersect(F.split("name", " "), F.split(q, " "))))), ["name"])


@query("E43_link_lint", f"""{WITH}, l AS (SELECT id AS src, CASE WHEN id % 4 = 0 THEN 'gone' ELSE CAST((id * 3) % 900 AS VARCHAR) END AS target FROM files) SELECT src, target FROM l WHERE target NOT IN (SELECT CAST(id AS VARCHAR) FROM files)""")
def _(t):
    f = views(t)["files"]
    body = F.concat(F.lit("see [it]("), F.when(F.col("id") % 4 == 0, "gone").otherwise((F.col("id") * 3 % 900).cast("string")), F.lit(") and [site](https://example.com)"))
    return P.links(f.select(F.col("id").alias("src"), body.alias("body")), "src", "body").join(f.select(F.col("id").cast("string").alias("target")), "target", "left_anti").select("src", "target")

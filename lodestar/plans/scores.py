"""Queries of statistics and scoring over labels, events and the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as X
from ..operators import stats
from .codeindex import WITH, views
from .registry import query

_PAIRS = "SELECT doc_id, CASE quality WHEN 1 THEN 'good' ELSE 'bad' END AS a, CASE WHEN toxic = 1 OR doc_id % 6 = 0 THEN 'bad' ELSE 'good' END AS b FROM labels"


def pairs(t):
    """Two raters' labels of the same documents."""
    b = F.when((F.col("toxic") == 1) | (F.col("doc_id") % 6 == 0), "bad").otherwise("good")
    return t.labels.select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("bad").alias("a"), b.alias("b"))


@query("A27_cohens_kappa", f"""
WITH p AS ({_PAIRS}), n AS (SELECT count(*) AS n, count(*) FILTER (WHERE a = b) AS same FROM p), k AS (SELECT sum(x.n * y.n) AS ab FROM (SELECT a AS k, count(*) AS n FROM p GROUP BY 1) x JOIN (SELECT b AS k, count(*) AS n FROM p GROUP BY 1) y USING (k))
SELECT n, same / n AS observed, ab / (n * n) AS expected, (same / n - ab / (n * n)) / (1 - ab / (n * n)) AS kappa FROM n, k""")
def _(t):
    return stats.kappa(pairs(t), "a", "b")


@query("A28_accuracy", f"WITH p AS ({_PAIRS}) SELECT avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END) AS accuracy FROM p")
def _(t):
    return pairs(t).agg(F.avg((F.col("a") == F.col("b")).cast("double")).alias("accuracy"))


@query("A29_wilson", """
WITH s AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS h, count(*) AS n FROM events GROUP BY 1), c AS (SELECT *, h / n AS p, 1.959963984540054 AS z FROM s)
SELECT user_id, greatest(0, (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)) AS low,
 least(1, (p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)) AS high FROM c""")
def _(t):
    s = t.events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("h"), F.count("*").alias("n"))
    low, high = stats.wilson(F.col("h"), F.col("n"))
    return s.select("user_id", low.alias("low"), high.alias("high"))


@query("A30_cluster_bootstrap")
def _(t):
    p = pairs(t).withColumn("g", F.lit("all")).withColumn("cluster", F.col("doc_id") % 25)
    return stats.bootstrap(p, "g", "cluster", "a", "b", 400)


@query("A31_panel_label", """
WITH v AS (SELECT doc_id, [quality, 1 - toxic, CAST(doc_id % 2 AS INTEGER)] AS votes FROM labels), s AS (SELECT doc_id, list_sum(votes) AS s FROM v)
SELECT doc_id, CASE WHEN s IN (0, 3) THEN 'unanimous' WHEN s IN (1, 2) THEN 'decisive' END AS panel, CASE WHEN s IN (1, 2) THEN 1 ELSE 0 END AS dissent FROM s""")
def _(t):
    s = F.col("quality") + (1 - F.col("toxic")) + (F.col("doc_id") % 2)
    table = F.create_map(*(F.lit(x) for x in ("0", "unanimous", "1", "decisive", "2", "decisive", "3", "unanimous")))
    return t.labels.select("doc_id", F.element_at(table, s.cast("string")).alias("panel"), F.when(s.isin(1, 2), 1).otherwise(0).alias("dissent"))


@query("A33_bradley_terry")
def _(t):
    m = t.lineitem.select((F.col("l_orderkey") % 3).alias("g"), (F.col("l_suppkey") % 20).alias("x"), (F.col("l_partkey") % 20).alias("y"), F.when(F.col("l_quantity") > 30, 1.0).when(F.col("l_quantity") < 20, 0.0).otherwise(0.5).alias("score"))
    return stats.bradley_terry(m.filter("x != y"), "g")


@query("A36_rank_intervals", """
WITH r AS (SELECT c_custkey AS i, c_acctbal - 50 AS lo, c_acctbal + 50 AS hi FROM customer)
SELECT a.i, 1 + count(*) FILTER (WHERE b.lo > a.hi) AS best, (SELECT count(*) FROM r) - count(*) FILTER (WHERE b.hi < a.lo) AS worst FROM r a, r b GROUP BY a.i""")
def _(t):
    r = t.customer.select(F.col("c_custkey").alias("i"), (F.col("c_acctbal") - 50).alias("lo"), (F.col("c_acctbal") + 50).alias("hi"))
    return stats.rank_intervals(r, "i", "lo", "hi")


@query("A37_kendall_tau", """
WITH r AS (SELECT s_suppkey AS i, s_acctbal AS a, s_nationkey * 10 + s_suppkey % 3 AS b FROM supplier)
SELECT count(*) AS pairs, count(*) FILTER (WHERE sign(x.a - y.a) * sign(x.b - y.b) > 0) AS concordant, count(*) FILTER (WHERE sign(x.a - y.a) * sign(x.b - y.b) < 0) AS discordant,
 (count(*) FILTER (WHERE sign(x.a - y.a) * sign(x.b - y.b) > 0) - count(*) FILTER (WHERE sign(x.a - y.a) * sign(x.b - y.b) < 0)) / count(*) AS tau FROM r x JOIN r y ON x.i < y.i""")
def _(t):
    r = t.supplier.select(F.col("s_suppkey").alias("i"), F.col("s_acctbal").alias("a"), (F.col("s_nationkey") * 10 + F.col("s_suppkey") % 3).alias("b"))
    return stats.kendall(r, "a", "b", "i")


@query("A40_precision_recall", f"""
WITH p AS ({_PAIRS}) SELECT count(*) FILTER (WHERE a = 'good' AND b = 'good') AS tp, count(*) FILTER (WHERE b = 'good') AS p, count(*) FILTER (WHERE a = 'good') AS t,
 count(*) FILTER (WHERE a = 'good' AND b = 'good') / count(*) FILTER (WHERE b = 'good') AS precision, count(*) FILTER (WHERE a = 'good' AND b = 'good') / count(*) FILTER (WHERE a = 'good') AS recall FROM p""")
def _(t):
    return stats.precision_recall(pairs(t), F.col("a") == "good", F.col("b") == "good")


@query("A41_stratified_split", """
SELECT doc_id, row_number() OVER (PARTITION BY quality ORDER BY sha256(CAST(doc_id AS VARCHAR)), doc_id) <= round_even(count(*) OVER (PARTITION BY quality) * 0.6, 0) AS train FROM labels""")
def _(t):
    return stats.stratified_split(t.labels, "quality", "doc_id").select("doc_id", "train")


@query("A68_digest_fold", """
SELECT doc_id, CAST(CAST('0x' || substr(sha256(CAST(doc_id AS VARCHAR) || chr(0) || CAST(quality AS VARCHAR)), 1, 16) AS UBIGINT) % 5 AS INTEGER) AS fold FROM labels""")
def _(t):
    return t.labels.select("doc_id", stats.digest_fold([F.col("doc_id"), F.col("quality")], 5).alias("fold"))


@query("A47_largest_remainder", """
WITH w AS (SELECT s_nationkey AS g, s_suppkey AS k, CAST(floor(s_acctbal) + 1000 AS BIGINT) AS w FROM supplier), p AS (SELECT *, CAST(sum(w) OVER (PARTITION BY g) AS HUGEINT) AS a FROM w),
f AS (SELECT *, CAST((CAST(w AS HUGEINT) * 100 - (CAST(w AS HUGEINT) * 100) % a) / a AS BIGINT) AS s, (CAST(w AS HUGEINT) * 100) % a AS r FROM p)
SELECT k, s + CASE WHEN row_number() OVER (PARTITION BY g ORDER BY r DESC, k) <= 100 - sum(s) OVER (PARTITION BY g) THEN 1 ELSE 0 END AS share FROM f""")
def _(t):
    w = t.supplier.select(F.col("s_nationkey").alias("g"), F.col("s_suppkey").alias("k"), (F.floor("s_acctbal") + 1000).cast("long").alias("w"))
    return stats.largest_remainder(w, "g", "k", "w", 100).select("k", "share")


@query("A67_standardize", "SELECT s_suppkey, (s_acctbal - avg(s_acctbal) OVER (PARTITION BY s_nationkey)) / nullif(stddev_pop(s_acctbal) OVER (PARTITION BY s_nationkey), 0) AS z FROM supplier")
def _(t):
    return stats.standardized(t.supplier, "s_nationkey", "s_acctbal").select("s_suppkey", "z")


@query("A45_density_score", """
WITH d AS (SELECT p_partkey, CAST(p_size AS BIGINT) * 700000 AS d FROM part)
SELECT p_partkey, CASE WHEN d <= 0 THEN 100000000 WHEN d < 1000000 THEN 100000000 - d * 10 WHEN d < 5000000 THEN 90000000 - ((d - 1000000) * 20 + 3) // 4 WHEN d < 10000000 THEN 70000000 - ((d - 5000000) * 30 + 4) // 5
 WHEN d < 20000000 THEN 40000000 - ((d - 10000000) * 30 + 9) // 10 WHEN d < 30000000 THEN 10000000 - ((d - 20000000) * 10 + 9) // 10 ELSE 0 END AS score FROM d""")
def _(t):
    return t.part.select("p_partkey", stats.density_score(F.col("p_size").cast("long") * 700_000).alias("score"))


@query("A42_function_cost", f"""{WITH} SELECT id, CASE WHEN cyclomatic > 10 THEN (cyclomatic - 10) * (cyclomatic - 10) * 250000 // 10 ELSE 0 END + CASE WHEN line_span > 20 THEN (line_span - 20) * (line_span - 20) * 50000 // 20 ELSE 0 END + 1000 * cognitive AS cost FROM entities WHERE kind = 1""")
def _(t):
    e = views(t)["entities"].filter("kind = 1")
    return e.select("id", (stats.excess_cost(F.col("cyclomatic"), 10, 250_000) + stats.excess_cost(F.col("line_span"), 20, 50_000) + 1000 * F.col("cognitive")).alias("cost"))


@query("A44_dominance", f"""{WITH}, s AS (SELECT file_id, sum(line_span) AS t FROM entities WHERE kind = 1 GROUP BY 1)
SELECT e.id, CAST(1000000 + greatest(2 * e.line_span - s.t, 0) * 3 * 1000000 // s.t AS BIGINT) AS scale FROM entities e JOIN s USING (file_id) WHERE kind = 1 AND s.t > 0""")
def _(t):
    e = views(t)["entities"].filter("kind = 1")
    s = e.groupBy("file_id").agg(F.sum("line_span").alias("t")).filter("t > 0")
    return e.join(s, "file_id").select("id", stats.dominance(F.col("line_span"), F.col("t"), 3).cast("long").alias("scale"))


@query("A46_scope_score", """
SELECT n_name AS scope, CAST(sum(CAST(l_quantity AS HUGEINT) * l_linenumber) AS VARCHAR) AS numerator, CAST(sum(CAST(l_linenumber AS HUGEINT)) AS VARCHAR) AS denominator,
 sum(CAST(l_quantity AS HUGEINT) * l_linenumber) >= 25 * sum(CAST(l_linenumber AS HUGEINT)) AS meets FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1""")
def _(t):
    j = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    s = stats.scope_score(j.select(F.col("n_name").alias("scope"), F.col("l_quantity").alias("score"), F.col("l_linenumber").alias("tokens")), "scope", "score", "tokens")
    return s.select("scope", F.col("numerator").cast("string").alias("numerator"), F.col("denominator").cast("string").alias("denominator"), stats.meets(F.col("numerator"), F.col("denominator"), 25).alias("meets"))


@query("A50_percentile_vs_reference", """
SELECT s_suppkey, CAST(floor(100 * (SELECT count(*) FROM customer WHERE c_acctbal < s_acctbal) / (SELECT count(*) FROM customer)) AS BIGINT) AS percentile FROM supplier""")
def _(t):
    return stats.percentile_vs(t.supplier.select("s_suppkey", F.col("s_acctbal").alias("v")), t.customer.select(F.col("c_acctbal").alias("v")), "v").select("s_suppkey", "percentile")


@query("A49_reference_line", "SELECT c_mktsegment, quantile_disc(c_acctbal, 0.8) AS line FROM customer GROUP BY 1")
def _(t):
    return t.customer.groupBy("c_mktsegment").agg(stats.nearest_rank("c_acctbal", 80).alias("line"))


@query("A51_threshold_shrinkage", """
WITH a AS (SELECT s_nationkey, count(*) AS k, CAST(floor(max(s_acctbal)) AS BIGINT) AS anchor FROM supplier GROUP BY 1)
SELECT s_nationkey, least(greatest(5000 + CAST(floor((2 * k * (anchor - 5000) + (k + 2)) / (2 * (k + 2))) AS BIGINT), 4000), 9000) AS threshold FROM a""")
def _(t):
    a = t.supplier.groupBy("s_nationkey").agg(F.count("*").alias("k"), F.floor(F.max("s_acctbal")).cast("long").alias("anchor"))
    return a.select("s_nationkey", stats.shifted(5000, F.col("anchor"), F.col("k"), F.lit(4000), F.lit(9000)).alias("threshold"))


@query("A52_cognitive_complexity", f"""{WITH}, n AS (SELECT i.id, i.file_id, count(o.id) AS depth FROM entities i LEFT JOIN entities o ON o.file_id = i.file_id AND o.kind = 2 AND o.id <> i.id AND o.start_byte <= i.start_byte AND o.end_byte >= i.end_byte WHERE i.kind = 2 GROUP BY 1, 2)
SELECT file_id, CAST(sum(1 + depth) AS BIGINT) AS cognitive FROM n GROUP BY 1""")
def _(t):
    from ..operators import relational as R

    e = views(t)["entities"].filter("kind = 2").select("id", "file_id", "start_byte", "end_byte")
    o = e.select("file_id", F.col("id").alias("o_id"), F.col("start_byte").alias("o_start"), F.col("end_byte").alias("o_end"))
    depth = R.contained(e, o, ["file_id"], "start_byte", "end_byte", "o_start", "o_end", 256).filter("id != o_id").groupBy("id").agg(F.count("*").alias("depth"))
    return e.join(depth, "id", "left").groupBy("file_id").agg(F.sum(1 + F.coalesce("depth", F.lit(0))).alias("cognitive"))


@query("A53_cyclomatic_complexity", f"{WITH} SELECT file_id, 1 + count(*) FILTER (WHERE kind = 2) AS cyclomatic FROM entities GROUP BY 1")
def _(t):
    return views(t)["entities"].groupBy("file_id").agg((1 + F.count_if(F.col("kind") == 2)).alias("cyclomatic"))


@query("A55_breakdown", """
WITH c AS (SELECT p_brand AS component, sum(p_size) AS debt FROM part GROUP BY 1) SELECT component, CAST(debt AS BIGINT) AS debt, debt / sum(debt) OVER () AS share FROM c""")
def _(t):
    c = t.part.groupBy(F.col("p_brand").alias("component")).agg(F.sum("p_size").alias("debt"))
    return c.crossJoin(F.broadcast(t.part.agg(F.sum("p_size").alias("all")))).select("component", "debt", (F.col("debt") / F.col("all")).alias("share"))


@query("A72_fix_ranking", f"""{WITH}, s AS (SELECT e.id, f.language, e.cyclomatic, e.cyclomatic / sum(e.cyclomatic) OVER (PARTITION BY f.language) AS share FROM entities e JOIN files f ON f.id = e.file_id WHERE e.kind = 1 AND e.cyclomatic > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY language ORDER BY cyclomatic > 10 DESC, share DESC, id) AS r FROM s) SELECT id, language, share FROM r WHERE r <= 5""")
def _(t):
    from pyspark.sql import Window

    v = views(t)
    e = v["entities"].filter("kind = 1 AND cyclomatic > 0").join(v["files"].select(F.col("id").alias("file_id"), "language"), "file_id")
    w = Window.partitionBy("language")
    s = e.withColumn("share", F.col("cyclomatic") / F.sum("cyclomatic").over(w))
    return s.withColumn("r", F.row_number().over(w.orderBy(F.desc(F.col("cyclomatic") > 10), F.desc("share"), "id"))).filter("r <= 5").select("id", "language", "share")


@query("A56_progress_rollup", """
SELECT o_custkey AS plan, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, min(o_orderkey) FILTER (WHERE o_orderstatus = 'O') AS next_ready FROM orders GROUP BY 1""")
def _(t):
    s = F.col("o_orderstatus")
    return t.orders.groupBy(F.col("o_custkey").alias("plan")).agg(F.count("*").alias("total"), F.count_if(s == "F").alias("done"), F.min(F.when(s == "O", F.col("o_orderkey"))).alias("next_ready"))


@query("A61_topic_counts", "SELECT p_type AS topic, count(*) AS n FROM part GROUP BY 1")
def _(t):
    return t.part.groupBy(F.col("p_type").alias("topic")).agg(F.count("*").alias("n"))


@query("A62_promotion_candidates", "SELECT l_partkey AS step, count(*) AS requests, count(*) FILTER (WHERE l_returnflag = 'R') AS trouble FROM lineitem GROUP BY 1 HAVING count(*) >= 40 OR count(*) FILTER (WHERE l_returnflag = 'R') >= 15")
def _(t):
    g = t.lineitem.groupBy(F.col("l_partkey").alias("step")).agg(F.count("*").alias("requests"), F.count_if(F.col("l_returnflag") == "R").alias("trouble"))
    return g.filter("requests >= 40 OR trouble >= 15")


@query("A01_usage_by_kind", """
SELECT l_returnflag AS kind, count(*) AS n, sum(l_extendedprice) AS total, CAST(sum(l_quantity) AS BIGINT) // 7 AS saved FROM lineitem GROUP BY 1 ORDER BY total DESC""")
def _(t):
    g = t.lineitem.groupBy(F.col("l_returnflag").alias("kind")).agg(F.count("*").alias("n"), F.sum("l_extendedprice").alias("total"), F.sum("l_quantity").alias("q"))
    return g.select("kind", "n", "total", X.trunc_div(F.col("q").cast("long"), F.lit(7)).alias("saved")).orderBy(F.desc("total"))


@query("A77_budget_decision", """
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'missing' WHEN c_nationkey > 20 THEN 'provider' WHEN c_acctbal > 9000 THEN 'memory' WHEN c_custkey % 11 = 0 THEN 'workers' ELSE 'start' END AS decision FROM customer""")
def _(t):
    d = F.when(F.col("c_acctbal") < 0, "missing").when(F.col("c_nationkey") > 20, "provider").when(F.col("c_acctbal") > 9000, "memory").when(F.col("c_custkey") % 11 == 0, "workers").otherwise("start")
    return t.customer.select("c_custkey", d.alias("decision"))


@query("A78_reach", """
SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(l_partkey) FILTER (WHERE l_returnflag <> 'R'))), ',') AS reach FROM lineitem GROUP BY 1""")
def _(t):
    kept = F.when(F.col("l_returnflag") != "R", F.col("l_partkey"))
    g = t.lineitem.groupBy("l_orderkey").agg(F.sort_array(F.collect_set(kept)).alias("reach"))
    return g.select("l_orderkey", F.when(F.size("reach") > 0, F.array_join(F.col("reach").cast("array<string>"), ",")).alias("reach"))


@query("F12_fixed_decimals", "SELECT s_suppkey, CAST(CAST(s_acctbal AS DECIMAL(30,6)) * 1000000 AS BIGINT) AS micro FROM supplier")
def _(t):
    return t.supplier.select("s_suppkey", X.to_micro(F.col("s_acctbal").cast("decimal(20,6)").cast("string")).cast("long").alias("micro"))


@query("F10_trunc_div", "SELECT s_suppkey, CAST(trunc((s_suppkey - 50) / 7) AS BIGINT) AS q FROM supplier")
def _(t):
    return t.supplier.select("s_suppkey", X.trunc_div(F.col("s_suppkey") - 50, F.lit(7)).alias("q"))


@query("F17_canonical_digest", """SELECT s_suppkey, sha256('{"s_nationkey":' || s_nationkey || ',"s_suppkey":' || s_suppkey || '}') AS digest FROM supplier""")
def _(t):
    return t.supplier.select("s_suppkey", X.canonical_digest("s_suppkey", "s_nationkey").alias("digest"))


@query("F23_share_micros", "SELECT l_suppkey, CAST(floor(count(*) FILTER (WHERE l_returnflag = 'R') * 1000000 / count(*)) AS BIGINT) AS micros FROM lineitem GROUP BY 1")
def _(t):
    g = t.lineitem.groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("a"), F.count("*").alias("n"))
    return g.select("l_suppkey", X.share_micros(F.col("a"), F.col("n")).alias("micros"))


@query("F19_json_arrays", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(json_extract(props, '$.k') AS BIGINT) IN (1, 2, 3) AS listed FROM events")
def _(t):
    k = F.from_json("props", "k long")["k"]
    return t.events.select("event_id", k.alias("k"), F.array_contains(F.from_json(F.lit("[1,2,3]"), "array<bigint>"), k).alias("listed"))


@query("F24_path_sort_key", f"{WITH} SELECT id, CASE WHEN regexp_matches(path, '^src/') THEN 0 ELSE 1 END AS rank FROM files ORDER BY rank, path LIMIT 60")
def _(t):
    f = views(t)["files"].withColumn("rank", F.when(F.col("path").rlike("^src/"), 0).otherwise(1))
    return f.orderBy("rank", "path").limit(60).select("id", "rank")

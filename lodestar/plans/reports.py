"""Reports and cascades: roles, receipts, rates, dissent, findings, cycles of review, page and colour scalars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import functions as X
from ..operators import relational as R
from ..operators import sequence as S
from ..operators import stats
from ..operators import text as T
from .codeindex import WITH, views
from .registry import query


def error():
    return F.col("event_type") == "error"


@query("A10_role_classification", """
SELECT conv_id, turn, CASE WHEN regexp_matches(lower(substr(text, 1, 260)), 'license|review') THEN 'reviewer' WHEN contains(lower(substr(text, 1, 60)), 'the ') THEN 'planner' WHEN lower(text) LIKE 'a%' THEN 'builder' ELSE 'main' END AS role FROM conversations""")
def _(t):
    low = F.lower("text")
    role = F.when(F.substring(low, 1, 260).rlike("license|review"), "reviewer").when(F.substring(low, 1, 60).contains("the "), "planner").when(low.startswith("a"), "builder").otherwise("main")
    return t.conversations.select("conv_id", "turn", role.alias("role"))


@query("A19_ready_idle", """
WITH e AS (SELECT *, sum(CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS depth, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events)
SELECT user_id, sum((epoch_us(nxt) - epoch_us(ts)) / 1000000) AS idle_s FROM e WHERE depth > 0 AND nxt IS NOT NULL GROUP BY 1""")
def _(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    step = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "purchase", -1).otherwise(0)
    e = t.events.withColumn("depth", F.sum(step).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("nxt", F.lead("ts").over(w))
    return e.filter("depth > 0 AND nxt IS NOT NULL").groupBy("user_id").agg(F.sum((S.micros(F.col("nxt")) - S.micros(F.col("ts"))) / 1_000_000).alias("idle_s"))


@query("A23_latency_criterion", """
WITH l AS (SELECT o_orderkey, o_orderpriority, min((epoch_us(l_shipdate) - epoch_us(o_orderdate)) // 1000000) AS s FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_shipdate >= o_orderdate GROUP BY 1, 2)
SELECT o_orderpriority, count(*) AS n, quantile_disc(s, 0.95) AS p95, CASE WHEN count(*) < 100 THEN 'insufficient' WHEN quantile_disc(s, 0.95) <= 100000000 THEN 'pass' ELSE 'fail' END AS verdict FROM l GROUP BY 1""")
def _(t):
    j = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).filter("l_shipdate >= o_orderdate")
    s = ((S.micros(F.col("l_shipdate")) - S.micros(F.col("o_orderdate"))) / 1_000_000).cast("long")
    l = j.groupBy("o_orderkey", "o_orderpriority").agg(F.min(s).alias("s"))
    g = l.groupBy("o_orderpriority").agg(F.count("*").alias("n"), stats.nearest_rank("s", 95).alias("p95"))
    return g.withColumn("verdict", F.when(F.col("n") < 100, "insufficient").when(F.col("p95") <= 100_000_000, "pass").otherwise("fail"))


@query("A25_replay_count", """
SELECT p.user_id, count(*) AS replays FROM events p WHERE p.event_type = 'purchase' AND EXISTS (SELECT 1 FROM events s WHERE s.user_id = p.user_id AND s.event_type = 'signup' AND s.ts < p.ts AND s.ts > p.ts - INTERVAL 1 DAY) GROUP BY 1""")
def _(t):
    p = t.events.filter("event_type = 'purchase'")
    last = R.as_of(p.select("event_id", "user_id", "ts"), t.events.filter("event_type = 'signup'").select("user_id", "ts", F.col("ts").alias("seen")), ["user_id"], ["ts"], ["ts"], ["seen"])
    return last.filter(F.col("seen") > F.col("ts") - F.make_dt_interval(F.lit(1))).groupBy("user_id").agg(F.count("*").alias("replays"))


@query("A26_wake_metrics", """
SELECT count(*) AS wakes, count(*) FILTER (WHERE value > 50) AS missed, count(DISTINCT user_id) AS recipients, max(value) AS slowest FROM events WHERE event_type = 'click'""")
def _(t):
    c = t.events.filter("event_type = 'click'")
    return c.agg(F.count("*").alias("wakes"), F.count_if(F.col("value") > 50).alias("missed"), F.countDistinct("user_id").alias("recipients"), F.max("value").alias("slowest"))


@query("A35_stopping_rule", """
WITH r AS (SELECT s_nationkey AS g, s_suppkey AS i, s_acctbal AS v, lead(s_acctbal) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS nxt FROM supplier)
SELECT g, min(v - nxt) AS least_gap, coalesce(min(v - nxt) > 500, true) AS stop FROM r GROUP BY 1""")
def _(t):
    w = Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey")
    r = t.supplier.withColumn("gap", F.col("s_acctbal") - F.lead("s_acctbal").over(w))
    return r.groupBy(F.col("s_nationkey").alias("g")).agg(F.min("gap").alias("least_gap")).withColumn("stop", F.coalesce(F.col("least_gap") > 500, F.lit(True)))


@query("A38_latest_label", "SELECT user_id, event_type, arg_max(value, (ts, props)) AS value FROM events GROUP BY 1, 2")
def _(t):
    return t.events.groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "props")).alias("value"))


@query("A43_file_cost", f"""{WITH}, o AS (SELECT from_file_id AS id, count(DISTINCT to_file_id) AS fan FROM edges WHERE resolved = 1 GROUP BY 1)
SELECT f.id, CASE WHEN f.complexity > 20 THEN (f.complexity - 20) * (f.complexity - 20) * 100000 // 20 ELSE 0 END + CASE WHEN coalesce(o.fan, 0) > 5 THEN (o.fan - 5) * (o.fan - 5) * 20000 // 5 ELSE 0 END AS cost FROM files f LEFT JOIN o ON o.id = f.id""")
def _(t):
    v = views(t)
    o = v["edges"].filter("resolved = 1").groupBy(F.col("from_file_id").alias("id")).agg(F.countDistinct("to_file_id").alias("fan"))
    f = v["files"].join(o, "id", "left")
    return f.select("id", (stats.excess_cost(F.col("complexity"), 20, 100_000) + stats.excess_cost(F.coalesce("fan", F.lit(0)), 5, 20_000)).alias("cost"))


@query("A59_friction_filters", """
SELECT DISTINCT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY' AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND contains(o_orderpriority, 'URGENT')) ORDER BY 1 LIMIT 100""")
def _(t):
    hit = t.orders.filter(F.col("o_orderpriority").contains("URGENT")).select(F.col("o_custkey").alias("c_custkey"))
    return R.page(t.customer.filter("c_mktsegment = 'MACHINERY'").join(hit, "c_custkey", "left_semi").select("c_custkey"), [F.asc("c_custkey")], 100)


@query("A60_visible_entries", """
SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_orderdate >= TIMESTAMP '1998-01-01' AND (o_custkey % 10 = 0 OR o_orderpriority IN ('1-URGENT', '2-HIGH'))""")
def _(t):
    wanted = t.spark.createDataFrame([("1-URGENT",), ("2-HIGH",)], "o_orderpriority string").withColumn("hit", F.lit(True))
    o = t.orders.filter((F.col("o_orderstatus") != "F") & (F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp")))
    return o.join(F.broadcast(wanted), "o_orderpriority", "left").filter((F.col("o_custkey") % 10 == 0) | F.col("hit")).select("o_orderkey")


@query("A64_decisive_rates", """
SELECT event_type AS dimension, count(*) FILTER (WHERE value > 10) / count(*) AS decisive, count(*) FILTER (WHERE value > 40) / count(*) AS unanimous FROM events GROUP BY 1""")
def _(t):
    rate = lambda c: F.count_if(c) / F.count("*")
    return t.events.groupBy(F.col("event_type").alias("dimension")).agg(rate(F.col("value") > 10).alias("decisive"), rate(F.col("value") > 40).alias("unanimous"))


@query("A65_dissent_rates", """
WITH l AS (SELECT DISTINCT event_type AS lens FROM events), v AS (SELECT DISTINCT user_id % 10 AS variant FROM events)
SELECT variant, lens, count(e.event_id) AS dissent FROM v CROSS JOIN l LEFT JOIN events e ON e.user_id % 10 = variant AND e.event_type = lens AND e.value > 45 GROUP BY 1, 2""")
def _(t):
    v, l = t.events.select((F.col("user_id") % 10).alias("variant")).distinct(), t.events.select(F.col("event_type").alias("lens")).distinct()
    d = t.events.filter("value > 45").groupBy((F.col("user_id") % 10).alias("variant"), F.col("event_type").alias("lens")).agg(F.count("*").alias("dissent"))
    # both sides are dimensions of a few values
    return v.crossJoin(l).join(d, ["variant", "lens"], "left").select("variant", "lens", F.coalesce("dissent", F.lit(0)).alias("dissent"))


@query("A66_latest_votes", "SELECT user_id % 7 AS lens, arg_max(event_type, (ts, user_id, event_id)) AS vote FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy((F.col("user_id") % 7).alias("lens")).agg(F.max_by("event_type", F.struct("ts", "user_id", "event_id")).alias("vote"))


@query("A70_delegation_share", f"{WITH} SELECT file_id, avg(CASE WHEN owner_type IS NOT NULL THEN CASE WHEN cyclomatic < 3 THEN 1.0 ELSE 0.0 END END) AS share FROM entities GROUP BY 1")
def _(t):
    known = F.when(F.col("owner_type").isNotNull(), (F.col("cyclomatic") < 3).cast("double"))
    return views(t)["entities"].groupBy("file_id").agg(F.avg(known).alias("share"))


@query("A71_median_tokens", f"{WITH} SELECT file_id, quantile_disc(line_span, 0.5) AS p50 FROM entities GROUP BY 1")
def _(t):
    return views(t)["entities"].groupBy("file_id").agg(stats.nearest_rank("line_span", 50).alias("p50"))


@query("A73_before_after", """
SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'new' WHEN p_size < (p_partkey * 7) % 50 THEN 'worse' WHEN p_size > (p_partkey * 7) % 50 THEN 'better' ELSE 'same' END AS verdict FROM part""")
def _(t):
    before = t.part.filter("p_partkey % 5 != 0").select("p_partkey", (F.col("p_partkey") * 7 % 50).alias("was"))
    j = t.part.select("p_partkey", "p_size").join(before, "p_partkey", "left")
    return j.select("p_partkey", F.when(F.col("was").isNull(), "new").when(F.col("p_size") < F.col("was"), "worse").when(F.col("p_size") > F.col("was"), "better").otherwise("same").alias("verdict"))


@query("A74_coverage", "SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS per_call, count(*) FILTER (WHERE event_type = 'view') AS total_only, count(*) FILTER (WHERE event_type = 'error') AS none FROM events GROUP BY 1")
def _(t):
    p = t.events.groupBy("user_id").pivot("event_type", ["click", "view", "error"]).count().na.fill(0)
    return p.select("user_id", F.col("click").alias("per_call"), F.col("view").alias("total_only"), F.col("error").alias("none"))


@query("A75_context_sample", "SELECT user_id, arg_max(value, (ts, event_id)) AS sample FROM events WHERE event_type <> 'error' GROUP BY 1")
def _(t):
    return t.events.filter("event_type != 'error'").groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("sample"))


@query("A79_merge_verdict", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'merged' WHEN 'P' THEN 'ready' ELSE 'none' END AS verdict FROM orders")
def _(t):
    return t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "merged").when(F.col("o_orderstatus") == "P", "ready").otherwise("none").alias("verdict"))


@query("E06_frame_diff", """
WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, arg_max(event_type, (ts, event_id)) AS state FROM events GROUP BY 1, 2)
SELECT user_id, CAST(day AS VARCHAR) AS day, prev, state FROM (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY day) AS prev FROM d) WHERE prev IS NOT NULL AND prev <> state""")
def _(t):
    d = t.events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"))
    return S.state_changes(d, ["user_id"], ["day"], "state").select("user_id", F.col("day").cast("string").alias("day"), F.col("previous").alias("prev"), "state")


@query("E09_oversized_output", "SELECT doc_id, strlen(text) AS bytes FROM documents WHERE strlen(text) >= 4096 AND NOT contains(text, 'license')")
def _(t):
    return t.documents.filter((F.octet_length("text") >= 4096) & ~F.col("text").contains("license")).select("doc_id", F.octet_length("text").alias("bytes"))


@query("E18_daily_usage", """
SELECT user_id, CAST(greatest(sum(value), 1000 * (epoch_us(max(ts)) - epoch_us(greatest(min(ts), date_trunc('day', max(ts))))) / 3600000000) AS DECIMAL(18, 4)) > 500 AS heavy FROM events GROUP BY 1""")
def _(t):
    span = 1000 * (S.micros(F.max("ts")) - S.micros(F.greatest(F.min("ts"), F.date_trunc("day", F.max("ts")).cast("timestamp_ntz")))) / 3_600_000_000
    return t.events.groupBy("user_id").agg((F.greatest(F.sum("value"), span) > 500).alias("heavy"))


@query("E20_undelivered_deadlines", """
SELECT event_id, CAST(epoch_us(ts) // 1000000 + CASE WHEN user_id % 5 = 0 THEN 60 ELSE 600 END AS BIGINT) AS deadline FROM events WHERE event_type = 'click' AND NOT EXISTS (SELECT 1 FROM events d WHERE d.event_type = 'purchase' AND d.user_id = events.user_id AND d.ts > events.ts)""")
def _(t):
    delivered = t.events.filter("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("_delivered"))
    e = t.events.filter("event_type = 'click'").join(delivered, "user_id", "left").filter("_delivered IS NULL OR _delivered <= ts")
    return e.select("event_id", (F.floor(S.micros(F.col("ts")) / 1_000_000) + F.when(F.col("user_id") % 5 == 0, 60).otherwise(600)).cast("long").alias("deadline"))


@query("E21_claim_candidates", """
SELECT s AS queue, k AS item FROM (SELECT o_custkey % 20 AS s, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderpriority, o_orderdate, o_orderkey) AS r FROM orders o WHERE o_orderstatus = 'O' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')) WHERE r = 1""")
def _(t):
    ready = t.orders.filter("o_orderstatus = 'O'").join(t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")
    best = F.min(F.struct("o_orderpriority", "o_orderdate", "o_orderkey"))
    return ready.groupBy((F.col("o_custkey") % 20).alias("queue")).agg(best.alias("b")).select("queue", F.col("b.o_orderkey").alias("item"))


@query("E22_lease_expiry", "SELECT user_id, event_type = 'click' AS claimed FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 AND ts < (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def _(t):
    now = F.lit(t.events.agg(F.max("ts")).first()[0])
    last = S.latest(t.events.select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"])
    return last.filter(F.col("ts") < now - F.make_dt_interval(F.lit(0), F.lit(1))).select("user_id", (F.col("event_type") == "click").alias("claimed"))


@query("E24_event_fold", """
SELECT user_id, count(*) AS occurrences, arg_max(event_type, (ts, event_id)) AS status, len(list_distinct(list(event_type))) AS tags FROM events GROUP BY 1""")
def _(t):
    return t.events.groupBy("user_id").agg(F.count("*").alias("occurrences"), F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.countDistinct("event_type").alias("tags"))


@query("E32_stopped_readers", "SELECT user_id FROM events GROUP BY 1 HAVING max(ts) < (SELECT max(ts) FROM events) - INTERVAL 30 MINUTE AND count(*) FILTER (WHERE event_type = 'view') > 5")
def _(t):
    now = F.lit(t.events.agg(F.max("ts")).first()[0])
    g = t.events.groupBy("user_id").agg(F.max("ts").alias("last"), F.count_if(F.col("event_type") == "view").alias("pending"))
    return g.filter((F.col("last") < now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(30))) & (F.col("pending") > 5)).select("user_id")


@query("E33_sweep_selection", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def _(t):
    return t.customer.join(t.orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("E34_metric_findings", """
SELECT user_id, kind, n, substr(sha256(kind || ':' || CAST(user_id AS VARCHAR)), 1, 16) AS dedupe_key FROM (
 SELECT user_id, 'errors' AS kind, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1 HAVING count(*) > 15 UNION ALL SELECT user_id, 'views', count(*) FROM events WHERE event_type = 'view' GROUP BY 1 HAVING count(*) > 18)""")
def _(t):
    part = lambda k, e, n: t.events.filter(F.col("event_type") == e).groupBy("user_id").agg(F.count("*").alias("n")).filter(F.col("n") > n).select("user_id", F.lit(k).alias("kind"), "n")
    found = part("errors", "error", 15).union(part("views", "view", 18))
    return found.withColumn("dedupe_key", F.left(F.sha2(F.concat_ws(":", "kind", F.col("user_id").cast("string")), 256), F.lit(16)))


@query("E35_dedupe_open", """
WITH open AS (SELECT unnest(regexp_extract_all('sweep-key:' || CAST(o_custkey % 50 AS VARCHAR), 'sweep-key:([0-9]+)', 1)) AS k FROM orders WHERE o_orderstatus = 'O' AND o_custkey % 3 = 0) SELECT c_custkey FROM customer WHERE CAST(c_custkey AS VARCHAR) NOT IN (SELECT k FROM open)""")
def _(t):
    note = F.concat(F.lit("sweep-key:"), (F.col("o_custkey") % 50).cast("string"))
    keys = t.orders.filter("o_orderstatus = 'O' AND o_custkey % 3 = 0").select(F.explode(F.regexp_extract_all(note, F.lit("sweep-key:([0-9]+)"))).alias("k")).distinct()
    return t.customer.join(keys, F.col("c_custkey").cast("string") == F.col("k"), "left_anti").select("c_custkey")


@query("E37_audit_since", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20' AND (event_type = 'click' OR starts_with(event_type, 'pur'))")
def _(t):
    return t.events.filter((F.col("ts") >= F.lit("2024-01-20").cast("timestamp")) & ((F.col("event_type") == "click") | F.col("event_type").startswith("pur"))).select("event_id")


@query("E39_latest_activity", """
SELECT user_id, CASE WHEN c IS NOT NULL AND (v IS NULL OR c >= v) THEN 'click' ELSE 'view' END AS source FROM (SELECT user_id, max(ts) FILTER (WHERE event_type = 'click') AS c, max(ts) FILTER (WHERE event_type = 'view') AS v FROM events GROUP BY 1)""")
def _(t):
    last = lambda k: F.max(F.when(F.col("event_type") == k, F.col("ts")))
    g = t.events.groupBy("user_id").agg(last("click").alias("c"), last("view").alias("v"))
    return g.select("user_id", F.when(F.col("c").isNotNull() & (F.col("v").isNull() | (F.col("c") >= F.col("v"))), "click").otherwise("view").alias("source"))


@query("E40_stalled_minutes", """
SELECT user_id, CASE WHEN i >= 600 THEN i END AS stalled FROM (SELECT user_id, CAST(floor((epoch_us((SELECT max(ts) FROM events)) - epoch_us(max(ts))) / 60000000) AS BIGINT) AS i FROM events GROUP BY 1)""")
def _(t):
    now = S.micros(F.lit(t.events.agg(F.max("ts")).first()[0]))
    g = t.events.groupBy("user_id").agg(F.floor((now - S.micros(F.max("ts"))) / 60_000_000).cast("long").alias("i"))
    return g.select("user_id", F.when(F.col("i") >= 600, F.col("i")).alias("stalled"))


@query("E42_generations_kept", "SELECT day FROM (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, row_number() OVER (ORDER BY CAST(ts AS DATE) DESC) AS r FROM events GROUP BY CAST(ts AS DATE)) WHERE r <= 6")
def _(t):
    days = t.events.select(F.to_date("ts").cast("string").alias("day")).distinct()
    return days.orderBy(F.desc("day")).limit(6)


@query("E44_loop_detection", """
WITH w AS (SELECT user_id, event_type, count(*) OVER (PARTITION BY user_id, event_type ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS n FROM events WHERE event_type IN ('purchase', 'signup')),
a AS (SELECT user_id, min(event_type) AS action, max(n) AS n FROM w WHERE n >= 3 GROUP BY 1),
m AS (SELECT user_id, event_type = 'purchase' AS stop, lag(event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events WHERE event_type IN ('signup', 'purchase')),
b AS (SELECT user_id, count(*) AS n FROM m WHERE stop AND NOT coalesce(prev, true) GROUP BY 1),
c AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' AND ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY GROUP BY 1 HAVING count(*) >= 3)
SELECT u.user_id, CASE WHEN a.n IS NOT NULL THEN a.action || ' repeated ' || CAST(a.n AS VARCHAR) WHEN b.n >= 5 THEN 'launch and stop ' || CAST(b.n AS VARCHAR) WHEN c.n IS NOT NULL THEN 'refused ' || CAST(c.n AS VARCHAR) END AS found
FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN a USING (user_id) LEFT JOIN b USING (user_id) LEFT JOIN c USING (user_id)""")
def _(t):
    return S.loops(t.events, "user_id", "event_type", "ts", F.col("event_type").isin("purchase", "signup"), F.col("event_type") == "signup", F.col("event_type") == "purchase", error(), repeat=(3, 86_400), cycles=5, refusals=(3, 10 * 86_400))


@query("E27_classify_files", f"""{WITH} SELECT id, CASE WHEN id % 9 = 0 THEN 'new' WHEN id % 8 = 0 THEN 'changed' ELSE 'unchanged' END AS status FROM files""")
def _(t):
    from ..sources import manifest_diff

    f = views(t)["files"]
    old = f.filter("id % 9 != 0").select("id", F.when(F.col("id") % 8 == 0, F.lit("old")).otherwise(F.sha2("path", 256)).alias("hash"))
    return manifest_diff(old, f.select("id", F.sha2("path", 256).alias("hash")), "id")


@query("F01_iso_instants", "SELECT event_id, CAST(epoch_us(ts) // 1000000 AS BIGINT) AS s FROM events")
def _(t):
    text = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return t.events.select("event_id", F.unix_seconds(X.instant(text)).alias("s"))


@query("F07_iso_week", "SELECT event_id, isoyear(ts) || '-W' || lpad(CAST(week(ts) AS VARCHAR), 2, '0') AS week FROM events")
def _(t):
    return t.events.select("event_id", X.iso_week(F.col("ts")).alias("week"))


@query("F13_half_up", "SELECT s_suppkey, CAST(CAST(round(CAST(s_acctbal AS DECIMAL(20,2)), 1) AS DECIMAL(20,1)) AS VARCHAR) AS shown FROM supplier")
def _(t):
    micro = (F.col("s_acctbal").cast("decimal(20,2)") * 1_000_000).cast("long")
    return t.supplier.select("s_suppkey", X.from_micro(micro, 1).alias("shown"))


@query("F20_hash_chain", "SELECT n_nationkey, sha256(sha256('start') || sha256(n_name)) AS link FROM nation")
def _(t):
    return t.nation.select("n_nationkey", X.chained(F.sha2(F.lit("start"), 256), F.sha2("n_name", 256)).alias("link"))


@query("F21_win_probability", "SELECT s_suppkey, round(1 / (1 + exp(-(s_acctbal / 5000 - 1))), 8) AS p FROM supplier")
def _(t):
    return t.supplier.select("s_suppkey", stats.win_probability(F.col("s_acctbal") / 5000, F.lit(1.0)).alias("p"))


@query("F27_saturated", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(least(greatest(CAST(l_extendedprice * 100000 AS BIGINT) - 1000000000, 0), 4294967295) AS BIGINT) AS v FROM lineitem")
def _(t):
    v = F.round(F.col("l_extendedprice") * 100_000).cast("long") - 1_000_000_000
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", X.saturated_u32(v).alias("v"))


@query("F28_css_values", "SELECT s_suppkey, s_suppkey * 16.0 / 2 AS px, s_suppkey * 100.0 AS ms FROM supplier")
def _(t):
    px = X.css_px(F.concat((F.col("s_suppkey") / 2).cast("string"), F.lit("rem")))
    ms = X.css_ms(F.concat((F.col("s_suppkey") / 10).cast("decimal(10,1)").cast("string"), F.lit("s")))
    return t.supplier.select("s_suppkey", px.alias("px"), F.round(ms, 6).alias("ms"))


@query("G31_fragments", f"""{WITH} SELECT file_id, count(*) FILTER (WHERE line_span <= 5 AND owner_type IS NOT NULL) AS fragments, count(*) FILTER (WHERE confidence = 'low') * 10 > count(*) * 3 AS low_confidence FROM entities WHERE kind = 1 GROUP BY 1""")
def _(t):
    e = views(t)["entities"].filter("kind = 1")
    return e.groupBy("file_id").agg(F.count_if((F.col("line_span") <= 5) & F.col("owner_type").isNotNull()).alias("fragments"), (F.count_if(F.col("confidence") == "low") * 10 > F.count("*") * 3).alias("low_confidence"))


@query("G09_wrapper_targets", f"""{WITH} SELECT w.id AS wrapper, min(d.id) AS target FROM entities w JOIN entities d ON d.file_id = w.file_id AND d.name = w.name AND d.kind = 1 AND w.start_byte <= d.start_byte AND w.end_byte >= d.end_byte WHERE w.kind = 0 GROUP BY 1 HAVING count(*) = 1""")
def _(t):
    e = views(t)["entities"]
    d = e.filter("kind = 1").select("id", "file_id", "name", "start_byte", "end_byte")
    w = e.filter("kind = 0").select("file_id", "name", F.col("id").alias("wrapper"), F.col("start_byte").alias("o_start"), F.col("end_byte").alias("o_end"))
    inside = R.contained(d, w, ["file_id", "name"], "start_byte", "end_byte", "o_start", "o_end", 256)
    return inside.groupBy("wrapper").agg(F.min("id").alias("target"), F.count("*").alias("_n")).filter("_n = 1").drop("_n")


@query("G11_route_handlers", f"""{WITH} SELECT r.id AS route, h.id AS handler FROM entities r JOIN (SELECT file_id, name, min(id) AS id FROM entities WHERE kind = 1 GROUP BY 1, 2 HAVING count(*) = 1) h ON h.file_id = r.file_id AND h.name = r.name WHERE r.kind = 4""")
def _(t):
    e = views(t)["entities"]
    one = e.filter("kind = 1").groupBy("file_id", "name").agg(F.min("id").alias("handler"), F.count("*").alias("_n")).filter("_n = 1").drop("_n")
    return e.filter("kind = 4").join(one, ["file_id", "name"]).select(F.col("id").alias("route"), "handler")


@query("G12_process_mains", f"""{WITH} SELECT e.id FROM entities e JOIN files f ON f.id = e.file_id WHERE e.name IN ('n1', 'n2') AND e.owner_type IS NULL AND f.language IN ('go', 'java')""")
def _(t):
    v = views(t)
    return v["entities"].filter("name IN ('n1', 'n2') AND owner_type IS NULL").join(v["files"].filter("language IN ('go', 'java')").select(F.col("id").alias("file_id")), "file_id", "left_semi").select("id")


@query("G13_exported_routes", f"""{WITH} SELECT f.id FROM files f WHERE f.path LIKE 'app/%' AND EXISTS (SELECT 1 FROM entities e WHERE e.file_id = f.id AND e.kind = 0 AND e.name = 'n3')""")
def _(t):
    v = views(t)
    return v["files"].filter("path LIKE 'app/%'").join(v["entities"].filter("kind = 0 AND name = 'n3'").select(F.col("file_id").alias("id")), "id", "left_semi").select("id")


@query("Q06_tests_for_file", f"""{WITH} SELECT DISTINCT f.id FROM edges e JOIN files f ON f.id = e.from_file_id WHERE e.kind = 1 AND e.resolved = 1 AND e.to_file_id IN (SELECT id FROM files WHERE churn = 3 AND complexity = 20) AND f.is_test_path""")
def _(t):
    v = views(t)
    seeds = v["files"].filter("churn = 3 AND complexity = 20").select(F.col("id").alias("to_file_id"))
    e = v["edges"].filter("kind = 1 AND resolved = 1").join(seeds, "to_file_id", "left_semi").select(F.col("from_file_id").alias("id")).distinct()
    return v["files"].filter("is_test_path").join(e, "id", "left_semi").select("id")


@query("Q11_name_boundary", r"SELECT page_id FROM pages WHERE regexp_matches(html, '(^|[^A-Za-z0-9._-])the ')")
def _(t):
    return t.pages.filter(F.col("html").rlike("(^|[^A-Za-z0-9._-])the ")).select("page_id")


@query("Q21_context_pack", f"""{WITH}, s AS (SELECT f.id, row_number() OVER (ORDER BY f.complexity DESC, f.id) AS rank FROM files f QUALIFY rank <= 50), l AS (SELECT f.id, row_number() OVER (ORDER BY f.churn DESC, f.path) AS rank FROM files f QUALIFY rank <= 50)
SELECT id, sum(1 / (60 + rank)) AS score FROM (SELECT * FROM s UNION ALL SELECT * FROM l) GROUP BY 1""")
def _(t):
    f = views(t)["files"]
    top = lambda *order: f.orderBy(*order).limit(50).withColumn("rank", F.row_number().over(Window.orderBy(*order))).select("id", "rank")
    return T.fuse(top(F.desc("complexity"), "id").union(top(F.desc("churn"), "path")), ["id"])


@query("R29_enclosing_function", f"""{WITH}, p AS (SELECT i.id, o.id AS o_id, o.end_byte - o.start_byte AS size, row_number() OVER (PARTITION BY i.id ORDER BY o.end_byte - o.start_byte, o.id) AS r FROM entities i JOIN entities o ON o.file_id = i.file_id AND o.kind = 1 AND o.start_byte <= i.start_byte AND o.end_byte >= i.end_byte WHERE i.kind = 2) SELECT id, o_id FROM p WHERE r = 1""")
def _(t):
    e = views(t)["entities"]
    i = e.filter("kind = 2").select("id", "file_id", "start_byte", "end_byte")
    o = e.filter("kind = 1").select("file_id", F.col("id").alias("o_id"), F.col("start_byte").alias("o_start"), F.col("end_byte").alias("o_end"))
    pairs = R.contained(i, o, ["file_id"], "start_byte", "end_byte", "o_start", "o_end", 256)
    return pairs.groupBy("id").agg(F.min(F.struct((F.col("o_end") - F.col("o_start")).alias("size"), "o_id")).alias("b")).select("id", "b.o_id")


@query("R28_suppressed_findings", f"""{WITH} SELECT e.id FROM entities e WHERE e.kind = 1 AND e.cyclomatic > 20 AND NOT EXISTS (SELECT 1 FROM edges s WHERE s.from_file_id = e.file_id AND s.kind = 3 AND s.id % 40 = e.id % 40)""")
def _(t):
    v = views(t)
    quiet = v["edges"].filter("kind = 3").select(F.col("from_file_id").alias("file_id"), (F.col("id") % 40).alias("slot")).distinct()
    return v["entities"].filter("kind = 1 AND cyclomatic > 20").withColumn("slot", F.col("id") % 40).join(quiet, ["file_id", "slot"], "left_anti").select("id")


@query("R31_band_collapse", f"""{WITH} SELECT name, line_span, count(*) AS members, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM entities WHERE kind = 1 AND line_span > 45 GROUP BY 1, 2 HAVING count(*) > 1""")
def _(t):
    g = views(t)["entities"].filter("kind = 1 AND line_span > 45").groupBy("name", "line_span").agg(F.count("*").alias("members"), F.sort_array(F.collect_list("id")).alias("ids"))
    return g.filter("members > 1").withColumn("ids", F.array_join(F.transform("ids", lambda x: x.cast("string")), ","))


@query("R32_severity_summary", f"""{WITH} SELECT CASE WHEN cyclomatic > 25 THEN 'error' WHEN cyclomatic > 15 THEN 'warning' ELSE 'info' END AS severity, count(*) AS n FROM entities WHERE kind = 1 GROUP BY 1""")
def _(t):
    s = F.when(F.col("cyclomatic") > 25, "error").when(F.col("cyclomatic") > 15, "warning").otherwise("info")
    return views(t)["entities"].filter("kind = 1").groupBy(s.alias("severity")).agg(F.count("*").alias("n"))


@query("R52_gate_policy", f"""{WITH} SELECT language, bool_or(complexity > 49) AS fails FROM files GROUP BY 1""")
def _(t):
    return views(t)["files"].groupBy("language").agg(F.bool_or(F.col("complexity") > 49).alias("fails"))


@query("R35_generated_paths", f"""{WITH} SELECT id FROM files WHERE regexp_matches(path, '(^|/)(vendor|third_party|node_modules)/|(^|/)generated/')""")
def _(t):
    return views(t)["files"].filter(F.col("path").rlike("(^|/)(vendor|third_party|node_modules)/|(^|/)generated/")).select("id")


@query("SK03_edge_diff", """
WITH a AS (SELECT l_suppkey % 50 AS s, l_partkey % 50 AS d FROM lineitem WHERE l_linestatus = 'O'), b AS (SELECT l_suppkey % 50 AS s, l_partkey % 50 AS d FROM lineitem WHERE l_linestatus = 'F')
SELECT s, d, 'insert' AS op FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT s, d, 'delete' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def _(t):
    side = lambda k: t.lineitem.filter(F.col("l_linestatus") == k).select((F.col("l_suppkey") % 50).alias("s"), (F.col("l_partkey") % 50).alias("d"))
    a, b = side("O"), side("F")
    return a.exceptAll(b).withColumn("op", F.lit("insert")).union(b.exceptAll(a).withColumn("op", F.lit("delete")))


@query("SK04_postings", """
WITH w AS (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '')) AS term FROM benchmark), p AS (SELECT term, item_id, count(*) AS tf FROM w GROUP BY 1, 2)
SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM p GROUP BY 1""")
def _(t):
    p = T.postings(t.benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")), "item_id", "text")
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query("SK11_batched_delete", "SELECT event_id FROM events WHERE event_id NOT IN (1, 5, 9, 200)")
def _(t):
    ids = t.spark.range(1).select(F.explode(F.from_json(F.lit("[1, 5, 9, 200]"), "array<bigint>")).alias("event_id"))
    return t.events.join(F.broadcast(ids), "event_id", "left_anti").select("event_id")


@query("SK12_checksums", "SELECT l_returnflag, count(*) AS n, bit_xor(CAST(('0x' || substr(sha256(CAST(l_orderkey AS VARCHAR) || ':' || CAST(l_linenumber AS VARCHAR) || ':' || CAST(l_partkey AS VARCHAR)), 1, 15)) AS BIGINT)) AS seal FROM lineitem GROUP BY 1")
def _(t):
    digest = F.sha2(F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey"), 256)
    return t.lineitem.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.bit_xor(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")).alias("seal"))


@query("T16_strip_ansi", "SELECT item_id, sha256(text) AS digest FROM benchmark")
def _(t):
    coloured = F.concat(F.lit("\x1b[31m"), F.col("text"), F.lit("\x1b[0m"))
    return t.benchmark.select("item_id", F.sha2(T.strip_ansi(coloured), 256).alias("digest"))


@query("T21_url_sanitize", r"SELECT page_id, regexp_replace(regexp_replace(url, '//[^/@]*@', '//'), '([?&])(ref|token|key)=[^&]*', '\1\2=***', 'g') AS url FROM pages")
def _(t):
    return t.pages.select("page_id", F.regexp_replace(F.regexp_replace("url", "//[^/@]*@", "//"), "([?&])(ref|token|key)=[^&]*", "$1$2=***").alias("url"))


@query("T28_leading_documentation", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 'note ' || s_name END AS doc FROM supplier")
def _(t):
    even = F.concat(F.lit('def f():\n    """'), F.col("s_name"), F.lit('"""\n    return 1'))
    odd = F.concat(F.lit("# note "), F.col("s_name"), F.lit("\nx = 1"))
    return t.supplier.select("s_suppkey", T.leading_documentation(F.when(F.col("s_suppkey") % 2 == 0, even).otherwise(odd)).alias("doc"))


@query("T35_css_px", "SELECT s_suppkey, s_suppkey * 1.0 AS px FROM supplier")
def _(t):
    return t.supplier.select("s_suppkey", X.css_px(F.concat(F.col("s_suppkey").cast("string"), F.lit("px"))).alias("px"))


@query("T37_globs", f"""{WITH} SELECT id FROM files WHERE regexp_matches(path, '^src/(?:.*/)?[^/]*_test\\.py$')""")
def _(t):
    return views(t)["files"].filter(F.col("path").rlike(T.glob_to_regex("src/**/*_test.py"))).select("id")

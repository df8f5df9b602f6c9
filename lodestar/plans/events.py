"""Queries over events, conversations and orders: sequences, rates, latencies, folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relational as R
from ..operators import sequence as S
from ..operators import stats
from .registry import query

HOURS6 = 6 * 3600


def is_error():
    return F.col("event_type") == "error"


_RETRY = f"""
SELECT *, coalesce(user_id IS NOT NULL AND epoch_us(ts) - max(CASE WHEN event_type = 'error' THEN epoch_us(ts) END)
  OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= {HOURS6 * 1_000_000}, false) AS is_retry
FROM events"""


def retries(t):
    return S.mark_retries(t.events, ["user_id"], ["ts", "event_id"], is_error(), HOURS6)


@query("A03_mark_retries", f"SELECT event_id, user_id, is_retry FROM ({_RETRY})")
def _(t):
    return retries(t).select("event_id", "user_id", "is_retry")


@query("A02_rank_commands", f"""
WITH r AS ({_RETRY}), g AS (
 SELECT 'event_type' AS "grouping", event_type AS key, event_type = 'error' AS f, is_retry FROM r
 UNION ALL SELECT 'user', CAST(user_id AS VARCHAR), event_type = 'error', is_retry FROM r
 UNION ALL SELECT 'week', isoyear(ts) || '-W' || lpad(CAST(week(ts) AS VARCHAR), 2, '0'), event_type = 'error', is_retry FROM r)
SELECT "grouping", key, count(*) AS calls, count(*) FILTER (WHERE f) AS failures, count(*) FILTER (WHERE is_retry) AS retries,
 count(*) FILTER (WHERE f) / count(*) AS failure_rate, count(*) FILTER (WHERE is_retry) / count(*) AS retry_rate
FROM g GROUP BY 1, 2""")
def rank_commands(t):
    week = F.concat(F.extract(F.lit("YEAROFWEEK"), F.col("ts")).cast("string"), F.lit("-W"), F.lpad(F.weekofyear("ts").cast("string"), 2, "0"))
    return S.rank_commands(retries(t), {"event_type": F.col("event_type"), "user": F.col("user_id"), "week": week}, is_error())


@query("E07_retry_loop", """
WITH m AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events)
SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS length FROM m WHERE event_type = 'error' GROUP BY user_id, g HAVING count(*) >= 3""")
def _(t):
    return S.streaks(t.events, ["user_id"], ["ts", "event_id"], is_error())


@query("A24_ok_day_streak", """
WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) FILTER (WHERE event_type = 'error') = 0 AS ok FROM events GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day DESC) - 1 AS n, datediff('day', day, max(day) OVER (PARTITION BY user_id)) AS age FROM d),
h AS (SELECT *, min(CASE WHEN ok AND n = age THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY day DESC) AS held FROM r)
SELECT user_id, CAST(sum(held) AS BIGINT) AS streak FROM h GROUP BY user_id""")
def _(t):
    days = t.events.groupBy("user_id", F.to_date("ts").alias("day")).agg((F.count_if(is_error()) == 0).alias("ok"))
    return S.day_streak(days, ["user_id"], "day", "ok")


@query("E13_idle_gap", """
SELECT event_id, user_id, gap_s FROM (SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1000000 AS gap_s FROM events)
WHERE gap_s > 3600 AND value > 20""")
def _(t):
    return S.gaps(t.events, ["user_id"], ["ts", "event_id"], 3600, F.col("value") > 20).select("event_id", "user_id", "gap_s")


@query("E08_repeat_reads", """
SELECT event_id, nth FROM (SELECT *, count(*) OVER (PARTITION BY user_id, event_type) AS n, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS nth FROM events)
WHERE n >= 3 AND nth > 1""")
def _(t):
    return S.repeats(t.events, ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "nth")


@query("E14_repeated_action", """
SELECT event_id, n_recent FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id, event_type ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS n_recent FROM events)
WHERE n_recent >= 3""")
def _(t):
    return S.trailing_count(t.events, ["user_id", "event_type"], "ts", 86400).select("event_id", "n_recent").filter("n_recent >= 3")


@query("E16_refusal_burst", """
SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' AND ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY GROUP BY 1 HAVING count(*) >= 3""")
def _(t):
    now = t.events.agg(F.max("ts")).first()[0]
    return S.burst(t.events.filter(is_error()), ["user_id"], "ts", F.lit(now), 10 * 86400, 3)


@query("E15_launch_stop_cycles", """
WITH m AS (SELECT user_id, event_type = 'purchase' AS stop, lag(event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events WHERE event_type IN ('signup', 'purchase'))
SELECT user_id, count(*) AS cycles FROM m WHERE stop AND NOT coalesce(prev, true) GROUP BY 1""")
def _(t):
    return S.launch_stop_cycles(t.events, "user_id", "ts", F.col("event_type") == "signup", F.col("event_type") == "purchase")


@query("E17_rate_caps", """
WITH w AS (SELECT user_id, count(*) FILTER (WHERE ts >= m - INTERVAL 1 DAY) AS per_day, count(*) FILTER (WHERE ts >= m - INTERVAL 7 DAY) AS per_week
 FROM events, (SELECT max(ts) AS m FROM events) GROUP BY 1)
SELECT user_id, CASE WHEN per_day > 5 THEN 'day' WHEN per_week > 20 THEN 'week' END AS breach, per_day, per_week FROM w""")
def _(t):
    now = F.lit(t.events.agg(F.max("ts")).first()[0])
    n = lambda days: F.count_if(F.col("ts") >= now - F.make_dt_interval(F.lit(days)))
    w = t.events.groupBy("user_id").agg(n(1).alias("per_day"), n(7).alias("per_week"))
    return w.select("user_id", F.when(F.col("per_day") > 5, "day").when(F.col("per_week") > 20, "week").alias("breach"), "per_day", "per_week")


@query("A13_first_call", """
SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts NULLS LAST, event_id) AS r FROM events) WHERE r = 1""")
def _(t):
    return S.first_per_key(t.events, ["user_id"], [F.asc_nulls_last("ts"), F.asc("event_id")]).select("user_id", "event_id", "event_type")


@query("A14_later_rounds", """
WITH s AS (SELECT event_type, user_id, min(struct_pack(ts := ts, e := event_id)) AS st FROM events GROUP BY 1, 2),
r AS (SELECT event_type, user_id, dense_rank() OVER (PARTITION BY event_type ORDER BY st, user_id) AS round FROM s)
SELECT e.event_id, r.round FROM events e JOIN r USING (event_type, user_id) WHERE round > 1""")
def _(t):
    return S.later_rounds(t.events, ["event_type"], "user_id", ["ts", "event_id"]).select("event_id", "round")


@query("A06_last_content_first_position", """
SELECT user_id, event_type, min(ts) AS ts, arg_min(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2""")
def _(t):
    return S.last_content_first_position(t.events, ["user_id", "event_type"], ["ts", "event_id"], ["value"])


@query("E29_latest_wins", """
SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def _(t):
    return S.latest(t.events.select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("E04_state_changes", """
SELECT event_id, previous, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events) WHERE previous <> event_type""")
def _(t):
    return S.state_changes(t.events, ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "previous", "event_type")


@query("E12_call_result_pairing", """
SELECT c.event_id, min(r.ts) AS result_ts FROM events c LEFT JOIN events r ON r.user_id = c.user_id AND r.event_type = 'purchase' AND r.ts >= c.ts
WHERE c.event_type = 'signup' GROUP BY 1""")
def _(t):
    calls = t.events.filter("event_type = 'signup'").select("event_id", "user_id", "ts")
    return S.paired(calls, t.events.filter("event_type = 'purchase'"), "user_id", "ts").select("event_id", "result_ts")


@query("E11_slow_command", """
WITH p AS (SELECT c.event_id, (epoch_us(min(r.ts)) - epoch_us(any_value(c.ts))) / 1000000 AS seconds FROM events c JOIN events r ON r.user_id = c.user_id AND r.event_type = 'purchase' AND r.ts >= c.ts
WHERE c.event_type = 'signup' GROUP BY 1) SELECT * FROM p WHERE seconds > 86400""")
def _(t):
    calls = t.events.filter("event_type = 'signup'").select("event_id", "user_id", "ts")
    return S.paired(calls, t.events.filter("event_type = 'purchase'"), "user_id", "ts").select("event_id", "seconds").filter("seconds > 86400")


@query("E05_quiet_sessions", """
WITH m AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 43200000000 THEN 1 ELSE 0 END AS n FROM events),
s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM m)
SELECT user_id, CAST(session AS BIGINT) AS session, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM s GROUP BY 1, 2""")
def _(t):
    return S.sessions(t.events, ["user_id"], ["ts", "event_id"], 43200)


@query("A76_errors_per_run", """
WITH r AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM events)
SELECT user_id, CAST(run AS BIGINT) AS run, min(ts) AS started, count(*) FILTER (WHERE event_type = 'error') AS errors FROM r WHERE run > 0 GROUP BY 1, 2""")
def _(t):
    return S.skill_errors(t.events, ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup", is_error())


@query("A58_friction_recurrences", """
SELECT o.event_id, a.event_id AS adoption_id FROM (SELECT * FROM events WHERE event_type = 'error') o
LEFT JOIN LATERAL (SELECT event_id FROM events a WHERE a.user_id = o.user_id AND a.event_type = 'purchase' AND (a.ts < o.ts) ORDER BY a.ts DESC, a.event_id DESC LIMIT 1) a ON true""")
def _(t):
    left = t.events.filter(is_error()).select("event_id", "user_id", "ts")
    right = t.events.filter("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("adoption_id"))
    return R.as_of(left, right, ["user_id"], ["ts"], ["ts"], ["adoption_id"]).select("event_id", "adoption_id")


@query("A04_session_metrics", """
SELECT user_id, count(*) AS calls, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000 AS wall_seconds, sum(value) AS total, max(value) AS peak, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1""")
def _(t):
    wall = (S.micros(F.max("ts")) - S.micros(F.min("ts"))) / 1_000_000
    return t.events.groupBy("user_id").agg(F.count("*").alias("calls"), wall.alias("wall_seconds"), F.sum("value").alias("total"), F.max("value").alias("peak"), F.count_if(is_error()).alias("errors"))


_SPEND = "CAST(json_extract(props, '$.k') AS BIGINT)"


@query("A07_weighted_spend", f"SELECT event_id, value + 0.1 * {_SPEND} + 2 * (user_id % 5) + 5 * (event_id % 3) AS weighted FROM events")
def _(t):
    k = F.get_json_object("props", "$.k").cast("long")
    return t.events.select("event_id", (F.col("value") + 0.1 * k + 2 * (F.col("user_id") % 5) + 5 * (F.col("event_id") % 3)).alias("weighted"))


@query("A09_spend_report", """
WITH s AS (SELECT event_type AS role, CASE WHEN user_id % 4 = 0 THEN '(unattributed)' ELSE 'plan' || CAST(user_id % 4 AS VARCHAR) END AS plan, sum(value) AS spend, count(*) AS calls FROM events GROUP BY 1, 2)
SELECT *, spend / sum(spend) OVER () AS share FROM s""")
def _(t):
    plan = F.when(F.col("user_id") % 4 == 0, "(unattributed)").otherwise(F.concat(F.lit("plan"), (F.col("user_id") % 4).cast("string")))
    s = t.events.groupBy(F.col("event_type").alias("role"), plan.alias("plan")).agg(F.sum("value").alias("spend"), F.count("*").alias("calls"))
    return s.crossJoin(F.broadcast(t.events.agg(F.sum("value").alias("_all")))).select("role", "plan", "spend", "calls", (F.col("spend") / F.col("_all")).alias("share"))


@query("A12_waste_shares", """
SELECT sum(value) FILTER (WHERE value > 40) / sum(value) AS large, sum(value) FILTER (WHERE event_type = 'error') / sum(value) AS failed, sum(value) FILTER (WHERE event_type = 'view') / sum(value) AS polled FROM events""")
def _(t):
    part = lambda c: F.sum(F.when(c, F.col("value"))) / F.sum("value")
    return t.events.agg(part(F.col("value") > 40).alias("large"), part(is_error()).alias("failed"), part(F.col("event_type") == "view").alias("polled"))


@query("A15_snapshot_compare", """
WITH p AS (SELECT event_type, sum(value) FILTER (WHERE ts < '2024-01-15') AS prev, sum(value) FILTER (WHERE ts >= '2024-01-15') AS cur FROM events GROUP BY 1),
d AS (SELECT *, cur - prev AS delta, CASE WHEN prev = 0 THEN 1.0 ELSE (cur - prev) / prev END AS rel FROM p)
SELECT event_type, delta, CASE WHEN abs(rel) < 0.05 THEN 'unchanged' WHEN rel > 0 THEN 'up' ELSE 'down' END AS change FROM d""")
def _(t):
    cutoff = F.lit("2024-01-15").cast("timestamp")
    part = lambda c: F.sum(F.when(c, F.col("value")))
    d = t.events.groupBy("event_type").agg(part(F.col("ts") < cutoff).alias("prev"), part(F.col("ts") >= cutoff).alias("cur"))
    rel = F.when(F.col("prev") == 0, 1.0).otherwise((F.col("cur") - F.col("prev")) / F.col("prev"))
    return d.select("event_type", (F.col("cur") - F.col("prev")).alias("delta"), F.when(F.abs(rel) < 0.05, "unchanged").when(rel > 0, "up").otherwise("down").alias("change"))


@query("A16_nearest_rank", """
SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1""")
def _(t):
    return t.events.groupBy("event_type").agg(*(stats.nearest_rank("value", p).alias(f"p{p}") for p in (50, 90, 95)))


@query("A18_queue_medians", """
SELECT o_orderpriority AS queue, median(s) AS median_s, count(*) FILTER (WHERE s IS NULL) AS skipped FROM (
 SELECT o_orderpriority, CASE WHEN l_shipdate >= o_orderdate THEN (epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 1000000 END AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY 1""")
def _(t):
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    s = F.when(F.col("l_shipdate") >= F.col("o_orderdate"), (S.micros(F.col("l_shipdate")) - S.micros(F.col("o_orderdate"))) / 1_000_000)
    return j.withColumn("s", s).groupBy(F.col("o_orderpriority").alias("queue")).agg(F.median("s").alias("median_s"), F.count_if(F.col("s").isNull()).alias("skipped"))


@query("A17_message_status", """
WITH l AS (SELECT c_mktsegment AS address, o_orderstatus, (epoch_us(l_shipdate) - epoch_us(o_orderdate)) // 1000000 AS s FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey)
SELECT address, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'O') AS unread, count(*) FILTER (WHERE s > 86400 * 365) AS overdue,
 quantile_disc(s, 0.5) AS p50, quantile_disc(s, 0.9) AS p90 FROM l GROUP BY 1""")
def _(t):
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"))
    l = j.select(F.col("c_mktsegment").alias("address"), "o_orderstatus", ((S.micros(F.col("l_shipdate")) - S.micros(F.col("o_orderdate"))) / 1_000_000).cast("long").alias("s"))
    return l.groupBy("address").agg(F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "O").alias("unread"), F.count_if(F.col("s") > 86400 * 365).alias("overdue"), stats.nearest_rank("s", 50).alias("p50"), stats.nearest_rank("s", 90).alias("p90"))


@query("A20_queue_wait", """
WITH e AS (SELECT *, max(CASE WHEN event_type = 'signup' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS queued FROM events)
SELECT user_id, queued, min((epoch_us(ts) - epoch_us(queued)) / 1000000) AS wait_s FROM e WHERE event_type = 'purchase' AND queued IS NOT NULL GROUP BY 1, 2""")
def _(t):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = t.events.withColumn("queued", F.max(F.when(F.col("event_type") == "signup", F.col("ts"))).over(w)).filter("event_type = 'purchase' AND queued IS NOT NULL")
    return e.groupBy("user_id", "queued").agg(F.min((S.micros(F.col("ts")) - S.micros(F.col("queued"))) / 1_000_000).alias("wait_s"))


@query("A21_decision_summary", """
SELECT CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR) AS bucket, event_type, count(*) AS n, count(*) FILTER (WHERE value > 20) / count(*) AS rate, median(value) AS median_value FROM events GROUP BY 1, 2""")
def _(t):
    return t.events.groupBy(F.to_date(F.date_trunc("week", "ts")).cast("string").alias("bucket"), "event_type").agg(F.count("*").alias("n"), (F.count_if(F.col("value") > 20) / F.count("*")).alias("rate"), F.median("value").alias("median_value"))


@query("A22_auto_approve", """
SELECT user_id FROM events GROUP BY 1 HAVING count(*) FILTER (WHERE event_type = 'click') >= 3 AND count(*) FILTER (WHERE event_type = 'error' AND value > 40) = 0""")
def _(t):
    g = t.events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("yes"), F.count_if(is_error() & (F.col("value") > 40)).alias("no"))
    return g.filter("yes >= 3 AND no = 0").select("user_id")


@query("E19_message_receipts", """
WITH q AS (SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next_turn FROM conversations)
SELECT conv_id, turn, CASE WHEN next_role = 'assistant' THEN 'answered' WHEN next_role IS NOT NULL THEN 'read' ELSE 'delivered' END AS state, CASE WHEN next_role = 'assistant' THEN next_turn END AS answer_turn FROM q WHERE role = 'user'""")
def _(t):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    q = t.conversations.withColumn("nr", F.lead("role").over(w)).withColumn("nt", F.lead("turn").over(w)).filter("role = 'user'")
    answered = F.coalesce(F.col("nr") == "assistant", F.lit(False))
    return q.select("conv_id", "turn", F.when(answered, "answered").when(F.col("nr").isNotNull(), "read").otherwise("delivered").alias("state"), F.when(answered, F.col("nt")).alias("answer_turn"))


@query("E36_keyset_page", "SELECT event_id, event_type FROM events WHERE event_id < 500 ORDER BY event_id DESC LIMIT 50")
def _(t):
    return R.keyset_page(t.events.select("event_id", "event_type"), "event_id", 500, 50)


@query("SK09_keep_last_n", """
SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 5""")
def _(t):
    return R.keep_last(t.events, ["user_id"], [F.desc("ts"), F.desc("event_id")], 5).select("event_id")


@query("SK10_retention_prune", """
SELECT event_id FROM events WHERE ts >= least(TIMESTAMP '2024-01-20', (SELECT max(ts) FROM events WHERE event_type = 'purchase'))""")
def _(t):
    used = F.lit(t.events.filter("event_type = 'purchase'").agg(F.max("ts")).first()[0])
    return R.retained(t.events, "ts", F.lit("2024-01-20").cast("timestamp"), used).select("event_id")


@query("SK06_upsert", """
SELECT user_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, p DESC, event_id DESC) AS r FROM (
 SELECT user_id, ts, event_id, value, 0 AS p FROM events WHERE event_type = 'view' UNION ALL SELECT user_id, ts, event_id, value, 1 FROM events WHERE event_type = 'click')) WHERE r = 1""")
def _(t):
    rows = lambda k: t.events.filter(F.col("event_type") == k).select("user_id", "ts", "event_id", "value")
    return R.upsert(S.latest(rows("view"), ["user_id"], ["ts", "event_id"]), S.latest(rows("click"), ["user_id"], ["ts", "event_id"]), ["user_id"], "ts").select("user_id", "value")


@query("SK07_insert_or_ignore", """
SELECT user_id, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1""")
def _(t):
    return t.events.select("user_id", "event_type").dropDuplicates().groupBy("user_id").agg(F.count("*").alias("n"))


@query("J14_append_missing", """
SELECT event_id, user_id FROM events WHERE event_type = 'view' UNION ALL SELECT event_id, user_id FROM events WHERE event_type = 'click' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'view' AND user_id IS NOT NULL)""")
def _(t):
    rows = lambda k: t.events.filter(F.col("event_type") == k).select("event_id", "user_id")
    return R.append_missing(rows("view"), rows("click"), ["user_id"])


@query("A05_usage_precedence", """
WITH m AS (SELECT *, max(CASE event_type WHEN 'purchase' THEN 3 WHEN 'click' THEN 2 ELSE 1 END) OVER (PARTITION BY user_id) AS best FROM events)
SELECT event_id FROM m WHERE CASE event_type WHEN 'purchase' THEN 3 WHEN 'click' THEN 2 ELSE 1 END = best""")
def _(t):
    from pyspark.sql import Window

    p = F.when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "click", 2).otherwise(1)
    return t.events.withColumn("_p", p).withColumn("_b", F.max("_p").over(Window.partitionBy("user_id"))).filter("_p = _b").select("event_id")


@query("A11_parent_attribution", """
SELECT c.event_id, coalesce(p.event_type, c.event_type) AS role FROM events c LEFT JOIN events p ON c.event_id % 3 <> 0 AND p.event_id = c.event_id // 3""")
def _(t):
    c = t.events.select("event_id", F.col("event_type").alias("own"), F.when(F.col("event_id") % 3 != 0, F.floor(F.col("event_id") / 3).cast("long")).alias("parent"))
    p = t.events.select(F.col("event_id").alias("parent"), F.col("event_type").alias("role"))
    return c.join(p, "parent", "left").select("event_id", F.coalesce("role", "own").alias("role"))


@query("E10_rerun_for_detail", """
WITH g AS (SELECT *, count(DISTINCT CAST(json_extract(props, '$.k') AS BIGINT)) OVER (PARTITION BY user_id, event_type) AS tails, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events)
SELECT event_id FROM g WHERE tails > 1 AND n > 1""")
def _(t):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id", "event_type")
    k = F.get_json_object("props", "$.k")
    return t.events.withColumn("_t", F.size(F.collect_set(k).over(w))).withColumn("_n", F.row_number().over(w.orderBy("ts", "event_id"))).filter("_t > 1 AND _n > 1").select("event_id")


@query("E38_watch_state", """
SELECT user_id, CASE WHEN bool_or(event_type = 'purchase' AND ts >= m - INTERVAL 1 DAY) THEN 'terminal' WHEN max(ts) < m - INTERVAL 3 DAY THEN 'stale' WHEN bool_and(event_type = 'error') THEN 'blocked' ELSE 'active' END AS state,
 CAST(floor((epoch_us(any_value(m)) - epoch_us(max(ts))) / 60000000) AS BIGINT) AS idle_minutes FROM events, (SELECT max(ts) AS m FROM events) GROUP BY user_id, m""")
def _(t):
    now = F.lit(t.events.agg(F.max("ts")).first()[0])
    g = t.events.groupBy("user_id").agg(F.bool_or((F.col("event_type") == "purchase") & (F.col("ts") >= now - F.make_dt_interval(F.lit(1)))).alias("done"), F.max("ts").alias("last"), F.bool_and(is_error()).alias("bad"))
    state = F.when(F.col("done"), "terminal").when(F.col("last") < now - F.make_dt_interval(F.lit(3)), "stale").when(F.col("bad"), "blocked").otherwise("active")
    return g.select("user_id", state.alias("state"), F.floor((S.micros(now) - S.micros(F.col("last"))) / 60_000_000).cast("long").alias("idle_minutes"))


@query("F05_durations", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 86400 WHEN 1 THEN 3600 WHEN 2 THEN 60 ELSE 1 END * (event_id % 30 + 1) AS seconds FROM events""")
def _(t):
    from ..functions import duration_seconds

    text = F.concat((F.col("event_id") % 30 + 1).cast("string"), F.element_at(F.array(*map(F.lit, "dhms")), (F.col("event_id") % 4 + 1).cast("int")))
    return t.events.select("event_id", duration_seconds(text).alias("seconds"))


@query("F16_sleep_adjusted", """
SELECT user_id, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000 - least((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000, coalesce(sum(value) FILTER (WHERE event_type = 'error'), 0)) AS awake_s FROM events GROUP BY 1""")
def _(t):
    wall = (S.micros(F.max("ts")) - S.micros(F.min("ts"))) / 1_000_000
    return t.events.groupBy("user_id").agg((wall - F.least(wall, F.coalesce(F.sum(F.when(is_error(), F.col("value"))), F.lit(0.0)))).alias("awake_s"))


@query("E28_pending_selection", """
WITH l AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, count(*) FILTER (WHERE event_type = 'error') AS attempts FROM events WHERE user_id % 7 <> 0 GROUP BY 1)
SELECT c.c_custkey AS id, CASE WHEN l.user_id IS NULL THEN 'new' WHEN status IN ('view', 'click') THEN 'pending' WHEN status = 'error' AND attempts < 20 THEN 'retry' END AS reason FROM customer c LEFT JOIN l ON l.user_id = c.c_custkey
WHERE l.user_id IS NULL OR status IN ('view', 'click') OR (status = 'error' AND attempts < 20)""")
def _(t):
    l = t.events.filter("user_id % 7 != 0").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.count_if(is_error()).alias("attempts"))
    j = t.customer.join(l, F.col("c_custkey") == F.col("user_id"), "left")
    reason = F.when(F.col("user_id").isNull(), "new").when(F.col("status").isin("view", "click"), "pending").when((F.col("status") == "error") & (F.col("attempts") < 20), "retry")
    return j.select(F.col("c_custkey").alias("id"), reason.alias("reason")).filter("reason IS NOT NULL")

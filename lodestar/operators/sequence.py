"""Event-sequence operators: retries, streaks, gaps, rates and latest-wins folds.

Each takes the key columns and an order (time, then a tie breaker).  Windows are partitioned
by the key, so a key's rows are one task's share; ``rate_over`` and the folds that only need
sums, minima or maxima are aggregations with map-side combine instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp, with or without a zone (UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def mark_retries(df: DataFrame, keys: list[str], order: list[str], failed: Column, window_s: float = 120) -> DataFrame:
    """Adds is_retry: the latest prior failure of the same keys is at most window_s earlier; never for a null key."""
    prior = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    at = micros(F.col(order[0]))
    last = F.last(F.when(failed, at), ignorenulls=True).over(prior)
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    return df.withColumn("is_retry", F.coalesce(known & (at - last <= F.lit(int(window_s * 1_000_000))), F.lit(False)))


def rank_commands(df: DataFrame, groupings: dict[str, Column], failed: Column) -> DataFrame:
    """calls, failures, retries and rates for each value of several groupings, in one pass of grouping sets."""
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("grouping"), c.cast("string").alias("key")) for name, c in groupings.items())))
    rows = df.select(each.alias("g"), failed.alias("_f"), "is_retry").select("g.*", "_f", "is_retry")
    sums = rows.groupBy("grouping", "key").agg(F.count("*").alias("calls"), F.count_if("_f").alias("failures"), F.count_if("is_retry").alias("retries"))
    return sums.withColumn("failure_rate", F.col("failures") / F.col("calls")).withColumn("retry_rate", F.col("retries") / F.col("calls"))


def streaks(df: DataFrame, keys: list[str], order: list[str], hit: Column, least: int = 3) -> DataFrame:
    """Runs of at least ``least`` consecutive hits: keys, first and last time, and length."""
    w = Window.partitionBy(*keys).orderBy(*order)
    runs = df.withColumn("_hit", hit).withColumn("_breaks", F.sum(F.when(F.col("_hit"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    t = order[0]
    return runs.filter("_hit").groupBy(*keys, "_breaks").agg(F.min(t).alias("first_ts"), F.max(t).alias("last_ts"), F.count("*").alias("length")).filter(F.col("length") >= least).drop("_breaks")


def day_streak(days: DataFrame, keys: list[str], day: str, ok: str) -> DataFrame:
    """Consecutive good days up to each key's last day; a gap or a bad day ends them."""
    w = Window.partitionBy(*keys)
    dated = days.withColumn("_last", F.max(day).over(w)).withColumn("_age", F.datediff("_last", F.col(day)))
    # a day counts if all days since it were good and none is missing: its rank among the latest is its age
    ranked = dated.withColumn("_n", F.row_number().over(w.orderBy(F.desc(day))) - 1)
    upto = w.orderBy(F.desc(day)).rowsBetween(Window.unboundedPreceding, 0)
    held = ranked.withColumn("_held", F.min(F.when(F.col(ok) & (F.col("_n") == F.col("_age")), 1).otherwise(0)).over(upto))
    return held.groupBy(*keys).agg(F.sum("_held").alias("streak"))


def gaps(df: DataFrame, keys: list[str], order: list[str], idle_s: float, also: Column | None = None) -> DataFrame:
    """Rows that come more than idle_s after the one before them (and for which ``also`` holds), with the gap in seconds."""
    w = Window.partitionBy(*keys).orderBy(*order)
    at = micros(F.col(order[0]))
    gap = (at - F.lag(at).over(w)) / 1_000_000
    out = df.withColumn("gap_s", gap).filter(F.col("gap_s") > idle_s)
    return out if also is None else out.filter(also)


def repeats(df: DataFrame, keys: list[str], order: list[str], least: int = 3) -> DataFrame:
    """All but the first of the rows whose keys occur at least ``least`` times."""
    w = Window.partitionBy(*keys)
    return df.withColumn("_n", F.count("*").over(w)).withColumn("nth", F.row_number().over(w.orderBy(*order))).filter((F.col("_n") >= least) & (F.col("nth") > 1)).drop("_n")


def trailing_count(df: DataFrame, keys: list[str], ts: str, window_s: int) -> DataFrame:
    """Adds n_recent: rows of the same keys in the window_s up to and including each row's time."""
    w = Window.partitionBy(*keys).orderBy(micros(F.col(ts))).rangeBetween(-window_s * 1_000_000, 0)
    return df.withColumn("n_recent", F.count("*").over(w))


def burst(df: DataFrame, keys: list[str], ts: str, now: Column, window_s: int, least: int) -> DataFrame:
    """Keys with at least ``least`` rows in the window_s before ``now``."""
    return df.filter((micros(F.col(ts)) >= micros(now) - window_s * 1_000_000) & (F.col(ts) <= now)).groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def later_rounds(df: DataFrame, target: list[str], session: str, order: list[str]) -> DataFrame:
    """Rows of all sessions of a target after its first one; sessions are in order of their first row."""
    starts = df.groupBy(*target, session).agg(F.min(F.struct(*order)).alias("_start"))
    ranked = starts.withColumn("round", F.dense_rank().over(Window.partitionBy(*target).orderBy("_start", session)))
    return df.join(ranked.filter("round > 1").select(*target, session, "round"), [*target, session])


def last_content_first_position(df: DataFrame, keys: list[str], order: list[str], content: list[str]) -> DataFrame:
    """One row a key: the content of its last row at the position of its first."""
    place = F.struct(*order)
    return df.groupBy(*keys).agg(F.min(place).alias("_p"), *(F.max_by(c, place).alias(c) for c in content)).select(*keys, "_p.*", *content)


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: a latest-wins fold of an append-only log, by one aggregation."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def state_changes(df: DataFrame, keys: list[str], order: list[str], state: str) -> DataFrame:
    """Rows whose state differs from the one before, with that one; the first row of a key is no change."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("previous", F.lag(state).over(w)).filter(F.col("previous").isNotNull() & (F.col("previous") != F.col(state)))


def paired(calls: DataFrame, results: DataFrame, key: str, ts: str) -> DataFrame:
    """Calls with the first result of their key that isn't earlier, and the seconds in between; one pass over a key's calls and results."""
    both = calls.withColumn("_call", F.lit(True)).unionByName(results.select(key, ts, F.col(ts).alias("_result")), allowMissingColumns=True)
    later = Window.partitionBy(key).orderBy(ts).rangeBetween(Window.currentRow, Window.unboundedFollowing)
    once = both.withColumn("result_ts", F.min("_result").over(later)).filter("_call").select(*calls.columns, "result_ts")
    return once.withColumn("seconds", (micros(F.col("result_ts")) - micros(F.col(ts))) / 1_000_000)


def launch_stop_cycles(df: DataFrame, key: str, ts: str, launched: Column, stopped: Column) -> DataFrame:
    """Keys and how many of their stops follow a launch that no other stop has followed."""
    w = Window.partitionBy(key).orderBy(ts, "event_id")
    marks = df.filter(launched | stopped).withColumn("_stop", stopped).withColumn("_prev", F.lag(stopped).over(w))
    return marks.filter(F.col("_stop") & ~F.coalesce("_prev", F.lit(True))).groupBy(key).agg(F.count("*").alias("cycles"))


def loops(df: DataFrame, key: str, action: str, ts: str, written: Column, launched: Column, stopped: Column, refused: Column, repeat: tuple[int, int], cycles: int, refusals: tuple[int, int]) -> DataFrame:
    """key and found: the first of three reasons to call what a key does a loop, null without one.

    An action that writes, repeated so often in so many seconds; launches that are stopped again; refusals in the
    last so many seconds.  Each is the operator of its own name.
    """
    again = trailing_count(df.filter(written), [key, action], ts, repeat[1]).filter(F.col("n_recent") >= repeat[0])
    again = again.groupBy(key).agg(F.concat(F.min(action), F.lit(" repeated "), F.max("n_recent").cast("string")).alias("_a"))
    stops = launch_stop_cycles(df, key, ts, launched, stopped).filter(F.col("cycles") >= cycles).select(key, F.concat(F.lit("launch and stop "), F.col("cycles").cast("string")).alias("_b"))
    now = df.agg(F.max(ts)).first()[0]
    no = burst(df.filter(refused), [key], ts, F.lit(now), refusals[1], refusals[0]).select(key, F.concat(F.lit("refused "), F.col("n").cast("string")).alias("_c"))
    return df.select(key).distinct().join(again, key, "left").join(stops, key, "left").join(no, key, "left").select(key, F.coalesce("_a", "_b", "_c").alias("found"))


def sessions(df: DataFrame, keys: list[str], order: list[str], quiet_s: float) -> DataFrame:
    """Sessions divided by quiet periods: keys, number, first and last time, and rows."""
    w = Window.partitionBy(*keys).orderBy(*order)
    at = micros(F.col(order[0]))
    fresh = F.when(at - F.lag(at).over(w) > int(quiet_s * 1_000_000), 1).otherwise(0)
    numbered = df.withColumn("_new", fresh).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "session").agg(F.min(order[0]).alias("first_ts"), F.max(order[0]).alias("last_ts"), F.count("*").alias("n"))


def skill_errors(df: DataFrame, keys: list[str], order: list[str], mark: Column, error: Column) -> DataFrame:
    """For each mark: the errors after it and before the next mark of the same keys."""
    w = Window.partitionBy(*keys).orderBy(*order)
    runs = df.withColumn("run", F.sum(F.when(mark, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("run > 0")
    return runs.groupBy(*keys, "run").agg(F.min(order[0]).alias("started"), F.count_if(error).alias("errors"))


def alive(df: DataFrame, key: str, order: list[str], event: str, ts: str, now: Column, windows: dict[str, int]) -> DataFrame:
    """key and alive: whether a key's latest event is of a kind with a window, in seconds, that hasn't passed."""
    last = df.groupBy(key).agg(F.max_by(F.struct(event, ts), F.struct(*order)).alias("_l"))
    age = (micros(now) - micros(F.col(f"_l.{ts}"))) / 1_000_000
    known = F.create_map(*(F.lit(x) for pair in windows.items() for x in pair))
    return last.select(key, F.coalesce(age < F.try_element_at(known, F.col(f"_l.{event}")), F.lit(False)).alias("alive"))

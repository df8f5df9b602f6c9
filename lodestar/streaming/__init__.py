"""Structured Streaming forms of the stateful operators.

Every state is bounded by its keys or by a watermark.  ``fold_to`` is the exactly-once sink: each micro-batch
merges into a written generation, so a repeated batch leaves the same table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, path: str, schema: str, per_trigger: int | None = None) -> DataFrame:
    """A stream of the Parquet files of a folder."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).parquet(path)


def once_each(df: DataFrame, key: str, ts: str, late: str = "1 day") -> DataFrame:
    """Rows whose key hasn't been seen within the watermark."""
    return df.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(df: DataFrame, ts: str, size: str, slide: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Rows in each sliding window and key; windows close at the watermark."""
    return df.withWatermark(ts, late).groupBy(F.window(ts, size, slide), *keys).agg(F.count("*").alias("n"))


def quiet_sessions(df: DataFrame, ts: str, keys: list[str], gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions that end after a quiet gap: the debounced refresh of a watcher."""
    return df.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *keys).agg(F.count("*").alias("n"))


def mark_retries(df: DataFrame, key: str, ts: str, event_id: str, failed: Column, window_s: float) -> DataFrame:
    """event_id and is_retry of each row: its key's latest earlier failure is at most window_s before it.

    Rows of a micro-batch are taken in order of time; state is one time for each key.
    """
    rows = df.select(F.col(key).alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.col(event_id).alias("event_id"), failed.alias("failed"))

    def step(key_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        pdf = pd.concat(list(batches)).sort_values(["at", "event_id"])
        out = []
        for at, failed_ in zip(pdf["at"], pdf["failed"]):
            out.append(last is not None and at - last <= window_s * 1_000_000)
            if failed_:
                last = int(at)
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({"event_id": pdf["event_id"], "is_retry": out})

    return rows.filter("key IS NOT NULL").groupBy("key").applyInPandasWithState(step, "event_id long, is_retry boolean", "last long", "append", GroupStateTimeout.NoTimeout)


def state_changes(df: DataFrame, key: str, ts: str, event_id: str, state_column: str, seed: bool = False) -> DataFrame:
    """key, event_id, previous and current wherever a key's state differs from its last one.

    A key's first state is kept silently; with ``seed``, a whole first micro-batch of a key is.
    """
    rows = df.select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("ts"), F.col(event_id).alias("event_id"), F.col(state_column).alias("state"))

    def step(key_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, silent = (state.get[0], False) if state.exists else (None, seed)
        pdf = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for event, now in zip(pdf["event_id"], pdf["state"]):
            if last is not None and now != last and not silent:
                out.append((key_[0], event, last, now))
            last = now
        state.update((last,))
        yield pd.DataFrame(out, columns=["key", "event_id", "previous", "current"])

    return rows.groupBy("key").applyInPandasWithState(step, "key long, event_id long, previous string, current string", "last string", "append", GroupStateTimeout.NoTimeout)


def leases(df: DataFrame, key: str, ts: str, lease: str) -> DataFrame:
    """key and expired_at of claims that weren't renewed in time, by processing-time timers."""
    ms = int(pd.Timedelta(lease).total_seconds() * 1000)
    rows = df.select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("ts"))

    def step(key_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = state.get[0]
            state.remove()
            yield pd.DataFrame({"key": [key_[0]], "expired_at": [pd.Timestamp(last, unit="us") + pd.Timedelta(milliseconds=ms)]})
            return
        last = max([state.get[0]] if state.exists else [0], default=0)
        for pdf in batches:
            last = max(last, int(pdf["ts"].max().value // 1000))
        state.update((last,))
        state.setTimeoutDuration(ms)

    return rows.groupBy("key").applyInPandasWithState(step, "key long, expired_at timestamp", "last long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def fold_to(path: str, keys: list[str], order: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps the latest row of each key: one written generation for each batch, read back as ``current``.

    A batch that is run again writes its own generation anew from the one before it, so it counts once.
    """
    from ..operators.sequence import latest

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = generation(spark, path, number - 1)
        both = batch if before is None else before.unionByName(batch)
        latest(both, keys, order).select(*batch.columns).write.mode("overwrite").parquet(f"{path}/generation={number}")

    return sink


def generation(spark: SparkSession, path: str, at_most: int) -> DataFrame | None:
    """The table of the last generation up to a number, null if there is none."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return None
    numbers = [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(root) if s.getPath().getName().startswith("generation=")]
    numbers = [n for n in numbers if n <= at_most]
    return spark.read.parquet(f"{path}/generation={max(numbers)}") if numbers else None


def since(events: DataFrame, cursor: str | None, generation_: str, capacity: int) -> tuple[DataFrame, bool]:
    """Events (n, ...) after a cursor gen:n, and whether the reader has to start anew.

    No cursor means from now on; one of another generation, of dropped events or of the future is a reset.
    """
    last = events.agg(F.max("n")).first()[0] or 0
    none = events.filter(F.lit(False))
    if cursor is None:
        return none, False
    gen, _, n = cursor.partition(":")
    if gen != generation_ or not n.isdigit() or int(n) > last or int(n) < last - capacity:
        return none, True
    return events.filter(F.col("n") > int(n)).orderBy("n"), False

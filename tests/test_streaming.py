"""Streams give what the batch forms give, whatever the micro-batches."""

from pyspark.sql import functions as F

from lodestar import streaming
from lodestar.operators import sequence

from .oracle import DATA

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def files(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    for i in range(3):
        events.filter((F.col("event_id") >= i * 400) & (F.col("event_id") < (i + 1) * 400)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return events


def drain(spark, df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_retries_and_changes_equal_batch(spark, tmp_path):
    events = files(spark, tmp_path)
    stream = streaming.read_events(spark, str(tmp_path / "in"), SCHEMA, 1)
    got = drain(spark, streaming.mark_retries(stream, "user_id", "ts", "event_id", F.col("event_type") == "error", 21600), "retries")
    want = sequence.mark_retries(events, ["user_id"], ["ts", "event_id"], F.col("event_type") == "error", 21600).select("event_id", "is_retry")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    got = drain(spark, streaming.state_changes(stream, "user_id", "ts", "event_id", "event_type"), "changes").select("event_id", "previous")
    want = sequence.state_changes(events, ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "previous")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_fold_sink_is_latest_wins_and_repeatable(spark, tmp_path):
    events = files(spark, tmp_path).select("user_id", "ts", "event_id", "event_type")
    sink = streaming.fold_to(str(tmp_path / "out"), ["user_id"], ["ts", "event_id"])
    halves = [events.filter("event_id < 500"), events.filter("event_id >= 500")]
    for n, half in [(0, halves[0]), (1, halves[1]), (1, halves[1])]:
        sink(half, n)
    got, want = streaming.generation(spark, str(tmp_path / "out"), 1), sequence.latest(events, ["user_id"], ["ts", "event_id"]).select(*events.columns)
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_windows_and_once(spark, tmp_path):
    files(spark, tmp_path)
    stream = streaming.read_events(spark, str(tmp_path / "in"), SCHEMA)
    assert drain(spark, streaming.windowed_counts(stream, "ts", "1 day", "1 day", ["event_type"]), "windows", "complete").agg(F.sum("n")).first()[0] == 1000
    assert drain(spark, streaming.once_each(stream.union(stream), "event_id", "ts", "60 days"), "once").count() == 1000


def test_resume_from_cursor(spark):
    e = spark.range(1, 101).withColumnRenamed("id", "n")
    rows = lambda c: (lambda df, reset: (df.count(), reset))(*streaming.since(e, c, "g", 50))
    assert rows("g:90") == (10, False) and rows(None) == (0, False)
    assert rows("h:90") == rows("g:101") == rows("g:10") == (0, True)

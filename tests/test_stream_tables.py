"""Expiring state, late rows and compaction of streams."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from panelwright.sources.flow_files import fresh_path
from panelwright.streaming import tables
from panelwright.streaming.streams import folder_stream, run_to_files

READINGS = "key string, mid int, value double, source_url string, sequence bigint, arrived timestamp"


def delivered(spark, schema, *batches):
    path = fresh_path(spark, "deliveries")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return folder_stream(spark, path, spark.read.parquet(path).schema, 1)


def test_revisions_start_from_a_table_and_expire(spark):
    day = lambda n: datetime(2024, 1, n)
    seed = spark.createDataFrame([("a", 1, 1.0, "u", 1, day(1)), ("b", 1, 5.0, "u", 1, day(1))], READINGS)
    stream = delivered(
        spark, READINGS,
        [("a", 1, 1.5, "u", 2, day(2)), ("a", 1, 9.0, "u", 1, day(2)), ("c", 1, None, "u", 1, day(2)), ("b", 1, 5.0, None, 2, day(2))],
        [("c", 1, 3.0, "u", 2, day(3)), ("z", 1, 0.0, "u", 1, day(20))],
        [("z", 1, 0.0, "v", 2, day(21))],
        [("b", 1, 7.0, "u", 2, day(22)), ("a", 1, 7.0, "u", 3, day(22)), ("z", 1, 1.0, "v", 3, day(22))])
    rows = run_to_files(tables.expiring_revisions(stream, seed, timedelta(days=5), "1 day"), "expiring").collect()
    assert sorted((r.key, r.sequence, r.old_value, r.new_value, r.outcome) for r in rows if r.key != "c") == [
        ("a", 1, None, 9.0, "rejected: stale"), ("a", 2, 1.0, 1.5, "value_revision"), ("b", 2, None, 5.0, "rejected: no source"),
        ("z", 2, 0.0, 0.0, "source_update"), ("z", 3, 0.0, 1.0, "value_revision")]  # a and b were forgotten before they came again
    assert [(r.old_value, r.new_value) for r in rows if r.key == "c"] == [(None, 3.0)]


def test_windows_and_late_rows_hold_every_row(spark):
    at = lambda h, m=0: datetime(2024, 1, 1, h, m)
    stream = delivered(spark, "ts timestamp, stem string, value double",
                       [(at(0, 10), "s", 1.0), (at(5), "s", 2.0)], [(at(0, 20), "s", 4.0), (at(9), "t", 8.0)], [(at(0, 30), "s", 16.0), (at(12), "t", 32.0), (at(7, 45), "s", 64.0)])
    target = tables.sliding_counts(stream, "2 hours", "1 hour", "1 hour")
    counted = spark.read.parquet(f"{target}/counts").agg(F.sum("events")).first()[0]
    late = spark.read.parquet(f"{target}/late").collect()
    assert counted + len(late) == 2 * 7
    assert sorted((r.ts.hour, r.ts.minute, r.start.hour) for r in late) == [(0, 20, 0), (0, 20, 23), (0, 30, 0), (0, 30, 23), (7, 45, 6)]
    closed = {(r.start.day, r.start.hour, r.stem): (r.events, r.total, r.late_events) for r in tables.closed_windows(spark, target, "1 hour").collect()}
    assert closed[1, 0, "s"] == (1, 1.0, 2) and closed[1, 7, "s"] == (1, 64.0, 0) and closed[1, 6, "s"] == (0, None, 1) and closed[1, 8, "t"] == (1, 8.0, 0)
    assert not any(hour >= 10 for day, hour, _ in closed if day == 1)


def test_listener_counts_what_a_watermark_drops(spark):
    at = lambda h, m=0: datetime(2024, 1, 1, h, m)
    stream = delivered(spark, "ts timestamp, stem string, value double", [(at(0, 10), "s", 1.0), (at(5), "s", 2.0)],
                       [(at(0, 20), "s", 4.0), (at(9), "t", 8.0)], [(at(0, 30), "s", 16.0), (at(7, 45), "s", 64.0)])
    listener = tables.LateRows()
    spark.streams.addListener(listener)
    try:
        counts = stream.withWatermark("ts", "1 hour").groupBy(F.window("ts", "2 hours", "1 hour"), "stem").count().select("window.start", "stem", "count")
        run_to_files(counts, "native")
        for _ in range(50):
            if sum(listener.dropped.values()):
                break
            __import__("time").sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert sum(listener.dropped.values()) > 0


def test_compacted_table_reads_few_parts(spark):
    schema = "key string, value double, sequence bigint"
    batches = [[(f"k{j}", float(n), n) for j in range(n % 4 + 1)] for n in range(11)]
    stream = delivered(spark, schema, *batches)
    target = tables.merge_compacted(stream, ["key"], "sequence", every=3)
    want = {}
    for batch in batches:
        want |= {k: v for k, v, _ in batch}
    now = lambda: {r.key: r.value for r in tables.compacted_table(spark, target, ["key"], "sequence").collect()}
    assert now() == want
    base, deltas = tables.tiers(spark, target)
    assert base == 8 and deltas == [9, 10]
    spark.createDataFrame(batches[4], schema).write.mode("overwrite").parquet(f"{target}/deltas/batch=4")  # a replay
    assert now() == want
    # a base whose switch was never written is not read
    spark.createDataFrame([("k0", -1.0, 99)], schema).write.parquet(f"{target}/bases/base=11")
    assert now() == want and tables.tiers(spark, target, upto=5) == (2, [3, 4, 5])

"""Streams against their batch counterparts, and resumption of stored tables."""

from pyspark.sql import functions as F

from panelwright.operators import revisions
from panelwright.sources import flow_files
from panelwright.streaming import streams


def test_latest_table_and_log_equal_batch(spark):
    schema = "key string, mid int, value double, source_url string, sequence bigint"
    rows = [("a", 1, 1.0, "u", 1), ("a", 2, 2.0, "u", 1), ("a", 1, 1.0, "v", 2), ("a", 2, 2.5, "u", 2), ("a", 3, None, "u", 2),
            ("a", 3, 4.0, "u", 3)]
    frame = spark.createDataFrame(rows, schema)
    path = flow_files.fresh_path(spark, "readings")
    for n in (1, 2, 3):
        frame.filter(F.col("sequence") == n).coalesce(1).write.mode("append").parquet(path)
    stored = streams.merge_batches(streams.folder_stream(spark, path, frame.schema, 1), ["key", "mid"], "sequence")
    current = streams.current_table(spark, stored, ["key", "mid"], "sequence")
    assert {(r.mid, r.value, r.source_url) for r in current.collect()} == {(1, 1.0, "v"), (2, 2.5, "u"), (3, 4.0, "u")}
    log = streams.run_to_files(streams.revision_log(streams.folder_stream(spark, path, frame.schema, 1)), "log")
    assert {(r.mid, r.old_value, r.new_value, r.change_type) for r in log.collect()} == {
        (1, 1.0, 1.0, "source_update"), (2, 2.0, 2.5, "value_revision"), (3, None, 4.0, "value_revision")}


def test_late_rows_are_dropped_and_counted(spark):
    path = flow_files.fresh_path(spark, "late")

    def deliver(*times):
        rows = spark.createDataFrame([(t, "s", 1.0) for t in times], "ts string, stem string, value double")
        rows.select(F.to_timestamp("ts").alias("ts"), "stem", "value").coalesce(1).write.mode("append").parquet(path)

    deliver("2024-01-01 00:10:00", "2024-01-01 05:00:00")
    deliver("2024-01-01 00:20:00", "2024-01-01 09:00:00")  # still in the batch that closes the first window
    deliver("2024-01-01 00:30:00", "2024-01-01 12:00:00")  # behind the watermark of the batch before
    schema = spark.read.parquet(path).schema
    stream = streams.windowed_counts(streams.folder_stream(spark, path, schema, 1), "1 hour", "1 hour")
    target = flow_files.fresh_path(spark, "late-out")
    query = (stream.writeStream.outputMode("append").format("parquet").option("path", f"{target}/d")
             .option("checkpointLocation", f"{target}/c").trigger(availableNow=True).start())
    query.awaitTermination()
    assert streams.rows_dropped_late(query) == 1
    rows = spark.read.schema(stream.schema).parquet(f"{target}/d").collect()
    assert sorted((r.start.hour, r.events) for r in rows) == [(0, 2), (5, 1), (9, 1)]


def test_edges_are_rewritten_only_where_content_changed(spark):
    schema = "year int, country_code string, partner_code string, hs2 string, trade_usd double"
    first = spark.createDataFrame([(2020, "A", "B", "01", 1.0), (2021, "A", "B", "01", 2.0)], schema)
    raw = spark.createDataFrame([(2020, 1.5), (2021, 2.0)], "year int, raw_usd double")
    path = flow_files.fresh_path(spark, "edges")
    flow_files.write_edges(first, path, raw).collect()
    kept = spark.read.parquet(path).filter("year = 2020").inputFiles()
    second = spark.createDataFrame([(2020, "A", "B", "01", 1.0), (2021, "A", "B", "01", 3.0)], schema)
    audit = {r.year: r for r in flow_files.write_edges(second, path, raw).collect()}
    files = spark.read.parquet(path).inputFiles()
    assert set(f for f in files if "year=2020" in f) == set(f for f in kept if "year=2020" in f)
    assert {r.year: r.trade_usd for r in spark.read.parquet(path).collect()} == {2020: 1.0, 2021: 3.0}
    assert audit[2020].excluded_usd == 0.5


def test_dedupe_last_is_order_free(spark):
    rows = spark.createDataFrame([("a", 1, 1.0, 1), ("a", 1, 2.0, 2)], "key string, mid int, value double, version int")
    merged = revisions.union_by_priority([("x", rows.filter("version = 1")), ("y", rows.filter("version = 2"))], ["key", "mid"])
    assert [(r.collector, r.value) for r in merged.collect()] == [("y", 2.0)]

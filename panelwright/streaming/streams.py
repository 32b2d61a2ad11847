"""Structured Streaming versions of the ingestion tables.

Every stream writes files below the shared folder and keeps its checkpoint there, so a restarted query resumes
where it stopped. State is held in RocksDB and bounded by watermarks, or by the number of published readings.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from panelwright.sources.flow_files import fresh_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def table_stream(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One table of the data directory as a stream of its files; the schema comes from the table."""
    schema = spark.read.parquet(f"{directory}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(directory)


def folder_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def run_to_files(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process everything available, write it as files, and return them as a table."""
    spark = stream.sparkSession
    target = fresh_path(spark, name)
    query = (
        stream.writeStream.outputMode(mode).format("parquet").option("path", f"{target}/data")
        .option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{target}/data")


def event_time(events: DataFrame) -> DataFrame:
    """Parquet timestamps without zone become UTC instants, which watermarks need."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def rows_dropped_late(query) -> int:
    """Rows a finished or running query discarded because they were behind the watermark."""
    return sum(int(state["numRowsDroppedByWatermark"]) for progress in query.recentProgress
               for state in progress["stateOperators"])


class RevisionProcessor(StatefulProcessor):
    """Last accepted reading per (key, month); emits a log row when a later one differs."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = T.StructType([T.StructField("sequence", T.LongType()), T.StructField("value", T.DoubleType()),
                               T.StructField("source_url", T.StringType())])
        self.current = handle.getValueState("current", schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("sequence")
        known = self.current.get() if self.current.exists() else None
        out = []
        for row in batch.itertuples(index=False):
            value = None if pd.isna(row.value) else float(row.value)
            if known is not None and row.sequence <= known[0]:
                continue
            if known is not None and (known[1] != value or known[2] != row.source_url):
                kind = "value_revision" if known[1] != value else "source_update"
                out.append((key[0], int(key[1]), known[1], value, known[2], row.source_url, kind))
            known = (int(row.sequence), value, row.source_url)
        self.current.update(known)
        yield pd.DataFrame(out, columns=LOG_COLUMNS)

    def close(self) -> None:
        pass


LOG_COLUMNS = ["key", "mid", "old_value", "new_value", "old_url", "new_url", "change_type"]
LOG_SCHEMA = T.StructType([
    T.StructField("key", T.StringType()), T.StructField("mid", T.IntegerType()), T.StructField("old_value", T.DoubleType()),
    T.StructField("new_value", T.DoubleType()), T.StructField("old_url", T.StringType()),
    T.StructField("new_url", T.StringType()), T.StructField("change_type", T.StringType()),
])


def revision_log(readings: DataFrame) -> DataFrame:
    """Append-only log of changed readings; ``sequence`` is the ingest order."""
    readings.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return readings.groupBy("key", "mid").transformWithStateInPandas(
        RevisionProcessor(), outputStructType=LOG_SCHEMA, outputMode="Append", timeMode="None")


def windowed_counts(events: DataFrame, width: str, delay: str) -> DataFrame:
    """Events and values per stem and tumbling window; windows close when the watermark passes them."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "stem").agg(
        F.count("*").alias("events"), F.sum("value").alias("total")
    ).select(F.col("w.start").alias("start"), "stem", "events", "total")


def session_runs(events: DataFrame, gap: str, delay: str) -> DataFrame:
    """Bursts of activity per batch, separated by silent gaps."""
    return events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "batch_id").agg(
        F.count("*").alias("events")
    ).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "batch_id", "events")


def deduplicated(events: DataFrame, keys: list[str], delay: str) -> DataFrame:
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def merge_batches(readings: DataFrame, keys: list[str], order: str) -> str:
    """Merge micro-batches into a current table kept as a log of reduced batches.

    A batch is reduced to its last row per key and written to its own partition; a replayed batch overwrites
    exactly that partition, and no batch rewrites the table.
    """
    spark = readings.sparkSession
    target = fresh_path(spark, "current-table")
    columns = [c for c in readings.columns if c not in keys]

    def write(batch: DataFrame, batch_id: int) -> None:
        last = batch.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("w")).select(*keys, "w.*")
        last.write.mode("overwrite").parquet(f"{target}/data/batch={batch_id}")

    query = (
        readings.writeStream.foreachBatch(write).option("checkpointLocation", f"{target}/checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return f"{target}/data"


def current_table(spark: SparkSession, path: str, keys: list[str], order: str) -> DataFrame:
    """Latest row per key over all merged batches."""
    log = spark.read.parquet(path).drop("batch")
    columns = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("w")).select(*keys, "w.*")


def late_publications(published: DataFrame, calendar: DataFrame) -> DataFrame:
    """Publication lag in months against the static calendar of data months; flagged outside 0-3."""
    released = F.year("published") * 12 + F.month("published") - 1
    return published.join(calendar, "mid").withColumn("lag_months", released - F.col("calendar_mid")).withColumn(
        "flagged", ~F.col("lag_months").between(0, 3))

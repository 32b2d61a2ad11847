"""Streams with bounded state and bounded reads: expiring revisions, sliding windows with their late rows, compacted tables.

What a stream writes lies below the shared folder in one part per batch, so a batch that is replayed after a failure replaces exactly
what it wrote before.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from panelwright.sources.flow_files import fresh_path
from panelwright.streaming.streams import ROCKSDB

# ---- revisions whose state expires -------------------------------------------------------------------------------

CHANGES = T.StructType([
    T.StructField("key", T.StringType()), T.StructField("mid", T.IntegerType()), T.StructField("sequence", T.LongType()),
    T.StructField("old_value", T.DoubleType()), T.StructField("new_value", T.DoubleType()), T.StructField("old_url", T.StringType()),
    T.StructField("new_url", T.StringType()), T.StructField("outcome", T.StringType()),
])


class ExpiringRevisions(StatefulProcessor):
    """Last accepted reading of a (key, month), forgotten when the watermark passes its arrival by ``idle``."""

    def __init__(self, idle: timedelta):
        self.idle_ms = int(idle.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.current = handle.getValueState("current", T.StructType([
            T.StructField("sequence", T.LongType()), T.StructField("value", T.DoubleType()), T.StructField("source_url", T.StringType())]))

    def _keep(self, known: tuple, arrived: pd.Timestamp) -> None:
        self.current.update(known)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(arrived.timestamp() * 1000) + self.idle_ms)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.sort_values("sequence").iloc[-1]
        value = None if pd.isna(row["value"]) else float(row["value"])
        self._keep((int(row["sequence"]), value, row["source_url"]), row["arrived"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("sequence", kind="stable")
        known = self.current.get() if self.current.exists() else None
        out, accepted = [], None
        for row in batch.itertuples(index=False):
            value = None if pd.isna(row.value) else float(row.value)
            sequence = int(row.sequence)
            if row.source_url is None or known is not None and sequence <= known[0]:
                outcome = "rejected: no source" if row.source_url is None else "rejected: stale"
                out.append((key[0], int(key[1]), sequence, None, value, None, row.source_url, outcome))
                continue
            if known is not None and (known[1], known[2]) != (value, row.source_url):
                outcome = "value_revision" if known[1] != value else "source_update"
                out.append((key[0], int(key[1]), sequence, known[1], value, known[2], row.source_url, outcome))
            known = (sequence, value, row.source_url)
            accepted = row.arrived if accepted is None else max(accepted, row.arrived)
        if accepted is not None:
            self._keep(known, accepted)
        yield pd.DataFrame(out, columns=CHANGES.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.current.clear()
        yield pd.DataFrame([], columns=CHANGES.names)

    def close(self) -> None:
        pass


def expiring_revisions(readings: DataFrame, seed: DataFrame, idle: timedelta, delay: str) -> DataFrame:
    """Changes and rejected rows of a stream of readings (key, mid, value, source_url, sequence, arrived).

    ``seed`` is a table of the same columns from which the state starts. A later reading that differs gives a row with
    ``outcome`` value_revision or source_update; one without a source, or not later in ``sequence`` than the known one, a rejected row. A
    reading is forgotten when no newer one was accepted until the watermark (``delay`` behind the latest arrival) has passed its
    arrival by ``idle``: the next one then counts as the first, so state holds only what is still being revised.
    """
    readings.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return readings.withWatermark("arrived", delay).groupBy("key", "mid").transformWithStateInPandas(
        ExpiringRevisions(idle), outputStructType=CHANGES, outputMode="Append", timeMode="EventTime", initialState=seed.groupBy("key", "mid"))


# ---- sliding windows and the rows that come too late -------------------------------------------------------------

class LateRows(StreamingQueryListener):
    """Adds up the rows that the queries of a session drop behind their watermarks."""

    def __init__(self):
        self.dropped: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        rows = sum(state.numRowsDroppedByWatermark for state in progress.stateOperators)
        self.dropped[str(progress.id)] = self.dropped.get(str(progress.id), 0) + rows

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def sliding_assignments(events: DataFrame, width: str, slide: str) -> DataFrame:
    """One row per event and window of ``width`` that holds it; windows begin every ``slide``."""
    return events.select("*", F.window("ts", width, slide).alias("w")).select(*events.columns, F.col("w.start").alias("start"), F.col("w.end").alias("end"))


def sliding_counts(events: DataFrame, width: str, slide: str, delay: str, target: str | None = None) -> str:
    """Counts of overlapping windows and, apart, the rows that came after their window had closed; the path of both.

    A batch's watermark is the latest event time of the batches before it, less ``delay``, as for any stream. A row of a
    window that ends by then is late for it and goes to ``late``; the others are counted, per batch, in ``counts``. Each batch writes its
    own part of both and its latest time in ``times``: a replay replaces them, and every assignment is in exactly one of the two. A
    stopped stream goes on if its path is given as ``target``.
    """
    target = target or fresh_path(events.sparkSession, "sliding")
    times = "latest timestamp, batch long"

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        seen = session.read.schema(times).parquet(f"{target}/times") if batch_id else session.createDataFrame([], times)
        before = seen.where(F.col("batch") < batch_id).agg(F.max("latest")).first()[0]
        closed = F.lit(before).cast("timestamp") - F.expr(f"INTERVAL {delay}")
        assigned = sliding_assignments(batch, width, slide).withColumn("late", F.coalesce(F.col("end") <= closed, F.lit(False)))
        assigned.where("NOT late").groupBy("start", "end", "stem").agg(F.count("*").alias("events"), F.sum("value").alias("total")).write.mode(
            "overwrite").parquet(f"{target}/counts/batch={batch_id}")
        assigned.where("late").drop("late").write.mode("overwrite").parquet(f"{target}/late/batch={batch_id}")
        batch.agg(F.max("ts").alias("latest")).write.mode("overwrite").parquet(f"{target}/times/batch={batch_id}")

    events.writeStream.foreachBatch(write).option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return target


def closed_windows(spark: SparkSession, target: str, delay: str) -> DataFrame:
    """(start, end, stem, events, total, late_events) of the windows that the last watermark has passed."""
    last = spark.read.parquet(f"{target}/times").agg((F.max("latest") - F.expr(f"INTERVAL {delay}")).alias("mark"))
    keys = ["start", "end", "stem"]
    counts = spark.read.parquet(f"{target}/counts").groupBy(*keys).agg(F.sum("events").alias("events"), F.sum("total").alias("total"))
    late = spark.read.parquet(f"{target}/late").groupBy(*keys).agg(F.count("*").alias("late_events"))
    both = counts.join(late, keys, "full").join(last).where("end <= mark")
    return both.select(*keys, F.coalesce("events", F.lit(0)).alias("events"), "total", F.coalesce("late_events", F.lit(0)).alias("late_events"))


# ---- a current table in two tiers --------------------------------------------------------------------------------

def merge_compacted(readings: DataFrame, keys: list[str], order: str, every: int = 8, target: str | None = None) -> str:
    """Merges batches into a current table of a base and at most ``every`` small deltas; returns its path.

    A batch is reduced to its last row per key and written as a delta. After ``every`` batches the base and its deltas become a
    new base, and only then one row in ``switches`` names it: readers see the old state or the new one. Batches up to a switch are part of
    its base, so a replayed batch changes nothing. A stopped stream goes on if ``target`` is given again. Files of former bases
    and of merged deltas may be removed once no reader uses them.
    """
    spark = readings.sparkSession
    target = target or fresh_path(spark, "compacted")
    columns = [c for c in readings.columns if c not in keys]

    def write(batch: DataFrame, batch_id: int) -> None:
        last = batch.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("w")).select(*keys, "w.*")
        last.write.mode("overwrite").parquet(f"{target}/deltas/batch={batch_id}")
        if (batch_id + 1) % every == 0:
            session = batch.sparkSession
            compacted_table(session, target, keys, order, upto=batch_id).write.mode("overwrite").parquet(f"{target}/bases/base={batch_id}")
            session.createDataFrame([(batch_id,)], "upto long").coalesce(1).write.mode("overwrite").parquet(f"{target}/switches/base={batch_id}")

    readings.writeStream.foreachBatch(write).option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return target


def _parts(spark: SparkSession, path: str, name: str) -> list[int]:
    """Numbers of the parts ``name=N`` of a folder, without reading their files; none if it does not exist."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not files.exists(folder):
        return []
    found = [s.getPath() for s in files.listStatus(folder)]
    done = [p for p in found if p.getName().startswith(f"{name}=") and files.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().split("=")[1]) for p in done)


def tiers(spark: SparkSession, target: str, upto: int | None = None) -> tuple[int | None, list[int]]:
    """(base, deltas after it) that make up the table now, or as it was after batch ``upto``."""
    inside = lambda n: upto is None or n <= upto
    bases = [n for n in _parts(spark, f"{target}/switches", "base") if inside(n) and n != upto]
    base = bases[-1] if bases else None
    return base, [n for n in _parts(spark, f"{target}/deltas", "batch") if inside(n) and (base is None or n > base)]


def compacted_table(spark: SparkSession, target: str, keys: list[str], order: str, upto: int | None = None) -> DataFrame:
    """Latest row per key: one base and the few deltas after it, however many batches there were."""
    base, deltas = tiers(spark, target, upto)
    paths = [f"{target}/deltas/batch={n}" for n in deltas] + ([f"{target}/bases/base={base}"] if base is not None else [])
    rows = spark.read.parquet(*paths)
    columns = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("w")).select(*keys, "w.*")

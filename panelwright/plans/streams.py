from datetime import timedelta

from pyspark.sql import functions as F

from panelwright.functions.expressions import rounded
from panelwright.plans.registry import query
from panelwright.sources.flow_files import fresh_path
from panelwright.streaming import streams as op
from panelwright.streaming import tables


def readings(inp):
    """Two deliveries of the same readings as stream files, in ingest order."""
    path = fresh_path(inp.spark, "readings")
    rows = inp.obs_versions.select("key", "mid", "value", "source_url", F.col("version").cast("bigint").alias("sequence"))
    for version in (1, 2):
        rows.filter(F.col("sequence") == version).write.mode("append").parquet(path)
    return op.folder_stream(inp.spark, path, rows.schema, files_per_batch=1)


def events(inp):
    """The event table as a stream in the shape of the release log."""
    return shaped(op.event_time(op.table_stream(inp.spark, inp.directory, "events")))


def shaped(raw):
    status = F.when(F.col("event_type") == "purchase", "published").when(F.col("event_type") == "error", "failed").when(
        F.col("event_type") == "signup", "restored").otherwise("checked")
    return raw.select(
        "event_id", "ts", F.concat(F.lit("b"), (F.col("user_id") % 40).cast("string")).alias("batch_id"),
        F.concat(F.lit("stem"), (F.col("event_id") % 6).cast("string")).alias("stem"), status.alias("status"), "value")


@query("stream_revision_log", """
SELECT key, mid, a.value AS old_value, b.value AS new_value, a.source_url AS old_url, b.source_url AS new_url, CASE WHEN a.value IS DISTINCT FROM b.value THEN 'value_revision' ELSE 'source_update' END AS change_type
FROM (SELECT * FROM obs_versions WHERE version = 1) a JOIN (SELECT * FROM obs_versions WHERE version = 2) b USING (key, mid) WHERE a.value IS DISTINCT FROM b.value OR a.source_url IS DISTINCT FROM b.source_url""")
def stream_revision_log(inp):
    return op.run_to_files(op.revision_log(readings(inp)), "revision-log")


def stamp(name):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


@query("stream_monthly_counts", """
SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d %H:%M:%S') AS start, stem, count(*) AS events, round(sum(value), 4) + 0.0 AS total FROM release_events
GROUP BY ALL HAVING time_bucket(INTERVAL 1 DAY, min(ts)) + INTERVAL 1 DAY <= (SELECT max(ts) FROM release_events) - INTERVAL 6 HOUR""")
def stream_monthly_counts(inp):
    counts = op.run_to_files(op.windowed_counts(events(inp), "1 day", "6 hours"), "window-counts")
    return counts.select(stamp("start"), "stem", "events", rounded("total", 4).alias("total"))


@query("stream_session_runs", """
WITH g AS (SELECT batch_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS n FROM release_events WINDOW w AS (PARTITION BY batch_id ORDER BY ts)),
s AS (SELECT batch_id, ts, sum(n) OVER (PARTITION BY batch_id ORDER BY ts) AS i FROM g),
r AS (SELECT batch_id, i, min(ts) AS a, max(ts) + INTERVAL 30 MINUTE AS b, count(*) AS events FROM s GROUP BY ALL)
SELECT strftime(a, '%Y-%m-%d %H:%M:%S') AS start, strftime(b, '%Y-%m-%d %H:%M:%S') AS "end", batch_id, events FROM r WHERE b <= (SELECT max(ts) FROM release_events) - INTERVAL 6 HOUR""")
def stream_session_runs(inp):
    runs = op.run_to_files(op.session_runs(events(inp), "30 minutes", "6 hours"), "session-runs")
    return runs.select(stamp("start"), stamp("end"), "batch_id", "events")


@query("stream_dedupe", "SELECT event_id, stem, status, round(value, 6) + 0.0 AS value FROM release_events")
def stream_dedupe(inp):
    # every event is delivered twice
    twice = events(inp).unionByName(events(inp))
    kept = op.run_to_files(op.deduplicated(twice, ["event_id"], "2 days"), "deduplicated")
    return kept.select("event_id", "stem", "status", rounded("value", 6).alias("value"))


@query("stream_latest_table", """
SELECT key, mid, value, source_url, version AS sequence FROM (SELECT *, row_number() OVER (PARTITION BY key, mid ORDER BY version DESC) AS n FROM obs_versions) WHERE n = 1""")
def stream_latest_table(inp):
    path = op.merge_batches(readings(inp), ["key", "mid"], "sequence")
    return op.current_table(inp.spark, path, ["key", "mid"], "sequence").select(
        "key", "mid", "value", "source_url", F.col("sequence").cast("int").alias("sequence"))


@query("stream_late_publication", """
WITH p AS (SELECT doc_id, mid, CAST(make_date(py, pm, pd) + CAST(CASE WHEN s % 13 = 0 THEN 150 WHEN s % 17 = 0 THEN -60 ELSE 0 END AS INT) AS DATE) AS published FROM report_src),
l AS (SELECT doc_id, mid, published, CAST(year(published) * 12 + month(published) - 1 - mid AS INT) AS lag_months FROM p)
SELECT doc_id, mid, CAST(published AS VARCHAR) AS published, lag_months, NOT lag_months BETWEEN 0 AND 3 AS flagged FROM l""")
def stream_late_publication(inp):
    shift = F.when(F.col("s") % 13 == 0, 150).when(F.col("s") % 17 == 0, -60).otherwise(0)
    rows = inp.report_src.select("doc_id", "mid", F.date_add(F.make_date("py", "pm", "pd"), shift).alias("published"))
    path = fresh_path(inp.spark, "publications")
    rows.write.parquet(path)
    calendar = inp.report_src.select("mid", F.col("mid").alias("calendar_mid")).distinct()
    flagged = op.run_to_files(op.late_publications(op.folder_stream(inp.spark, path, rows.schema), calendar), "late-publications")
    return flagged.select("doc_id", "mid", F.col("published").cast("string").alias("published"), "lag_months", "flagged")


@query("stream_expiring_revisions", """
WITH a AS (SELECT * FROM obs_versions WHERE version = 1), b AS (SELECT * FROM obs_versions WHERE version = 2)
SELECT key, mid, CAST(2 AS BIGINT) AS sequence, a.value AS old_value, b.value AS new_value, a.source_url AS old_url, b.source_url AS new_url,
  CASE WHEN a.value IS DISTINCT FROM b.value THEN 'value_revision' ELSE 'source_update' END AS outcome FROM a JOIN b USING (key, mid) WHERE a.value IS DISTINCT FROM b.value OR a.source_url IS DISTINCT FROM b.source_url
UNION ALL SELECT key, mid, 1, NULL, value, NULL, source_url, 'rejected: stale' FROM a WHERE mid % 5 = 0""")
def stream_expiring_revisions(inp):
    """The second version as a stream over the first as a table; a part of the first is delivered again and refused."""
    rows = inp.obs_versions.select("key", "mid", "value", "source_url", F.col("version").cast("bigint").alias("sequence"),
                                   F.timestamp_seconds(F.col("mid").cast("long") * 86400).alias("arrived"))
    path = fresh_path(inp.spark, "expiring-readings")
    rows.filter("sequence = 2 OR mid % 5 = 0").write.parquet(path)
    stream = op.folder_stream(inp.spark, path, rows.schema)
    return op.run_to_files(tables.expiring_revisions(stream, rows.filter("sequence = 1"), timedelta(days=36500), "1 day"), "expiring-revisions")


@query("stream_sliding_counts", """
WITH e AS (SELECT *, event_id % 50 = 7 AS delayed FROM release_events), m AS (SELECT max(ts) FILTER (WHERE NOT delayed) - INTERVAL 6 HOUR AS mark, max(ts) - INTERVAL 6 HOUR AS last FROM e),
w AS (SELECT e.*, date_trunc('day', ts) - o * INTERVAL 1 DAY AS start FROM e, (SELECT unnest([0, 1]) AS o)),
c AS (SELECT start, stem, value, last, delayed AND start + INTERVAL 2 DAY <= mark AS late FROM w, m)
SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, stem, count(*) FILTER (WHERE NOT late) AS events, round(sum(value) FILTER (WHERE NOT late), 4) + 0.0 AS total, count(*) FILTER (WHERE late) AS late_events
FROM c GROUP BY start, stem, last HAVING start + INTERVAL 2 DAY <= last""")
def stream_sliding_counts(inp):
    """Two-day windows that begin every day, over three deliveries; the last brings events that are long past."""
    rows = shaped(op.event_time(inp.events))
    delayed = F.col("event_id") % 50 == 7
    first, last = rows.agg(F.min("ts"), F.max("ts")).first()
    middle = F.lit(first + (last - first) / 2)
    path, target = fresh_path(inp.spark, "deliveries"), fresh_path(inp.spark, "sliding")
    for part in (~delayed & (F.col("ts") < middle), ~delayed & (F.col("ts") >= middle), delayed):
        rows.filter(part).write.mode("append").parquet(path)
        tables.sliding_counts(op.folder_stream(inp.spark, path, rows.schema), "2 days", "1 day", "6 hours", target)
    closed = tables.closed_windows(inp.spark, target, "6 hours")
    return closed.select(stamp("start"), "stem", "events", rounded("total", 4).alias("total"), "late_events")


@query("stream_compacted_table", """
SELECT key, mid, value, source_url, CAST(version AS INT) AS sequence FROM (SELECT *, row_number() OVER (PARTITION BY key, mid ORDER BY version DESC) AS n FROM obs_versions) WHERE n = 1""")
def stream_compacted_table(inp):
    target = tables.merge_compacted(readings(inp), ["key", "mid"], "sequence", every=2)
    return tables.compacted_table(inp.spark, target, ["key", "mid"], "sequence").select("key", "mid", "value", "source_url", F.col("sequence").cast("int").alias("sequence"))

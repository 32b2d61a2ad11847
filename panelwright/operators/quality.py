"""Release calendar, coverage status and observation audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.expressions import finite, month_label, month_number

# Planned publication day per category and month (None: no separate release).
RELEASE_DAYS = {
    "overview": (19, None, 16, 16, 18, 16, 15, 17, 15, 19, 16, 15),
    "price": (9, 11, 9, 10, 11, 10, 9, 9, 9, 14, 9, 9),
    "profit": (27, None, 27, 27, 27, 27, 27, 27, 28, 27, 27, 27),
    "pmi": (31, None, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31),
}


def release_calendar(spark, year: int) -> DataFrame:
    """One row per category and data month with the planned instant (UTC).

    The category released with the month itself has one exception: its February figure comes on 4 March.
    """
    days = spark.createDataFrame(
        [(c, m, d) for c, row in RELEASE_DAYS.items() for m, d in enumerate(row, 1) if d], "category string, month int, day int"
    )
    same_month = F.col("category") == "pmi"
    overview = F.col("category") == "overview"
    hour = F.when(overview & (F.col("month") == 8), 15).when(overview, 10).otherwise(9)
    minute = F.when(overview, 0).otherwise(30)
    data_month = F.lit(year * 12) + F.col("month") - 1 - F.when(same_month, 0).otherwise(1)
    planned = days.select(
        "category", data_month.cast("int").alias("mid"),
        F.make_timestamp(F.lit(year), F.col("month"), F.col("day"), hour, minute, F.lit(0)).alias("scheduled"),
    )
    extra = spark.range(1).select(
        F.lit("pmi").alias("category"), F.lit(year * 12 + 1).alias("mid"),
        F.make_timestamp(F.lit(year), F.lit(3), F.lit(4), F.lit(9), F.lit(30), F.lit(0)).alias("scheduled"),
    )
    return planned.unionByName(extra)


def planned_release(cells: DataFrame, calendar: DataFrame) -> DataFrame:
    """Scheduled instant of each (key, month) through its category; NULL where none was verified."""
    return cells.join(F.broadcast(calendar), ["category", "mid"], "left")  # at most 49 rows


def key_rules(key: Column) -> dict[str, Column]:
    """Release category, active range and months without a separate reading, per key of the test tables."""
    return {
        "category": F.when(key == "p1", "pmi").when(key == "p2", "price").when(key == "p3", "profit").when(key == "p4", "overview"),
        "active_from": F.when(key == "p4", 1996 * 12 + 5).cast("int"),
        "active_to": F.when(key == "p5", 2000 * 12 + 11).cast("int"),
        "no_january": key.isin("p3"),
        "no_january_february": key.isin("p2"),
    }


def period_status(cells: DataFrame, monthly: DataFrame, calendar: DataFrame, as_of: str) -> DataFrame:
    """recorded, inactive, not separate, pending, unconfirmed, missing - in that precedence."""
    instant = F.to_timestamp(F.lit(as_of))
    ruled = cells.withColumns(key_rules(F.col("key")))
    have = monthly.select("key", "mid", F.lit(True).alias("_have"))
    joined = planned_release(ruled, calendar).join(have, ["key", "mid"], "left")
    month = F.col("mid") % 12 + 1
    recent = (F.year(instant) * 12 + F.month(instant) - 1) - 1
    status = (
        F.when(F.col("_have").isNotNull(), "recorded")
        .when((F.col("mid") < F.col("active_from")) | (F.col("mid") > F.col("active_to")), "inactive")
        .when((F.col("no_january") & (month == 1)) | (F.col("no_january_february") & month.isin(1, 2)), "not_separate")
        .when(instant < F.col("scheduled"), "pending")
        .when(F.col("scheduled").isNull() & (F.col("mid") >= recent), "unconfirmed")
        .otherwise("missing")
    )
    return joined.select("key", "mid", "category", "scheduled", status.alias("status"))


def coverage(statuses: DataFrame, monthly: DataFrame, end: int) -> DataFrame:
    """Observed over expected months per key and overall, with the lists and the lag of the latest value."""
    status = F.col("status")
    label = month_label(F.col("mid"))

    def listed(code: str) -> Column:
        return F.array_join(F.array_sort(F.collect_list(F.when(status == code, label))), ",")

    counts = [
        F.count_if(status == "recorded").alias("observed"),
        F.count_if(status.isin("recorded", "missing")).alias("expected"),
    ]
    latest = monthly.groupBy("key").agg((F.lit(end) - F.max("mid")).alias("lag_months"))
    per_key = statuses.groupBy("key").agg(
        *counts, listed("missing").alias("missing"), listed("pending").alias("pending"),
        listed("unconfirmed").alias("unconfirmed"),
    ).join(latest, "key", "left")
    total = statuses.agg(*counts).select(
        F.lit("ALL").alias("key"), "observed", "expected", *[F.lit(None).cast("string").alias(c) for c in ("missing", "pending", "unconfirmed")],
        F.lit(None).cast("int").alias("lag_months"),
    )
    both = per_key.unionByName(total)
    share = F.when(F.col("expected") > 0, F.round(100.0 * F.col("observed") / F.col("expected"), 1)).otherwise(0.0)
    return both.withColumn("coverage_pct", share)


def documented_gaps(missing: DataFrame, listed: DataFrame) -> DataFrame:
    """Documented reason for a gap: combined January-February releases by rule, single months by list."""
    rule = F.when(F.col("key").isin("p3", "p4") & (F.col("mid") % 12 < 2), "only a combined January-February figure exists")
    return missing.join(listed, ["key", "mid"], "left").withColumn("reason", F.coalesce(rule, "listed_reason")).drop(
        "listed_reason"
    )


def audit_observations(rows: DataFrame, catalog: DataFrame, hosts: list[str], low: float, high: float) -> DataFrame:
    """One row per defect. Errors: key, period, host, title, number, limits, date; warning: publication lag."""
    known = catalog.select("key", F.lit(True).alias("_known"))
    joined = rows.join(known, "key", "left")
    mid = month_number(F.col("period"))
    url = F.col("source_url")
    official = url.startswith("https://") & F.coalesce(F.try_parse_url(url, F.lit("HOST")).isin(hosts), F.lit(False))
    published = F.col("published").try_cast("date")
    lag = F.year(published) * 12 + F.month(published) - 1 - mid
    value = F.col("value")
    defects = F.array_compact(F.array(
        F.when(F.col("_known").isNull(), "error: unknown indicator"),
        F.when(mid.isNull(), "error: invalid period"),
        F.when(~official, "error: source host"),
        F.when(F.trim("source_title") == "", "error: empty title"),
        F.when(~finite(value), "error: not finite"),
        F.when(finite(value) & ~value.between(low, high), "error: outside limits"),
        F.when(F.col("published").isNotNull() & (F.col("published") != "") & published.isNull(), "error: publication date"),
        F.when(~lag.between(0, 3), "warning: publication lag"),
    ))
    return joined.select("row_id", F.explode(defects).alias("defect"))


def detail_rows(spine: DataFrame, statuses: DataFrame, monthly: DataFrame) -> DataFrame:
    """Month spine with value, status and evidence address for a chart."""
    values = monthly.select("key", "mid", "value", "source_url")
    return spine.join(statuses.select("key", "mid", "status"), ["key", "mid"], "left").join(
        values, ["key", "mid"], "left"
    ).withColumn("evidence", F.coalesce("source_url", F.concat(F.lit("status:"), F.col("status")))).drop("source_url")


def latest_table(monthly: DataFrame, changes: DataFrame, log: DataFrame) -> DataFrame:
    """Latest value per indicator, its change to the previous calendar month and the number of revisions."""
    newest = F.max("mid").over(Window.partitionBy("key"))
    current = changes.withColumn("_m", newest).filter("mid = _m").select(
        "key", "name", "mid", "value", "delta", "direction", "reason"
    )
    counts = log.groupBy("key").agg(F.count("*").alias("revisions"))
    return current.join(counts, "key", "left").withColumn("revisions", F.coalesce("revisions", F.lit(0)))

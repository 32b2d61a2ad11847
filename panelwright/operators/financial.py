"""Central-bank style series: policy rates, credit triplets and price-adjusted indices.

Months are integer ids, quarters ``year * 4 + quarter - 1``. No value is carried across a missing period.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.expressions import ratio
from panelwright.operators.revisions import latest_by

# Years in a history window, the selected one included.
HISTORY_YEARS = {"policy": 10, "credit": 20, "index": 6}


def at_offset(value: str, keys: list[str], order: str, offset: int) -> Column:
    """Value exactly ``offset`` calendar steps away; NULL if that step does not exist."""
    return F.max(value).over(Window.partitionBy(*keys).orderBy(order).rangeBetween(offset, offset))


def change_12m(index: DataFrame) -> DataFrame:
    """Percentage change against the same series exactly twelve months earlier."""
    before = at_offset("value", ["country_code", "measure"], "mid", -12)
    return index.withColumn("value_12m_ago", before).withColumn(
        "change_12m_pct", 100 * (ratio(F.col("value"), F.col("value_12m_ago")) - 1)
    )


def index_long(index: DataFrame) -> DataFrame:
    return index.unpivot(["country_code", "mid"], ["nominal", "real_value"], "measure", "value")


def asof_values(series: DataFrame, cutoffs: list[int]) -> DataFrame:
    """Per country and cutoff: the exact record, the latest non-missing record before it, the last record date.

    Cutoff markers are added to the series and a running window picks the newest observation, so all cutoffs
    cost one pass over the data.
    """
    markers = series.select("country_code").distinct().withColumn(
        "mid", F.explode(F.array(*[F.lit(c).cast("int") for c in cutoffs]))
    )
    rows = series.select("country_code", "mid", "value", "obs_status", F.lit(False).alias("marker")).unionByName(
        markers.select("country_code", "mid", F.lit(None).cast("double").alias("value"),
                       F.lit(None).cast("string").alias("obs_status"), F.lit(True).alias("marker"))
    )
    past = Window.partitionBy("country_code").orderBy("mid").rangeBetween(Window.unboundedPreceding, 0)
    here = Window.partitionBy("country_code").orderBy("mid").rangeBetween(0, 0)
    record = F.struct("mid", "value", "obs_status")
    observed = F.max(F.when(F.col("value").isNotNull(), record)).over(past)
    real = ~F.col("marker")
    out = rows.select(
        "country_code", F.col("mid").alias("cutoff"), "marker", observed.alias("latest"),
        F.max(F.when(real, F.col("mid"))).over(past).alias("last_record_mid"),
        F.max(F.when(real, record)).over(here).alias("common"),
    )
    return out.filter("marker").select(
        "country_code", "cutoff", F.col("common.value").alias("common_value"),
        F.coalesce("common.obs_status", F.lit("")).alias("common_status"),
        F.col("latest.mid").alias("latest_mid"), F.col("latest.value").alias("latest_value"), "last_record_mid",
    )


def latest_in_year(series: DataFrame, keys: list[str]) -> DataFrame:
    """The last record of each year even when its value is missing."""
    year = F.floor(F.col("mid") / 12).cast("int")
    return latest_by(series.withColumn("year", year), [*keys, "year"], [F.desc("mid")])


def history_window(series: DataFrame, order: str, per_year: int, years: int) -> DataFrame:
    """Rows of the ``years`` years up to each selected year; a code's selected years are those in which it has a record."""
    dated = series.withColumn("year", F.floor(F.col(order) / per_year).cast("int"))
    chosen = dated.select("code", F.col("year").alias("selected_year")).distinct()
    ends = dated.withColumn("selected_year", F.explode(F.sequence("year", F.col("year") + years - 1))).drop("year")
    return ends.join(chosen, ["code", "selected_year"], "left_semi")


def latest_quarter(credit: DataFrame) -> DataFrame:
    """Ratio, trend and gap of the last reported quarter of the year; never mixed across quarters."""
    year = F.floor(F.col("qid") / 4).cast("int")
    last = F.max("qid").over(Window.partitionBy("nk", "year"))
    current = credit.withColumn("year", year).withColumn("_last", last).filter("qid = _last")
    return current.groupBy("nk", "year", "qid").pivot("measure", ["ratio", "trend", "gap"]).agg(F.max("value"))


def series_extent(series: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, first and last month and the missing months in between."""
    spans = series.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.count("value").alias("observed"), F.min("mid").alias("first_mid"),
        F.max("mid").alias("last_mid"), F.collect_set("mid").alias("_have"),
    )
    missing = F.array_sort(F.array_except(F.sequence("first_mid", "last_mid"), "_have"))
    return spans.withColumn("missing", missing).drop("_have")


def trim_trailing(series: DataFrame, keys: list[str], minimum: int) -> DataFrame:
    """Drop placeholder months after the last observed one; series below the minimum are refused."""
    group = Window.partitionBy(*keys)
    last = F.max(F.when(F.col("value").isNotNull(), F.col("mid"))).over(group)
    return series.withColumns({"_last": last, "observations": F.count("value").over(group)}).filter(
        (F.col("mid") <= F.col("_last")) & (F.col("observations") >= minimum)
    ).drop("_last")


def identity_gaps(credit: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """ratio - trend must equal the reported gap; incomplete triplets are reported apart."""
    wide = credit.groupBy("nk", "qid").pivot("measure", ["ratio", "trend", "gap"]).agg(F.max("value"))
    difference = F.col("ratio") - F.col("trend") - F.col("gap")
    return wide.withColumn(
        "status",
        F.when(difference.isNull(), "incomplete").when(F.abs(difference) <= tolerance, "ok").otherwise("mismatch"),
    )

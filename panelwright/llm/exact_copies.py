"""Exact copies of report texts, found by a 128-bit digest and confirmed by their bytes; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import bucket_of, text_of


def exact_copies(reports: DataFrame, report_id: str = "report_id", text: str = "text") -> DataFrame:
    """(report_id, keep_id, group_size, kept, text_sha256) of every row of ``reports``.

    Texts are equal when their bytes are, null being empty; the largest id of equal texts stays (``keep_id``). Digests
    that occur once need no comparison. Of the others the digest and the text itself are grouped together, so two texts
    with one digest are never mixed. Rows without an id are left out; repeated rows are returned as often as they come,
    each counted in ``group_size``. Other columns are ignored. An empty table gives an empty result.

    Shuffles: one row of 24 bytes per text and task, combined before it is sent; whole texts move only for digests that
    occur twice, one per task in the grouping. A hot group is combined before the shuffle and, where it meets its group's
    single row, is split by the adaptive skew join. The broadcast filter holds at most 2**20 small numbers.
    """
    rows = reports.select(F.col(report_id).alias("report_id"), text_of(text).alias("text")).where("report_id IS NOT NULL")
    rows = rows.withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary"))))
    rows = rows.withColumn("_bucket", bucket_of("digest"))
    seen = rows.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1")
    buckets = F.broadcast(seen.select(bucket_of("digest").alias("_bucket")).distinct())
    sha = F.sha2(F.col("text").cast("binary"), 256)
    single = rows.join(buckets, "_bucket", "left_anti").select(
        "report_id", F.col("report_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), sha.alias("text_sha256"))
    several = rows.join(buckets, "_bucket", "left_semi")
    groups = several.groupBy("digest", "text").agg(F.max("report_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = groups.repartition("keep_id")  # leaves the grouping's partitions, so that the join below can split a hot group
    grouped = several.join(groups, ["digest", "text"]).select(
        "report_id", "keep_id", "group_size", (F.col("report_id") == F.col("keep_id")).alias("kept"), sha.alias("text_sha256"))
    return single.unionByName(grouped)

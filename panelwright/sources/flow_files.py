"""Flow archives as CSV folders and the edge list as a partitioned table."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.operators.revisions import fingerprint
from panelwright.session import materialized, shared_dir

FLOW_SCHEMA = T.StructType(
    [
        T.StructField("i", T.IntegerType()),
        T.StructField("j", T.IntegerType()),
        T.StructField("k", T.StringType()),
        T.StructField("v", T.DoubleType()),
        T.StructField("q", T.DoubleType()),
        T.StructField("t", T.IntegerType()),
    ]
)


def fresh_path(spark: SparkSession, name: str) -> str:
    return shared_dir(spark, f"{name}-{uuid.uuid4().hex}")


def write_flow_archive(flows: DataFrame, path: str) -> None:
    """One folder per year, with a header; the product code stays text."""
    flows.select("i", "j", "k", "v", "q", "t").write.mode("overwrite").partitionBy("t").option("header", True).csv(path)


def read_flow_archive(spark: SparkSession, path: str) -> DataFrame:
    """Declared schema, never inferred: inference would drop the leading zero of the product code."""
    return spark.read.schema(FLOW_SCHEMA).option("header", True).csv(path)


def edge_audit(edges: DataFrame) -> DataFrame:
    """Rows, total and content fingerprint of every year."""
    cells = ["country_code", "partner_code", "hs2", F.round("trade_usd", 4).cast("decimal(24,4)")]
    return fingerprint(edges, cells, ["year"], (F.sum("trade_usd").alias("total_usd"),))


def write_edges(edges: DataFrame, path: str, raw_totals: DataFrame) -> DataFrame:
    """Write the years whose content changed and return the audit table (with ``current``).

    Dynamic overwrite replaces only the partitions present in the written frame, so valid years stay. A year that an earlier run wrote and this
    one has not keeps its rows, and its audit row says that it is not ``current``. The edges are computed once and written to the shared
    folder before they are compared. ``raw_totals`` (year, raw_usd) gives the amount the chapter rule left out.
    """
    spark = edges.sparkSession
    audit_path = f"{path}_audit"
    edges = materialized(edges)
    audit = edge_audit(edges).join(raw_totals, "year", "left").withColumn(
        "excluded_usd", F.col("raw_usd") - F.col("total_usd")
    ).withColumn("current", F.lit(True))
    changed = audit.select("year")
    try:
        known = materialized(spark.read.parquet(audit_path))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    else:
        known = known if "current" in known.columns else known.withColumn("current", F.lit(True))
        changed = audit.join(known, ["year", "fingerprint"], "left_anti").select("year")
        gone = known.join(audit.select("year"), "year", "left_anti").withColumn("current", F.lit(False))
        audit = audit.unionByName(gone)
    dynamic = {"partitionOverwriteMode": "dynamic"}
    # one shuffle by year and country: a hot year is spread over several files
    stale = edges.join(changed, "year", "left_semi").repartition("year", "country_code")
    stale.write.mode("overwrite").options(**dynamic).partitionBy("year").parquet(path)
    audit.write.mode("overwrite").options(**dynamic).partitionBy("year").parquet(audit_path)
    return spark.read.parquet(audit_path)

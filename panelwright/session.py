"""Session settings. Everything size-dependent is left to AQE."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, app: str = "panelwright", **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, *parts: str) -> str:
    """A path below the folder the cluster names in spark.checkpoint.dir.

    Only when the session names none (tests, a laptop) a temporary folder is used, and remembered in
    the session so that every later call agrees.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("panelwright.local.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="panelwright-")
        spark.conf.set("panelwright.local.checkpoint.dir", root)
    return os.path.join(root, *parts) if parts else root


def use_checkpoints(spark: SparkSession) -> None:
    """Point reliable checkpoints at the shared folder before the first ``checkpoint()``."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(spark))


def materialized(frame: DataFrame) -> DataFrame:
    """Reliable checkpoint of a table that several branches of a query read.

    The feature table is small next to the flows it is made of; writing it once keeps the branches from
    recomputing the flows and survives the loss of any executor.
    """
    use_checkpoints(frame.sparkSession)
    return frame.checkpoint()

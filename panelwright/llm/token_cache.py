"""Token counts of report texts from a digest cache: only texts that no earlier run has counted are encoded."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import encode_bytes, near_ids, text_of

CACHE_SCHEMA = "digest binary, tokenizer string, n_bytes long, n_tokens long"


def tokenizer_digest(path: str) -> str:
    """Version of a tokenizer: the digest of its file."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def _counts(path: str, version: str):
    def count(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([version] * len(texts)), pa.array([len(t.encode()) for t in texts], pa.int64()),
                 pa.array([len(encode_bytes(t, path)) for t in texts], pa.int64())],
                names=["digest", "tokenizer", "n_bytes", "n_tokens"])

    return count


def token_counts(reports: DataFrame, cache: str, tokenizer: str, limit: int = 1024, report_id: str = "report_id",
                 text: str = "text") -> DataFrame:
    """(report_id, n_bytes, n_tokens, over_limit) of every row of ``reports``; new counts are appended to ``cache``.

    ``cache`` is a folder that all executors reach, with rows (digest, tokenizer, n_bytes, n_tokens); it is made by the
    first run. Content is normalised by reading null as empty, and by nothing else, since any other change could change a
    count. The key is the SHA-256 of the content together with the digest of the tokenizer file ``tokenizer``. Each
    distinct missing text is encoded once, where it lies; copies take the stored count. Special strings in a text are
    encoded as the library does by default. A row repeated with its id may be encoded and stored again. ``over_limit`` is n_tokens > ``limit``. Rows without an id are left out,
    repeated rows repeated; an empty table gives an empty result. If two runs append the same digest at once, its equal
    counts are read as one.

    Shuffles: a digest and an id per text. A text moves only if its id shares one of 2**20 buckets with a copy.
    """
    spark = reports.sparkSession
    version = tokenizer_digest(tokenizer)
    rows = reports.select(F.col(report_id).alias("report_id"), text_of(text).alias("text")).where("report_id IS NOT NULL")
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))

    def stored() -> DataFrame:
        known = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == version)
        return known.groupBy("digest").agg(F.max("n_bytes").alias("n_bytes"), F.max("n_tokens").alias("n_tokens"))

    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache)
    first = rows.groupBy("digest").agg(F.min("report_id").alias("report_id"))
    wanted = first.join(stored(), "digest", "left_anti").select("report_id", "digest")
    keys = rows.select("report_id", "digest")
    others = keys.join(wanted, ["report_id", "digest"], "left_anti").select("report_id")
    may = near_ids(rows, "report_id", wanted.select("report_id"))
    alone = near_ids(may, "report_id", others, keep=False)
    mixed = near_ids(may, "report_id", others).join(wanted, ["report_id", "digest"], "left_semi")
    misses = alone.select("digest", "text").unionByName(mixed.select("digest", "text"))
    misses.mapInArrow(_counts(tokenizer, version), CACHE_SCHEMA).write.mode("append").parquet(cache)
    return keys.join(stored(), "digest").select(
        "report_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

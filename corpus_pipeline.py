"""From raw documents to packed training sequences: each stage calls one corpus operator and keeps what it accepts.

Every stage but the last returns the columns of ``documents``; rows without a doc_id pass the filters and are left out by
the packing. An empty table passes every stage as an empty table; null texts are dropped by the language stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelwright.llm import co_training, exact_copies, language_codes, packing, shingle_join
from panelwright.llm.common import near_ids, staged, tokenizer_path, without
from panelwright.llm.queries import WORD_VOCABULARY, reports


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts."""
    labels = reports(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    judged = co_training.co_trained_quality(reports(docs), labels)
    return without(docs, "doc_id", staged(judged.where("NOT kept").select("report_id"), "rejected"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; 'und' goes, an ambiguous one stays."""
    found = language_codes.languages(reports(docs))
    return without(docs, "doc_id", staged(found.where("lang_pred = 'und'").select("report_id"), "rejected"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of equal texts: that of the largest doc_id, once even if its row is repeated."""
    copies = exact_copies.exact_copies(reports(docs))
    rest = without(docs, "doc_id", copies.where("NOT kept").select("report_id"))
    repeated = copies.groupBy("report_id").count().where("count > 1").select("report_id")
    return near_ids(rest, "doc_id", repeated, keep=False).unionByName(near_ids(rest, "doc_id", repeated).dropDuplicates(["doc_id", "text"]))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts: that of the smallest doc_id."""
    groups = shingle_join.shingle_components(reports(docs))
    return without(docs, "doc_id", staged(groups.where("report_id <> component_id").select("report_id"), "rejected"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents in sequences of at most 4096 tokens."""
    return packing.packed(reports(docs), tokenizer_path(WORD_VOCABULARY)).withColumnRenamed("report_id", "doc_id")


STAGES = [("quality classifier", quality), ("language ID", language), ("exact dedup", exact_dedup), ("n-gram Jaccard join", near_dedup), ("packing", pack)]

#: SQL can't express the trained classifiers; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result is written to the shared folder and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs

"""The numbered queries: each maps a given table to its operator's report records and the result back."""

from __future__ import annotations

import string
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm import (
    article_text, co_training, collocations, exact_copies, hard_negatives, language_codes, language_model, near_vectors, packing, shingle_join, token_archive,
    token_cache, token_codec,
)
from panelwright.llm.common import tokenizer_path
from panelwright.session import shared_dir

BYTE_VOCABULARY, WORD_VOCABULARY = "byte_bpe_50k.json", "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reports(frame: DataFrame) -> DataFrame:
    """Documents as report records: an id, a text, and the page data the documents have; a column of the id's name gives way."""
    return frame.drop("report_id").withColumnRenamed("doc_id", "report_id")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings"), 0.95)


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = token_codec.round_trip(reports(table(spark, sf_dir, "documents")), tokenizer_path(BYTE_VOCABULARY))
    return coded.select(F.col("report_id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("text_bytes", 256).alias("decoded_sha256"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_copies.exact_copies(reports(table(spark, sf_dir, "documents"))).withColumnRenamed("report_id", "doc_id")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = reports(table(spark, sf_dir, "labels"))
    return co_training.co_trained_quality(reports(table(spark, sf_dir, "documents")), labels).withColumnRenamed("report_id", "doc_id")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("source_url"), "html")
    return article_text.article_text(pages).withColumnRenamed("source_url", "url")


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.shingle_components(reports(table(spark, sf_dir, "documents"))).withColumnRenamed("report_id", "doc_id")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.text_likelihood(reports(table(spark, sf_dir, "documents"))).withColumnRenamed("report_id", "doc_id")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(reports(table(spark, sf_dir, "documents")), tokenizer_path(WORD_VOCABULARY)).withColumnRenamed("report_id", "doc_id")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # every call starts a cache of its own, so that its figures are those of a first run
    cache = f"{shared_dir(spark)}/llm/token-counts-{uuid.uuid4().hex}"
    return token_cache.token_counts(reports(table(spark, sf_dir, "documents")), cache, tokenizer_path(BYTE_VOCABULARY)).withColumnRenamed("report_id", "doc_id")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = reports(table(spark, sf_dir, "documents"))
    return language_codes.languages(documents).withColumnRenamed("report_id", "doc_id")


def op11_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    # every call writes an archive of its own
    archive = f"{shared_dir(spark)}/llm/archive-{uuid.uuid4().hex}"
    token_archive.write_archive(reports(table(spark, sf_dir, "documents")), archive, tokenizer_path(BYTE_VOCABULARY))
    stored = token_archive.read_archive(spark, archive)
    return stored.select(F.col("report_id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op12_phrase_collocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(reports(table(spark, sf_dir, "documents")))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), outcome.alias("outcome"), F.col("embedding").alias("features"))
    return hard_negatives.hard_negatives(vectors, "row_id % 100 = 0")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_embedding_near_dedup, op2_bpe_round_trip, op3_exact_dedup, op4_quality_classifier, op5_html_extraction,
        op6_ngram_jaccard_join, op7_lm_scoring, op8_packing, op9_token_counts, op10_language_id,
        op11_token_output, op12_phrase_collocation, op13_hard_negatives)
}

ORACLES: dict[str, str] = {
    "op1_embedding_near_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL),
w AS (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM w a JOIN w b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)) >= 0.95),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a), c AS (SELECT a, min(b) AS m FROM r GROUP BY a)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM v LEFT JOIN n ON vec_id = n.a LEFT JOIN c ON vec_id = c.a""",
    "op3_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WHERE doc_id IS NOT NULL WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op6_ngram_jaccard_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\\x20\\x09-\\x0D]+') AS w
                     FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
k AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
l AS (SELECT a, b FROM k UNION SELECT b, a FROM k),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS m FROM r GROUP BY 1)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id
FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN m ON w.doc_id = m.a""",
    "op12_phrase_collocation": f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
o AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT lang, 1 AS size, w[i] AS phrase FROM o UNION ALL SELECT lang, 2, w[i] || ' ' || w[i + 1] FROM o WHERE i + 1 <= len(w)
      UNION ALL SELECT lang, 3, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM o WHERE i + 2 <= len(w)),
f AS MATERIALIZED (SELECT lang, size, phrase, lang || chr(9) || phrase AS key, count(*) AS c FROM g GROUP BY ALL),
c AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND c >= 10),
i AS (SELECT lang, phrase, c, w, unnest(range(1, size)) AS k FROM c),
k AS MATERIALIZED (SELECT *, lang || chr(9) || array_to_string(w[1:k], ' ') AS head, lang || chr(9) || array_to_string(w[k + 1:], ' ') AS tail FROM i),
h AS MATERIALIZED (SELECT key, c FROM f WHERE c >= 10),
s AS (SELECT k.lang, k.phrase, k.c AS a, x.c AS l, y.c AS r, k.k, (1000000::HUGEINT * k.c * k.c) // (x.c::HUGEINT * y.c) AS score
      FROM k JOIN h x ON x.key = k.head JOIN h y ON y.key = k.tail),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
t AS (SELECT lang, phrase, max(c) AS c FROM (SELECT lang, w[1] || ' ' || w[2] AS phrase, c FROM c WHERE size = 3 UNION ALL SELECT lang, w[2] || ' ' || w[3], c FROM c WHERE size = 3) GROUP BY ALL),
d AS (SELECT b.* FROM b LEFT JOIN t ON b.lang = t.lang AND b.phrase = t.phrase WHERE t.c IS NULL OR 100 * t.c < 50 * b.a),
z AS (SELECT lang, sum(c) AS n FROM f WHERE size = 1 GROUP BY 1),
e AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM d)
SELECT e.lang, rank, phrase, a, l, r, CAST(z.n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM e JOIN z ON e.lang = z.lang WHERE rank <= 2000""",
    "op13_hard_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL),
f AS (SELECT DISTINCT vec_id, label, list_transform(e, lambda x: floor(256 * x)) AS q FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
      FROM f a JOIN f b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""",
}

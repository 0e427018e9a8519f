"""The queries of this subpackage, one for each operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import digest, language_id, line_dedup, mixing, ngram_lm, packing, quality, simhash, token_counts, topk_search
from .common import fold
from .paths import tokenizer


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_docs(spark, sf_dir), tokenizer("piece_bpe_32k.model"), limit=4096)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    model = ngram_lm.fit(docs.where(fold("doc_id", 5) != 1))
    said = ngram_lm.score(docs, model)
    return said.withColumn("held_out", fold("doc_id", 5) == 1).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.duplicate_lines(_docs(spark, sf_dir), edits=2, min_chars=24, equal_chars=1)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    model = language_id.fit(docs, fold("doc_id", 3) != 1, sample=2400)
    said = language_id.predict(docs, model)
    return said.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op5_exact_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk_search.top_k(vectors, vectors.where("vec_id % 20 = 0"), k=20, scale=64.0)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    net = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), fold("doc_id", 3) != 1, sample=2000)
    return quality.predict(docs, net).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.fingerprints(_docs(spark, sf_dir))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_docs(spark, sf_dir), tokenizer("word_bpe_49k.json"), capacity=2048, end_id=0)


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_docs(spark, sf_dir), words=3, max_bits=2)


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_docs(spark, sf_dir), weights=(1, 2, 3), most=3.0)


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_lm_scoring, op3_line_dedup, op4_language_id, op5_exact_topk_search, op6_quality_classifier, op7_best_fit_packing, op8_simhash_near_dedup, op9_source_mixing, op10_document_fingerprints)}

#: Queries that SQL can express over whole tables.
ORACLE_SQL: dict[str, str] = {
    "op5_exact_topk_search": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
) SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
}

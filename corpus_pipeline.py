"""A corpus pipeline over documents: language ID, line dedup, near-dedup, mixing, packing.

Each stage works on all that the one before kept, written as Parquet between them, and all but the last return the
columns of documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from confab.llm import language_id, line_dedup, mixing, packing, simhash
from confab.llm.common import fold, remove, shared_folder
from confab.llm.paths import tokenizer

#: A prediction below this is no language that the model knows. Odd texts of a known language score above it.
LEAST_SCORE = 0.3
#: Texts of a learned language share nearly all their n-grams with it (0.9 or more); another language, or junk, mostly fewer.
LEAST_KNOWN = 0.88


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has letters and a language that the model stands by; it learns from two thirds of them."""
    model = language_id.fit(docs, fold("doc_id", 3) != 1, sample=2400)
    return language_id.select_rows(docs, model, LEAST_SCORE, LEAST_KNOWN)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines but their first occurrence go, and rows that they leave empty; n_chars follows the text."""
    out = line_dedup.remove_lines(docs, edits=2, min_chars=24, equal_chars=1)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes).get("n_chars", "bigint")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that with the smallest id."""
    return simhash.keep_first(docs, words=3, max_bits=2)


def sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as its share of the mix: rows that the mix takes nothing of go, others repeat."""
    return mixing.sample_rows(docs, weights=(1, 2, 3), most=3.0)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows in sequences of 2048 tokens."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"), capacity=2048, end_id=0)


STAGES = [("language_id", language), ("line_dedup", lines), ("simhash_near_dedup", near_duplicates), ("source_mixing", sources), ("best_fit_packing", pack)]

#: SQL can express neither the language model nor the edit join; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the last one's rows.

    What a stage hands on is written to the shared folder, and goes once the next one's is; the last such table stays for
    the result, which is read from it. Null texts and texts without letters don't pass the first stage; repeated rows are
    near copies, of which one stays; very long texts go whole through every stage; columns of any name are handed on; an
    empty table gives no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, before = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = f"{folder}/{k}-{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            remove(spark, before)
        before = path
    return docs

"""A training corpus from ``documents`` in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept;
all but the last return the columns of ``documents``.  Classifiers learn from the
stage's own input by the splits of their queries, on bounded samples.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import language_id, near_dup, packing, quality, secret_scan
from siltstone.llm._runtime import crc32_bucket, materialize, table

#: Least quality score and least language score of a document that stays.
LEAST_QUALITY, LEAST_LANGUAGE = 0.3, 0.3


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for quality 1; learned from labels outside the held-out fold."""
    labels = table(spark, sf_dir, "labels").where(crc32_bucket("doc_id", 5) != 0)
    return quality.keep_quality(docs, quality.fit(docs, labels), LEAST_QUALITY)


def language_identification(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the filters recognise."""
    model = language_id.fit(docs.where(crc32_bucket("doc_id", 3) != 1))
    return language_id.keep_identified(docs, model, LEAST_LANGUAGE)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more."""
    return near_dup.drop_near_duplicates(docs, width=5, percent=80)


def secret_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark for each secret; n_chars follows the text."""
    marked = secret_scan.redact_secrets(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return marked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("bigint")))


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4,096 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), most=4096, end_id=2)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("language_identification", language_identification),
    ("near_deduplication", near_deduplication),
    ("secret_removal", secret_removal),
    ("sequence_packing", sequence_packing),
]

#: No SQL expresses trained classifiers or a tokenizer library; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

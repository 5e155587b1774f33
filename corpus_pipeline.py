"""A corpus from raw documents to packed sequences: quality rules, toxicity, exact copies, near copies, packing.

Defined results, for every stage: null texts are empty ones; extra columns of any name pass through all stages but the
last; empty tables give empty ones, and without labels nothing is learned and nothing rejected by it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import exact_dedup, jaccard, packing, rules, toxicity
from graphloom.session import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned decision list keep; repeated rows alike. Empty texts go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return rules.passing(docs, rules.fit_rules(docs, labels))


def non_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold; repeated rows alike."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.clean_documents(docs, toxicity.fit_toxicity(docs, labels))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text: that of the largest doc_id, null being the smallest, any one of rows that tie."""
    return exact_dedup.distinct_documents(docs)


def distinct_contents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more. The smallest doc_id
    stays, with all rows that repeat it; rows without doc_id and texts without words stay."""
    return jaccard.one_of_each(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens; repeated rows are documents of their own."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality),
    ("toxicity", non_toxic),
    ("exact_dedup", distinct_texts),
    ("ngram_jaccard_join", distinct_contents),
    ("packing", packed),
]

#: Learned models, similarity classes and tokenizers can't be written as SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents, each written before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

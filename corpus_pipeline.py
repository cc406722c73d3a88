"""The corpus pipeline: five stages over ``documents``, each one operator of chromaflow.llm.

Each stage reads what its predecessor wrote and returns the columns of documents; the
last returns, for every document of the mixture, its id and its encoded form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chromaflow.llm import bpe, jaccard_join, mixing, repetition, substring_dedup
from chromaflow.llm.common import materialise, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules reject go."""
    return repetition.quality_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shingles of five words at a similarity of 0.8 or more, that of the smallest id stays."""
    return jaccard_join.keep_one(docs, match=80, size=5)


def substring_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that also start earlier go; documents stay, with what is left of them."""
    return substring_dedup.strip_repeats(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mixture takes it."""
    return mixing.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document, encoded and decoded."""
    return bpe.encode_decode_digests(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("substring_repeats", substring_repeats),
    ("source_mix", source_mix),
    ("token_ids", token_ids),
]

#: SQL cannot express the recompression, the mixture or the encoding; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

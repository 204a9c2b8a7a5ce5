"""From raw documents to packed training sequences, in five stages.

Quality rules drop poor documents, near-duplicates keep one document of each group, passages that
occur earlier are cut out, sources are mixed to their target weights, and what is left is packed.
A stage's rows are written as Parquet and read back before the next one, which therefore starts
from storage if executors are lost.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from seektrail.llm import mixing, near_duplicates, packing, quality_rules, suffix_dedup
from seektrail.plans.hot import shared_dir
from seektrail.sources.tables import read_table

# Overlap of word shingles from which documents are near-duplicates; op9 by itself takes 85.
NEAR_PERCENT = 80


def reject_outliers(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules of their language and source."""
    return quality_rules.drop_outliers(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest doc_id.

    Near-duplicates overlap by `NEAR_PERCENT` of their word shingles or more."""
    return near_duplicates.drop_near_duplicates(docs, NEAR_PERCENT)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of 100 bytes or more that occur earlier."""
    return suffix_dedup.remove_repeated(docs)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in whole or in part."""
    return mixing.take(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", reject_outliers),
    ("near_duplicates", drop_near_duplicates),
    ("suffix_dedup", cut_repeated_passages),
    ("mix_sources", mix_to_weights),
    ("best_fit_packing", pack_sequences),
]

# The stages shingle, sort suffixes and encode with a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of `documents`."""
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline_{uuid4().hex}"
    for name, stage in STAGES:
        result = stage(spark, docs, sf_dir)
        path = f"{folder}/{name}"
        result.write.parquet(path)
        docs = spark.read.schema(result.schema).parquet(path)
    return docs

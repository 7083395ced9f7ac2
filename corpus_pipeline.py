"""The corpus pipeline: civil documents, one of each near copy, sanitised, packed into sequences.

Defined results, stage by stage: a null text counts as empty, is civil, and is a
copy of any other text without words; a null doc_id stays in every stage; rows that
share a doc_id but not a text are documents of their own, equal rows are one to the near-copy stage and rows of their own to the
others; texts of any length are read in whole; an empty table gives no rows; columns
beyond doc_id and text, whatever their names, go through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserae.llm import packing, pii, simhash, toxicity
from tesserae.llm.common import settle, small_batches
from tesserae.llm.queries import BYTE_BPE, BYTE_RANKS


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects."""
    small_batches(spark)
    model = toxicity.train(docs, toxicity.learnable(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return toxicity.keep_civil(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near copies."""
    small_batches(spark)
    return simhash.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data, and the terms that give it away, by their kind."""
    small_batches(spark)
    return pii.sanitise(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of 2048 tokens."""
    small_batches(spark)
    return packing.pack(docs, BYTE_BPE, BYTE_RANKS)


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash_near_dedup", near_duplicates),
    ("pii", personal_data),
    ("best_fit_packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each on what the one before it wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: A kernel machine and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None

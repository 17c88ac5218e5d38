"""A corpus cleaning pipeline: each stage applies one operator to all that its predecessor kept.

Toxic documents go, repeated lines go from the texts, one document of each near-duplicate group stays,
documents with benchmark passages go, and what is left is encoded. Stages pass Parquet to each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm import decontaminate, line_dedup, ngram_join, toxicity
from panelforge.llm.common import materialize
from panelforge.llm.queries import encoded_digests, table, toxicity_train_rows


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon, learned from the labelled documents, doesn't reject."""
    lexicon = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "toxic", toxicity_train_rows())
    return toxicity.reject(docs, lexicon)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that repeat an earlier line (nearly); n_chars follows the text."""
    return line_dedup.deduplicate(docs).withColumn("n_chars", F.length("text").cast("bigint"))


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest doc_id) of each near-duplicate group."""
    return ngram_join.keep_one(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and decoded texts."""
    return encoded_digests(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("ngram_join", ngram_join_stage),
    ("decontaminate", decontaminate_stage),
    ("byte_bpe", encode_stage),
]

#: Learned, fuzzy and tokenising stages have no SQL. Tests hold the rows of the whole pipeline against plain Python
#: versions of its stages, on planted and given documents.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

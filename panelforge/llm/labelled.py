"""Bounded samples of labelled rows for the learned operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold_of(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; null ids have none."""
    return F.crc32(doc_id.cast("string")) % mod


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, max_rows: int, train: Column | None = None) -> DataFrame:
    """(doc_id, text, label int) of at most max_rows labelled documents, chosen by hash of doc_id; one row per doc_id.

    train filters the labels by their doc_id column before the choice. The choice is the same on any
    partitioning. Only the chosen ids (at most max_rows) are broadcast, and only the chosen documents are shuffled.
    Rows with a null id, label or no document are left out; a null text counts as empty; of several labels of one id
    the largest counts, of several texts the least.
    """
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    if train is not None:
        ids = ids.where(train)
    ids = ids.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    found = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")

"""A bounded, deterministic sample of labelled documents for fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinstone.llm.common import held_out


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, text, y): at most `most` labelled documents outside the evaluation fold.

    The sample is the `most` ids of smallest hash, so it doesn't depend on
    partitioning.  A document labelled twice takes the larger label.  The id
    list has at most `most` rows of 16 bytes: that bound is what lets it be
    broadcast.  Rows that repeat a sampled id all count, until the caller's limit
    of `most` rows, taken in the order of the ids' hashes.
    """
    ids = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id")

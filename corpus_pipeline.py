"""The corpus pipeline: stages over the documents table, each one operator.

All stages but the last return the columns they were given, others than those
of documents too.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinstone.llm import decontamination, near_dedup, packing, pii, toxicity
from veinstone.llm.common import materialize, read_table

#: The least similarity of near copies, in hundredths.
NEAR_PERCENT = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores under 0.5 stay.

    Null and empty texts get the score of the bias, so they stay unless most
    labels are toxic.  Equal rows are judged alike.
    """
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one of smallest id.

    Near are texts whose sets of five-word shingles have similarity 0.8 or more (op9's own query takes 0.85).
    Rows without an id stay only if no other row of their group has one.  Where
    ids repeat, the texts decide: equal rows become one, and near copies of one
    id leave one.  Texts without words, null ones too, are in no group and stay.
    """
    gone, repeats = near_dedup.superseded(docs, NEAR_PERCENT)
    gone = materialize(gone.select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")), "superseded")
    sent = F.broadcast(gone) if gone.count() <= near_dedup.MOST_SENT else gone
    mine = F.xxhash64(docs["text"])
    out = docs.join(sent, docs["doc_id"].eqNullSafe(sent["gone_id"]) & (mine == sent["gone_hash"]), "left_anti")
    if not repeats:
        return out
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return out.where(worded).dropDuplicates(["doc_id", "text"]).unionByName(out.where(~worded))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage stay; null and empty texts hold none, equal rows are judged alike."""
    return decontamination.keep_clean(docs, read_table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes its type's mark; null texts stay null, equal rows stay equal."""
    return pii.redacted(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document with its place in a sequence; null and empty texts are one piece of one token."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("packing", pack_sequences),
]
#: Model scores and tokenizers can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

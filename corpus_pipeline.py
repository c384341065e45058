"""The corpus pipeline: each stage takes (spark, docs, sf_dir) and returns a DataFrame.

Every stage but the last returns the columns of ``documents``; a stage's result is
written as Parquet and read again before the next one. Null texts count as empty, empty
tables pass through, and columns that a stage doesn't know stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from contigua.llm import exact_dedup, minhash, packing, pii, toxicity
from contigua.session import cut, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text (white space apart) one stays."""
    return exact_dedup.keep_exact(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest id stays."""
    return minhash.keep_one(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the text gives way to the name of its kind; n_chars follows."""
    return pii.redact(docs)


def pack_by_length(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per document: its bucket, batch and place."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_copies),
    ("minhash", drop_near_copies),
    ("pii", redact_personal_data),
    ("packing", pack_by_length),
]

#: The classifier, the language model and the signatures have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

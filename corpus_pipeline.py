"""Corpus pipeline: documents -> identified, deduplicated, decontaminated,
sanitised and mixed documents.

Each stage takes the Parquet table that its predecessor left and works on all
of it. The first four return the columns of ``documents``; the last adds the
place of each row in the mixture and lays the rows out in that order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewise.llm import decontaminate, langid, mixing, pii, simhash
from pagewise.llm.common import bounded_batches, is_held_out, read
from pagewise.session import cut_lineage


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language can be told (op 6): rows without a letter, or with
    no language that covers its least share of the words, go."""
    bounded_batches(spark)
    return langid.keep_identified(docs, langid.fit(docs, ~is_held_out(F.col("doc_id"), 4, 2)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near duplicates (op 7)."""
    bounded_batches(spark)
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that contain no item of ``benchmark`` (op 2)."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def sanitisation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, their texts without personal data and the terms that reveal it (op 1)."""
    bounded_batches(spark)
    return pii.sanitise(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, interleaved to the target weights of their sources (op 4)."""
    return mixing.interleaved(docs)


STAGES = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("sanitisation", sanitisation),
    ("mixture", mixture),
]

ORACLE_SQL = None  # the first stage is a trained sequence model


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Corpus cleaning: the stages in order, each over all that its predecessor kept.

A stage takes (spark, docs, sf_dir). All but the last return the columns of documents; the last adds
the encoded text. None of the stages' models can be written in SQL, so there is no SQL for the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from assayframe.llm import classifiers, common, decontaminate, near_copies, pieces, pii
from assayframe.llm.queries import MODEL


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return classifiers.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies stays: SimHash links, and 5-word shingles of similarity 0.8.

    Null texts are empty ones, and those are one group; null doc_ids are documents like any other; rows equal in doc_id and text are one.
    """
    return near_copies.keep_one(docs, share=0.8, shingle=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, and terms that reveal it, give way to their kind."""
    return pii.sanitise(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each text, their number, and whether they decode to the same text."""
    return pieces.encode(docs, MODEL)


STAGES = [
    ("quality classifier", quality),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("pii", privacy),
    ("sentencepiece", encoding),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = common.store(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs

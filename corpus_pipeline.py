"""From raw documents to token ids: STAGES in order, each reading what its predecessor kept.

Rows of every kind pass the stages or are taken out by their rule: a null or empty text is scored by the quality model as one without words, is one text
to exact dedup, and has no near copies, leaks or tokens. A null doc_id ranks last in exact dedup; near dedup keeps its row. Of
documents that tie, the least doc_id stays; of rows alike in doc_id and text, one. Empty tables give empty tables. Extra columns come through
all stages but the last, whatever their names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lumenpair.llm import benchmark, bpe, exact_dedup, near_dedup, quality
from lumenpair.llm._spark import forget, shared_folder, table
from lumenpair.shipping import ship


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model keeps."""
    ship(spark)
    return quality.keep(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each distinct text."""
    ship(spark)
    return exact_dedup.dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    ship(spark)
    return near_dedup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of test items."""
    ship(spark)
    return benchmark.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left."""
    ship(spark)
    return bpe.encode(docs)


STAGES = [("quality", classify), ("exact_dedup", deduplicate), ("near_dedup", near), ("decontamination", decontaminate), ("bpe", tokenize)]

#: The quality model is trained, alignments are scored and bytes are merged: no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents. What a stage returns is written as Parquet in the shared folder, and read again by the next; then the one before goes. The
    last that was written stays for the rows that are returned."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
        if 0 < k < len(STAGES) - 1:
            forget(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs

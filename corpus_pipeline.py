"""The corpus pipeline: five stages over documents, each one operator of plumbline.llm.

1. quality classifier: documents that the line field rejects go;
2. MinHash near-dedup: of each group of near duplicates the smallest id stays;
3. benchmark decontamination: documents in which an item leaks go;
4. PII: confirmed spans are replaced by their kinds;
5. byte-level BPE: every text that is left is encoded and decoded; the documents
   come out with their ids and digests.

Every stage works on all its predecessor kept. Rows with null ids, null or empty
texts, repeated rows and further columns pass through as the operators say; an
empty table stays empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import bpe, decontaminate, near_dedup, pii, quality
from plumbline.llm.tables import read, shared_folder, small_batches


def good_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return near_dedup.keep_one(docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return pii.redact(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return bpe.tokenized(docs)


STAGES = [
    ("quality classifier", good_lines),
    ("MinHash near-dedup", one_of_each),
    ("benchmark decontamination", without_benchmarks),
    ("PII", without_personal_data),
    ("byte-level BPE", encoded),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again by the next."""
    docs, folder = read(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs

"""Corpus pipeline: five operators of ``ledgerspark.llm`` one after the other.

STAGES lists (name, function).  A function takes the session, the documents
that its predecessor kept and the folder of the tables, and returns a frame;
all but the last return the columns of documents.  ``run`` applies them to
``documents``; each stage is written as Parquet to the shared scratch folder
and read again, so a lost executor costs one stage's tasks at most.

1. quality classifier: documents that it rejects go;
2. near-duplicates: one document of each group stays;
3. secrets: each span is replaced by a mask;
4. mixing: documents are repeated or left out to meet the source weights;
5. byte-level BPE: one row of token ids for each document taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerspark.llm import bpe, mixing, near_dup, quality, secret_scan
from ledgerspark.llm.docs import materialize, read_table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_one(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeat(docs)


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # the executors' heap is full of earlier stages: small workers
    return bpe.encode(docs, with_ids=True, cache_units=100_000, slice_bytes=2 << 20)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", minhash_near_dedup),
    ("secret_scans", secret_scans),
    ("mixing_sources", mixing_sources),
    ("byte_level_bpe", byte_level_bpe),
]

# A trained classifier, hash thresholds and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

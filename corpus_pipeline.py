"""The corpus pipeline: documents to packed training sequences in five written stages.

Toxic documents go, then those that break the quality rules; one document of each near-duplicate group stays; the
rest is mixed to target shares by language (short languages repeat documents, none is lost) and packed.  Every stage
takes all rows that its predecessor wrote; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tabulens.llm.common import BATCH_BYTES, BATCH_SETTING, table
from tabulens.llm.minhash import drop_near_duplicates
from tabulens.llm.mixing import labelled_languages, resample
from tabulens.llm.packing import pack_documents
from tabulens.llm.quality_rules import filter_quality
from tabulens.llm.queries import LANGUAGE_TARGETS
from tabulens.llm.toxicity import drop_toxic
from tabulens.session import checkpoint_dir


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    spark.conf.set(BATCH_SETTING, BATCH_BYTES)        # for good: the texts are scored when the result is written
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that keep to the quality rules."""
    spark.conf.set(BATCH_SETTING, BATCH_BYTES)
    return filter_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target shares ask for."""
    return resample(docs, labelled_languages(docs, table(spark, sf_dir, "labels")), LANGUAGE_TARGETS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 2048 tokens."""
    return pack_documents(docs, capacity=2048)


STAGES = [("toxicity", toxicity), ("quality rules", quality), ("MinHash near-dedup", near_duplicates),
          ("mixing sources to target weights", mixing), ("best-fit packing", packing)]

#: SQL cannot express the learned stages; tests/llm holds the pipeline against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    base = f"{checkpoint_dir(spark).rstrip('/')}/pipeline/{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        path = f"{base}/{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

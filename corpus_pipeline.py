"""From raw documents to packed training sequences: five stages, each an operator of kosha.llm at work.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from kosha.llm.common import Scratch
from kosha.llm.packing import VOCABULARY, packed_documents
from kosha.llm.quality import keep_fluent
from kosha.llm.secrets import redact
from kosha.llm.simhash import drop_near_copies
from kosha.llm.toxicity import keep_civil, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return keep_civil(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model rejects go."""
    return keep_fluent(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return drop_near_copies(docs, words=5, similarity=0.8)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Findings of the secret scan are masked in the texts."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their ids and their places in sequences."""
    return packed_documents(docs, public_tokenizers.path(VOCABULARY), with_ids=True)


STAGES = [("toxicity", toxicity), ("quality", quality), ("near_dedup", near_dedup), ("secrets", secrets), ("packing", packing)]

#: A language model, fingerprints and a tokenizer are beyond SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return docs

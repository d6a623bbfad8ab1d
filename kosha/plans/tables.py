"""Shortcuts of the query modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, page, text): lines of documents stand in for pages."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("pos", "text")).select(
        "doc_id", "source", (F.col("pos") + 1).alias("page"), "text"
    )


LINES = "(SELECT doc_id, source, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS page, unnest(string_split(text, chr(10))) AS text FROM documents)"

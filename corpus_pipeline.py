"""The corpus pipeline: five stages over documents, each written as Parquet and reread as the next one's input.

Every stage works on all rows that its predecessor kept. Only `mix` adds columns: size, taken (words the mix takes) and target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphlake.llm import decontaminate, exact_dedup, jaccard, mixing, quality
from glyphlake.llm.common import scratch, table


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs less those of ids (doc_id), the fewer side; a null doc_id stays."""
    return docs.join(ids.select(F.col("doc_id").alias("_gone")), F.col("doc_id") == F.col("_gone"), "left_anti")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def no_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.unique(docs)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without(docs, jaccard.join(docs, percent=80, words=5).filter("doc_id != component_id"))


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


STAGES = [("quality classifier", good_quality), ("exact dedup", no_copies), ("n-gram Jaccard join", no_near_copies), ("benchmark decontamination", no_benchmark), ("mixing to target weights", mixed)]

#: A trained classifier and edit distances aren't expressed in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

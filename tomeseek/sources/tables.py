"""Readers for the input tables; schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeseek import schemas


def _read(spark: SparkSession, folder: str, name: str, ddl: str) -> DataFrame:
    return schemas.require(spark.read.parquet(f"{folder}/{name}.parquet"), ddl, name)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "documents", schemas.DOCUMENTS)


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "pages", schemas.PAGES)


def labels(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "labels", schemas.LABELS)


def conversations(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "conversations", schemas.CONVERSATIONS)


def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder, "embeddings", schemas.EMBEDDINGS)


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """The benchmark texts as a batch of queries."""
    items = _read(spark, folder, "benchmark", schemas.BENCHMARK)
    return items.select(F.col("item_id").alias("query_id"), "text")

"""Queries of the text and vector operators, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from heliograph.llm import bpe, garbled, packing, similar


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return similar.similar_pairs(spark.read.parquet(f"{d}/challenge_data.parquet"))


def p1_clusters(spark: SparkSession, d: str) -> DataFrame:
    return similar.clusters(spark.read.parquet(f"{d}/challenge_data.parquet"), least=1)


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(spark.read.parquet(f"{d}/documents.parquet"), keep=["doc_id"])


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.containers(spark.read.parquet(f"{d}/documents.parquet"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(p7_containers(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return garbled.found(spark.read.parquet(f"{d}/documents.parquet"))


def p8_restored(spark: SparkSession, d: str) -> DataFrame:
    return garbled.restore(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")).where("garbled").drop("garbled")


QUERIES = {f.__name__: f for f in (p1_found, p1_clusters, p6_ids, p7_containers, p7_fill, p8_found, p8_restored)}
SQL: dict[str, str] = {}

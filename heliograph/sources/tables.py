"""Declared schemas and readers of the engine's tables (nothing is inferred)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCKS = T.StructType([T.StructField("idx", T.LongType()), T.StructField("block", T.LongType())])
CHALLENGE_DATA = T.StructType(
    [
        T.StructField("ticker", T.StringType()),
        T.StructField("sidx", T.LongType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("price_data", T.StringType()),
        T.StructField("hotkeys", T.StringType()),
        T.StructField("embeddings", T.BinaryType()),
        T.StructField("ts", T.LongType()),
    ]
)
RAW_PAYLOADS = T.StructType(
    [
        T.StructField("ts", T.LongType()),
        T.StructField("hotkey", T.StringType()),
        T.StructField("payload", T.StringType()),
        T.StructField("feed", T.StringType()),
        T.StructField("file_no", T.LongType()),
    ]
)
BREAKOUT_STATE = T.StructType(
    [T.StructField("asset", T.StringType()), T.StructField("state_json", T.StringType()), T.StructField("ts", T.LongType())]
)
CHALLENGE_META = T.StructType(
    [
        T.StructField("ticker", T.StringType()),
        T.StructField("dim", T.IntegerType()),
        T.StructField("blocks_ahead", T.IntegerType()),
        T.StructField("release_no", T.IntegerType()),
    ]
)
SCHEMAS = {
    "blocks": BLOCKS,
    "challenge_data": CHALLENGE_DATA,
    "raw_payloads": RAW_PAYLOADS,
    "breakout_state": BREAKOUT_STATE,
    "challenge_meta": CHALLENGE_META,
}


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of ``folder``; declared schemas are applied where one exists."""
    reader = spark.read
    if name in SCHEMAS:
        reader = reader.schema(SCHEMAS[name])
    return reader.parquet(f"{folder}/{name}.parquet")


def minute_of_block(block: F.Column) -> F.Column:
    """One minute holds five blocks; floor division, also below zero."""
    return F.floor(block / F.lit(5)).cast("long")

"""Streams of landed rows: sampling, maturation, keyed late upserts, atomic steps, event-time windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from heliograph.operators import ingest


def read_landing(spark: SparkSession, folder: str, schema: T.StructType, fmt: str = "json", files_per_batch: int = 100) -> DataFrame:
    """Files of a landing folder as a stream with a declared schema."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(folder)


def sampled(blocks: DataFrame, every: int = 5) -> DataFrame:
    """Only blocks on the sampling grid."""
    return blocks.where(F.col("block") % every == 0)


def event_time(df: DataFrame, column: str, delay: str) -> DataFrame:
    """Watermark on a TIMESTAMP (a TIMESTAMP_NTZ column is cast first)."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def hourly(df: DataFrame, at: str, group: list[str], value: str, delay: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Event-time windows with late rows up to ``delay``."""
    return event_time(df, at, delay).groupBy(F.window(at, width), *group).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def deduplicated(df: DataFrame, keys: list[str], at: str, delay: str) -> DataFrame:
    """Repeated deliveries of a key within the watermark count once."""
    return event_time(df, at, delay).dropDuplicatesWithinWatermark(keys)


def upsert_writer(table: str, keys: list[str], version: str, values: list[str]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: each batch is one atomic append of its own folder, named by batch id.

    Late rows go to their original key and are never dropped: no watermark is
    involved. A repeated batch (after a failure) overwrites its own folder, so
    replays are idempotent; ``read_upserted`` gives the newest row per key.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        ingest.latest(batch, keys, version, values).write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    return write


def read_upserted(spark: SparkSession, table: str, keys: list[str], version: str, values: list[str]) -> DataFrame:
    """The newest row per key over all batches (larger version, then later batch)."""
    rows = spark.read.parquet(table).withColumn("_v", F.struct(version, F.col("batch").alias("_batch")))
    chosen = rows.groupBy(*keys).agg(F.max(F.struct("_v", *values)).alias("_m"))
    return chosen.select(*keys, F.col("_m._v")[version].alias(version), *(F.col("_m")[c].alias(c) for c in values))


def start_upsert(stream: DataFrame, table: str, checkpoint: str, keys: list[str], version: str, values: list[str], trigger: dict | None = None) -> StreamingQuery:
    """The running query; its checkpoint is what a restart continues from."""
    writer = stream.writeStream.foreachBatch(upsert_writer(table, keys, version, values)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def opened_by_round(payloads: DataFrame, signatures: DataFrame) -> DataFrame:
    """Payloads of version 2 beside their round's signature (null where none has come yet); T06: other versions are left out."""
    return payloads.where(F.col("version") == 2).join(signatures, "round", "left")


def settled(payloads: DataFrame, signatures: DataFrame, tries: str = "tries", most: int = 3) -> DataFrame:
    """Rows that are done with: opened ones, and those without a signature after ``most`` tries, ``lost``, whose vectors are zeros; the rest wait for another try."""
    beside = opened_by_round(payloads, signatures)
    return beside.withColumn("lost", F.col("signature").isNull()).where(~F.col("lost") | (F.col(tries) >= most))


def with_defaults(rows: DataFrame, aliases: dict[str, str], numbers: list[str], default: float = 0.0) -> DataFrame:
    """A fetched snapshot: keys under their own or an alias' name, missing or unreadable numbers as ``default``."""
    found = {c: [k for k in (c, *(a for a, to in aliases.items() if to == c)) if k in rows.columns] for c in numbers}
    given = {c: F.coalesce(*(F.col(k).try_cast("double") for k in ks), F.lit(default)) if ks else F.lit(default) for c, ks in found.items()}
    return rows.select(*(c for c in rows.columns if c not in aliases and c not in numbers), *(v.alias(c) for c, v in given.items()))


def clock(spark: SparkSession, per_second: int = 1) -> DataFrame:
    """A clock as a stream: (timestamp, block), one block per row; a restart continues from the checkpoint, so a missed poll is caught up."""
    return spark.readStream.format("rate").option("rowsPerSecond", per_second).load().withColumnRenamed("value", "block")

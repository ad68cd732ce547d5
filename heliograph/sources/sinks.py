"""Writers: partitioned tables, packed vectors, saved weights and breakdown logs."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_partitioned(df: DataFrame, path: str, by: list[str], mode: str = "append") -> None:
    """Parquet partitioned by ``by``; rows of a partition are brought together first, so each is a few large files.

    Large partitions are still split: AQE rebalances by size, not by key alone.
    """
    df.hint("rebalance", *by).write.mode(mode).partitionBy(*by).parquet(path)


def replace_table(df: DataFrame, path: str) -> None:
    """Overwrite."""
    df.write.mode("overwrite").parquet(path)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def half_precision(vectors: pd.Series) -> pd.Series:
    """Values rounded to float16, as they were compared when stored."""
    return vectors.map(lambda v: None if v is None else np.asarray(v, dtype=np.float16).astype(np.float32).tolist())


def packed(rows: DataFrame, group: list[str], hotkey: str, vec: str) -> DataFrame:
    """Per group one blob: JSON list of hotkeys in byte order, a zero byte, float16 row by row."""

    listed = rows.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct(F.col(hotkey).alias("h"), F.col(vec).alias("v")))).alias("l"))
    schema = listed.select(*group).schema.add("embeddings", T.BinaryType())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(group))
            ends = np.diff(lists.offsets.to_numpy()).cumsum()
            flat = lists.flatten()
            names, vectors = flat.field(0).to_pylist(), flat.field(1)
            size = np.diff(vectors.offsets.to_numpy())
            values, at = vectors.flatten().to_numpy(zero_copy_only=False).astype("<f2"), np.concatenate(([0], size.cumsum()))
            blobs, low = [], 0
            for high in ends.tolist():
                if (size[low:high] != size[low]).any():
                    raise ValueError("vectors of one group differ in length")
                blobs.append(json.dumps(names[low:high]).encode() + b"\0" + values[at[low] : at[high]].tobytes())
                low = high
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(group)], pa.array(blobs, pa.binary())], names=[*group, "embeddings"])

    return listed.mapInArrow(pack, schema)


def save_weights(weights: DataFrame, path: str, block: int) -> None:
    """(uid, hotkey, w) appended under its block."""
    weights.withColumn("block", F.lit(block).cast("long")).write.mode("append").partitionBy("block").parquet(path)


def load_weights(spark: SparkSession, path: str) -> DataFrame:
    """The weights of the largest block; the partition filter prunes all other folders."""
    table = spark.read.parquet(path)
    last = table.agg(F.max("block")).first()[0]
    return table.where(F.col("block") == F.lit(last))


def published(weights: DataFrame, w: str = "w") -> DataFrame:
    """Rows with a positive weight."""
    return weights.where(F.col(w) > 0)


def breakdown(df: DataFrame, key: Column, *columns: str) -> DataFrame:
    """One JSON line per key."""
    return df.select(key.alias("key"), F.to_json(F.struct(*columns)).alias("line"))

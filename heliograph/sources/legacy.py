"""Readers of legacy stores: SQLite files as a data source, packed vector blobs as a table function, landed objects."""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.udtf import UserDefinedTableFunction

from heliograph.functions.json_text import allow_repeated_keys, readable
from heliograph.operators.ingest import is_envelope

_TYPES = {"INTEGER": "bigint", "REAL": "double", "TEXT": "string", "BLOB": "binary"}


class _Range(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        self.low, self.high = low, high


class SqliteSource(DataSource):
    """A table of an SQLite file; options path, table, partitions. Partitions are row-id ranges, read in parallel.

    ``spark.dataSource.register(SqliteSource)`` and ``spark.read.format("heliograph-sqlite")``.
    """

    @classmethod
    def name(cls) -> str:
        return "heliograph-sqlite"

    def _connect(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True)

    def schema(self) -> str:
        with self._connect() as c:
            columns = c.execute(f"PRAGMA table_info({self._table()})").fetchall()
        if not columns:
            raise ValueError(f"no table {self.options['table']}")
        return ", ".join(f"`{name}` {_TYPES.get(kind.upper(), 'string')}" for _, name, kind, *_ in columns)

    def _table(self) -> str:
        return '"' + self.options["table"].replace('"', '""') + '"'

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _SqliteReader(self, schema)


class _SqliteReader(DataSourceReader):
    def __init__(self, source: SqliteSource, schema: T.StructType) -> None:
        self.source, self.columns = source, [f.name for f in schema.fields]

    def partitions(self) -> list[_Range]:
        with self.source._connect() as c:
            low, high = c.execute(f"SELECT min(rowid), max(rowid) FROM {self.source._table()}").fetchone()
        if low is None:
            return [_Range(0, 0)]
        n = int(self.source.options.get("partitions", "4"))
        step = max(1, -(-(high - low + 1) // n))
        return [_Range(k, min(k + step, high + 1)) for k in range(low, high + 1, step)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        names = ", ".join('"' + c.replace('"', '""') + '"' for c in self.columns)
        with self.source._connect() as c:
            yield from c.execute(f"SELECT {names} FROM {self.source._table()} WHERE rowid >= ? AND rowid < ?", (partition.low, partition.high))


class BlobRows:
    """Table function (blob, width) -> (hotkey, vec): JSON list of hotkeys, one zero byte, row-major float16; a wrong size has no rows."""

    def eval(self, blob: bytes, width: int) -> Iterator[tuple[str, list[float]]]:
        at = blob.find(b"\0") if blob else -1
        if at < 0:
            return
        try:
            hotkeys = json.loads(bytes(blob[:at]))
        except ValueError:
            return
        if not isinstance(hotkeys, list) or len(blob) - at - 1 != len(hotkeys) * width * 2:
            return
        values = np.frombuffer(bytes(blob), dtype="<f2", offset=at + 1).reshape(len(hotkeys), width).astype(np.float32)
        for hotkey, row in zip(hotkeys, values.tolist(), strict=True):
            yield hotkey, row


def blob_rows() -> UserDefinedTableFunction:
    """The table function; register it with ``spark.udtf.register("blob_rows", blob_rows())`` and call it laterally."""
    return F.udtf(BlobRows, returnType="hotkey string, vec array<float>")


def unpacked(rows: DataFrame, blob: str, width: int) -> DataFrame:
    """S19 for whole tables: all columns but ``blob``, hk and vec, one row per vector.

    Only a blob's header is parsed as text; all vectors of an Arrow batch are
    one buffer, and the other columns follow by ``take``.
    """
    kept = [c for c in rows.columns if c not in (blob, "hk", "vec")]
    schema = rows.select(*kept).schema.add("hk", T.StringType()).add("vec", T.ArrayType(T.FloatType(), False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, names, parts = [], [], []
            for i, raw in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                at = raw.find(b"\0") if raw else -1
                if at < 0:
                    continue
                try:
                    hotkeys = json.loads(raw[:at])
                except ValueError:
                    continue
                if isinstance(hotkeys, list) and len(raw) - at - 1 == len(hotkeys) * width * 2 and all(isinstance(h, str) for h in hotkeys):
                    owner += [i] * len(hotkeys)
                    names += hotkeys
                    parts.append(raw[at + 1 :])
            values = pa.array(np.frombuffer(b"".join(parts), dtype="<f2").astype(np.float32))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(owner) + 1) * width, width, dtype=np.int32)), values)
            index = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(index) for c in range(len(kept))), pa.array(names, pa.string()), lists], names=[*kept, "hk", "vec"])

    return rows.select(*kept, blob).mapInArrow(run, schema)


def landed_objects(spark: SparkSession, folder: str, largest: int = 25 * 1024 * 1024) -> DataFrame:
    """Files of a folder with path, length and content as text; larger ones are rejected by size before their content is read."""
    files = spark.read.format("binaryFile").load(folder)
    return files.where(F.col("length") <= largest).select("path", "length", F.decode("content", "UTF-8").alias("text"))


def landed_envelopes(objects: DataFrame) -> DataFrame:
    """Objects that are complete version 2 envelopes."""
    allow_repeated_keys(objects.sparkSession)
    return objects.withColumn("v", readable("text")).where(is_envelope("v")).drop("v")

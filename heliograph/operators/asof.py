"""Joins in time: exact offset, row offset, nearest with tolerance, onto a grid, and backward as-of.

No operator here ranges over a whole source: offsets are equi-joins, bounded
looks use blocks with a halo, and tolerances are turned into equi-joins on
buckets as wide as the tolerance. ``source`` and ``order`` must be unique
together; rows with a null in either are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliograph.operators.sequence import fill_forward, numbered, with_halo

#: Key units per chunk when rows of a source are counted.
CHUNK = 10_080


def offset_join(df: DataFrame, source: str, order: str, value: str, ahead: int, to: str) -> DataFrame:
    """The value at exactly ``order + ahead`` of the same source, null where that row is absent (gap-safe)."""
    later = df.select(source, (F.col(order) - ahead).alias(order), F.col(value).alias(to))
    return df.join(later, [source, order], "left")


def row_offset(df: DataFrame, source: str, order: str, value: str, ahead: int, to: str, chunk: int = CHUNK, block: int = 20_000) -> DataFrame:
    """The value ``ahead`` rows later in the source (null at its end)."""
    placed = with_halo(numbered(df, source, order, chunk), ahead, max(block, ahead))
    w = Window.partitionBy(source, "block").orderBy("pos")
    return placed.withColumn(to, F.lead(value, ahead).over(w)).where("core").drop("pos", "block", "core")


def nearest_asof(df: DataFrame, source: str, order: str, value: str, ahead: int, tolerance: int | None = None, prefix: str = "at") -> DataFrame:
    """The strictly later row nearest to ``order + ahead`` within the tolerance (15 % of ``ahead`` by default, at least 1).

    Adds ``{prefix}_order`` and ``{prefix}_value``; equal distances take the
    earlier row. Both sides are bucketed by 2·tolerance + 1, so each row meets
    at most two buckets of candidates.
    """
    tol = max(1, int(0.15 * ahead)) if tolerance is None else tolerance
    width = 2 * tol + 1
    target = F.col(order) + ahead
    low, high = F.floor((target - tol) / width), F.floor((target + tol) / width)
    asked = df.withColumn("_bucket", F.explode(F.array_distinct(F.array(low, high))))
    offered = df.select(F.col(source).alias("_source"), F.col(order).alias("_order"), F.col(value).alias("_value"), F.floor(F.col(order) / width).alias("_b"))
    near = (F.col("_source") == F.col(source)) & (F.col("_b") == F.col("_bucket")) & F.col("_order").between(target - tol, target + tol) & (F.col("_order") > F.col(order))
    met = asked.join(offered, near)
    best = met.groupBy(source, order).agg(F.min(F.struct(F.abs(F.col("_order") - target).alias("d"), F.col("_order").alias("o"), F.col("_value").alias("v"))).alias("_best"))
    return df.join(best, [source, order], "left").withColumn(f"{prefix}_order", F.col("_best.o")).withColumn(f"{prefix}_value", F.col("_best.v")).drop("_best")


def grid_asof(df: DataFrame, source: str, order: str, step: int, within: int | None = None) -> DataFrame:
    """Rows that a grid of ``step`` from each source's first row selects: the first row at or after a grid point, at most ``within`` (step // 6) away; each row once.

    A row is the first at or after its grid point exactly if it is the first
    row of its grid interval, so one aggregate per (source, interval) suffices.
    """
    reach = step // 6 if within is None else within
    first = df.groupBy(source).agg(F.min(order).alias("_first"))
    # Rows of interval k lie in [first + k·step, first + (k+1)·step); a later grid point never selects them.
    placed = df.join(first, source).withColumn("_k", F.floor((F.col(order) - F.col("_first")) / step))
    chosen = placed.groupBy(source, "_k", "_first").agg(F.min(order).alias(order))
    chosen = chosen.where(F.col(order) - (F.col("_first") + F.col("_k") * step) <= reach)
    return df.join(chosen.select(source, order, (F.col("_first") + F.col("_k") * step).alias("grid")), [source, order])


def backward_asof(df: DataFrame, source: str, order: str, value: str, refreshed: Column, to: str, chunk: int = CHUNK) -> DataFrame:
    """The value of the latest row (up to the current one) for which ``refreshed`` holds."""
    return fill_forward(df, source, order, F.when(refreshed, F.col(value)), chunk, to)


def segment_join(df: DataFrame, order: str, segments: DataFrame) -> DataFrame:
    """Rows to the walk-forward segments that hold them; the segment table is small (one row per chunk of rows) and broadcast by size."""
    return df.join(segments, (F.col(order) >= F.col("start")) & (F.col(order) < F.col("end")))

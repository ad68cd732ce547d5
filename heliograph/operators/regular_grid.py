"""Irregular readings onto a regular grid of minutes.

As-of merge of the sorted grid with the sorted readings of each source. Every
grid minute takes its neighbours on both sides and, where they are at most
``max_gap`` minutes apart, a time-weighted linear interpolation; otherwise the
minute is marked.

No task holds a whole source: grid and readings are cut into chunks of time.
Windows run inside a chunk; what lies beyond its ends comes from a table with
one row per (source, chunk), the first and last reading of each.

Defined cases: null source, time or value rows are ignored; a repeated
(source, time) keeps the value delivered last; an empty grid gives an empty
result; without any reading all minutes are marked ``missing``; extra columns
are not read, so clashing names cannot occur.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heliograph.operators.prices import PRICE_TICKERS, last_delivery, usable_rows

#: Minutes per chunk of a source.
CHUNK = 2880


def hourly_minutes(blocks: DataFrame) -> DataFrame:
    """Every minute ``sidx`` of each hour in which at least one block exists."""
    hours = blocks.where(F.col("block").isNotNull()).select(F.floor(F.col("block") / 300).cast("long").alias("hour")).distinct()
    return hours.select(F.explode(F.sequence(F.col("hour") * 60, F.col("hour") * 60 + 59)).alias("sidx"))


def regular_minutes(challenge: DataFrame, blocks: DataFrame, tickers: tuple[str, ...] = PRICE_TICKERS, max_gap: int = 30, chunk: int = CHUNK) -> DataFrame:
    """One row per price ticker and grid minute.

    Columns: ticker, sidx, price (observed or interpolated, else null), status
    (``observed``, ``interpolated``, ``gap``: neighbours too far apart,
    ``edge``: neighbour on one side only, ``missing``: none), before_sidx,
    after_sidx.
    """
    grid = hourly_minutes(blocks).select(F.explode(F.array(*map(F.lit, tickers))).alias("ticker"), "sidx", F.lit(None).cast("long").alias("ts"), F.lit(None).cast("double").alias("price"), F.lit(True).alias("wanted"))
    given = usable_rows(challenge, tickers).withColumn("wanted", F.lit(False))
    merged = (
        grid.unionByName(given)
        .groupBy("ticker", F.floor(F.col("sidx") / chunk).cast("long").alias("chunk"), "sidx")
        .agg(last_delivery().alias("price"), F.max("wanted").alias("wanted"))
        .withColumn("at", F.when(F.col("price").isNotNull(), F.struct("sidx", "price")))
    )
    ends = merged.groupBy("ticker", "chunk").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    back = Window.partitionBy("ticker").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    forth = Window.partitionBy("ticker").orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select("ticker", "chunk", F.last("last", True).over(back).alias("from_before"), F.last("first", True).over(forth).alias("from_after"))
    up = Window.partitionBy("ticker", "chunk").orderBy("sidx").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("ticker", "chunk").orderBy(F.desc("sidx")).rowsBetween(Window.unboundedPreceding, 0)
    near = merged.select("ticker", "chunk", "sidx", "price", "wanted", F.last("at", True).over(up).alias("b"), F.last("at", True).over(down).alias("a"))
    joined = near.where("wanted").join(carry, ["ticker", "chunk"], "left").select("ticker", "sidx", "price", F.coalesce("b", "from_before").alias("b"), F.coalesce("a", "from_after").alias("a"))
    share = (F.col("sidx") - F.col("b.sidx")) / (F.col("a.sidx") - F.col("b.sidx"))
    between = F.col("b.price") + (F.col("a.price") - F.col("b.price")) * share
    status = (
        F.when(F.col("price").isNotNull(), "observed")
        .when(F.col("a").isNull() & F.col("b").isNull(), "missing")
        .when(F.col("a").isNull() | F.col("b").isNull(), "edge")
        .when(F.col("a.sidx") - F.col("b.sidx") > max_gap, "gap")
        .otherwise("interpolated")
    )
    return joined.select(
        "ticker",
        "sidx",
        F.when(status == "observed", F.col("price")).when(status == "interpolated", between).alias("price"),
        status.alias("status"),
        F.col("b.sidx").alias("before_sidx"),
        F.col("a.sidx").alias("after_sidx"),
    )


def missing_minutes(challenge: DataFrame, blocks: DataFrame, tickers: tuple[str, ...] = PRICE_TICKERS, **options: int) -> DataFrame:
    """The (ticker, sidx) of the grid without a usable price in any row."""
    return regular_minutes(challenge, blocks, tickers, **options).where(F.col("status") != "observed").select("ticker", "sidx")

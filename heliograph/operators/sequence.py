"""Order-dependent work on long sources without one task per source.

``numbered`` gives every row of a source its dense position, from per-chunk
counts; ``with_halo`` cuts a source into blocks of equal row count and copies
the rows next to a border into the neighbouring block, so that window
functions over (source, block) see enough of both sides. ``exact_median``
finds a median per key inside a bracket that a bounded sketch proves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, source: str, order: str, chunk: int, to: str = "pos") -> DataFrame:
    """Adds the dense 0-based position of each row in its source.

    ``order`` must be an integer column that is unique inside the source. Rows
    are counted per (source, order div chunk); only these counts are summed
    along a source.
    """
    part = df.withColumn("_chunk", F.floor(F.col(order) / chunk).cast("long"))
    counts = part.groupBy(source, "_chunk").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(source).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(source, "_chunk", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(source, "_chunk").orderBy(order)
    ranked = part.withColumn("_rank", F.row_number().over(inside) - 1)
    return ranked.join(offsets, [source, "_chunk"]).withColumn(to, F.col("_offset") + F.col("_rank")).drop("_chunk", "_rank", "_offset")


def with_halo(df: DataFrame, halo: int, block: int = 20_000, pos: str = "pos") -> DataFrame:
    """Adds ``block`` and ``core``: each row once with core = true, and copies (core = false) beside block borders."""
    if halo > block:
        raise ValueError("the halo must not exceed the block")
    own = F.floor(F.col(pos) / block).cast("long")
    inside = F.pmod(F.col(pos), F.lit(block))
    homes = F.filter(
        F.array(own, F.when((inside < halo) & (own > 0), own - 1), F.when(inside >= block - halo, own + 1)),
        lambda x: x.isNotNull(),
    )
    return df.withColumn("block", F.explode(homes)).withColumn("core", F.col("block") == own)


def exact_median(df: DataFrame, key: str, value: Column, accuracy: int = 10_000) -> DataFrame:
    """(key, median): the exact median of the non-null values of each key.

    A quantile sketch of bounded size (its rank error is below 1 / accuracy)
    gives a bracket of 10 / accuracy of the rows around the middle; values
    below it are only counted, values inside it are combined to (value, count)
    and summed up in order. An even count gives the mean of both middles. That
    both middles are inside the bracket is checked; the query fails otherwise.
    """
    slack = 5.0 / accuracy
    rows = df.select(key, value.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    bracket = rows.groupBy(key).agg(F.percentile_approx("_v", [0.5 - slack, 0.5 + slack], accuracy).alias("_b"), F.count("*").alias("_n"))
    tied = rows.join(bracket, key).where(F.col("_v") <= F.col("_b")[1])
    folded = tied.select(key, "_n", F.when(F.col("_v") >= F.col("_b")[0], F.col("_v")).alias("_v")).groupBy(key, "_n", "_v").agg(F.count("*").alias("_c"))
    run = Window.partitionBy(key).orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = folded.withColumn("_to", F.sum("_c").over(run))
    low, high = F.floor((F.col("_n") - 1) / 2) + 1, F.floor(F.col("_n") / 2) + 1
    middles = ranked.groupBy(key).agg(
        F.min(F.when(F.col("_to") >= low, F.col("_v"))).alias("_low"),
        F.min(F.when(F.col("_to") >= high, F.col("_v"))).alias("_high"),
        F.coalesce(F.max(F.when(F.col("_v").isNull(), F.col("_to") < low)), F.lit(True)).alias("_above"),
    )
    missed = F.raise_error(F.lit("the median is outside its bracket")).cast("double")
    return middles.select(key, F.when(F.col("_above") & F.col("_high").isNotNull(), (F.col("_low") + F.col("_high")) / 2).otherwise(missed).alias("median"))


def with_key_halo(df: DataFrame, order: str, back: int, ahead: int, chunk: int) -> DataFrame:
    """Like ``with_halo``, by key distance: chunks of ``chunk`` key units, with copies of what lies ``back`` before and ``ahead`` after."""
    own = F.floor(F.col(order) / chunk).cast("long")
    low = F.floor((F.col(order) - ahead) / chunk).cast("long")
    high = F.floor((F.col(order) + back) / chunk).cast("long")
    return df.withColumn("block", F.explode(F.sequence(low, high))).withColumn("core", F.col("block") == own)


def running_sum(df: DataFrame, source: str, order: str, value: Column, chunk: int, to: str) -> DataFrame:
    """Adds the running sum (inclusive) of ``value`` along a source, chunk by chunk with carried sums."""
    part = df.withColumn("_chunk", F.floor(F.col(order) / chunk).cast("long")).withColumn("_x", value)
    upto = Window.partitionBy(source).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = part.groupBy(source, "_chunk").agg(F.sum("_x").alias("_s"))
    carried = sums.select(source, "_chunk", F.coalesce(F.sum("_s").over(upto), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(source, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    summed = part.withColumn("_run", F.sum("_x").over(inside)).join(carried, [source, "_chunk"])
    return summed.withColumn(to, F.col("_before") + F.coalesce("_run", F.lit(0))).drop("_chunk", "_x", "_run", "_before")


def fill_forward(df: DataFrame, source: str, order: str, value: Column, chunk: int, to: str) -> DataFrame:
    """Adds the last non-null ``value`` up to each row of its source (backward as-of), chunk by chunk with carried values."""
    part = df.withColumn("_chunk", F.floor(F.col(order) / chunk).cast("long")).withColumn("_x", value)
    inside = Window.partitionBy(source, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    last = part.groupBy(source, "_chunk").agg(F.max(F.when(F.col("_x").isNotNull(), F.struct(F.col(order).alias("o"), F.col("_x").alias("x")))).alias("_l"))
    before = Window.partitionBy(source).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(source, "_chunk", F.last("_l", True).over(before)["x"].alias("_c"))
    filled = part.withColumn("_in", F.last("_x", True).over(inside)).join(carried, [source, "_chunk"])
    return filled.withColumn(to, F.coalesce("_in", "_c")).drop("_chunk", "_x", "_in", "_c")

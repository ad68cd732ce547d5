"""Participants and columns that may take part: activity, staleness, distinct values, class and count guards, equal lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def active_share(df: DataFrame, group: list[str], active: Column, least: float) -> DataFrame:
    """Groups in which more than ``least`` of the rows are active."""
    return df.groupBy(*group).agg(F.count("*").alias("n"), F.avg(active.cast("double")).alias("active_share")).where(F.col("active_share") > least)


def unstale(df: DataFrame, group: list[str], value: str, least: float = 1e-4, to: str = "fresh") -> DataFrame:
    """the value, or 0 in groups whose population deviation is below ``least``."""
    s = df.groupBy(*group).agg(F.stddev_pop(value).alias("_s"))
    return df.join(s, group).withColumn(to, F.when(F.coalesce(F.col("_s"), F.lit(0.0)) < least, F.lit(0.0)).otherwise(F.col(value))).drop("_s")


def enough(df: DataFrame, group: list[str], value: str, label: str | None = None, least_rows: int = 1, least_distinct: int = 1) -> DataFrame:
    """groups with enough rows, distinct non-zero values and, with a label, both classes."""
    aggs = [F.count("*").alias("n"), F.countDistinct(F.when(F.col(value) != 0, F.col(value))).alias("n_distinct")]
    if label:
        aggs.append(F.countDistinct(label).alias("n_classes"))
    s = df.groupBy(*group).agg(*aggs).where((F.col("n") >= least_rows) & (F.col("n_distinct") >= least_distinct))
    return s.where("n_classes = 2") if label else s


def probation(df: DataFrame, who: str, pos: str, submitted: str, now: int, least_age: int, window: int, least_cover: float) -> DataFrame:
    """Participants old enough that submitted in enough of the last ``window`` positions."""
    s = df.groupBy(who).agg(F.min(F.when(F.col(submitted), F.col(pos))).alias("first"), (F.count_if(F.col(submitted) & (F.col(pos) > now - window)) / F.lit(float(window))).alias("coverage"))
    return s.where((F.lit(now) - F.col("first") >= least_age) & (F.col("coverage") >= least_cover))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """equal as multisets of rows."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def price_fallback(asked: DataFrame, asset: str, direct: DataFrame, spec: DataFrame) -> DataFrame:
    """The price under the asset's own ticker, else that of the task whose price_key names the asset (the first ticker)."""
    keyed = spec.where(F.col("price_key").isNotNull()).groupBy(F.col("price_key").alias(asset)).agg(F.min("ticker").alias("_via"))
    own, via = direct.select(F.col("ticker").alias(asset), F.col("price").alias("_own")), direct.select(F.col("ticker").alias("_via"), F.col("price").alias("_other"))
    joined = asked.join(own, asset, "left").join(F.broadcast(keyed), asset, "left").join(via, "_via", "left")
    return joined.withColumn("price", F.coalesce("_own", "_other")).drop("_own", "_other", "_via")


def classwise_centred(df: DataFrame, group: list[str], label: str, value: str, to: str = "centred") -> DataFrame:
    """Value minus its mean per group and class."""
    m = df.groupBy(*group, label).agg(F.avg(value).alias("_m"))
    return df.join(m, [*group, label]).withColumn(to, F.col(value) - F.col("_m")).drop("_m")


def softmax_shares(df: DataFrame, log_weight: str, uniqueness: str, to: str = "share") -> DataFrame:
    """exp(x - max)·uniqueness, normalised."""
    raw = df.withColumn("_e", F.exp(F.col(log_weight) - df.agg(F.max(log_weight)).scalar()) * F.col(uniqueness))
    shares = raw.withColumn("_t", raw.agg(F.sum("_e")).scalar())
    return shares.withColumn(to, F.when(F.col("_t") > 0, F.col("_e") / F.col("_t")).otherwise(0.0)).drop("_e", "_t")

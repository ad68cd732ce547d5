"""Windows along a source: rolling spread, labels, ranges, paths, runs, episodes, weights and segments.

Bounded frames run on blocks of equal row count with a halo of the frame's
reach (``blocks``), so a source of any length is spread over many tasks.
Unbounded running values are carried from chunk to chunk.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from heliograph.operators.sequence import fill_forward, numbered, running_sum, with_halo, with_key_halo

CHUNK = 10_080
EPS = 1e-12


def blocks(df: DataFrame, source: str, order: str, halo: int, block: int = 20_000) -> DataFrame:
    """Rows with pos, block and core; windows over (source, block) ordered by pos may look ``halo`` rows to both sides."""
    return with_halo(numbered(df, source, order, CHUNK), halo, max(block, halo))


def over(source: str) -> Window:
    return Window.partitionBy(source, "block").orderBy("pos")


def core(df: DataFrame) -> DataFrame:
    return df.where("core").drop("block", "core")


def log_price(price: Column) -> Column:
    """P06."""
    return F.log(price + F.lit(EPS))


def rolling_std(x: Column, window: int, w: Window) -> Column:
    """Sample standard deviation over the last ``window`` rows, null until the window is full."""
    frame = w.rowsBetween(-(window - 1), 0)
    return F.when(F.count(x).over(frame) == window, F.stddev_samp(x).over(frame))


def rolling_std_prefix(df: DataFrame, source: str, x: str, window: int, to: str, w: Window) -> DataFrame:
    """W01 in O(1) per row for wide windows: running sums of the centred value and of its square, and their lags.

    ``df`` comes from ``blocks`` with a halo of at least ``window``; values are
    centred on the block's mean, which keeps the difference of sums exact
    enough. Null values count as not full.
    """
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    mean = F.avg(x).over(Window.partitionBy(source, "block"))
    s = df.withColumn("_c", F.col(x) - mean).withColumn("_s1", F.sum("_c").over(run)).withColumn("_s2", F.sum(F.col("_c") * F.col("_c")).over(run)).withColumn("_n", F.count("_c").over(run))
    diff = lambda c: F.col(c) - F.coalesce(F.lag(c, window).over(w), F.lit(0.0))
    s1, s2, n = diff("_s1"), diff("_s2"), diff("_n")
    return s.withColumn(to, F.when(n == window, F.sqrt(F.greatest((s2 - s1 * s1 / window) / max(window - 1, 1), F.lit(0.0))))).drop("_c", "_s1", "_s2", "_n")


def sigma(df: DataFrame, source: str, order: str, price: str, ahead: int, window: int) -> DataFrame:
    """Forward log return ``fwd``, its rolling spread ``sigma_noncausal`` (uses prices up to t + ahead) and ``sigma_causal`` (completed by t)."""
    w = over(source)
    placed = blocks(df, source, order, ahead * 2 + window).withColumn("lp", log_price(F.col(price)))
    placed = placed.withColumn("fwd", F.lead("lp", ahead).over(w) - F.col("lp"))
    spread = rolling_std_prefix(placed, source, "fwd", window, "sigma_noncausal", w)
    return spread.withColumn("sigma_causal", F.lag("sigma_noncausal", ahead).over(w))


def bucket_label(z: Column) -> Column:
    """0 for z <= -2, 1 up to -1, 2 for [-1, 1], 3 below 2, 4 from 2 on; null stays null."""
    return F.when(z <= -2, 0).when(z < -1, 1).when(z <= 1, 2).when(z < 2, 3).when(z >= 2, 4)


def trailing_range(df: DataFrame, source: str, order: str, value: str, reach: int) -> DataFrame:
    """Min, max and count over keys in [order - reach, order), exclusive of the current key."""
    placed = with_key_halo(df, order, reach, 0, max(reach * 4, 1440))
    w = Window.partitionBy(source, "block").orderBy(order).rangeBetween(-reach, -1)
    ranged = placed.withColumn("range_low", F.min(value).over(w)).withColumn("range_high", F.max(value).over(w)).withColumn("range_n", F.count(value).over(w))
    return core(ranged)


def path_extremes(df: DataFrame, source: str, order: str, price: str, ahead: int) -> DataFrame:
    """Highest and lowest log move over [t, t + ahead] against the row before t (null unless the path is whole)."""
    w = over(source)
    placed = blocks(df, source, order, ahead + 1).withColumn("lp", log_price(F.col(price)))
    frame = w.rowsBetween(0, ahead)
    whole = F.count("lp").over(frame) == ahead + 1
    base = F.lag("lp", 1).over(w)
    return core(placed.withColumn("up", F.when(whole, F.max("lp").over(frame) - base)).withColumn("down", F.when(whole, F.min("lp").over(frame) - base)))


def forward_sum(x: Column, ahead: int, w: Window) -> Column:
    """Sum over the next ``ahead`` rows, null unless all are there."""
    frame = w.rowsBetween(1, ahead)
    return F.when(F.count(x).over(frame) == ahead, F.sum(x).over(frame))


def unchanged_streak(df: DataFrame, source: str, order: str, value: str, to: str = "streak") -> DataFrame:
    """1-based length of the run of equal values up to each row; a null value neither resets nor extends it."""
    placed = numbered(df.where(F.col(value).isNotNull()), source, order, CHUNK)
    w = over(source)
    flagged = core(with_halo(placed, 1).withColumn("_new", F.lag(value).over(w).isNull() | (F.lag(value).over(w) != F.col(value))))
    begun = fill_forward(flagged, source, "pos", F.expr("CASE WHEN _new THEN pos END"), 20_000, "_from")
    return begun.withColumn(to, F.col("pos") - F.col("_from") + 1).drop("pos", "_new", "_from")


def episodes(df: DataFrame, source: str, order: str, gap: int, to: str = "episode") -> DataFrame:
    """0-based episode number; a new one begins where more than ``gap`` key units have passed."""
    w = over(source)
    placed = blocks(df, source, order, 1)
    cut_here = core(placed.withColumn("_cut", F.when(F.col(order) - F.lag(order).over(w) > gap, 1).otherwise(0)))
    return running_sum(cut_here, source, "pos", F.col("_cut"), 20_000, to).drop("pos", "_cut")


def first_barrier(df: DataFrame, source: str, order: str, price: str, barrier: str, ahead: int) -> DataFrame:
    """Which of ±``barrier`` (log move) is hit first in the next ``ahead`` rows: 0 up, 1 down, 2 neither; null where the barrier is.

    Blocks of equal row count with a halo of ``ahead`` rows are searched as
    vectors, step by step for all rows that haven't hit yet.
    """
    placed = blocks(df, source, order, ahead)
    schema = StructType([*placed.schema.fields, StructField("first_hit", IntegerType())])

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", ignore_index=True)
        lp, far = np.log(pdf[price].to_numpy(dtype=float) + EPS), pdf[barrier].to_numpy(dtype=float, na_value=np.nan)
        n = len(lp)
        label = np.full(n, 2)
        open_ = np.flatnonzero((np.arange(n) + ahead < n) & ~np.isnan(far))
        whole = open_.copy()
        for k in range(1, ahead + 1):
            move = lp[open_ + k] - lp[open_]
            up, down = move >= far[open_], move <= -far[open_]
            label[open_[up & ~down]], label[open_[down & ~up]] = 0, 1
            open_ = open_[~(up | down)]
            if not len(open_):
                break
        told = pd.array([pd.NA] * n, dtype="Int32")
        told[whole] = label[whole]
        return pdf.assign(first_hit=told)[pdf["core"].to_numpy(dtype=bool)]

    return placed.groupBy(source, "block").applyInPandas(search, schema).drop("block", "core")


def decay_weights(df: DataFrame, source: str, order: str, per_day: float, half_life_days: float, to: str = "weight") -> DataFrame:
    """Exponential weights by age in rows (the last row has age 1), scaled to mean 1 per source."""
    placed = numbered(df, source, order, CHUNK)
    n = placed.groupBy(source).agg(F.max("pos").alias("_last"))
    aged = placed.join(n, source).withColumn("_w", F.exp(-F.log(F.lit(2.0)) * (F.col("_last") - F.col("pos") + 1) / (per_day * half_life_days)))
    mean = aged.groupBy(source).agg(F.avg("_w").alias("_m"))
    return aged.join(mean, source).withColumn(to, F.col("_w") / F.col("_m")).drop("pos", "_last", "_w", "_m")


def recent_mass_weights(df: DataFrame, source: str, order: str, recent: int, mass: float, to: str = "weight") -> DataFrame:
    """Rows within ``recent`` key units of the source's last key share ``mass`` of the weight; scaled to mean 1."""
    last = df.groupBy(source).agg(F.max(order).alias("_max"))
    flagged = df.join(last, source).withColumn("_new", F.col(order) >= F.col("_max") - (recent - 1))
    counts = flagged.groupBy(source).agg(F.count_if("_new").alias("_nr"), F.count_if(~F.col("_new")).alias("_no"))
    raw = F.when(F.col("_new") & (F.col("_no") > 0), mass * F.col("_no") / ((1 - mass) * F.col("_nr"))).otherwise(F.lit(1.0))
    total = F.when(F.col("_no") > 0, mass * F.col("_no") / (1 - mass) + F.col("_no")).otherwise(F.col("_nr"))
    joined = flagged.join(counts, source)
    return joined.withColumn(to, raw * (F.col("_nr") + F.col("_no")) / total).drop("_max", "_new", "_nr", "_no")


def trailing_rows(df: DataFrame, source: str, order: str, n: int) -> DataFrame:
    """The last ``n`` rows of each source."""
    placed = numbered(df, source, order, CHUNK)
    last = placed.groupBy(source).agg(F.max("pos").alias("_last"))
    return placed.join(last, source).where(F.col("pos") > F.col("_last") - n).drop("pos", "_last")


def row_windows(df: DataFrame, source: str, order: str, size: int, to: str = "window_no") -> DataFrame:
    """Tumbling windows of ``size`` rows."""
    return numbered(df, source, order, CHUNK).withColumn(to, F.floor(F.col("pos") / size).cast("long")).drop("pos")


def rank_decay(df: DataFrame, group: list[str], score: str, key: str, k: int, least: float = 1e-6, to: str = "share") -> DataFrame:
    """score·exp(-rank / max(1, k/3)) by falling score, normalised, shares up to ``least`` dropped."""
    w = Window.partitionBy(*group).orderBy(F.desc(score), key)
    decayed = df.where(F.col(score) > 0).withColumn("_r", F.row_number().over(w) - 1).withColumn("_d", F.col(score) * F.exp(-F.col("_r") / max(1.0, k / 3)))
    total = decayed.groupBy(*group).agg(F.sum("_d").alias("_t")) if group else None
    shares = decayed.join(total, group) if group else decayed.withColumn("_t", F.sum("_d").over(Window.partitionBy()))
    return shares.withColumn(to, F.col("_d") / F.col("_t")).where(F.col(to) > least).drop("_r", "_d", "_t")


def banded_top(df: DataFrame, group: list[str], score: str, key: str, k: int, margin: float, extra: int, least: float) -> DataFrame:
    """The top ``k`` and up to ``extra`` more within ``margin`` of the k-th score; all above ``least``."""
    w = Window.partitionBy(*group).orderBy(F.desc(score), key)
    ranked = df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k + extra)
    kth = F.min(F.when(F.col("rank") <= k, F.col(score))).over(Window.partitionBy(*group))
    return ranked.withColumn("_k", kth).where(((F.col("rank") <= k) | (F.col(score) >= F.col("_k") - margin)) & (F.col(score) > least)).drop("_k")


def top_k(df: DataFrame, group: list[str], score: str, key: str, k: int) -> DataFrame:
    """The ``k`` best per group, ties by key; Spark prunes groups while ranking (window group limit)."""
    w = Window.partitionBy(*group).orderBy(F.desc(score), key)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def segments(spark: SparkSession, start: int, end: int, chunk: int, lag: int) -> DataFrame:
    """Walk-forward segments: validate on [start, end) of each chunk, fit on rows before start - lag."""
    s = spark.range(start, max(end, start), chunk).select(F.col("id").alias("start"), F.least(F.col("id") + chunk, F.lit(end)).alias("end"))
    return s.withColumn("fit_end", F.greatest(F.col("start") - lag, F.lit(0))).withColumn("segment", F.floor((F.col("start") - start) / chunk).cast("long"))


def seniority(df: DataFrame, first_seen: str, key: str, to: str = "seniority") -> DataFrame:
    """0-based order by first appearance, then key (a dimension of participants)."""
    return df.withColumn(to, F.row_number().over(Window.orderBy(first_seen, key)) - 1)


def rolling_beta(df: DataFrame, source: str, order: str, own: str, market: str, window: int, shrink: float = 0.3, refresh: int = 1) -> DataFrame:
    """Shrunk beta over the ``window`` rows before t: sample covariance over population variance, mixed as (1-s)·b + s."""
    w = over(source)
    frame = w.rowsBetween(-window, -1)
    placed = blocks(df, source, order, window)
    full = F.count(own).over(frame) == window
    beta = (1 - shrink) * F.covar_samp(own, market).over(frame) / (F.var_pop(market).over(frame) + EPS) + shrink
    out = core(placed.withColumn("beta", F.when(full & (F.col("pos") % refresh == 0), beta)).withColumn("vol", F.when(full, F.stddev_pop(own).over(frame))))
    if refresh == 1:
        return out.drop("pos")
    return fill_forward(out, source, "pos", F.col("beta"), 20_000, "beta_used").drop("pos")

"""Evaluation statistics and weights: exact AUC, balanced accuracy, votes, medians of means, discoveries, caps, blends.

All are aggregates with map-side combine or windows over small aggregated
tables. Missing values are NULL (never NaN); every ranking has an explicit
final tie-break.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def auc(df: DataFrame, group: list[str], score: str, label: Column) -> DataFrame:
    """Exact ROC AUC with ties per group: group, n1, n0, auc (null without both classes).

    Mann-Whitney on (score, positives, negatives) counts: equal scores are
    combined before anything is ordered, so a group's window holds one row per
    distinct score.
    """
    rows = df.where(F.col(score).isNotNull() & label.isNotNull())
    counted = rows.groupBy(*group, score).agg(F.count_if(label).alias("_p"), F.count_if(~label).alias("_q"))
    below = Window.partitionBy(*group).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    won = counted.withColumn("_u", F.col("_p") * (F.coalesce(F.sum("_q").over(below), F.lit(0)) + F.col("_q") * F.lit(0.5)))
    totals = won.groupBy(*group).agg(F.sum("_p").alias("n1"), F.sum("_q").alias("n0"), F.sum("_u").alias("_u"))
    return totals.select(*group, "n1", "n0", F.when((F.col("n1") > 0) & (F.col("n0") > 0), F.col("_u") / (F.col("n1").cast("double") * F.col("n0"))).alias("auc"))


def auc_scale(auc_: Column) -> Column:
    """0 at chance and below, 1 at perfect."""
    return F.greatest((F.coalesce(auc_, F.lit(0.5)) - F.lit(0.5)) / F.lit(0.5), F.lit(0.0))


def normalise(df: DataFrame, group: list[str], value: str, to: str) -> DataFrame:
    """Value / total per group; 0 where the total is 0."""
    if not group:
        joined = df.withColumn("_t", df.agg(F.sum(value)).scalar())
    else:
        joined = df.join(df.groupBy(*group).agg(F.sum(value).alias("_t")), group)
    return joined.withColumn(to, F.when(F.col("_t") > 0, F.col(value) / F.col("_t")).otherwise(0.0)).drop("_t")


def balanced_accuracy(df: DataFrame, group: list[str], truth: str, guess: str, classes: int) -> DataFrame:
    """Mean recall over the classes present, and over all ``classes``."""
    recall = df.groupBy(*group, truth).agg((F.count_if(F.col(truth) == F.col(guess)) / F.count("*")).alias("_r"))
    return recall.groupBy(*group).agg(F.avg("_r").alias("ba_present"), (F.sum("_r") / F.lit(float(classes))).alias("ba_all"))


def weighted_vote(df: DataFrame, group: list[str], choice: str, weight: str) -> DataFrame:
    """The choice with the largest total weight; the smaller choice on ties."""
    votes = df.groupBy(*group, choice).agg(F.sum(weight).alias("_w"))
    best = votes.groupBy(*group).agg(F.max(F.struct(F.col("_w"), -F.col(choice))).alias("_b"))
    return best.select(*group, (-F.col("_b")["col2"]).alias("vote"), F.col("_b")["_w"].alias("vote_weight"))


def median_of_means(df: DataFrame, group: list[str], replicate: str, value: str, groups: int = 4) -> DataFrame:
    """Replicates 0..n-1 in ``groups`` blocks of n // groups (the remainder dropped): median of block means; ``mean`` over all."""
    n = df.groupBy(*group).agg(F.count("*").alias("_n"), F.avg(value).alias("mean"))
    size = F.greatest(F.floor(F.col("_n") / groups), F.lit(1))
    placed = df.join(n, group).withColumn("_size", size).where(F.col(replicate) < F.col("_size") * groups)
    means = placed.groupBy(*group, "mean", F.floor(F.col(replicate) / F.col("_size")).alias("_b")).agg(F.avg(value).alias("_m"))
    return means.groupBy(*group, "mean").agg(F.median("_m").alias("median_of_means"))


def recency_mean(df: DataFrame, group: list[str], age: Column, value: str, half_life: float, least: int = 1) -> DataFrame:
    """Mean weighted by 0.5^(age / half_life); null below ``least`` values."""
    w = F.pow(F.lit(0.5), age / F.lit(float(half_life)))
    return df.where(F.col(value).isNotNull()).groupBy(*group).agg(F.count("*").alias("n"), (F.sum(w * F.col(value)) / F.sum(w)).alias("_m")).select(*group, "n", F.when(F.col("n") >= least, F.col("_m")).alias("recency_mean"))


def discoveries(df: DataFrame, group: list[str], p: str, key: str, q: float) -> DataFrame:
    """Benjamini-Hochberg: rows up to the largest rank k with p(k) <= q·k/m."""
    w = Window.partitionBy(*group).orderBy(p, key)
    ranked = df.where(F.col(p).isNotNull()).withColumn("_k", F.row_number().over(w)).withColumn("_m", F.count("*").over(Window.partitionBy(*group)))
    limit = F.max(F.when(F.col(p) <= F.lit(q) * F.col("_k") / F.col("_m"), F.col("_k"))).over(Window.partitionBy(*group))
    return ranked.withColumn("_kmax", limit).where(F.col("_k") <= F.col("_kmax")).withColumnRenamed("_k", "rank").drop("_m", "_kmax")


def cap_shares(df: DataFrame, group: list[str], share: str, cap: float, to: str = "capped") -> DataFrame:
    """Shares above ``cap`` are cut; the excess is offered once to the others in proportion, each up to its room."""
    over = F.greatest(F.col(share) - cap, F.lit(0.0))
    sums = {"_x": F.sum(over), "_u": F.sum(F.when(F.col(share) < cap, F.col(share)).otherwise(0.0))}
    if group:
        joined = df.join(df.groupBy(*group).agg(*(s.alias(c) for c, s in sums.items())), group)
    else:
        joined = df.withColumn("_s", df.agg(F.struct(*(s.alias(c) for c, s in sums.items()))).scalar()).withColumns({c: F.col("_s")[c] for c in sums}).drop("_s")
    offered = F.when(F.col("_u") > 0, F.col("_x") * F.col(share) / F.col("_u")).otherwise(0.0)
    return joined.withColumn(to, F.when(F.col(share) >= cap, F.lit(float(cap))).otherwise(F.col(share) + F.least(offered, F.lit(cap) - F.col(share)))).drop("_x", "_u")


def cluster_credit(df: DataFrame, cluster: list[str], value: str, to: str = "credit") -> DataFrame:
    """Every member of a cluster gets total / n²."""
    totals = df.groupBy(*cluster).agg((F.sum(value) / (F.count("*") * F.count("*"))).alias(to))
    return df.join(totals, cluster)


def zscore(df: DataFrame, group: list[str], value: str, to: str = "z") -> DataFrame:
    """Population z-score per group; spreads below 1e-8 count as 1, missing values as 0."""
    stats = df.groupBy(*group).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    spread = F.when(F.coalesce(F.col("_s"), F.lit(0.0)) < 1e-8, F.lit(1.0)).otherwise(F.col("_s"))
    return df.join(stats, group).withColumn(to, F.coalesce((F.col(value) - F.col("_m")) / spread, F.lit(0.0))).drop("_m", "_s")


def blend(left: DataFrame, right: DataFrame, key: str, value: str, share: float) -> DataFrame:
    """Full outer blend of two maps, ``share`` of the left; absent keys count 0."""
    a, b = left.select(key, F.col(value).alias("_a")), right.select(key, F.col(value).alias("_b"))
    return a.join(b, key, "full_outer").select(key, (share * F.coalesce("_a", F.lit(0.0)) + (1 - share) * F.coalesce("_b", F.lit(0.0))).alias(value))


def ema(new: DataFrame, old: DataFrame, key: str, value: str, alpha: float) -> DataFrame:
    """alpha·new + (1 - alpha)·old over the new keys (old of absent keys is 0), normalised."""
    a, b = new.select(key, F.col(value).alias("_a")), old.select(key, F.col(value).alias("_b"))
    mixed = a.join(b, key, "left").select(key, (alpha * F.col("_a") + (1 - alpha) * F.coalesce("_b", F.lit(0.0))).alias("_v"))
    return normalise(mixed, [], "_v", value).select(key, value)


def task_average(parts: list[DataFrame], weights: list[float], key: str, value: str) -> DataFrame:
    """Weighted mean of per-task maps over the tasks that gave a score, normalised."""
    total = sum(weights)
    tagged = [p.select(key, (F.col(value) * F.lit(w / total)).alias("_v")) for p, w in zip(parts, weights, strict=True)]
    summed = reduce(DataFrame.unionByName, tagged).groupBy(key).agg(F.sum("_v").alias("_v"))
    return normalise(summed, [], "_v", value).select(key, value)


def compose_shares(df: DataFrame, key: str, value: str, young: Column, fixed: float) -> DataFrame:
    """Young keys get ``fixed`` each; the others share the rest in proportion."""
    # One subquery for both sums: several over the same rows, nested in another, are merged wrongly by the optimizer.
    totals = df.agg(F.struct(F.count_if(young).alias("_y"), F.sum(F.when(~young, F.col(value)).otherwise(0.0)).alias("_m"))).scalar()
    rest = 1 - F.lit(fixed) * F.col("_y")
    share = F.when(young, F.lit(fixed)).when(F.col("_m") > 0, rest * F.col(value) / F.col("_m")).otherwise(0.0)
    return df.withColumn("_t", totals).select("*", "_t.*").select(key, share.alias("share"))


def uniform_guard(df: DataFrame, group: list[str], value: str, least: float = 0.01) -> DataFrame:
    """per group whether values are near-uniform ((max - min)/mean below ``least``), all equal, or without sum; ``cv`` uses the sample deviation."""
    s = df.where(F.col(value) > 0).groupBy(*group).agg(F.count("*").alias("n"), F.min(value).alias("_a"), F.max(value).alias("_b"), F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    return s.select(*group, "n", ((F.col("_b") - F.col("_a")) / F.col("_m") < least).alias("near_uniform"), (F.col("_a") == F.col("_b")).alias("one_value"), (F.col("_s") / F.col("_m")).alias("cv"))


def softplus(x: Column) -> Column:
    """P25, stable for large |x|."""
    return F.log1p(F.exp(-F.abs(x))) + F.greatest(x, F.lit(0.0))


def sigmoid(x: Column) -> Column:
    """P24."""
    return 1 / (1 + F.exp(-x))


def logit(p: Column, eps: float = 1e-6) -> Column:
    """Logit of a clipped probability."""
    c = F.greatest(F.least(p, F.lit(1 - eps)), F.lit(eps))
    return F.log(c / (1 - c))

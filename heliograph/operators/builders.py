"""Training rows per task: labels beside what participants had submitted, in the long form that the scorers take."""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.functions import vectors
from heliograph.operators import asof, ingest, pairs, similarity, windows
from heliograph.operators.prices import readings
from heliograph.operators.sequence import numbered
from heliograph.session import cut
from heliograph.sources.legacy import unpacked


def vector_rows(challenge: DataFrame, ticker: str, width: int) -> DataFrame:
    """(sidx, hk, vec) of a ticker; of repeated deliveries the last. Column and ticker filters reach the scan."""
    rows = challenge.where((F.col("ticker") == ticker) & (F.length("embeddings") > 0) & F.col("sidx").isNotNull()).select("sidx", "ts", "embeddings")
    flat = unpacked(rows, "embeddings", width)
    return ingest.latest(flat, ["sidx", "hk"], "ts", ["vec"]).select("sidx", "hk", "vec").where(~F.exists("vec", lambda x: F.isnan(x)))


def upto(df: DataFrame, block: Column, last: int | None) -> DataFrame:
    """only what had happened by block ``last`` (all of it where there is no cut-off)."""
    return df.where(block <= last) if last else df


def binary_rows(challenge: DataFrame, ticker: str, blocks_ahead: int, width: int = 2, last_block: int | None = None, active: DataFrame | None = None, longest_streak: int = 15) -> DataFrame:
    """(hk, pos, x, y), x the vector: P02, P04, P28, F05, F10, F11, J02 in the order the labels need.

    Rows keep a price that hasn't stood still for more than ``longest_streak``
    readings, a price exactly ``blocks_ahead`` later, and some non-zero vector
    of *any* participant; only then are participants restricted (J17). y tells
    whether the price rose; the later price is not limited by ``last_block``.
    """
    prices = readings(challenge, (ticker,))
    moved = windows.unchanged_streak(prices, "ticker", "sidx", "price").where(F.col("streak") <= longest_streak).drop("streak")
    later = prices.select("ticker", (F.col("sidx") - blocks_ahead // 5).alias("sidx"), F.col("price").alias("later"))
    labelled = upto(moved.join(later, ["ticker", "sidx"]), F.col("sidx") * 5, last_block)
    sent = vector_rows(challenge, ticker, width).where(vectors.active(F.col("vec")))
    used = labelled.join(sent.select("sidx").distinct(), "sidx", "left_semi")
    placed = numbered(used, "ticker", "sidx", windows.CHUNK)
    rows = placed.join(sent, "sidx").select("hk", "pos", F.transform("vec", lambda v: v.cast("double")).alias("x"), (F.col("later") > F.col("price")).cast("int").alias("y"))
    return rows if active is None else rows.join(active, "hk", "left_semi")


def bucket_rows(challenge: DataFrame, ticker: str, ahead: int, window: int, classes: int = 5, width: int = 17, least_active: float = 0.05) -> DataFrame:
    """(hk, pos, guess, truth, p) for the vote scorer: W04 labels beside the first class of the largest probability (P17); F16 activity."""
    s = windows.core(windows.sigma(readings(challenge, (ticker,)), "ticker", "sidx", "price", ahead, window))
    z = F.col("fwd") / (F.col("sigma_causal") + F.lit(windows.EPS))
    labelled = numbered(s.where("fwd IS NOT NULL AND sigma_causal IS NOT NULL").select("ticker", "sidx", windows.bucket_label(z).alias("truth")), "ticker", "sidx", windows.CHUNK)
    sent = vector_rows(challenge, ticker, width)
    busy = sent.groupBy("hk").agg(F.avg(F.exists(F.slice("vec", 1, classes), lambda x: x > 0.01).cast("double")).alias("a")).where(F.col("a") > least_active)
    shares = sent.join(busy.select("hk"), "hk", "left_semi").select("sidx", "hk", F.slice(vectors.probabilities(F.col("vec"), classes), 1, classes).alias("p"))
    return labelled.join(shares, "sidx").select("hk", "pos", vectors.argmax(F.col("p")).alias("guess"), "truth", "p")


def q_path_rows(challenge: DataFrame, ticker: str, ahead: int, window: int, width: int = 17) -> DataFrame:
    """X15 for X03: (model, hk, pos, x, y): for each outer bucket and each of three thresholds (0.5, 1 and 2 sigmas) whether the path reached it, beside the logits of the quantiles that were submitted for it."""
    prices = readings(challenge, (ticker,))
    s = windows.core(windows.sigma(prices, "ticker", "sidx", "price", ahead, window)).select("ticker", "sidx", "fwd", "sigma_causal", F.col("sigma_noncausal").alias("sigma"))
    path = windows.path_extremes(prices, "ticker", "sidx", "price", ahead).select("ticker", "sidx", "up", "down")
    both = s.join(path, ["ticker", "sidx"]).where("fwd IS NOT NULL AND sigma_causal IS NOT NULL AND sigma > 0 AND up IS NOT NULL")
    bucket = windows.bucket_label(F.col("fwd") / (F.col("sigma_causal") + F.lit(windows.EPS)))
    placed = numbered(both.select("ticker", "sidx", bucket.alias("bucket"), "sigma", "up", "down"), "ticker", "sidx", windows.CHUNK).where("bucket != 2")
    reached = lambda t: F.when(F.col("bucket") > 2, F.col("down") <= -t * F.col("sigma")).otherwise(F.col("up") >= t * F.col("sigma"))
    first = F.create_map(*(F.lit(v) for pair in ((0, 5), (1, 8), (3, 11), (4, 14)) for v in pair))[F.col("bucket")]
    hits = placed.select("sidx", "pos", "bucket", first.alias("first"), F.posexplode(F.array(*(reached(t).cast("int") for t in (0.5, 1.0, 2.0)))).alias("k", "y"))
    sent = vector_rows(challenge, ticker, width).select("sidx", "hk", vectors.logits(F.col("vec")).alias("l"))
    x = F.element_at("l", (F.col("first") + F.col("k") + 1).cast("int"))
    return hits.join(sent, "sidx").select(F.concat_ws("|", "bucket", "k").alias("model"), "hk", "pos", x.alias("x"), "y")


def hit_rows(challenge: DataFrame, ticker: str, ahead: int, window: int, width: int = 3) -> DataFrame:
    """X15 for X05: (hk, pos, up, down, hit): which barrier of one sigma is hit first (W03, W10) beside the logits of both probabilities."""
    s = windows.core(windows.sigma(readings(challenge, (ticker,)), "ticker", "sidx", "price", ahead, window)).select("ticker", "sidx", "price", F.when(F.col("sigma_noncausal") > 0, F.col("sigma_noncausal")).alias("barrier"))
    hits = numbered(windows.first_barrier(s, "ticker", "sidx", "price", "barrier", ahead).where("first_hit IS NOT NULL").select("ticker", "sidx", "first_hit"), "ticker", "sidx", windows.CHUNK)
    sent = vector_rows(challenge, ticker, width)
    return hits.join(sent, "sidx").select("hk", "pos", vectors.hit_logits(F.col("vec"), 0).alias("up"), vectors.hit_logits(F.col("vec"), 1).alias("down"), F.col("first_hit").alias("hit"))


def hourly_panel(predictions: DataFrame, blocks: DataFrame, prices: DataFrame, step: int = 60, window: int = 720, refresh: int = 24) -> tuple[DataFrame, DataFrame]:
    """X15 for X11: positions (h, hk, asset, pos) and factors (h, asset, weight, beta, r) on a grid of ``step`` minutes.

    An hour counts when all assets have a positive price. Weights are inverse
    volatilities and betas shrunk ones over ``window`` hours before, refreshed
    every ``refresh`` hours; even weights and betas of 1 until then.
    """
    # Cuts keep each step from being computed again by all later ones; from the grid on there is one row per hour and asset.
    prices = cut(prices)
    grid = cut(asof.grid_asof(prices.where("price > 0"), "asset", "sidx", step).select("asset", "sidx", "grid", "price"))
    assets = prices.agg(F.countDistinct("asset")).scalar()
    whole = grid.groupBy("grid").agg(F.countDistinct("asset").alias("n")).where(F.col("n") == assets).select("grid")
    hours = numbered(whole.select(F.lit(0).alias("one"), "grid"), "one", "grid", windows.CHUNK, "h").select("grid", "h")
    hours = cut(hours)
    p = grid.join(hours, "grid").select("asset", "h", "grid", "price")
    placed = windows.blocks(p.select("asset", "h", "price"), "asset", "h", 1)
    r = cut(windows.core(placed.withColumn("r", F.coalesce(F.log(F.col("price") / F.lag("price").over(windows.over("asset"))), F.lit(0.0)))).select("asset", "h", "r"))
    vol = cut(windows.rolling_beta(r.withColumn("market", F.col("r")), "asset", "h", "r", "market", window).select("asset", "h", "vol"))
    inverse = vol.withColumn("inverse", 1 / (F.col("vol") + F.lit(windows.EPS)))
    weight = inverse.join(inverse.groupBy("h").agg(F.sum("inverse").alias("all")), "h").select("h", "asset", (F.col("inverse") / F.col("all")).alias("now"))
    kept = cut(asof.backward_asof(r.join(weight, ["h", "asset"], "left"), "asset", "h", "now", F.col("h") % refresh == 0, "weight").select("asset", "h", "r", F.coalesce("weight", 1 / assets).alias("weight")))
    market = kept.join(kept.groupBy("h").agg(F.sum(F.col("weight") * F.col("r")).alias("market")), "h")
    beta = windows.rolling_beta(market, "asset", "h", "r", "market", window, refresh=refresh)
    factors = beta.select("h", "asset", "weight", F.coalesce("beta_used", F.lit(1.0)).alias("beta"), "r")
    timed = predictions.join(blocks.select(F.col("idx").alias("ts"), F.floor(F.col("block") / 5).cast("long").alias("sidx")), "ts")
    sent = timed.groupBy("hk", "asset", (F.floor(F.col("sidx") / step) * step).alias("grid")).agg(F.max(F.struct("ts", "x"))["x"].alias("pos"))
    start = grid.agg(F.min("grid") % step).scalar()
    return sent.withColumn("grid", F.col("grid") + start).join(hours, "grid").select("h", "hk", "asset", vectors.clip(F.col("pos").cast("double"), -1.0, 1.0).alias("pos")), factors


def asset_rows(predictions: DataFrame, blocks: DataFrame, prices: DataFrame, ahead: int) -> DataFrame:
    """(hk, pos, asset, x, y): predictions (ts, hk, asset, x) beside prices (sidx, asset, price): J01, J03, P05, A12 and the label above the median."""
    timed = predictions.join(blocks.select(F.col("idx").alias("ts"), F.floor(F.col("block") / 5).cast("long").alias("sidx")), "ts")
    sent = timed.groupBy("hk", "sidx", "asset").agg(F.max(F.struct("ts", "x"))["x"].alias("x"))
    gone = asof.row_offset(prices.where("price > 0"), "asset", "sidx", "price", ahead, "later").where("later > 0").select("asset", "sidx", (F.col("later") / F.col("price") - 1).alias("ret"))
    middle = gone.groupBy("sidx").agg(F.median("ret").alias("middle"))
    labelled = gone.join(middle, "sidx").select("asset", "sidx", (F.col("ret") > F.col("middle")).cast("int").alias("y"))
    order = numbered(labelled.select(F.lit(0).alias("one"), "sidx").distinct(), "one", "sidx", windows.CHUNK).select("sidx", "pos")
    return labelled.join(order, "sidx").join(sent, ["sidx", "asset"]).select("hk", "pos", "asset", F.col("x").cast("double").alias("x"), "y")


def decomposed(positions: DataFrame, factors: DataFrame) -> DataFrame:
    """Positions (h, hk, asset, pos) and factors (h, asset, weight, beta): clipped positions, their market part m and residual q = pos - m·beta."""
    p = positions.join(factors, ["h", "asset"]).withColumn("pos", vectors.clip(F.col("pos"), -1.0, 1.0))
    m = p.groupBy("h", "hk").agg(F.sum(F.col("weight") * F.col("pos")).alias("m"))
    return p.join(m, ["h", "hk"]).select("h", "hk", "asset", "pos", "m", (F.col("pos") - F.col("m") * F.col("beta")).alias("q"))


def active_by_spread(q: DataFrame, least: float = 1e-4) -> DataFrame:
    """participants whose residual positions move at all."""
    return q.groupBy("hk").agg(F.stddev_pop("q").alias("spread")).where(F.col("spread") >= least)


def close_pairs(rows: DataFrame, moment: str, who: str, vec: str, eps: float = 1e-3, share: float = 0.99, least: int = 200) -> DataFrame:
    """Pairs of participants whose vectors differ by less than ``eps`` in every element in at least ceil(``share``·joint) of their joint active moments.

    Both need ``least`` active moments, alone and jointly. Counts are summed as
    matrices, block by block; only pairs that are close are listed.
    """
    live = rows.where(vectors.active(F.col(vec))).select(moment, who, F.col(vec).cast("array<double>").alias("_v"))
    busy = live.groupBy(who).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(who)
    named = cut(pairs.slots(busy, who))
    test = lambda t: (t["n_match"] > 0) & (t["n"] >= least) & (t["n_match"] >= np.ceil(share * t["n"]))
    both = pairs.pairwise(live.join(F.broadcast(named), who), [moment], "_slot", F.col("_v"), named.count(), partial(pairs.add_close, eps=eps), ["n", "n_match"], test)
    kept = both.where((F.col("n_match") > 0) & (F.col("n") >= least) & (F.col("n_match") >= F.ceil(F.lit(share) * F.col("n"))))
    a, b = named.select(F.col(who).alias("a"), F.col("_slot").alias("i")), named.select(F.col(who).alias("b"), F.col("_slot").alias("j"))
    return kept.join(F.broadcast(a), "i").join(F.broadcast(b), "j").select("a", "b", F.col("n_match").cast("long").alias("n_match"), F.col("n").cast("long").alias("n_joint"))


def exact_clusters(rows: DataFrame, moment: str, who: str, vec: str, **options: float) -> DataFrame:
    """(member, representative) of participants that submit the same vectors (single linkage)."""
    return similarity.components(close_pairs(rows, moment, who, vec, **options).select("a", "b"))


def means_per_element(rows: DataFrame, who: str, vec: str) -> DataFrame:
    """Mean of each element over a participant's own active rows."""
    flat = rows.where(vectors.active(F.col(vec))).select(who, F.posexplode(vec).alias("d", "v"))
    return flat.groupBy(who, "d").agg(F.avg(F.col("v").cast("double")).alias("mean"))

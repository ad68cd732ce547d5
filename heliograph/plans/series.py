"""Queries on price series: time joins, labels, windows along a source, weights and segments."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.operators import asof, stats, windows
from heliograph.operators.prices import PRICE_TICKERS, readings
from heliograph.sources.tables import read_table

R = lambda c, name=None: F.round(c, 6).alias(name or c)


def _readings(spark: SparkSession, d: str) -> DataFrame:
    return readings(read_table(spark, d, "challenge_data"))


def exact_key_forward_return(spark: SparkSession, d: str) -> DataFrame:
    r = asof.offset_join(_readings(spark, d), "ticker", "sidx", "price", 60, "later")
    return r.select("ticker", "sidx", R((F.col("later") - F.col("price")) / F.col("price"), "ret"))


def positional_forward_return(spark: SparkSession, d: str) -> DataFrame:
    r = asof.row_offset(_readings(spark, d), "ticker", "sidx", "price", 60, "later")
    return r.select("ticker", "sidx", R(F.col("later") / F.col("price") - 1, "ret"))


def nearest_asof_tolerance(spark: SparkSession, d: str) -> DataFrame:
    r = asof.nearest_asof(_readings(spark, d), "ticker", "sidx", "price", 480)
    return r.select("ticker", "sidx", "at_order", "at_value")


def forward_grid_asof(spark: SparkSession, d: str) -> DataFrame:
    return asof.grid_asof(_readings(spark, d), "ticker", "sidx", 60).select("ticker", "sidx", "grid", "price")


def backward_asof_refresh(spark: SparkSession, d: str) -> DataFrame:
    r = asof.backward_asof(_readings(spark, d), "ticker", "sidx", "price", F.col("sidx") % 24 == 0, "refreshed")
    return r.select("ticker", "sidx", "refreshed")


def xsec_median_label(spark: SparkSession, d: str) -> DataFrame:
    r = asof.offset_join(_readings(spark, d), "ticker", "sidx", "price", 60, "later").where("later IS NOT NULL")
    r = r.select("ticker", "sidx", ((F.col("later") - F.col("price")) / F.col("price")).alias("ret"))
    m = r.groupBy("sidx").agg(F.median("ret").alias("med"))
    return r.join(m, "sidx").select("ticker", "sidx", R("med"), (F.col("ret") > F.col("med")).alias("label"))


def rolling_sigma(spark: SparkSession, d: str) -> DataFrame:
    s = windows.core(windows.sigma(_readings(spark, d), "ticker", "sidx", "price", 30, 240))
    return s.select("ticker", "sidx", R("sigma_noncausal"), R("sigma_causal"))


def bucket_label(spark: SparkSession, d: str) -> DataFrame:
    s = windows.core(windows.sigma(_readings(spark, d), "ticker", "sidx", "price", 30, 240))
    return s.where("fwd IS NOT NULL AND sigma_causal IS NOT NULL").select("ticker", "sidx", windows.bucket_label(F.round(F.col("fwd") / (F.col("sigma_causal") + windows.EPS), 6)).alias("bucket"))


def range_minmax_key(spark: SparkSession, d: str) -> DataFrame:
    r = windows.trailing_range(_readings(spark, d), "ticker", "sidx", "price", 720)
    return r.select("ticker", "sidx", "range_low", "range_high", F.col("range_n").cast("long").alias("range_n"))


def path_extremes_threshold_hits(spark: SparkSession, d: str) -> DataFrame:
    r = windows.path_extremes(_readings(spark, d), "ticker", "sidx", "price", 30)
    hits = [F.when(F.col("up").isNotNull(), (F.round(F.col("up"), 9) >= t).cast("int")).alias(f"hit_{int(t * 10000)}") for t in (0.0005, 0.001, 0.002)]
    return r.select("ticker", "sidx", R("up"), R("down"), *hits)


def forward_sum_window(spark: SparkSession, d: str) -> DataFrame:
    placed = windows.blocks(_readings(spark, d), "ticker", "sidx", 13)
    w = windows.over("ticker")
    step = placed.withColumn("y", F.coalesce(F.log(F.col("price") / F.lag("price").over(w)), F.lit(0.0)))
    return windows.core(step.withColumn("ahead_sum", windows.forward_sum(F.col("y"), 12, w))).select("ticker", "sidx", R("ahead_sum"))


def unchanged_streak(spark: SparkSession, d: str) -> DataFrame:
    return windows.unchanged_streak(_readings(spark, d), "ticker", "sidx", "price").select("ticker", "sidx", "streak")


def first_barrier_hit(spark: SparkSession, d: str) -> DataFrame:
    s = windows.core(windows.sigma(_readings(spark, d), "ticker", "sidx", "price", 30, 240)).select("ticker", "sidx", "price", F.round("sigma_noncausal", 6).alias("barrier"))
    return windows.first_barrier(s, "ticker", "sidx", "price", "barrier", 40).select("ticker", "sidx", "first_hit")


def episodes_gap(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events").select("user_id", "event_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long").alias("second"))
    # Episodes are those of the different seconds; all events of a second are in its episode.
    e = e.join(windows.episodes(e.select("user_id", "second").distinct(), "user_id", "second", 86_400), ["user_id", "second"])
    n = e.groupBy("user_id", "episode").agg(F.count("*").alias("n"))
    t = n.groupBy("user_id").agg(F.sum("n").alias("rows"), F.count("*").alias("episodes"))
    return e.join(n, ["user_id", "episode"]).join(t, "user_id").select("user_id", "event_id", F.col("episode").cast("long").alias("episode"), R(F.col("rows") / (F.col("n") * F.col("episodes")), "weight"))


def time_decay_weights(spark: SparkSession, d: str) -> DataFrame:
    return windows.decay_weights(_readings(spark, d), "ticker", "sidx", 1440, 15).select("ticker", "sidx", R("weight"))


def recent_mass_weights(spark: SparkSession, d: str) -> DataFrame:
    return windows.recent_mass_weights(_readings(spark, d), "ticker", "sidx", 2000, 0.5).select("ticker", "sidx", R("weight"))


def trailing_and_day_windows(spark: SparkSession, d: str) -> DataFrame:
    r = windows.row_windows(windows.trailing_rows(_readings(spark, d), "ticker", "sidx", 5000), "ticker", "sidx", 1440)
    return r.groupBy("ticker", "window_no").agg(F.count("*").alias("n"), F.min("sidx").alias("first_sidx"), F.max("sidx").alias("last_sidx"))


def walk_forward_segments(spark: SparkSession, d: str) -> DataFrame:
    from heliograph.operators.sequence import numbered

    r = numbered(_readings(spark, d), "ticker", "sidx", windows.CHUNK)
    # W21/J21 without a table of segments: these have one length, so a row's position names its segment, however many rows a ticker has.
    placed = r.where("pos >= 200").withColumn("segment", F.floor((F.col("pos") - 200) / 150).cast("long")).withColumn("fit_end", 200 + F.col("segment") * 150 - 60)
    return placed.groupBy("ticker", "segment").agg(F.count("*").alias("n"), F.min("sidx").alias("from_sidx"), F.max("fit_end").alias("fit_end"))


def beta_mixed_ddof(spark: SparkSession, d: str) -> DataFrame:
    r = asof.offset_join(_readings(spark, d), "ticker", "sidx", "price", 1, "later").where("later IS NOT NULL")
    r = r.select("ticker", "sidx", F.log(F.col("later") / F.col("price")).alias("own"))
    m = r.groupBy("sidx").agg(F.avg("own").alias("market"))
    b = windows.rolling_beta(r.join(m, "sidx"), "ticker", "sidx", "own", "market", 240)
    return b.select("ticker", "sidx", F.round("beta", 4).alias("beta"), F.round("vol", 8).alias("vol"))


def auc_weights_daily(spark: SparkSession, d: str) -> DataFrame:
    """Which users' daily values ranked the next day's direction of their event type, and what weight each earns."""
    e = read_table(spark, d, "events").select("user_id", "event_type", "value", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000).cast("long").alias("day"))
    panel = e.groupBy("event_type", "day").agg(F.avg("value").alias("level"))
    ahead = asof.offset_join(panel, "event_type", "day", "level", 1, "later").where("later IS NOT NULL")
    labelled = e.join(ahead.select("event_type", "day", (F.round("later", 9) > F.round("level", 9)).alias("up")), ["event_type", "day"])
    scored = stats.auc(labelled, ["user_id"], "value", F.col("up"))
    weight = stats.normalise(scored.withColumn("gain", stats.auc_scale(F.col("auc"))), [], "gain", "weight")
    return weight.select("user_id", F.col("n1").cast("long").alias("n1"), F.col("n0").cast("long").alias("n0"), R("auc"), R("weight"))


def zero_is_positive(sql: dict[str, str]) -> dict[str, str]:
    """Rounded results of the SQL as Spark gives them: a small negative value rounds to 0.0, never to -0.0."""
    return {name: re.sub(r", ([4689])\) AS (?!INT)", r", \1) + 0e0 AS ", text) for name, text in sql.items()}


QUERIES = {
    f.__name__: f
    for f in (
        exact_key_forward_return,
        positional_forward_return,
        nearest_asof_tolerance,
        forward_grid_asof,
        backward_asof_refresh,
        xsec_median_label,
        rolling_sigma,
        bucket_label,
        range_minmax_key,
        path_extremes_threshold_hits,
        forward_sum_window,
        unchanged_streak,
        first_barrier_hit,
        episodes_gap,
        time_decay_weights,
        recent_mass_weights,
        trailing_and_day_windows,
        walk_forward_segments,
        beta_mixed_ddof,
        auc_weights_daily,
    )
}

_TICKERS = ", ".join(f"'{t}'" for t in PRICE_TICKERS)
BASE = f"r AS (SELECT ticker, sidx, arg_max(price, (ts, price)) AS price FROM challenge_data WHERE ticker IN ({_TICKERS}) AND sidx IS NOT NULL AND price IS NOT NULL AND NOT isnan(price) AND price > 0 AND price < 'inf'::DOUBLE GROUP BY ticker, sidx)"
_SIGMA = """f AS (SELECT *, ln(price + 1e-12) AS lp, lead(ln(price + 1e-12), 30) OVER w - ln(price + 1e-12) AS fwd FROM r WINDOW w AS (PARTITION BY ticker ORDER BY sidx)),
s AS (SELECT *, CASE WHEN count(fwd) OVER (PARTITION BY ticker ORDER BY sidx ROWS BETWEEN 239 PRECEDING AND CURRENT ROW) = 240 THEN stddev_samp(fwd) OVER (PARTITION BY ticker ORDER BY sidx ROWS BETWEEN 239 PRECEDING AND CURRENT ROW) END AS sn FROM f),
c AS (SELECT *, lag(sn, 30) OVER (PARTITION BY ticker ORDER BY sidx) AS sc FROM s)"""
_NUM = "row_number() OVER (PARTITION BY ticker ORDER BY sidx)"

SQL = {
    "exact_key_forward_return": f"WITH {BASE} SELECT a.ticker, a.sidx, round((b.price - a.price) / a.price, 6) AS ret FROM r a LEFT JOIN r b ON a.ticker = b.ticker AND b.sidx = a.sidx + 60",
    "positional_forward_return": f"WITH {BASE} SELECT ticker, sidx, round(lead(price, 60) OVER (PARTITION BY ticker ORDER BY sidx) / price - 1, 6) AS ret FROM r",
    "nearest_asof_tolerance": f"""WITH {BASE}, m AS (SELECT a.ticker, a.sidx, b.sidx AS at_order, b.price AS at_value, row_number() OVER (PARTITION BY a.ticker, a.sidx ORDER BY abs(b.sidx - a.sidx - 480), b.sidx) AS k
      FROM r a JOIN r b ON a.ticker = b.ticker AND b.sidx BETWEEN a.sidx + 408 AND a.sidx + 552 AND b.sidx > a.sidx)
      SELECT r.ticker, r.sidx, at_order, at_value FROM r LEFT JOIN m ON r.ticker = m.ticker AND r.sidx = m.sidx AND k = 1""",
    "forward_grid_asof": f"""WITH {BASE}, f AS (SELECT *, min(sidx) OVER (PARTITION BY ticker) AS f0 FROM r), g AS (SELECT *, f0 + (sidx - f0) // 60 * 60 AS grid FROM f)
      SELECT ticker, sidx, grid, price FROM (SELECT *, min(sidx) OVER (PARTITION BY ticker, grid) AS s0 FROM g) WHERE sidx = s0 AND sidx - grid <= 10""",
    "backward_asof_refresh": f"WITH {BASE} SELECT ticker, sidx, last_value(CASE WHEN sidx % 24 = 0 THEN price END IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY sidx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS refreshed FROM r",
    "xsec_median_label": f"WITH {BASE}, x AS (SELECT a.ticker, a.sidx, (b.price - a.price) / a.price AS ret FROM r a JOIN r b ON a.ticker = b.ticker AND b.sidx = a.sidx + 60), m AS (SELECT sidx, median(ret) AS med FROM x GROUP BY sidx) SELECT ticker, x.sidx, round(med, 6) AS med, ret > med AS label FROM x JOIN m ON x.sidx = m.sidx",
    "rolling_sigma": f"WITH {BASE}, {_SIGMA} SELECT ticker, sidx, round(sn, 6) AS sigma_noncausal, round(sc, 6) AS sigma_causal FROM c",
    "bucket_label": f"WITH {BASE}, {_SIGMA}, z AS (SELECT ticker, sidx, round(fwd / (sc + 1e-12), 6) AS z FROM c WHERE fwd IS NOT NULL AND sc IS NOT NULL) SELECT ticker, sidx, CASE WHEN z <= -2 THEN 0 WHEN z < -1 THEN 1 WHEN z <= 1 THEN 2 WHEN z < 2 THEN 3 ELSE 4 END AS bucket FROM z",
    "range_minmax_key": f"WITH {BASE} SELECT ticker, sidx, min(price) OVER w AS range_low, max(price) OVER w AS range_high, count(price) OVER w AS range_n FROM r WINDOW w AS (PARTITION BY ticker ORDER BY sidx RANGE BETWEEN 720 PRECEDING AND 1 PRECEDING)",
    "path_extremes_threshold_hits": f"""WITH {BASE}, f AS (SELECT *, ln(price + 1e-12) AS lp FROM r), p AS (SELECT ticker, sidx, count(*) OVER w AS n, max(lp) OVER w - lag(lp) OVER (PARTITION BY ticker ORDER BY sidx) AS u, min(lp) OVER w - lag(lp) OVER (PARTITION BY ticker ORDER BY sidx) AS d FROM f WINDOW w AS (PARTITION BY ticker ORDER BY sidx ROWS BETWEEN CURRENT ROW AND 30 FOLLOWING)),
      q AS (SELECT ticker, sidx, CASE WHEN n = 31 THEN u END AS u, CASE WHEN n = 31 THEN d END AS d FROM p)
      SELECT ticker, sidx, round(u, 6) AS up, round(d, 6) AS down, CAST(round(u, 9) >= 5e-4 AS INT) AS hit_5, CAST(round(u, 9) >= 1e-3 AS INT) AS hit_10, CAST(round(u, 9) >= 2e-3 AS INT) AS hit_20 FROM q""",
    "forward_sum_window": f"WITH {BASE}, y AS (SELECT ticker, sidx, coalesce(ln(price / lag(price) OVER (PARTITION BY ticker ORDER BY sidx)), 0) AS y FROM r) SELECT ticker, sidx, round(CASE WHEN count(*) OVER w = 12 THEN sum(y) OVER w END, 6) AS ahead_sum FROM y WINDOW w AS (PARTITION BY ticker ORDER BY sidx ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING)",
    "unchanged_streak": f"WITH {BASE}, n AS (SELECT *, CASE WHEN price = lag(price) OVER (PARTITION BY ticker ORDER BY sidx) THEN 0 ELSE 1 END AS new FROM r), i AS (SELECT *, sum(new) OVER (PARTITION BY ticker ORDER BY sidx) AS island FROM n) SELECT ticker, sidx, row_number() OVER (PARTITION BY ticker, island ORDER BY sidx) AS streak FROM i",
    "first_barrier_hit": f"""WITH {BASE}, {_SIGMA}, n AS (SELECT ticker, sidx, lp, round(sn, 6) AS b, {_NUM} AS k, count(*) OVER (PARTITION BY ticker) AS total FROM s),
      h AS (SELECT a.ticker, a.k, min(CASE WHEN c.lp - a.lp >= a.b THEN c.k END) AS u, min(CASE WHEN c.lp - a.lp <= -a.b THEN c.k END) AS d FROM n a JOIN n c ON a.ticker = c.ticker AND c.k BETWEEN a.k + 1 AND a.k + 40 WHERE a.b IS NOT NULL GROUP BY a.ticker, a.k)
      SELECT n.ticker, n.sidx, CASE WHEN b IS NULL OR n.k + 40 > total THEN NULL WHEN u IS NOT NULL AND (d IS NULL OR u < d) THEN 0 WHEN d IS NOT NULL AND (u IS NULL OR d < u) THEN 1 ELSE 2 END AS first_hit FROM n LEFT JOIN h ON n.ticker = h.ticker AND n.k = h.k""",
    "episodes_gap": """WITH e AS (SELECT user_id, epoch_us(ts) // 1000000 AS s, event_id FROM events), g AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY user_id ORDER BY s, event_id) > 86400 THEN 1 ELSE 0 END AS cut FROM e),
      i AS (SELECT *, CAST(sum(cut) OVER (PARTITION BY user_id ORDER BY s, event_id) AS BIGINT) AS episode FROM g), t AS (SELECT user_id, count(*) AS n, max(episode) + 1 AS k FROM i GROUP BY user_id)
      SELECT i.user_id, event_id, episode, round(t.n / (count(*) OVER (PARTITION BY i.user_id, episode) * t.k), 6) AS weight FROM i JOIN t ON i.user_id = t.user_id""",
    "time_decay_weights": f"WITH {BASE}, a AS (SELECT ticker, sidx, exp(-ln(2e0) * (count(*) OVER (PARTITION BY ticker) - {_NUM} + 1) / (1440e0 * 15)) AS w FROM r) SELECT ticker, sidx, round(w / avg(w) OVER (PARTITION BY ticker), 6) AS weight FROM a",
    "recent_mass_weights": f"""WITH {BASE}, a AS (SELECT *, sidx >= max(sidx) OVER (PARTITION BY ticker) - 1999 AS recent FROM r), c AS (SELECT *, count(*) FILTER (recent) OVER (PARTITION BY ticker) AS nr, count(*) FILTER (NOT recent) OVER (PARTITION BY ticker) AS n_old FROM a),
      w AS (SELECT ticker, sidx, CASE WHEN recent AND n_old > 0 THEN 0.5e0 * n_old / (0.5e0 * nr) ELSE 1e0 END AS w FROM c) SELECT ticker, sidx, round(w / avg(w) OVER (PARTITION BY ticker), 6) AS weight FROM w""",
    "trailing_and_day_windows": f"WITH {BASE}, a AS (SELECT ticker, sidx, row_number() OVER (PARTITION BY ticker ORDER BY sidx DESC) AS k FROM r), b AS (SELECT ticker, sidx, ({_NUM} - 1) // 1440 AS window_no FROM a WHERE k <= 5000) SELECT ticker, window_no, count(*) AS n, min(sidx) AS first_sidx, max(sidx) AS last_sidx FROM b GROUP BY ALL",
    "walk_forward_segments": f"WITH {BASE}, a AS (SELECT ticker, sidx, {_NUM} - 1 AS pos FROM r) SELECT ticker, (pos - 200) // 150 AS segment, count(*) AS n, min(sidx) AS from_sidx, max(200 + (pos - 200) // 150 * 150 - 60) AS fit_end FROM a WHERE pos >= 200 GROUP BY ALL",
    "beta_mixed_ddof": f"""WITH {BASE}, x AS (SELECT a.ticker, a.sidx, ln(b.price / a.price) AS own FROM r a JOIN r b ON a.ticker = b.ticker AND b.sidx = a.sidx + 1), y AS (SELECT *, avg(own) OVER (PARTITION BY sidx) AS market FROM x)
      SELECT ticker, sidx, round(CASE WHEN count(*) OVER w = 240 THEN 0.7e0 * covar_samp(own, market) OVER w / (var_pop(market) OVER w + 1e-12) + 0.3e0 END, 4) AS beta, round(CASE WHEN count(*) OVER w = 240 THEN stddev_pop(own) OVER w END, 8) AS vol FROM y WINDOW w AS (PARTITION BY ticker ORDER BY sidx ROWS BETWEEN 240 PRECEDING AND 1 PRECEDING)""",
    "auc_weights_daily": """WITH e AS (SELECT user_id, event_type, value, epoch_us(ts) // 86400000000 AS day FROM events), p AS (SELECT event_type, day, avg(value) AS level FROM e GROUP BY ALL),
      l AS (SELECT a.event_type, a.day, round(b.level, 9) > round(a.level, 9) AS up FROM p a JOIN p b ON a.event_type = b.event_type AND b.day = a.day + 1), x AS (SELECT user_id, value, up FROM e JOIN l ON e.event_type = l.event_type AND e.day = l.day),
      k AS (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY value) + (count(*) OVER (PARTITION BY user_id, value) - 1) / 2e0 AS rk FROM x),
      s AS (SELECT user_id, count(*) FILTER (up) AS n1, count(*) FILTER (NOT up) AS n0, sum(rk) FILTER (up) AS sr FROM k GROUP BY user_id),
      a AS (SELECT user_id, n1, n0, CASE WHEN n1 > 0 AND n0 > 0 THEN (sr - n1 * (n1 + 1) / 2e0) / (n1 * n0) END AS auc FROM s), g AS (SELECT *, greatest((coalesce(auc, 0.5e0) - 0.5e0) / 0.5e0, 0) AS gain FROM a)
      SELECT user_id, n1, n0, round(auc, 6) AS auc, round(gain / sum(gain) OVER (), 6) AS weight FROM g""",
}
SQL = zero_is_positive(SQL)

"""Queries without SQL: replayed and streamed events, fits, evidence and scorers (checked by planted truth and brute force in tests)."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from heliograph.operators import asof, builders, events, fits, flatten, scorers, similarity, windows
from heliograph.operators.ingest import latest, parsed_map, positive_entries
from heliograph.operators.prices import readings
from heliograph.operators.sequence import numbered
from heliograph.session import cut, shared_folder
from heliograph.sources.tables import read_table
from heliograph.streaming import ingest, tracker

_TRACK = {"lookback": 240, "barrier": 0.25, "least_range": 0.001, "stale": 720}


def _signals(spark: SparkSession, d: str) -> DataFrame:
    """Users as participants: their daily mean per event type as signal, the next day's direction as label."""
    e = read_table(spark, d, "events").select("user_id", "event_type", "value", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000).cast("long").alias("hour"))
    level = e.groupBy("event_type", "hour").agg(F.avg("value").alias("level"))
    up = asof.offset_join(level, "event_type", "hour", "level", 1, "later").where("later IS NOT NULL").select("event_type", "hour", (F.col("later") > F.col("level")).cast("int").alias("y"))
    return e.join(up, ["event_type", "hour"]).withColumn("first", e.agg(F.min("hour")).scalar()).groupBy(F.col("user_id").cast("string").alias("hk"), (F.col("hour") - F.col("first")).alias("pos"), F.col("event_type").alias("asset")).agg(F.avg("value").alias("x"), F.max("y").alias("y"))


def breakout_replay(spark: SparkSession, d: str) -> DataFrame:
    return events.replay(readings(read_table(spark, d, "challenge_data")), "ticker", "sidx", "price", **_TRACK)


def _stream(spark: SparkSession, d: str) -> DataFrame:
    return spark.readStream.schema("ticker string, sidx bigint, price double, ts bigint").option("maxFilesPerTrigger", 64).parquet(f"{d}/challenge_data.parquet*").where("price > 0 AND price < double('infinity') AND sidx IS NOT NULL")


def _folder(spark: SparkSession) -> str:
    """A new folder in the place all executors share."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def breakout_stream(spark: SparkSession, d: str) -> DataFrame:
    """The live tracker over the price table read as a stream, run to its end into a table of the shared folder."""
    folder = _folder(spark)
    events_ = tracker.track(_stream(spark, d), "ticker", "sidx", "price", **_TRACK)
    writer = events_.writeStream.format("parquet").option("path", f"{folder}/table").option("checkpointLocation", f"{folder}/checkpoint")
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(events_.schema).parquet(f"{folder}/table")


def late_upsert_stream(spark: SparkSession, d: str) -> DataFrame:
    """Keyed late upserts through foreachBatch; equal to the batch upsert of the same rows."""
    folder = _folder(spark)
    ingest.start_upsert(_stream(spark, d), f"{folder}/table", f"{folder}/checkpoint", ["ticker", "sidx"], "ts", ["price"]).awaitTermination()
    return ingest.read_upserted(spark, f"{folder}/table", ["ticker", "sidx"], "ts", ["price"])


def univariate_fits(spark: SparkSession, d: str) -> DataFrame:
    return fits.univariate(_signals(spark, d), ["hk"], "x", "y", least=20)


def walk_forward_oos(spark: SparkSession, d: str) -> DataFrame:
    s = cut(_signals(spark, d))
    last = s.agg(F.max("pos")).first()[0]
    return fits.walk_forward_scores(s, "hk", "pos", "x", "y", windows.segments(spark, 200, 200 if last is None else last + 1, 200, 2), least=20)


def meta_importance(spark: SparkSession, d: str) -> DataFrame:
    r = asof.row_offset(readings(read_table(spark, d, "challenge_data")), "ticker", "sidx", "price", 30, "later").where("later IS NOT NULL")
    x = numbered(r, "ticker", "sidx", windows.CHUNK).withColumn("y", (F.col("later") > F.col("price")).cast("int"))
    panel = x.select("ticker", "pos", "y", F.log("price").alias("v0"), (F.col("sidx") % 60).cast("double").alias("v1"))
    return fits.bootstrap_importance(panel.withColumn("v1", F.col("v1") / 60), ["ticker"], "pos", ["v0", "v1"], "y", replicates=8, block=120)


def circular_shift_evidence(spark: SparkSession, d: str) -> DataFrame:
    r = numbered(readings(read_table(spark, d, "challenge_data")), "ticker", "sidx", windows.CHUNK)
    placed = windows.blocks(r.drop("pos"), "ticker", "sidx", 14)
    w = windows.over("ticker")
    step = placed.withColumn("y", F.coalesce(F.log(F.col("price") / F.lag("price").over(w)), F.lit(0.0)))
    ready = windows.core(step.withColumn("ahead", F.coalesce(windows.forward_sum(F.col("y"), 12, w), F.lit(0.0))))
    return fits.shift_evidence(ready, "ticker", "pos", "y", ["ahead"], [1.0], 96)


def linked_cohorts(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events").withColumn("day", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000))
    shares = similarity.match_share(e, ["day", "event_type"], "user_id", F.round("value", 1), 2, 0.05)
    return fits.linked_clusters(shares, "a", "b", "share", "component", 0.95)


def score_binary(spark: SparkSession, d: str) -> DataFrame:
    """Signals of users: a day has 24 rows here."""
    s = _signals(spark, d).groupBy("hk", "pos").agg(F.avg("x").alias("x"), F.max("y").alias("y"))
    return scorers.score("binary", s, chunk=200, lag=2, window=72, refit=120, fit_rows=720, per_day=24, least_rows=5, least_windows=2)


def score_cross_section(spark: SparkSession, d: str) -> DataFrame:
    """Cohorts of users as participants: a single user has too few hours for a model."""
    s = _signals(spark, d).groupBy(F.pmod(F.col("hk").cast("int"), F.lit(25)).cast("string").alias("hk"), "pos", "asset").agg(F.avg("x").alias("x"), F.max("y").alias("y"))
    return scorers.score("xsec_rank", s, chunk=120, lag=2)


def _tasks(spark: SparkSession, d: str, kind: str) -> list[Row]:
    """Ticker, width and horizon (minutes) of the tasks of a loss function: rows of the specification, which has twelve."""
    spec = read_table(spark, d, "task_spec").where(F.col("loss_func") == kind)
    return spec.select("ticker", "dim", F.coalesce("blocks_ahead", F.lit(300.0)).cast("int").alias("blocks"), F.coalesce(F.col("params")["window_rows"].cast("int"), F.lit(240)).alias("window")).orderBy("ticker").collect()


def _each(spark: SparkSession, d: str, kind: str, build: Callable[[Row], DataFrame]) -> DataFrame:
    """The rows of every task of a loss function, beside its ticker."""
    return reduce(DataFrame.unionByName, [build(t).withColumn("ticker", F.lit(t.ticker)) for t in _tasks(spark, d, kind)])


def binary_training_rows(spark: SparkSession, d: str) -> DataFrame:
    challenge = read_table(spark, d, "challenge_data")
    return _each(spark, d, "binary", lambda t: builders.binary_rows(challenge, t.ticker, t.blocks, t.dim))


def score_binary_task(spark: SparkSession, d: str) -> DataFrame:
    """All binary tasks; an hour of rows takes the place of a day, as the tables span days, not months."""
    rows = cut(binary_training_rows(spark, d))
    score = lambda t: scorers.score("binary", rows.where(F.col("ticker") == t.ticker).drop("ticker"), window=60, refit=300, fit_rows=1800, per_day=60, least_rows=10, chunk=240)
    return _each(spark, d, "binary", score)


def bucket_training_rows(spark: SparkSession, d: str) -> DataFrame:
    challenge = read_table(spark, d, "challenge_data")
    return _each(spark, d, "lbfgs", lambda t: builders.bucket_rows(challenge, t.ticker, t.blocks // 5, t.window, width=t.dim))


def score_bucket_task(spark: SparkSession, d: str) -> DataFrame:
    rows = cut(bucket_training_rows(spark, d))
    score = lambda t: scorers.score("lbfgs", rows.where(F.col("ticker") == t.ticker).drop("ticker"), warm_up=300, chunk=240, longest=720)
    return _each(spark, d, "lbfgs", score)


def score_q_path_task(spark: SparkSession, d: str) -> DataFrame:
    challenge = read_table(spark, d, "challenge_data")
    return _each(spark, d, "lbfgs", lambda t: scorers.score("q_path", builders.q_path_rows(challenge, t.ticker, t.blocks // 5, t.window, t.dim)))


def hit_training_rows(spark: SparkSession, d: str) -> DataFrame:
    """Barrier hits of both vector tasks by their first elements (the hit-first task has no vectors in these tables)."""
    challenge = read_table(spark, d, "challenge_data")
    return _each(spark, d, "lbfgs", lambda t: builders.hit_rows(challenge, t.ticker, 100, t.window, t.dim))


def score_hit_task(spark: SparkSession, d: str) -> DataFrame:
    rows = cut(hit_training_rows(spark, d))
    return _each(spark, d, "lbfgs", lambda t: scorers.score("hitfirst", rows.where(F.col("ticker") == t.ticker).drop("ticker")))


def _sent(spark: SparkSession, d: str) -> DataFrame:
    """(ticker, ts, hk, asset, x): what participants sent for the assets of each multi-asset task."""
    flat = flatten.flat_predictions(flatten.payload_branches(read_table(spark, d, "raw_payloads"), flatten.names_of(read_table(spark, d, "task_spec"))))
    x = F.regexp_extract("value", r"-?[0-9.]+(?:[eE][-+]?[0-9]+)?", 0).try_cast("double")
    return flat.where("value IS NOT NULL").select(F.col("branch").alias("ticker"), "ts", F.col("root").alias("hk"), F.col("leaf").alias("asset"), x.alias("x"))


def _asset_prices(spark: SparkSession, d: str) -> DataFrame:
    """(ticker, asset, sidx, price): newest usable entry of the price maps."""
    maps = read_table(spark, d, "challenge_data").where("price_data IS NOT NULL AND sidx IS NOT NULL").select("ticker", "sidx", "ts", F.explode(positive_entries(parsed_map(F.col("price_data")))).alias("asset", "price"))
    return latest(maps, ["ticker", "asset", "sidx"], "ts", ["price"]).select("ticker", "asset", "sidx", "price")


_MAP_TASKS = ("MULTIXSEC", "FUNDINGXSEC", "TRADEMIX")


def asset_training_rows(spark: SparkSession, d: str) -> DataFrame:
    sent, prices, blocks = cut(_sent(spark, d)), cut(_asset_prices(spark, d)), read_table(spark, d, "blocks")
    of = lambda df, t: df.where(F.col("ticker") == t).drop("ticker")
    return reduce(DataFrame.unionByName, [builders.asset_rows(of(sent, t), blocks, of(prices, t), 12).withColumn("ticker", F.lit(t)) for t in _MAP_TASKS])


def score_asset_tasks(spark: SparkSession, d: str) -> DataFrame:
    """X08 and X09 on the two ranked tasks."""
    rows = cut(asset_training_rows(spark, d))
    of = lambda t: rows.where(F.col("ticker") == t).drop("ticker")
    parts = (("MULTIXSEC", scorers.score("xsec_rank", of("MULTIXSEC"), chunk=24, lag=2, least_rows=50)), ("FUNDINGXSEC", scorers.score("funding_xsec", of("FUNDINGXSEC"), ahead=6, chunk=12, lag=2, least_rows=50)))
    return parts[0][1].withColumn("ticker", F.lit(parts[0][0])).unionByName(parts[1][1].withColumn("ticker", F.lit(parts[1][0])))


def score_trade_mix(spark: SparkSession, d: str) -> DataFrame:
    """X11 on a grid of ten minutes instead of hours."""
    of = lambda df: df.where("ticker = 'TRADEMIX'").drop("ticker")
    positions, factors = builders.hourly_panel(of(_sent(spark, d)), read_table(spark, d, "blocks"), of(_asset_prices(spark, d)), 10, 48, 6)
    return scorers.score("trade_mix_panel", positions, factors=cut(factors), least_shift=24, least_age=24, least_cover=0.1)


def same_vector_clusters(spark: SparkSession, d: str) -> DataFrame:
    challenge = read_table(spark, d, "challenge_data")
    return _each(spark, d, "lbfgs", lambda t: builders.exact_clusters(builders.vector_rows(challenge, t.ticker, t.dim), "sidx", "hk", "vec", eps=0.02, share=0.5, least=2))


QUERIES = {
    f.__name__: f
    for f in (breakout_replay, breakout_stream, late_upsert_stream, univariate_fits, walk_forward_oos, meta_importance, circular_shift_evidence, linked_cohorts, score_binary, score_cross_section, binary_training_rows, score_binary_task, bucket_training_rows, score_bucket_task, score_q_path_task, hit_training_rows, score_hit_task, asset_training_rows, score_asset_tasks, score_trade_mix, same_vector_clusters)
}
_NAMES = "names AS (SELECT ticker, unnest([ticker, name]) AS k FROM task_spec WHERE assets IS NOT NULL AND ticker IN ('MULTIXSEC', 'FUNDINGXSEC', 'TRADEMIX'))"
#: The streamed upsert equals the batch upsert, whose SQL is this.
SQL = {
    "late_upsert_stream": "SELECT ticker, sidx, max(ts) AS ts, arg_max(price, (ts, price)) AS price FROM challenge_data WHERE price > 0 AND NOT isnan(price) AND price < 'inf'::DOUBLE AND sidx IS NOT NULL GROUP BY ticker, sidx",
    "asset_training_rows": f"""
WITH {_NAMES}, pay AS (SELECT ts, hotkey, CASE WHEN json_type(j) = 'ARRAY' THEN json_extract(j, '$[0]') ELSE j END AS j FROM (SELECT ts, hotkey, TRY_CAST(payload AS JSON) AS j FROM raw_payloads WHERE json_valid(payload))),
  sent AS (SELECT ts, hotkey, CASE WHEN json_type(j, '$.C.ct') = 'VARCHAR' THEN TRY_CAST(json_extract_string(j, '$.C.ct') AS JSON) ELSE json_extract(j, '$.C.ct') END AS ct FROM pay),
  tasks AS (SELECT ts, hotkey, ticker, CASE WHEN json_type(e.value, '$.assets') = 'OBJECT' THEN json_extract(e.value, '$.assets') ELSE e.value END AS v FROM sent, json_each(ct) e JOIN names ON e.key = k WHERE json_type(ct) = 'OBJECT'),
  leaves AS (SELECT ts, hotkey, ticker, e.key AS asset, json_extract_string(e.value, '$') AS value FROM tasks, json_each(v) e WHERE json_type(v) = 'OBJECT' AND e.type != 'NULL'
    UNION ALL SELECT ts, hotkey, ticker, json_extract_string(e.value, '$.asset'), json_extract_string(e.value, '$.val') FROM tasks, json_each(v) e WHERE json_type(v) = 'ARRAY' AND coalesce(json_type(e.value, '$.val'), 'NULL') != 'NULL'),
  x AS (SELECT *, TRY_CAST(regexp_extract(value, '-?[0-9.]+(?:[eE][-+]?[0-9]+)?') AS DOUBLE) AS x FROM leaves),
  timed AS (SELECT ticker, hotkey AS hk, block // 5 AS sidx, asset, max(struct_pack(a := ts, x := x)).x AS x FROM x JOIN blocks ON x.ts = idx GROUP BY ALL),
  maps AS (SELECT ticker, sidx, ts, j.key AS asset, TRY_CAST(j.value AS DOUBLE) AS v FROM challenge_data, json_each(price_data) j WHERE price_data IS NOT NULL AND json_valid(price_data) AND sidx IS NOT NULL),
  p AS (SELECT ticker, asset, sidx, max(struct_pack(a := ts, v := v)).v AS price FROM maps WHERE v > 0 AND NOT isnan(v) AND v < 'inf'::DOUBLE AND ticker IN ('MULTIXSEC', 'FUNDINGXSEC', 'TRADEMIX') GROUP BY ALL),
  g AS (SELECT * FROM (SELECT *, lead(price, 12) OVER (PARTITION BY ticker, asset ORDER BY sidx) / price - 1 AS ret FROM p) WHERE ret IS NOT NULL),
  l AS (SELECT ticker, asset, sidx, CAST(ret > median(ret) OVER (PARTITION BY ticker, sidx) AS INT) AS y FROM g),
  o AS (SELECT ticker, sidx, row_number() OVER (PARTITION BY ticker ORDER BY sidx) - 1 AS pos FROM (SELECT DISTINCT ticker, sidx FROM l))
SELECT l.ticker, hk, pos, l.asset, x, y FROM l JOIN o ON l.ticker = o.ticker AND l.sidx = o.sidx JOIN timed t ON t.ticker = l.ticker AND t.asset = l.asset AND t.sidx = l.sidx""",
}

"""Queries of the general data-preparation operators (p2 to p5) with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.operators import drift, flatten, regular_grid, spikes
from heliograph.operators.prices import PRICE_TICKERS
from heliograph.sources.tables import read_table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    challenge = spark.read.parquet(f"{d}/challenge_data.parquet")
    return regular_grid.missing_minutes(challenge, spark.read.parquet(f"{d}/blocks.parquet"))


def p2_minutes(spark: SparkSession, d: str) -> DataFrame:
    return regular_grid.regular_minutes(read_table(spark, d, "challenge_data"), read_table(spark, d, "blocks"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    names = flatten.names_of(read_table(spark, d, "task_spec"))
    return flatten.present_predictions(flatten.all_predictions(read_table(spark, d, "raw_payloads"), read_table(spark, d, "breakout_state"), names))


def p3_branches(spark: SparkSession, d: str) -> DataFrame:
    names = flatten.names_of(read_table(spark, d, "task_spec"))
    both = flatten.payload_branches(read_table(spark, d, "raw_payloads"), names).unionByName(flatten.state_branches(read_table(spark, d, "breakout_state")))
    return flatten.branch_table(both).distinct()


def p3_roots(spark: SparkSession, d: str) -> DataFrame:
    """The payloads' own scalars, one row per member: the root level beside the branches and leaves."""
    roots = flatten.payload_roots(read_table(spark, d, "raw_payloads"))
    scalars = F.map_concat("scalars", F.transform_keys("owner", lambda k, _: F.concat(F.lit("W_owner."), k)))
    return roots.select("ts", "root", F.explode(scalars).alias("path", "value")).distinct()


def p3_samples(spark: SparkSession, d: str) -> DataFrame:
    """The states' samples with their own scalars, one row per member, numbers as such: the middle level."""
    samples = flatten.state_samples(read_table(spark, d, "breakout_state")).select("ts", "root", "branch", F.explode("scalars").alias("path", "value"))
    number = F.col("value").try_cast("double")
    return samples.select("ts", "root", "branch", "path", number.alias("number"), F.when(number.isNull(), F.col("value")).alias("text")).distinct()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return spikes.implausible(read_table(spark, d, "challenge_data"))


def p4_flags(spark: SparkSession, d: str) -> DataFrame:
    return spikes.flag_readings(read_table(spark, d, "challenge_data"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    tasks = drift.task_names(read_table(spark, d, "task_spec"))
    return drift.all_changes(read_table(spark, d, "raw_payloads"), read_table(spark, d, "challenge_meta"), tasks)


def p5_alternatives(spark: SparkSession, d: str) -> DataFrame:
    return drift.payload_alternatives(read_table(spark, d, "raw_payloads")).withColumn("share", F.round("share", 6))


def p5_consistent(spark: SparkSession, d: str) -> DataFrame:
    tasks = drift.task_names(read_table(spark, d, "task_spec"))
    payloads = read_table(spark, d, "raw_payloads")
    return drift.consistent_payloads(payloads, drift.canonical_names(drift.payload_changes(payloads, tasks)))


QUERIES = {f.__name__: f for f in (p2_found, p2_minutes, p3_found, p3_branches, p3_roots, p3_samples, p4_found, p4_flags, p5_found, p5_alternatives, p5_consistent)}

_TICKERS = ", ".join(f"'{t}'" for t in PRICE_TICKERS)
_USABLE = "price IS NOT NULL AND NOT isnan(price) AND price > 0 AND price < 'inf'::DOUBLE"
_GRID = f"""
  hours AS (SELECT DISTINCT CAST(floor(block / 300.0) AS BIGINT) AS h FROM blocks WHERE block IS NOT NULL),
  grid AS (SELECT t.ticker, h * 60 + m.m AS sidx FROM hours, (SELECT unnest([{_TICKERS}]) AS ticker) t, (SELECT unnest(range(60)) AS m) m),
  usable AS (SELECT ticker, sidx, arg_max(price, (ts, price)) AS price FROM challenge_data WHERE ticker IN ({_TICKERS}) AND sidx IS NOT NULL AND {_USABLE} GROUP BY ticker, sidx)"""

SQL = {
    "p2_found": f"WITH {_GRID} SELECT g.ticker, g.sidx FROM grid g ANTI JOIN usable u ON g.ticker = u.ticker AND g.sidx = u.sidx",
    "p2_minutes": f"""
WITH {_GRID},
  merged AS (SELECT coalesce(g.ticker, u.ticker) AS ticker, coalesce(g.sidx, u.sidx) AS sidx, u.price, g.sidx IS NOT NULL AS wanted,
             CASE WHEN u.price IS NOT NULL THEN coalesce(g.sidx, u.sidx) END AS seen FROM grid g FULL JOIN usable u ON g.ticker = u.ticker AND g.sidx = u.sidx),
  near AS (SELECT *, last_value(seen IGNORE NULLS) OVER b AS bs, last_value(price IGNORE NULLS) OVER b AS bp, first_value(seen IGNORE NULLS) OVER a AS ns, first_value(price IGNORE NULLS) OVER a AS np FROM merged
           WINDOW b AS (PARTITION BY ticker ORDER BY sidx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY ticker ORDER BY sidx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
  judged AS (SELECT *, CASE WHEN price IS NOT NULL THEN 'observed' WHEN bs IS NULL AND ns IS NULL THEN 'missing' WHEN bs IS NULL OR ns IS NULL THEN 'edge' WHEN ns - bs > 30 THEN 'gap' ELSE 'interpolated' END AS status FROM near WHERE wanted)
SELECT ticker, sidx, CASE status WHEN 'observed' THEN price WHEN 'interpolated' THEN bp + (np - bp) * (CAST(sidx - bs AS DOUBLE) / CAST(ns - bs AS DOUBLE)) END AS price, status, bs AS before_sidx, ns AS after_sidx FROM judged""",
    "p3_found": """
WITH names AS (SELECT ticker, unnest([ticker, name]) AS k FROM task_spec WHERE assets IS NOT NULL),
  pay AS (SELECT ts, hotkey, CASE WHEN json_type(j) = 'ARRAY' THEN json_extract(j, '$[0]') ELSE j END AS j FROM (SELECT ts, hotkey, TRY_CAST(payload AS JSON) AS j FROM raw_payloads WHERE json_valid(payload))),
  sent AS (SELECT ts, hotkey, CASE WHEN json_type(j, '$.C.ct') = 'VARCHAR' THEN TRY_CAST(json_extract_string(j, '$.C.ct') AS JSON) ELSE json_extract(j, '$.C.ct') END AS ct FROM pay),
  tasks AS (SELECT ts, hotkey, ticker, CASE WHEN json_type(e.value, '$.assets') = 'OBJECT' THEN json_extract(e.value, '$.assets') ELSE e.value END AS v FROM sent, json_each(ct) e JOIN names ON e.key = k WHERE json_type(ct) = 'OBJECT'),
  raw AS (SELECT ts, hotkey, ticker, e.key AS leaf FROM tasks, json_each(v) e WHERE json_type(v) = 'OBJECT' AND e.type != 'NULL'
    UNION ALL SELECT ts, hotkey, ticker, json_extract_string(e.value, '$.asset') FROM tasks, json_each(v) e WHERE json_type(v) = 'ARRAY' AND coalesce(json_type(e.value, '$.val'), 'NULL') != 'NULL'),
  st AS (SELECT ts, asset, CASE WHEN json_type(j) = 'VARCHAR' THEN TRY_CAST(json_extract_string(j, '$') AS JSON) ELSE j END AS j FROM (SELECT ts, asset, TRY_CAST(state_json AS JSON) AS j FROM breakout_state WHERE json_valid(state_json))),
  state AS (SELECT ts, asset, CASE WHEN json_type(j, '$.state') = 'OBJECT' THEN json_extract(j, '$.state') ELSE j END AS j FROM st),
  samples AS (SELECT ts, asset, slot, json_extract(j, '$.' || slot) AS s FROM state, (SELECT unnest(['pending_high', 'pending_low']) AS slot)
    UNION ALL SELECT ts, asset, 'completed', e.value FROM state, json_each(json_extract(j, '$.completed')) e WHERE json_type(j, '$.completed') = 'ARRAY'
    UNION ALL SELECT ts, asset, 'completed', f.value FROM state, json_each(json_extract(j, '$.completed')) e, json_each(e.value) f WHERE json_type(j, '$.completed') = 'OBJECT' AND e.type = 'ARRAY'),
  emb AS (SELECT ts, asset, slot || ':' || json_extract_string(s, '$.trigger_sidx') AS branch, CASE WHEN json_type(s, '$.embeddings.miners') = 'OBJECT' THEN json_extract(s, '$.embeddings.miners') ELSE json_extract(s, '$.embeddings') END AS v FROM samples WHERE json_type(s) = 'OBJECT'),
  leaves AS (SELECT ts, asset, branch, e.key AS leaf FROM emb, json_each(v) e WHERE json_type(v) = 'OBJECT' AND e.type != 'NULL'
    UNION ALL SELECT ts, asset, branch, json_extract_string(e.value, '$.hotkey') FROM emb, json_each(v) e WHERE json_type(v) = 'ARRAY' AND coalesce(json_type(e.value, '$.vec'), 'NULL') != 'NULL')
SELECT DISTINCT 'raw_payloads' AS src, ts, hotkey AS root, ticker AS branch, leaf FROM raw
UNION ALL SELECT DISTINCT 'breakout_state', ts, asset, branch, leaf FROM leaves""",
    "p3_roots": """
WITH pay AS (SELECT ts, hotkey, CASE WHEN json_type(j) = 'ARRAY' THEN json_extract(j, '$[0]') ELSE j END AS j FROM (SELECT ts, hotkey, TRY_CAST(payload AS JSON) AS j FROM raw_payloads WHERE json_valid(payload))),
  m AS (SELECT ts, hotkey, e.key AS path, e.value AS v, e.type AS t FROM pay, json_each(j) e WHERE json_type(j) = 'OBJECT'
    UNION ALL SELECT ts, hotkey, 'W_owner.' || e.key, e.value, e.type FROM pay, json_each(json_extract(j, '$.W_owner')) e WHERE json_type(j, '$.W_owner') = 'OBJECT')
SELECT DISTINCT ts, hotkey AS root, path, json_extract_string(v, '$') AS value FROM m WHERE t NOT IN ('OBJECT', 'ARRAY', 'NULL')""",
    "p3_samples": """
WITH st AS (SELECT ts, asset, CASE WHEN json_type(j) = 'VARCHAR' THEN TRY_CAST(json_extract_string(j, '$') AS JSON) ELSE j END AS j FROM (SELECT ts, asset, TRY_CAST(state_json AS JSON) AS j FROM breakout_state WHERE json_valid(state_json))),
  state AS (SELECT ts, asset, CASE WHEN json_type(j, '$.state') = 'OBJECT' THEN json_extract(j, '$.state') ELSE j END AS j FROM st),
  samples AS (SELECT ts, asset, slot, json_extract(j, '$.' || slot) AS s FROM state, (SELECT unnest(['pending_high', 'pending_low']) AS slot)
    UNION ALL SELECT ts, asset, 'completed', e.value FROM state, json_each(json_extract(j, '$.completed')) e WHERE json_type(j, '$.completed') = 'ARRAY'
    UNION ALL SELECT ts, asset, 'completed', f.value FROM state, json_each(json_extract(j, '$.completed')) e, json_each(e.value) f WHERE json_type(j, '$.completed') = 'OBJECT' AND e.type = 'ARRAY')
SELECT DISTINCT ts, asset AS root, slot || ':' || coalesce(json_extract_string(s, '$.trigger_sidx'), '') AS branch, e.key AS path, TRY_CAST(json_extract_string(e.value, '$') AS DOUBLE) AS number, CASE WHEN TRY_CAST(json_extract_string(e.value, '$') AS DOUBLE) IS NULL THEN json_extract_string(e.value, '$') END AS text FROM samples, json_each(s) e WHERE json_type(s) = 'OBJECT' AND e.type NOT IN ('OBJECT', 'ARRAY', 'NULL')""",
    "p4_found": f"""
WITH {_GRID.split("grid AS")[0].split("hours")[0]}
  usable AS (SELECT ticker, sidx, arg_max(price, (ts, price)) AS x FROM challenge_data WHERE ticker IN ({_TICKERS}) AND sidx IS NOT NULL AND {_USABLE} GROUP BY ticker, sidx),
  l AS (SELECT *, lag(x) OVER w AS b1, lead(x) OVER w AS a1, lead(x, 2) OVER w AS a2, lead(x, 3) OVER w AS a3, sum(CASE WHEN x = xb THEN 0 ELSE 1 END) OVER w AS island FROM (SELECT *, lag(x) OVER (PARTITION BY ticker ORDER BY sidx) AS xb FROM usable) WINDOW w AS (PARTITION BY ticker ORDER BY sidx)),
  m AS (SELECT ticker, 20e0 * median(abs(x - xb)) AS k FROM l GROUP BY ticker),
  o AS (SELECT l.*, k,
     k > 0 AND abs(x - b1) >= k AND abs(x - a1) >= k AND abs(b1 - a1) < k AS s1,
     k > 0 AND abs(x - b1) >= k AND abs(a1 - b1) >= k AND abs(x - a2) >= k AND abs(a1 - a2) >= k AND abs(b1 - a2) < k AS s2,
     k > 0 AND abs(x - b1) >= k AND abs(a1 - b1) >= k AND abs(a2 - b1) >= k AND abs(x - a3) >= k AND abs(a1 - a3) >= k AND abs(a2 - a3) >= k AND abs(b1 - a3) < k AS s3
     FROM l JOIN m ON l.ticker = m.ticker),
  f AS (SELECT ticker, sidx, count(*) OVER (PARTITION BY ticker, island) > 15 AS stuck,
     s1 OR s2 OR s3 OR coalesce(lag(s2) OVER w, false) OR coalesce(lag(s3) OVER w, false) OR coalesce(lag(s3, 2) OVER w, false) AS spike FROM o WINDOW w AS (PARTITION BY ticker ORDER BY sidx))
SELECT ticker, sidx FROM f WHERE stuck OR spike
UNION SELECT ticker, sidx FROM challenge_data WHERE ticker IN ({_TICKERS}) AND sidx IS NOT NULL AND NOT isnan(price) AND (price < 0 OR price = 'inf'::DOUBLE)""",
}

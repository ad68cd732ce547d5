"""Queries on participants and stores: guards, close pairs, decomposed books, envelopes, final shares, tables written and read again, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.functions import vectors
from heliograph.operators import builders, events, filters, ingest, scorers, similarity, stats, windows
from heliograph.plans.series import zero_is_positive
from heliograph.session import shared_folder
from heliograph.sources import legacy, sinks
from heliograph.sources.tables import read_table
from heliograph.streaming import ingest as streams

R = lambda c, name=None: F.round(c, 6).alias(name or c)
HOUR = 3_600_000_000


def _events(spark: SparkSession, d: str, unit: int = HOUR) -> DataFrame:
    e = read_table(spark, d, "events")
    return e.select("event_id", "user_id", "event_type", "value", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / unit).cast("long").alias("at"))


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder in the place all executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def probation_members(spark: SparkSession, d: str) -> DataFrame:
    """Users first seen at least 504 hours before the last hour, present in a tenth of the last 504 hours."""
    e = _events(spark, d).groupBy("user_id", "at").agg(F.lit(True).alias("sent"))
    now = e.agg(F.max("at")).scalar()
    return filters.probation(e, "user_id", "at", "sent", now, 504, 504, 0.1).select("user_id", "first", R("coverage"))


def close_participants(spark: SparkSession, d: str) -> DataFrame:
    """Users whose daily (mean, count) vectors agree to 2 in each element in a twentieth of their joint days."""
    e = _events(spark, d, 24 * HOUR).groupBy("at", "user_id").agg(F.array(F.round(F.avg("value"), 6), F.count("*").cast("double")).alias("v"))
    return builders.close_pairs(e, "at", "user_id", "v", 2.0, 0.05, 5).select("a", "b", "n_match", "n_joint")


def element_means(spark: SparkSession, d: str) -> DataFrame:
    """A07."""
    e = _events(spark, d, 24 * HOUR).groupBy("at", "user_id").agg(F.array(F.avg("value"), F.count("*").cast("double")).alias("v"))
    return builders.means_per_element(e, "user_id", "v").select("user_id", "d", R("mean"))


def _books(spark: SparkSession, d: str) -> DataFrame:
    """Users' hourly positions per event type beside even weights and a beta per type."""
    e = _events(spark, d)
    p = e.groupBy(F.col("at").alias("h"), F.col("user_id").alias("hk"), F.col("event_type").alias("asset")).agg(((F.avg("value") - 40) / 20).alias("pos"))
    f = e.select(F.col("at").alias("h"), F.col("event_type").alias("asset")).distinct().select("h", "asset", F.lit(0.2).alias("weight"), (F.length("asset") / 6.0).alias("beta"))
    return builders.decomposed(p, f)


def decomposed_positions(spark: SparkSession, d: str) -> DataFrame:
    """P20/P21."""
    return _books(spark, d).select("h", "hk", "asset", R("pos"), R("m"), R("q"))


def active_books(spark: SparkSession, d: str) -> DataFrame:
    """users whose residual positions vary by 0.55 and more."""
    return builders.active_by_spread(_books(spark, d), 0.55).select("hk", R("spread"))


def qualified_users(spark: SparkSession, d: str) -> DataFrame:
    """F22/A35."""
    s = _events(spark, d).withColumn("episode", F.floor(F.col("at") / 24)).withColumn("label", (F.col("value") > 30).cast("int"))
    return events.qualified(s, "user_id", "value", "label", "episode", 20, 45.0).select("user_id", "episodes", R("spread"))


def event_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Purchases beside the user's error value of the same hour."""
    e = _events(spark, d)
    asked = e.where("event_type = 'purchase'").select("event_id", "user_id", F.col("at").alias("trigger_sidx"))
    late = e.where("event_type = 'error'").groupBy("user_id", F.col("at").alias("sidx")).agg(F.max("value").alias("vec"))
    return events.with_vectors(asked, late, "user_id", ["vec"])


def balanced_episode_weights(spark: SparkSession, d: str) -> DataFrame:
    """Events weighted so that every day counts the same."""
    e = _events(spark, d).withColumn("episode", F.floor(F.col("at") / 24).cast("long"))
    return events.episode_weights(e, "episode").select("event_id", R("weight"))


def seniority_order(spark: SparkSession, d: str) -> DataFrame:
    """W25/O06/W15."""
    first = ingest.first_seen(_events(spark, d), "user_id", "at")
    return windows.seniority(first, "first_seen", "user_id").select("user_id", "first_seen", F.col("seniority").cast("long").alias("seniority"))


def participant_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Every customer's newest order."""
    o = read_table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("version"), "o_totalprice", "o_orderstatus")
    return ingest.snapshot(o, "o_custkey", "version")


def newest_rounds(spark: SparkSession, d: str) -> DataFrame:
    """What is left of the payloads after evicting all but the 100 newest steps."""
    return ingest.newest(read_table(spark, d, "raw_payloads").select("ts", "hotkey", "feed", "file_no").distinct(), "ts", 100)


def job_starts(spark: SparkSession, d: str) -> DataFrame:
    """Blocks at which a job of a period of 1,000 blocks starts."""
    return ingest.due(read_table(spark, d, "blocks").where("block IS NOT NULL"), 1000)


def start_guard(spark: SparkSession, d: str) -> DataFrame:
    """F31."""
    return ingest.enough_history(read_table(spark, d, "blocks"), 60)


def row_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows and first minute per ticker."""
    return read_table(spark, d, "challenge_data").groupBy("ticker").agg(F.count("*").alias("n"), F.min("sidx").alias("first_sidx"))


def envelope_checks(spark: SparkSession, d: str) -> DataFrame:
    """What is right about each readable payload, counted per feed."""
    c = ingest.envelope_checks(read_table(spark, d, "raw_payloads"), "payload", "hotkey")
    return c.groupBy("feed").agg(F.count("*").alias("n"), *(F.count_if(k).alias(k) for k in ("complete", "own", "bound")))


def settled_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Orders as payloads of a round (their customer), every third round without signature, tries by priority."""
    o = read_table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("round"), F.when(F.col("o_orderstatus") == "P", 1).otherwise(2).alias("version"), F.substring("o_orderpriority", 1, 1).cast("int").alias("tries"))
    s = read_table(spark, d, "customer").where("c_custkey % 3 != 0").select(F.col("c_custkey").alias("round"), F.col("c_name").alias("signature"))
    return streams.settled(o, s).select("o_orderkey", "round", "signature", "lost")


def snapshot_defaults(spark: SparkSession, d: str) -> DataFrame:
    """suppliers' balances under an alias, with defaults."""
    s = read_table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 4 != 0, F.col("s_acctbal").cast("string")).alias("balance"))
    return streams.with_defaults(s, {"balance": "price"}, ["price", "funding"])


def _scores(spark: SparkSession, d: str, part: str) -> DataFrame:
    """Shares of customers by the total of their orders of one status."""
    o = read_table(spark, d, "orders").where(F.col("o_orderstatus") == part).groupBy(F.col("o_custkey").cast("string").alias("hk")).agg(F.sum("o_totalprice").alias("x"))
    return stats.normalise(o, [], "x", "s").select("hk", "s")


def combined_scores(spark: SparkSession, d: str) -> DataFrame:
    """Two tasks' shares decayed by rank and averaged by weight."""
    return scorers.combined([(_scores(spark, d, "F"), 2.0), (_scores(spark, d, "O"), 1.0)]).select("hk", F.round("s", 9).alias("s"))


def cloned_scores(spark: SparkSession, d: str) -> DataFrame:
    """Customers of one hundred keys collapse into the first, those of a thousand that are left share."""
    s = _scores(spark, d, "F")
    key = F.col("hk").cast("long")
    exact = s.where(key % 100 < 2).select(F.col("hk").alias("member"), F.floor(key / 100).cast("long").alias("g"))
    exact = exact.join(exact.groupBy("g").agg(F.min("member").alias("representative")), "g").select("member", "representative")
    soft = s.where((key % 1000 >= 500) & (key % 10 == 3)).select(F.col("hk").alias("member"), F.floor(key / 1000).cast("long").alias("g"))
    soft = soft.join(soft.groupBy("g").agg(F.min("member").alias("representative")), "g").select("member", "representative")
    return scorers.clone_tiers(s, exact, soft).select("hk", F.round("s", 9).alias("s"))


def final_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares of customers' slots (nation), young ones fixed, a part burned, smoothed."""
    c = read_table(spark, d, "customer").select(F.col("c_nationkey").alias("uid"), F.col("c_custkey").cast("string").alias("hk"))
    seen = read_table(spark, d, "orders").groupBy(F.col("o_custkey").cast("string").alias("hk")).agg((F.min("o_orderkey")).alias("first_seen"))
    old = read_table(spark, d, "nation").select(F.col("n_nationkey").alias("uid"), F.lit(1 / 25).alias("w"))
    every = c.join(seen, "hk", "left_semi").where("CAST(hk AS BIGINT) % 40 = 7")
    return scorers.final_weights(_scores(spark, d, "F"), every, seen, old, 1000, 800, 0.002, 0.35).select("uid", F.round("w", 9).alias("w"))


def saved_weights(spark: SparkSession, d: str) -> DataFrame:
    """Weights of two blocks saved, the last ones loaded, positive ones published."""
    folder = _folder(spark, "weights")
    for block, part in ((7, "O"), (9, "F")):
        shares = _scores(spark, d, part).select(F.col("hk").cast("long").alias("uid"), "hk", F.when(F.col("hk").cast("long") % 2 == 0, F.col("s")).otherwise(0.0).alias("w"))
        sinks.save_weights(shares, folder, block)
    return sinks.published(sinks.load_weights(spark, folder)).select("uid", F.round("w", 9).alias("w"))


def partitioned_table(spark: SparkSession, d: str) -> DataFrame:
    """A table written by partition, a part of it replaced elsewhere, and read again."""
    folder = _folder(spark, "orders")
    o = read_table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    sinks.write_partitioned(o, folder, ["o_orderstatus"])
    kept = spark.read.schema(o.schema).parquet(folder)
    sinks.replace_table(kept.where("o_orderstatus != 'P'").groupBy("o_orderstatus").agg(F.count("*").alias("n"), R(F.sum("o_totalprice"), "total")), f"{folder}-sums")
    return spark.read.parquet(f"{folder}-sums")


def packed_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Quantities packed to blobs per order and read from them again."""
    li = read_table(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_suppkey").cast("string").alias("hk")).agg(F.max("l_quantity").cast("float").alias("a"), F.count("*").cast("float").alias("b"))
    blobs = sinks.packed(li.withColumn("vec", F.array("a", "b")), ["l_orderkey"], "hk", "vec")
    return legacy.unpacked(blobs, "embeddings", 2).select("l_orderkey", "hk", F.col("vec")[0].cast("double").alias("most"), F.col("vec")[1].cast("double").alias("lines"))


def breakdown_lines(spark: SparkSession, d: str) -> DataFrame:
    """K11."""
    n = read_table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return sinks.breakdown(n, F.col("n_name"), "n_nationkey", "n_regionkey")


def landed_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Payloads landed as files of one object each, read with a limit on their size."""
    folder = _folder(spark, "landing")
    rows = read_table(spark, d, "nation").select(F.concat(F.lit("{\"nation\": \""), "n_name", F.lit("\"}"), F.repeat(F.lit(" "), F.col("n_nationkey").cast("int"))).alias("value"))
    rows.repartition(25).write.option("lineSep", "\n").text(folder)
    return legacy.landed_objects(spark, f"{folder}/*.txt", 45).select("length", F.get_json_object("text", "$.nation").alias("nation"))


def watermark_windows(spark: SparkSession, d: str) -> DataFrame:
    """Event-time windows with a watermark as a stream, run to its end; a window's newest state counts."""
    folder = _folder(spark, "windows")
    source = spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).parquet(f"{d}/events.parquet*")
    hourly = streams.hourly(source, "ts", ["event_type"], "value", "40 days").select(F.unix_seconds("window.start").alias("start"), "event_type", "n", "mean")
    write = streams.upsert_writer(f"{folder}/table", ["start", "event_type"], "n", ["mean"])
    hourly.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return streams.read_upserted(spark, f"{folder}/table", ["start", "event_type"], "n", ["mean"]).select("start", "event_type", "n", R("mean"))


def joint_vector_similarity(spark: SparkSession, d: str) -> DataFrame:
    """|cosine| of users' daily vectors over joint days, own means taken out."""
    e = _events(spark, d, 24 * HOUR).groupBy("at", "user_id").agg(F.array(F.avg("value"), F.count("*").cast("double")).alias("v"))
    return similarity.centred_similarity(e, "at", "user_id", "v", 10).select("a", "b", "n_joint", vectors.rounded(F.col("similarity"), 5).alias("similarity"))


def history_similarity(spark: SparkSession, d: str) -> DataFrame:
    """A10: the same over all days, the participants' mean taken out, absent days as zeros."""
    e = _events(spark, d, 24 * HOUR).groupBy("at", "user_id").agg(F.array(F.avg("value"), F.count("*").cast("double")).alias("v"))
    return similarity.centred_similarity(e, "at", "user_id", "v", 1, False).select("a", "b", vectors.rounded(F.col("similarity"), 5).alias("similarity"))


def sigmoid_probabilities(spark: SparkSession, d: str) -> DataFrame:
    """Two probabilities of a row, clipped to 1e-12, normalised, as logits; 0 where nothing was submitted."""
    li = read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array("l_discount", "l_tax").alias("v"))
    return li.select("l_orderkey", "l_linenumber", *(R(c, n) for n, c in zip(("up", "down"), _hit_logits(F.col("v")), strict=True)))


def _hit_logits(v: Column) -> tuple[Column, Column]:
    return vectors.hit_logits(v, 0), vectors.hit_logits(v, 1)


QUERIES = {
    f.__name__: f
    for f in (
        probation_members, close_participants, element_means, decomposed_positions, active_books, qualified_users, event_vectors, balanced_episode_weights, seniority_order, participant_snapshot,
        newest_rounds, job_starts, start_guard, row_counts, envelope_checks, settled_payloads, snapshot_defaults, combined_scores, cloned_scores, final_shares, saved_weights, partitioned_table,
        packed_vectors, breakdown_lines, landed_payloads, watermark_windows, joint_vector_similarity, history_similarity, sigmoid_probabilities,
    )
}

_E = f"e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) // {HOUR} AS tick FROM events)"
_DAY = f"y AS (SELECT epoch_us(ts) // {24 * HOUR} AS tick, user_id, avg(value) AS v0, CAST(count(*) AS DOUBLE) AS v1 FROM events GROUP BY ALL)"
_BOOKS = f"""{_E}, p AS (SELECT tick AS h, user_id AS hk, event_type AS asset, greatest(least((avg(value) - 40) / 20, 1), -1) AS pos FROM e GROUP BY ALL),
  m AS (SELECT h, hk, sum(0.2e0 * pos) AS m FROM p GROUP BY ALL), b AS (SELECT p.*, m, pos - m * length(asset) / 6e0 AS q FROM p JOIN m ON p.h = m.h AND p.hk = m.hk)"""
_SHARES = "t AS (SELECT CAST(o_custkey AS VARCHAR) AS hk, o_orderstatus AS part, sum(o_totalprice) AS x FROM orders GROUP BY ALL), s AS (SELECT hk, part, x / sum(x) OVER (PARTITION BY part) AS s FROM t)"
_LONG = "u AS (SELECT tick, user_id, 0 AS d, v0 AS v FROM y UNION ALL SELECT tick, user_id, 1, v1 FROM y)"
_J = "j AS (SELECT hotkey, feed, CASE WHEN json_type(x) = 'ARRAY' THEN json_extract(x, '$[0]') ELSE x END AS j FROM (SELECT hotkey, feed, TRY_CAST(payload AS JSON) AS x FROM raw_payloads WHERE json_valid(payload)))"

SQL = {
    "probation_members": f"WITH {_E}, u AS (SELECT DISTINCT user_id, tick FROM e), n AS (SELECT max(tick) AS now FROM u) SELECT user_id, min(tick) AS first, round(count(*) FILTER (tick > now - 504) / 504e0, 6) AS coverage FROM u, n GROUP BY user_id, now HAVING now - min(tick) >= 504 AND count(*) FILTER (tick > now - 504) / 504e0 >= 0.1e0",
    "close_participants": f"""WITH {_DAY}, z AS (SELECT tick, user_id, round(v0, 6) AS v0, v1 FROM y), k AS (SELECT * FROM z WHERE user_id IN (SELECT user_id FROM z GROUP BY user_id HAVING count(*) >= 5)),
      c AS (SELECT p.user_id AS a, q.user_id AS b, count(*) AS n_joint, count(*) FILTER (abs(p.v0 - q.v0) < 2 AND abs(p.v1 - q.v1) < 2) AS n_match FROM k p JOIN k q ON p.tick = q.tick AND p.user_id < q.user_id GROUP BY ALL)
      SELECT a, b, n_match, n_joint FROM c WHERE n_joint >= 5 AND n_match > 0 AND n_match >= ceil(0.05e0 * n_joint)""",
    "element_means": f"WITH {_DAY}, {_LONG} SELECT user_id, d, round(avg(v), 6) AS mean FROM u GROUP BY ALL",
    "decomposed_positions": f"WITH {_BOOKS} SELECT h, hk, asset, round(pos, 6) AS pos, round(m, 6) AS m, round(q, 6) AS q FROM b",
    "active_books": f"WITH {_BOOKS} SELECT hk, round(stddev_pop(q), 6) AS spread FROM b GROUP BY hk HAVING stddev_pop(q) >= 0.55e0",
    "qualified_users": f"WITH {_E} SELECT user_id, count(DISTINCT tick // 24) AS episodes, round(stddev_pop(value), 6) AS spread FROM e GROUP BY user_id HAVING count(DISTINCT tick // 24) >= 20 AND stddev_pop(value) >= 45 AND count(DISTINCT value > 30) = 2",
    "event_vectors": f"WITH {_E}, l AS (SELECT user_id, tick, max(value) AS vec FROM e WHERE event_type = 'error' GROUP BY ALL) SELECT e.user_id, e.tick AS trigger_sidx, event_id, vec FROM e LEFT JOIN l ON e.user_id = l.user_id AND e.tick = l.tick WHERE event_type = 'purchase'",
    "balanced_episode_weights": f"WITH {_E}, n AS (SELECT tick // 24 AS k, count(*) AS n FROM e GROUP BY ALL) SELECT event_id, round((SELECT sum(n) / count(*) FROM n) / n, 6) AS weight FROM e JOIN n ON tick // 24 = k",
    "seniority_order": f"WITH {_E}, f AS (SELECT user_id, min(tick) AS first_seen FROM e GROUP BY user_id) SELECT *, row_number() OVER (ORDER BY first_seen, user_id) - 1 AS seniority FROM f",
    "participant_snapshot": "SELECT o_custkey, max(o_orderkey) AS version, arg_max(o_totalprice, o_orderkey) AS o_totalprice, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY o_custkey",
    "newest_rounds": "SELECT DISTINCT ts, hotkey, feed, file_no FROM raw_payloads WHERE ts IN (SELECT DISTINCT ts FROM raw_payloads ORDER BY ts DESC LIMIT 100)",
    "job_starts": "SELECT CAST(floor(block / 1000) AS BIGINT) AS period, min(block) AS block FROM blocks WHERE block IS NOT NULL GROUP BY period",
    "start_guard": "SELECT count(*) AS n, count(*) >= 121 AS ready FROM blocks",
    "row_counts": "SELECT ticker, count(*) AS n, min(sidx) AS first_sidx FROM challenge_data GROUP BY ticker",
    "envelope_checks": f"""WITH {_J}, k AS (SELECT feed, hotkey, j, list_bool_and([json_exists(j, '$.' || x) FOR x IN ['v', 'round', 'hk', 'owner_pk', 'C', 'W_owner', 'W_time', 'binding', 'alg']]) AND TRY_CAST(json_extract_string(j, '$.v') AS INT) = 2 AND json_type(j, '$.round') IN ('UBIGINT', 'BIGINT') AS complete,
      json_extract_string(j, '$.hk') = hotkey AS own, json_extract_string(j, '$.owner_pk') AS o, json_extract_string(j, '$.W_owner.pke') AS w FROM j)
      SELECT feed, count(*) AS n, count(*) FILTER (complete) AS complete, count(*) FILTER (own) AS own, count(*) FILTER (regexp_full_match(o, '([0-9a-fA-F]{{2}})*') AND regexp_full_match(w, '([0-9a-fA-F]{{2}})*') AND sha256(CAST(json_extract_string(j, '$.hk') || ':' || json_extract_string(j, '$.round') || ':' AS BLOB) || unhex(o) || CAST(':' AS BLOB) || unhex(w)) = lower(json_extract_string(j, '$.binding'))) AS bound FROM k GROUP BY feed""",
    "settled_payloads": "SELECT o_orderkey, o_custkey AS round, c_name AS signature, c_name IS NULL AS lost FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 3 != 0 WHERE o_orderstatus != 'P' AND (c_name IS NOT NULL OR CAST(substr(o_orderpriority, 1, 1) AS INT) >= 3)",
    "snapshot_defaults": "SELECT s_suppkey, CASE WHEN s_suppkey % 4 != 0 THEN s_acctbal ELSE 0 END AS price, 0e0 AS funding FROM supplier",
    "combined_scores": f"""WITH {_SHARES}, r AS (SELECT *, s * exp(-(row_number() OVER (PARTITION BY part ORDER BY s DESC, hk) - 1) / (50 / 3e0)) AS d FROM s WHERE part IN ('F', 'O')), n AS (SELECT *, d / sum(d) OVER (PARTITION BY part) AS x FROM r),
      w AS (SELECT hk, sum(x * CASE part WHEN 'F' THEN 2 ELSE 1 END / 3e0) AS v FROM n WHERE x > 1e-6 GROUP BY hk) SELECT hk, round(v / sum(v) OVER (), 9) AS s FROM w""",
    "cloned_scores": f"""WITH {_SHARES}, f AS (SELECT hk, s, CAST(hk AS BIGINT) AS k FROM s WHERE part = 'F'), x AS (SELECT hk, min(hk) OVER (PARTITION BY k // 100) AS r FROM f WHERE k % 100 < 2),
      c AS (SELECT coalesce(r, f.hk) AS hk, sum(s) AS s FROM f LEFT JOIN x ON f.hk = x.hk GROUP BY ALL), z AS (SELECT hk, min(hk) OVER (PARTITION BY k // 1000) AS r FROM f WHERE k % 1000 >= 500 AND k % 10 = 3),
      o AS (SELECT z.hk, z.r, sum(s) OVER (PARTITION BY z.r) / count(*) OVER (PARTITION BY z.r) AS s FROM z LEFT JOIN c ON z.hk = c.hk)
      SELECT hk, round(s, 9) AS s FROM o UNION ALL SELECT hk, round(s, 9) FROM c WHERE hk NOT IN (SELECT hk FROM z)""",
    "final_shares": f"""WITH {_SHARES}, e AS (SELECT c_nationkey AS uid, CAST(c_custkey AS VARCHAR) AS hk FROM customer WHERE c_custkey % 40 = 7), n AS (SELECT CAST(o_custkey AS VARCHAR) AS hk, min(o_orderkey) AS first FROM orders GROUP BY ALL),
      u AS (SELECT uid, sum(coalesce(s, 0)) AS s, bool_or(1000 - first < 800) AS young FROM e JOIN n ON e.hk = n.hk LEFT JOIN (SELECT * FROM s WHERE part = 'F') s ON e.hk = s.hk GROUP BY uid),
      h AS (SELECT uid, CASE WHEN young THEN 0.002e0 ELSE (1 - 0.002e0 * count(*) FILTER (young) OVER ()) * s / sum(s) FILTER (NOT young) OVER () END AS w FROM u),
      b AS (SELECT uid, coalesce(w, 0) * 0.65e0 + CASE WHEN uid = 0 THEN 0.35e0 ELSE 0 END AS w FROM h), m AS (SELECT uid, 0.3e0 * w / sum(w) OVER () + 0.7e0 / 25 AS w FROM b) SELECT uid, round(w / sum(w) OVER (), 9) AS w FROM m""",
    "saved_weights": f"WITH {_SHARES} SELECT CAST(hk AS BIGINT) AS uid, round(s, 9) AS w FROM s WHERE part = 'F' AND CAST(hk AS BIGINT) % 2 = 0 AND s > 0",
    "partitioned_table": "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 6) AS total FROM orders WHERE o_orderstatus != 'P' GROUP BY o_orderstatus",
    "packed_vectors": "SELECT l_orderkey, CAST(l_suppkey AS VARCHAR) AS hk, CAST(max(l_quantity) AS DOUBLE) AS most, CAST(count(*) AS DOUBLE) AS lines FROM lineitem GROUP BY ALL",
    "breakdown_lines": "SELECT n_name AS key, '{\"n_nationkey\":' || n_nationkey || ',\"n_regionkey\":' || n_regionkey || '}' AS line FROM nation",
    "landed_payloads": "SELECT CAST(length(n_name) + 15 + n_nationkey AS BIGINT) AS length, n_name AS nation FROM nation WHERE length(n_name) + 15 + n_nationkey <= 45",
    "watermark_windows": "SELECT epoch_us(ts) // 3600000000 * 3600 AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL",
    "joint_vector_similarity": f"""WITH {_DAY}, {_LONG}, c AS (SELECT *, v - avg(v) OVER (PARTITION BY user_id, d) AS x FROM u), z AS (SELECT p.user_id AS a, q.user_id AS b, count(*) // 2 AS n_joint, sum(p.x * q.x) AS xy, sum(p.x * p.x) * sum(q.x * q.x) AS w FROM c p JOIN c q ON p.tick = q.tick AND p.d = q.d AND p.user_id < q.user_id GROUP BY ALL)
      SELECT a, b, n_joint, round(CASE WHEN w > 0 THEN abs(xy) / sqrt(w) ELSE 0 END, 5) AS similarity FROM z WHERE n_joint >= 10""",
    "history_similarity": f"""WITH {_DAY}, {_LONG}, n AS (SELECT count(DISTINCT user_id) AS n FROM y), m AS (SELECT tick, d, sum(v) / n AS m FROM u, n GROUP BY tick, d, n), w AS (SELECT DISTINCT user_id FROM y),
      c AS (SELECT m.tick, m.d, w.user_id, coalesce(v, 0) - m AS x FROM m CROSS JOIN w LEFT JOIN u ON u.tick = m.tick AND u.d = m.d AND u.user_id = w.user_id)
      SELECT p.user_id AS a, q.user_id AS b, round(abs(sum(p.x * q.x)) / sqrt(sum(p.x * p.x) * sum(q.x * q.x)), 5) AS similarity FROM c p JOIN c q ON p.tick = q.tick AND p.d = q.d AND p.user_id < q.user_id GROUP BY ALL""",
    "sigmoid_probabilities": """WITH c AS (SELECT l_orderkey, l_linenumber, l_discount = 0 AND l_tax = 0 AS none, greatest(least(l_discount, 1 - 1e-12), 1e-12) AS a, greatest(least(l_tax, 1 - 1e-12), 1e-12) AS b FROM lineitem)
      SELECT l_orderkey, l_linenumber, round(CASE WHEN none THEN 0e0 ELSE ln(a / b) END, 6) AS up, round(CASE WHEN none THEN 0e0 ELSE ln(b / a) END, 6) AS down FROM c""",
}
SQL = zero_is_positive(SQL)

"""Queries on ingest: upserts, maturity, defaults, landed-row checks, maps and vectors, set operations, event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.functions import vectors
from heliograph.functions.json_text import readable
from heliograph.operators import drift, filters, ingest, stats, submissions
from heliograph.operators.prices import price_rows, usable
from heliograph.sources.tables import minute_of_block, read_table

R = lambda c, name=None: F.round(c, 6).alias(name or c)
#: Hosts that participants' objects may lie on.
HOSTS = ("r2.dev", "r2.cloudflarestorage.com")


def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    rows = price_rows(read_table(spark, d, "challenge_data")).where(usable(F.col("price")))
    return ingest.latest(rows, ["ticker", "sidx"], "ts", ["price"])


def upsert_by_column(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "challenge_data").where("ticker IS NOT NULL AND sidx IS NOT NULL").withColumn("price", F.when(usable(F.col("price")), F.col("price")))
    return ingest.upsert_columns(rows, ["ticker", "sidx"], "ts", ["price", "price_data"])


def merge_upsert(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("version"), "o_totalprice")
    per = lambda *status: ingest.latest(o.join(read_table(spark, d, "orders").where(F.col("o_orderstatus").isin(*status)).select(F.col("o_orderkey").alias("version")), "version", "left_semi"), ["o_custkey"], "version", ["o_totalprice"])
    return ingest.merge_upsert(per("F"), per("O", "P"), ["o_custkey"], "version")


def maturity_join(spark: SparkSession, d: str) -> DataFrame:
    blocks = read_table(spark, d, "blocks")
    now = ingest.last_block(blocks)
    joined = read_table(spark, d, "raw_payloads").select("ts", "hotkey").join(blocks.select(F.col("idx").alias("ts"), "block"), "ts")
    return joined.where(now.scalar() - F.col("block") >= 300).groupBy("hotkey").agg(F.count("*").alias("n"), F.max("block").alias("last_block"))


def sample_gate(spark: SparkSession, d: str) -> DataFrame:
    b = read_table(spark, d, "blocks").where("block % 5 = 0")
    return b.select("idx", "block", minute_of_block(F.col("block")).alias("sidx"), (minute_of_block(F.col("block")) * 5).alias("minute_block"))


def semi_active(spark: SparkSession, d: str) -> DataFrame:
    active = read_table(spark, d, "raw_payloads").groupBy("hotkey").agg(F.count("*").alias("n")).where("n >= 50")
    return read_table(spark, d, "documents").select("doc_id", "hotkey").join(active, "hotkey", "left_semi")


def anti_processed(spark: SparkSession, d: str) -> DataFrame:
    seen = read_table(spark, d, "documents").select("hotkey").distinct()
    return read_table(spark, d, "raw_payloads").select("ts", "hotkey", "feed", "file_no").distinct().join(seen, "hotkey", "left_anti")


def default_join(spark: SparkSession, d: str) -> DataFrame:
    last = ingest.latest(read_table(spark, d, "raw_payloads").where("payload IS NOT NULL"), ["hotkey"], "ts", ["payload"])
    keys = read_table(spark, d, "documents").select("hotkey").where("hotkey IS NOT NULL").distinct()
    return ingest.default_join(keys, last, ["hotkey"], "payload", "{}").select("hotkey", F.length("payload").cast("long").alias("length"))


def first_seen(spark: SparkSession, d: str) -> DataFrame:
    joined = read_table(spark, d, "raw_payloads").join(read_table(spark, d, "blocks").select(F.col("idx").alias("ts"), "block"), "ts")
    return ingest.first_seen(joined, "hotkey", "block")


def dense_index(spark: SparkSession, d: str) -> DataFrame:
    return ingest.dense_index(read_table(spark, d, "raw_payloads"), ["feed"], "hotkey").withColumn("index", F.col("index").cast("long"))


def ingest_counters(spark: SparkSession, d: str) -> DataFrame:
    p = read_table(spark, d, "raw_payloads").select("feed", F.col("payload").isNotNull().alias("there"), readable("payload").isNotNull().alias("ok"))
    c = p.groupBy("feed").agg(F.count("*").alias("n"), F.count_if("there").alias("n_there"), F.count_if("ok").alias("n_readable"))
    return c.select("*", R(100 * F.col("n_readable") / F.col("n"), "pct_readable"))


def url_validate(spark: SparkSession, d: str) -> DataFrame:
    doc = read_table(spark, d, "documents").where("hotkey IS NOT NULL AND source IS NOT NULL").select("doc_id", "hotkey", "source")
    kind = F.col("doc_id") % 5
    url = F.when(kind == 0, F.concat(F.lit("https://pub.r2.dev/"), "hotkey")).when(kind == 1, F.concat(F.lit("https://r2.dev/"), F.upper("hotkey"))).when(kind == 2, F.concat(F.lit("https://r2.dev/"), "hotkey", F.lit("/"))).when(kind == 3, F.concat(F.lit("https://example.org/"), "hotkey")).otherwise(F.concat(F.lit("https://pub.r2.dev/"), "source"))
    return doc.select("doc_id", ingest.valid_url(url, F.col("hotkey"), HOSTS).alias("valid"))


def sha_binding(spark: SparkSession, d: str) -> DataFrame:
    c = read_table(spark, d, "customer")
    return c.select("c_custkey", ingest.binding(F.col("c_name"), F.col("c_custkey"), F.col("c_mktsegment"), F.col("c_name")).alias("binding"))


def map_flatten(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "challenge_data").where("price_data IS NOT NULL").select("ticker", "sidx", "ts", ingest.positive_entries(ingest.parsed_map(F.col("price_data"))).alias("m"))
    return rows.select("ticker", "sidx", "ts", F.explode("m").alias("asset", "price")).distinct()


def price_vectors(spark: SparkSession, d: str) -> DataFrame:
    spec = read_table(spark, d, "task_spec").where("assets IS NOT NULL").select("ticker", "assets")
    rows = read_table(spark, d, "challenge_data").where("price_data IS NOT NULL").select("ticker", "sidx", "ts", ingest.parsed_map(F.col("price_data")).alias("m"))
    v = rows.join(spec, "ticker").withColumn("v", ingest.ordered_vector(F.col("m"), F.col("assets")))
    return v.select("ticker", "sidx", "ts", F.size("v").cast("long").alias("width"), R(vectors.total(F.col("v")), "total"), F.exists("v", lambda x: x > 0).alias("any_price"), F.forall("v", lambda x: x > 0).alias("all_prices")).distinct()


def sanitised_vectors(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 17).alias("v"))
    s = e.select("vec_id", vectors.sanitised(F.col("v")).alias("s"), vectors.probabilities(F.col("v")).alias("p"), vectors.logits(F.col("v")).alias("l"), vectors.asset_slice(F.col("v"), F.lit(3), 2).alias("part"))
    return s.select("vec_id", R(F.col("s")[0], "first"), R(vectors.total(F.col("s")), "total"), vectors.argmax(F.col("p")).alias("best"), R(vectors.total(F.col("l")), "logit_total"), R(F.col("part")[0].cast("double"), "part_first"))


def set_operations(spark: SparkSession, d: str) -> DataFrame:
    a = read_table(spark, d, "raw_payloads").select("hotkey").distinct()
    b = read_table(spark, d, "documents").select("hotkey").where("hotkey IS NOT NULL").distinct()
    tag = lambda df, name: df.select("hotkey", F.lit(name).alias("kind"))
    return tag(a.union(b).distinct(), "union").unionByName(tag(a.intersect(b), "intersect")).unionByName(tag(a.exceptAll(b), "except"))


def hourly_windows(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    w = e.groupBy(F.window("at", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return w.select(F.unix_seconds("w.start").alias("start"), "event_type", "n", R("mean"))


def sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("at", "2 hours", "1 hour").alias("w")).agg(F.count("*").alias("n")).select(F.unix_seconds("w.start").alias("start"), "n")


def session_windows(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    s = e.groupBy("user_id", F.session_window("at", "6 hours").alias("w")).agg(F.count("*").alias("n"), R(F.sum("value"), "total"))
    return s.select("user_id", F.unix_micros("w.start").alias("start"), "n", "total")


def scalar_functions(spark: SparkSession, d: str) -> DataFrame:
    c = read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_quantity")
    x = F.col("l_discount") - 0.05
    return c.select("l_orderkey", "l_linenumber", R(stats.sigmoid(x * 20), "sigmoid"), R(stats.softplus(x * 20), "softplus"), R(stats.logit(F.col("l_discount")), "logit"), F.greatest(F.lit(1), F.bround(F.col("l_quantity") / 5).cast("int")).alias("steps"), R(vectors.clip(x * 30, -1, 1), "position"))


def submission_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Positional submissions follow the specification's rows in their order."""
    from pyspark.sql import Window

    spec = read_table(spark, d, "task_spec").withColumn("ordinal", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())) - 1)
    sent = drift._envelopes(read_table(spark, d, "raw_payloads"), "ts", "hotkey").select("ts", "hotkey", F.expr("to_json(ct)").alias("ct")).where("ct IS NOT NULL").distinct()
    v = submissions.vectors(submissions.entries(sent, "ct", spec, ["ts", "hotkey"]))
    return v.where(vectors.active(F.col("vec"))).groupBy("ticker").agg(F.count("*").alias("n"), F.max(F.size("vec")).cast("long").alias("width"), F.round(F.sum(vectors.total(F.col("vec"))), 3).alias("total"))


def active_participants(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events")
    return filters.active_share(e, ["user_id"], F.col("value") > 50, 0.05).select("user_id", "n", R("active_share"))


def unstale_values(spark: SparkSession, d: str) -> DataFrame:
    li = read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount")
    return filters.unstale(li, ["l_orderkey"], "l_discount", 0.0205).select("l_orderkey", "l_linenumber", "fresh")


def count_guards(spark: SparkSession, d: str) -> DataFrame:
    li = read_table(spark, d, "lineitem").withColumn("returned", F.col("l_returnflag") == "R")
    return filters.enough(li, ["l_orderkey"], "l_discount", "returned", 3, 2)


def price_fallback(spark: SparkSession, d: str) -> DataFrame:
    asked = read_table(spark, d, "task_spec").where("assets IS NOT NULL").select(F.explode("assets").alias("asset")).distinct()
    last = price_rows(read_table(spark, d, "challenge_data")).where(usable(F.col("price"))).groupBy("ticker").agg(F.max(F.struct("sidx", "ts", "price"))["price"].alias("price"))
    return filters.price_fallback(asked, "asset", last, read_table(spark, d, "task_spec"))


def classwise_centred(spark: SparkSession, d: str) -> DataFrame:
    li = read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_quantity")
    return filters.classwise_centred(li, ["l_suppkey"], "l_returnflag", "l_quantity").select("l_orderkey", "l_linenumber", R("centred"))


def softmax_shares(spark: SparkSession, d: str) -> DataFrame:
    s = read_table(spark, d, "lineitem").groupBy("l_suppkey").agg((F.sum("l_quantity") / 1000).alias("x"), F.avg("l_discount").alias("u"))
    return filters.softmax_shares(s, "x", "u").select("l_suppkey", F.round("share", 9).alias("share"))


QUERIES = {
    f.__name__: f
    for f in (
        upsert_latest, upsert_by_column, merge_upsert, maturity_join, sample_gate, semi_active, anti_processed, default_join, first_seen, dense_index, ingest_counters,
        url_validate, sha_binding, map_flatten, price_vectors, sanitised_vectors, set_operations, hourly_windows, sliding_windows, session_windows, scalar_functions,
        submission_vectors, active_participants, unstale_values, count_guards, price_fallback, classwise_centred, softmax_shares,
    )
}

from heliograph.plans.series import _TICKERS, zero_is_positive  # noqa: E402

_USABLE = "price IS NOT NULL AND NOT isnan(price) AND price > 0 AND price < 'inf'::DOUBLE"
_MAPS = "m AS (SELECT ticker, sidx, ts, j.key AS asset, TRY_CAST(j.value AS DOUBLE) AS v FROM challenge_data, json_each(price_data) j WHERE price_data IS NOT NULL AND json_valid(price_data))"

SQL = {
    "active_participants": "SELECT user_id, count(*) AS n, round(count(*) FILTER (value > 50) / count(*), 6) AS active_share FROM events GROUP BY user_id HAVING count(*) FILTER (value > 50) / count(*) > 0.05e0",
    "unstale_values": "SELECT l_orderkey, l_linenumber, CASE WHEN stddev_pop(l_discount) OVER (PARTITION BY l_orderkey) < 0.0205e0 THEN 0e0 ELSE l_discount END AS fresh FROM lineitem",
    "count_guards": "SELECT l_orderkey, count(*) AS n, count(DISTINCT l_discount) FILTER (l_discount != 0) AS n_distinct, count(DISTINCT l_returnflag = 'R') AS n_classes FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 3 AND count(DISTINCT l_discount) FILTER (l_discount != 0) >= 2 AND count(DISTINCT l_returnflag = 'R') = 2",
    "price_fallback": f"WITH p AS (SELECT ticker, arg_max(price, (sidx, ts, price)) AS price FROM challenge_data WHERE ticker IN ({_TICKERS}) AND sidx IS NOT NULL AND {_USABLE} GROUP BY ticker), a AS (SELECT DISTINCT unnest(assets) AS asset FROM task_spec), k AS (SELECT price_key, min(ticker) AS via FROM task_spec WHERE price_key IS NOT NULL GROUP BY price_key) SELECT asset, coalesce(o.price, v.price) AS price FROM a LEFT JOIN p o ON o.ticker = asset LEFT JOIN k ON price_key = asset LEFT JOIN p v ON v.ticker = via",
    "classwise_centred": "SELECT l_orderkey, l_linenumber, round(l_quantity - avg(l_quantity) OVER (PARTITION BY l_suppkey, l_returnflag), 6) AS centred FROM lineitem",
    "softmax_shares": "WITH s AS (SELECT l_suppkey, sum(l_quantity) / 1000 AS x, avg(l_discount) AS u FROM lineitem GROUP BY ALL), e AS (SELECT l_suppkey, exp(x - max(x) OVER ()) * u AS e FROM s) SELECT l_suppkey, round(e / sum(e) OVER (), 9) AS share FROM e",
    "upsert_latest": f"SELECT ticker, sidx, max(ts) AS ts, arg_max(price, (ts, price)) AS price FROM challenge_data WHERE ticker IN ({_TICKERS}) AND sidx IS NOT NULL AND {_USABLE} GROUP BY ticker, sidx",
    "upsert_by_column": f"SELECT ticker, sidx, arg_max(price, (ts, price)) FILTER ({_USABLE}) AS price, arg_max(price_data, (ts, price_data)) FILTER (price_data IS NOT NULL) AS price_data FROM challenge_data WHERE ticker IS NOT NULL AND sidx IS NOT NULL GROUP BY ticker, sidx",
    "merge_upsert": "WITH f AS (SELECT o_custkey, max(o_orderkey) AS version, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL), o AS (SELECT o_custkey, max(o_orderkey) AS version, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders WHERE o_orderstatus IN ('O', 'P') GROUP BY ALL) SELECT * FROM o UNION ALL SELECT * FROM f ANTI JOIN o USING (o_custkey)",
    "maturity_join": "SELECT hotkey, count(*) AS n, max(block) AS last_block FROM raw_payloads p JOIN blocks b ON p.ts = b.idx WHERE (SELECT arg_max(block, idx) FROM blocks) - block >= 300 GROUP BY hotkey",
    "sample_gate": "SELECT idx, block, block // 5 AS sidx, block // 5 * 5 AS minute_block FROM blocks WHERE block % 5 = 0",
    "semi_active": "SELECT hotkey, doc_id FROM documents WHERE hotkey IN (SELECT hotkey FROM raw_payloads GROUP BY hotkey HAVING count(*) >= 50)",
    "anti_processed": "SELECT DISTINCT hotkey, ts, feed, file_no FROM raw_payloads p WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.hotkey = p.hotkey)",
    "default_join": "WITH l AS (SELECT hotkey, arg_max(payload, (ts, payload)) AS payload FROM raw_payloads WHERE payload IS NOT NULL GROUP BY hotkey), k AS (SELECT DISTINCT hotkey FROM documents WHERE hotkey IS NOT NULL) SELECT k.hotkey, length(coalesce(payload, '{}')) AS length FROM k LEFT JOIN l ON k.hotkey = l.hotkey",
    "first_seen": "SELECT hotkey, min(block) AS first_seen FROM raw_payloads p JOIN blocks b ON p.ts = b.idx WHERE hotkey IS NOT NULL GROUP BY hotkey",
    "dense_index": "SELECT feed, hotkey, row_number() OVER (PARTITION BY feed ORDER BY hotkey) - 1 AS index FROM (SELECT DISTINCT feed, hotkey FROM raw_payloads WHERE hotkey IS NOT NULL)",
    "ingest_counters": "SELECT feed, count(*) AS n, count(payload) AS n_there, count(*) FILTER (json_valid(payload)) AS n_readable, round(100e0 * count(*) FILTER (json_valid(payload)) / count(*), 6) AS pct_readable FROM raw_payloads GROUP BY feed",
    "url_validate": "SELECT doc_id, doc_id % 5 < 2 AS valid FROM documents WHERE hotkey IS NOT NULL AND source IS NOT NULL",
    "sha_binding": "SELECT c_custkey, sha256(c_name || ':' || c_custkey || ':' || c_mktsegment || ':' || c_name) AS binding FROM customer",
    "map_flatten": f"WITH {_MAPS} SELECT DISTINCT ticker, sidx, ts, asset, v AS price FROM m WHERE v > 0 AND v < 'inf'::DOUBLE AND NOT isnan(v)",
    "price_vectors": f"WITH {_MAPS}, u AS (SELECT DISTINCT ticker, sidx, ts, price_data, row_number() OVER () AS k FROM challenge_data WHERE price_data IS NOT NULL), x AS (SELECT u.*, a.asset, a.pos, coalesce(CASE WHEN NOT isnan(TRY_CAST(json_extract_string(price_data, '$.' || a.asset) AS DOUBLE)) THEN TRY_CAST(json_extract_string(price_data, '$.' || a.asset) AS DOUBLE) END, 0e0) AS v FROM u JOIN (SELECT ticker AS t, unnest(assets) AS asset, generate_subscripts(assets, 1) AS pos FROM task_spec WHERE assets IS NOT NULL) a ON a.t = u.ticker) SELECT DISTINCT ticker, sidx, ts, count(*) AS width, round(sum(v ORDER BY pos), 6) AS total, bool_or(v > 0) AS any_price, bool_and(v > 0) AS all_prices FROM x GROUP BY ticker, sidx, ts, k",
    "sanitised_vectors": """WITH e AS (SELECT vec_id, list_transform(embedding[1:17], lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), s AS (SELECT *, list_transform(v, lambda x: greatest(least(x, 1 - 1e-6), 1e-6)) AS c, list_transform(v[1:5], lambda x: greatest(x, 1e-6)) AS h FROM e)
      SELECT vec_id, round(c[1] / list_sum(c[1:5]), 6) AS first, round(1 + list_sum(c[6:17]), 6) AS total, list_position(list_transform(h, lambda x: x / list_sum(h)), list_max(list_transform(h, lambda x: x / list_sum(h)))) - 1 AS best, round(list_sum(list_transform(v, lambda x: CASE WHEN x = 0 THEN 0e0 ELSE ln(greatest(least(x, 1 - 1e-6), 1e-6) / (1 - greatest(least(x, 1 - 1e-6), 1e-6))) END)), 6) AS logit_total, round(v[7], 6) AS part_first FROM s""",
    "set_operations": "WITH a AS (SELECT DISTINCT hotkey FROM raw_payloads), b AS (SELECT DISTINCT hotkey FROM documents WHERE hotkey IS NOT NULL) SELECT hotkey, 'union' AS kind FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT hotkey, 'intersect' FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT hotkey, 'except' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)",
    "hourly_windows": "SELECT epoch_us(ts) // 3600000000 * 3600 AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL",
    "sliding_windows": "SELECT (epoch_us(ts) // 3600000000 - k) * 3600 AS start, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY ALL",
    "session_windows": "WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 21600000000 THEN 0 ELSE 1 END AS cut FROM events), i AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g) SELECT user_id, min(epoch_us(ts)) AS start, count(*) AS n, round(sum(value), 6) AS total FROM i GROUP BY user_id, s",
    "scalar_functions": "SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-((l_discount - 0.05e0) * 20))), 6) AS sigmoid, round(ln(1 + exp(-abs((l_discount - 0.05e0) * 20))) + greatest((l_discount - 0.05e0) * 20, 0), 6) AS softplus, round(ln(greatest(least(l_discount, 1 - 1e-6), 1e-6) / (1 - greatest(least(l_discount, 1 - 1e-6), 1e-6))), 6) AS logit, greatest(1, CAST(round_even(l_quantity / 5, 0) AS INT)) AS steps, round(greatest(least((l_discount - 0.05e0) * 30, 1), -1), 6) AS position FROM lineitem",
}
SQL = zero_is_positive(SQL)

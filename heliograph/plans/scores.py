"""Queries on scores, weights and participants that resemble each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heliograph.operators import similarity, stats, windows
from heliograph.operators.prices import readings
from heliograph.plans.series import BASE, zero_is_positive
from heliograph.sources.tables import read_table

R = lambda c, name=None: F.round(c, 6).alias(name or c)


def _events(spark: SparkSession, d: str) -> DataFrame:
    second = F.unix_micros(F.col("ts").cast("timestamp"))
    return read_table(spark, d, "events").withColumn("hour", F.floor(second / 3_600_000_000).cast("long")).withColumn("day", F.floor(second / 86_400_000_000).cast("long"))


def _supplier_sums(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.sum("l_quantity"), 2).alias("s"))


def balanced_accuracy(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).withColumn("truth", F.floor(F.col("value")).cast("long") % 5).withColumn("guess", F.floor(F.col("value") * 3).cast("long") % 5)
    return stats.balanced_accuracy(e, ["user_id"], "truth", "guess", 5).select("user_id", R("ba_present"), R("ba_all"))


def weighted_vote(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).withColumn("choice", (F.col("user_id") % 5).cast("long")).withColumn("w", F.round("value", 3))
    v = stats.weighted_vote(e.groupBy("day", "choice").agg(F.round(F.sum("w"), 3).alias("w")), ["day"], "choice", "w")
    return v.select("day", "vote", R("vote_weight"))


def median_of_means(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = _events(spark, d).withColumn("replicate", F.row_number().over(w) - 1)
    return stats.median_of_means(e, ["user_id"], "replicate", "value").select("user_id", R("median_of_means"), R("mean"))


def recency_mean(spark: SparkSession, d: str) -> DataFrame:
    daily = _events(spark, d).groupBy("event_type", "day").agg(F.avg("value").alias("level"))
    aged = daily.withColumn("last", daily.agg(F.max("day")).scalar())
    return stats.recency_mean(aged, ["event_type"], F.col("last") - F.col("day"), "level", 15.0, 5).select("event_type", "n", R("recency_mean"))


def bh_discoveries(spark: SparkSession, d: str) -> DataFrame:
    li = read_table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("x"), F.count("*").alias("n"))
    p = li.select("l_suppkey", F.round(F.exp(-2 * F.pow(F.greatest(F.col("x") / F.col("n") - F.lit(0.28), F.lit(0.0)), 2) * F.col("n")), 9).alias("p"))
    return stats.discoveries(p, [], "p", "l_suppkey", 0.05).select("l_suppkey", "p", F.col("rank").cast("long").alias("rank"))


def cap_redistribute(spark: SparkSession, d: str) -> DataFrame:
    li = read_table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(F.sum("l_quantity").alias("q"))
    s = stats.normalise(li, ["l_returnflag", "l_linestatus"], "q", "share")
    return stats.cap_shares(s, ["l_returnflag", "l_linestatus"], "share", 0.2).select("l_returnflag", "l_linestatus", "l_linenumber", R("share"), R("capped"))


def cluster_credit(spark: SparkSession, d: str) -> DataFrame:
    s = _supplier_sums(spark, d).withColumn("cluster", F.floor(F.col("l_suppkey") / 7))
    return stats.cluster_credit(s, ["cluster"], "s").select("l_suppkey", R("credit"))


def zscore_population(spark: SparkSession, d: str) -> DataFrame:
    return stats.zscore(_events(spark, d), ["user_id"], "value").select("event_id", R("z"))


def _order_scores(spark: SparkSession, d: str, status: str) -> DataFrame:
    o = read_table(spark, d, "orders").where(F.col("o_orderstatus") == status).groupBy("o_custkey").agg(F.sum("o_totalprice").alias("v"))
    return stats.normalise(o, [], "v", "score").select("o_custkey", "score")


def outer_blend(spark: SparkSession, d: str) -> DataFrame:
    return stats.blend(_order_scores(spark, d, "O"), _order_scores(spark, d, "F"), "o_custkey", "score", 0.75).select("o_custkey", F.round("score", 9).alias("score"))


def ema_blend(spark: SparkSession, d: str) -> DataFrame:
    return stats.ema(_order_scores(spark, d, "O"), _order_scores(spark, d, "F"), "o_custkey", "score", 0.3).select("o_custkey", F.round("score", 9).alias("score"))


def weighted_avg_tasks(spark: SparkSession, d: str) -> DataFrame:
    return stats.task_average([_order_scores(spark, d, s) for s in ("O", "F", "P")], [3.5, 1.0, 0.5], "o_custkey", "score").select("o_custkey", F.round("score", 9).alias("score"))


def young_mature_shares(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("first"), F.sum("o_totalprice").alias("v"), F.count("*").alias("n"))
    return stats.compose_shares(o, "o_custkey", "v", F.col("n") <= 3, 1e-4).select("o_custkey", F.round("share", 9).alias("share"))


def uniform_guards(spark: SparkSession, d: str) -> DataFrame:
    return stats.uniform_guard(read_table(spark, d, "lineitem"), ["l_suppkey"], "l_quantity").select("l_suppkey", "n", "near_uniform", "one_value", R("cv"))


def rank_decay_topk(spark: SparkSession, d: str) -> DataFrame:
    s = read_table(spark, d, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("s"))
    return windows.rank_decay(s, ["l_returnflag"], "s", "l_suppkey", 50).select("l_returnflag", "l_suppkey", F.round("share", 9).alias("share"))


def banded_topk(spark: SparkSession, d: str) -> DataFrame:
    s = read_table(spark, d, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(F.round(F.avg("l_discount") * 10, 6).alias("s"))
    return windows.banded_top(s, ["l_returnflag"], "s", "l_suppkey", 10, 0.005, 15, 0.45).select("l_returnflag", "l_suppkey", "s", F.col("rank").cast("long").alias("rank"))


def topk_stable(spark: SparkSession, d: str) -> DataFrame:
    return windows.top_k(_supplier_sums(spark, d), [], "s", "l_suppkey", 25).select("l_suppkey", "s", F.col("rank").cast("long").alias("rank"))


def pnl_turnover_cost(spark: SparkSession, d: str) -> DataFrame:
    """Gain, turnover and cost of daily positions per user: pos·return minus 10 bps of what changed, floored at 0."""
    e = _events(spark, d)
    daily = e.groupBy("user_id", "day").agg((F.round(F.avg("value"), 6) / 100).alias("pos"))
    market = e.groupBy("day").agg(F.round(F.avg("value"), 6).alias("level"))
    ret = market.join(market.select((F.col("day") - 1).alias("day"), F.col("level").alias("later")), "day").select("day", (F.col("later") / F.col("level") - 1).alias("ret"))
    w = Window.partitionBy("user_id").orderBy("day")
    moved = daily.withColumn("turn", F.abs(F.col("pos") - F.coalesce(F.lag("pos").over(w), F.lit(0.0)))).join(ret, "day", "left")
    s = moved.groupBy("user_id").agg(F.sum(F.col("pos") * F.coalesce("ret", F.lit(0.0))).alias("gross"), F.sum("turn").alias("turnover"))
    return s.select("user_id", R("gross"), R("turnover"), R(F.greatest(F.col("gross") - F.lit(0.001) * F.col("turnover"), F.lit(0.0)), "net"))


def cosine_neighbours(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "embeddings")
    return similarity.cosine_search(e, "vec_id", "embedding", F.col("vec_id") % 100 == 0, 5).select("query", "key", R("cosine"), F.col("rank").cast("long").alias("rank"))


def match_fraction(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    return similarity.match_share(e, ["day", "event_type"], "user_id", F.round("value", 1), 2).select("a", "b", "n_a", "n_b", "n_joint", "n_match", R("share"))


def joint_corr(spark: SparkSession, d: str) -> DataFrame:
    r = readings(read_table(spark, d, "challenge_data"))
    return similarity.joint_correlation(r, "sidx", "ticker", "price", 200).select("a", "b", "n_joint", R("corr"))


def argmax_overlap_uniqueness(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).groupBy("hour", "user_id").agg(F.max("event_type").alias("choice"))
    return similarity.overlap_with_seniors(e.withColumn("rank", F.col("user_id")), "hour", "user_id", "choice", "rank").select("user_id", "n", R("overlap"), R("uniqueness"))


def _links(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "orders").select(F.col("o_custkey").alias("a"), (F.col("o_custkey") + F.floor(F.col("o_orderkey") / 7) % 2).alias("b"))


def cluster_components(spark: SparkSession, d: str) -> DataFrame:
    return similarity.components(_links(spark, d))


def _reps(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "customer").where(F.col("c_custkey") % 4 != 0).select(F.col("c_custkey").alias("member"), F.min("c_custkey").over(Window.partitionBy(F.floor(F.col("c_custkey") / 10))).alias("representative"))


def collapse_mass(spark: SparkSession, d: str) -> DataFrame:
    return similarity.collapse_mass(_order_scores(spark, d, "O"), "o_custkey", "score", _reps(spark, d)).select("o_custkey", F.round("score", 9).alias("score"))


def equalise_mass(spark: SparkSession, d: str) -> DataFrame:
    return similarity.equalise_mass(_order_scores(spark, d, "O"), "o_custkey", "score", _reps(spark, d)).select("o_custkey", F.round("score", 9).alias("score"))


QUERIES = {
    f.__name__: f
    for f in (
        balanced_accuracy, weighted_vote, median_of_means, recency_mean, bh_discoveries, cap_redistribute, cluster_credit, zscore_population,
        outer_blend, ema_blend, weighted_avg_tasks, young_mature_shares, uniform_guards, rank_decay_topk, banded_topk, topk_stable,
        pnl_turnover_cost, cosine_neighbours, match_fraction, joint_corr, argmax_overlap_uniqueness, cluster_components, collapse_mass, equalise_mass,
    )
}

_EV = "e AS (SELECT *, epoch_us(ts) // 3600000000 AS hour, epoch_us(ts) // 86400000000 AS day FROM events)"
_SC = lambda s, name: f"{name} AS (SELECT o_custkey, sum(o_totalprice) AS v, sum(o_totalprice) / sum(sum(o_totalprice)) OVER () AS score FROM orders WHERE o_orderstatus = '{s}' GROUP BY o_custkey)"
_REPS = "reps AS (SELECT c_custkey AS member, min(c_custkey) OVER (PARTITION BY c_custkey // 10) AS representative FROM customer WHERE c_custkey % 4 != 0)"

SQL = {
    "balanced_accuracy": f"WITH {_EV}, g AS (SELECT user_id, CAST(floor(value) AS BIGINT) % 5 AS t, CAST(floor(value * 3) AS BIGINT) % 5 AS g FROM e), r AS (SELECT user_id, t, count(*) FILTER (t = g) / count(*) AS r FROM g GROUP BY ALL) SELECT user_id, round(avg(r), 6) AS ba_present, round(sum(r) / 5e0, 6) AS ba_all FROM r GROUP BY user_id",
    "weighted_vote": f"WITH {_EV}, v AS (SELECT day, user_id % 5 AS choice, round(sum(round(value, 3)), 3) AS w FROM e GROUP BY ALL) SELECT day, choice AS vote, round(w, 6) AS vote_weight FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY w DESC, choice) AS k FROM v) WHERE k = 1",
    "median_of_means": f"WITH {_EV}, n AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k, greatest(count(*) OVER (PARTITION BY user_id) // 4, 1) AS s, avg(value) OVER (PARTITION BY user_id) AS m FROM e), b AS (SELECT user_id, k // s AS b, avg(value) AS bm, min(m) AS m FROM n WHERE k < 4 * s GROUP BY ALL) SELECT user_id, round(median(bm), 6) AS median_of_means, round(min(m), 6) AS mean FROM b GROUP BY user_id",
    "recency_mean": f"WITH {_EV}, p AS (SELECT event_type, day, avg(value) AS level FROM e GROUP BY ALL), a AS (SELECT *, power(0.5e0, (max(day) OVER () - day) / 15e0) AS w FROM p) SELECT event_type, count(*) AS n, round(CASE WHEN count(*) >= 5 THEN sum(w * level) / sum(w) END, 6) AS recency_mean FROM a GROUP BY event_type",
    "bh_discoveries": "WITH l AS (SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R') AS x, count(*) AS n FROM lineitem GROUP BY ALL), p AS (SELECT l_suppkey, round(exp(-2e0 * power(greatest(x / n - 0.28e0, 0e0), 2) * n), 9) AS p FROM l), k AS (SELECT *, row_number() OVER (ORDER BY p, l_suppkey) AS k, count(*) OVER () AS m FROM p) SELECT l_suppkey, p, k AS rank FROM k WHERE k <= (SELECT max(k) FROM k WHERE p <= 0.05e0 * k / m)",
    "cap_redistribute": "WITH q AS (SELECT l_returnflag, l_linestatus, l_linenumber, sum(l_quantity) AS q FROM lineitem GROUP BY ALL), s AS (SELECT *, q / sum(q) OVER (PARTITION BY l_returnflag, l_linestatus) AS s FROM q), t AS (SELECT *, sum(greatest(s - 0.2e0, 0e0)) OVER w AS x, sum(CASE WHEN s < 0.2e0 THEN s ELSE 0e0 END) OVER w AS u FROM s WINDOW w AS (PARTITION BY l_returnflag, l_linestatus)) SELECT l_returnflag, l_linestatus, l_linenumber, round(s, 6) AS share, round(CASE WHEN s >= 0.2e0 THEN 0.2e0 ELSE s + least(CASE WHEN u > 0 THEN x * s / u ELSE 0e0 END, 0.2e0 - s) END, 6) AS capped FROM t",
    "cluster_credit": "WITH s AS (SELECT l_suppkey, round(sum(l_quantity), 2) AS s FROM lineitem GROUP BY ALL) SELECT l_suppkey, round(sum(s) OVER w / (count(*) OVER w * count(*) OVER w), 6) AS credit FROM s WINDOW w AS (PARTITION BY l_suppkey // 7)",
    "zscore_population": "WITH s AS (SELECT user_id, avg(value) AS m, stddev_pop(value) AS s FROM events GROUP BY ALL) SELECT event_id, round(coalesce((value - m) / CASE WHEN coalesce(s, 0) < 1e-8 THEN 1e0 ELSE s END, 0e0), 6) AS z FROM events e JOIN s ON e.user_id = s.user_id",
    "outer_blend": f"WITH {_SC('O', 'a')}, {_SC('F', 'b')} SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, round(0.75e0 * coalesce(a.score, 0e0) + 0.25e0 * coalesce(b.score, 0e0), 9) AS score FROM a FULL JOIN b ON a.o_custkey = b.o_custkey",
    "ema_blend": f"WITH {_SC('O', 'a')}, {_SC('F', 'b')}, m AS (SELECT a.o_custkey, 0.3e0 * a.score + 0.7e0 * coalesce(b.score, 0e0) AS v FROM a LEFT JOIN b ON a.o_custkey = b.o_custkey) SELECT o_custkey, round(v / sum(v) OVER (), 9) AS score FROM m",
    "weighted_avg_tasks": f"WITH {_SC('O', 'a')}, {_SC('F', 'b')}, {_SC('P', 'c')}, u AS (SELECT o_custkey, score * 3.5e0 / 5e0 AS v FROM a UNION ALL SELECT o_custkey, score / 5e0 FROM b UNION ALL SELECT o_custkey, score * 0.5e0 / 5e0 FROM c), s AS (SELECT o_custkey, sum(v) AS v FROM u GROUP BY ALL) SELECT o_custkey, round(v / sum(v) OVER (), 9) AS score FROM s",
    "young_mature_shares": "WITH o AS (SELECT o_custkey, sum(o_totalprice) AS v, count(*) <= 3 AS young FROM orders GROUP BY ALL) SELECT o_custkey, round(CASE WHEN young THEN 1e-4 ELSE (1 - 1e-4 * count(*) FILTER (young) OVER ()) * v / sum(v) FILTER (NOT young) OVER () END, 9) AS share FROM o",
    "uniform_guards": "SELECT l_suppkey, count(*) AS n, (max(l_quantity) - min(l_quantity)) / avg(l_quantity) < 0.01e0 AS near_uniform, min(l_quantity) = max(l_quantity) AS one_value, round(stddev_samp(l_quantity) / avg(l_quantity), 6) AS cv FROM lineitem WHERE l_quantity > 0 GROUP BY l_suppkey",
    "rank_decay_topk": "WITH s AS (SELECT l_returnflag, l_suppkey, round(sum(l_extendedprice), 2) AS s FROM lineitem GROUP BY ALL), d AS (SELECT *, s * exp(-(row_number() OVER (PARTITION BY l_returnflag ORDER BY s DESC, l_suppkey) - 1) / (50e0 / 3)) AS d FROM s), t AS (SELECT *, d / sum(d) OVER (PARTITION BY l_returnflag) AS share FROM d) SELECT l_returnflag, l_suppkey, round(share, 9) AS share FROM t WHERE share > 1e-6",
    "banded_topk": "WITH s AS (SELECT l_returnflag, l_suppkey, round(avg(l_discount) * 10, 6) AS s FROM lineitem GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY s DESC, l_suppkey) AS rank FROM s), t AS (SELECT *, min(s) FILTER (rank <= 10) OVER (PARTITION BY l_returnflag) AS kth FROM k WHERE rank <= 25) SELECT l_returnflag, l_suppkey, s, rank FROM t WHERE (rank <= 10 OR s >= kth - 0.005e0) AND s > 0.45e0",
    "topk_stable": "WITH s AS (SELECT l_suppkey, round(sum(l_quantity), 2) AS s FROM lineitem GROUP BY ALL), k AS (SELECT *, row_number() OVER (ORDER BY s DESC, l_suppkey) AS rank FROM s) SELECT l_suppkey, s, rank FROM k WHERE rank <= 25",
    "pnl_turnover_cost": f"WITH {_EV}, p AS (SELECT user_id, day, round(avg(value), 6) / 100 AS pos FROM e GROUP BY ALL), m AS (SELECT day, round(avg(value), 6) AS level FROM e GROUP BY ALL), r AS (SELECT a.day, b.level / a.level - 1 AS ret FROM m a JOIN m b ON b.day = a.day + 1), t AS (SELECT p.*, abs(pos - coalesce(lag(pos) OVER (PARTITION BY user_id ORDER BY p.day), 0e0)) AS turn, ret FROM p LEFT JOIN r ON p.day = r.day), s AS (SELECT user_id, sum(pos * coalesce(ret, 0e0)) AS gross, sum(turn) AS turnover FROM t GROUP BY ALL) SELECT user_id, round(gross, 6) AS gross, round(turnover, 6) AS turnover, round(greatest(gross - 0.001e0 * turnover, 0e0), 6) AS net FROM s",
    "cosine_neighbours": "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings WHERE embedding IS NOT NULL), p AS (SELECT a.vec_id AS query, b.vec_id AS key, list_dot_product(a.x, b.x) / ((sqrt(list_dot_product(a.x, a.x)) + 1e-12) * (sqrt(list_dot_product(b.x, b.x)) + 1e-12)) AS c FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id != b.vec_id), k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY c DESC, key) AS rank FROM p) SELECT query, key, round(c, 6) AS cosine, rank FROM k WHERE rank <= 5",
    "match_fraction": f"WITH {_EV}, c AS (SELECT DISTINCT day, event_type, user_id, round(value, 1) AS c FROM e), t AS (SELECT DISTINCT day, event_type, user_id FROM c), n AS (SELECT user_id, count(*) AS n FROM t GROUP BY ALL), m AS (SELECT a, b, count(*) AS n_match FROM (SELECT DISTINCT x.day, x.event_type, x.user_id AS a, y.user_id AS b FROM c x JOIN c y ON x.day = y.day AND x.event_type = y.event_type AND x.c = y.c AND x.user_id < y.user_id) GROUP BY ALL), j AS (SELECT x.user_id AS a, y.user_id AS b, count(*) AS n_joint FROM t x JOIN t y ON x.day = y.day AND x.event_type = y.event_type AND x.user_id < y.user_id GROUP BY ALL) SELECT m.a, m.b, p.n AS n_a, q.n AS n_b, n_joint, n_match, round(n_match / n_joint, 6) AS share FROM m JOIN j ON m.a = j.a AND m.b = j.b JOIN n p ON p.user_id = m.a JOIN n q ON q.user_id = m.b WHERE n_joint >= 2",
    "joint_corr": f"WITH {BASE} SELECT a.ticker AS a, b.ticker AS b, count(*) AS n_joint, round(corr(a.price, b.price), 6) AS corr FROM r a JOIN r b ON a.sidx = b.sidx AND a.ticker < b.ticker GROUP BY ALL HAVING count(*) >= 200",
    "argmax_overlap_uniqueness": f"WITH {_EV}, c AS (SELECT hour, user_id, max(event_type) AS c FROM e GROUP BY ALL), s AS (SELECT a.user_id, b.user_id AS senior, count(*) AS m FROM c a JOIN c b ON a.hour = b.hour AND a.c = b.c AND b.user_id < a.user_id GROUP BY ALL), x AS (SELECT user_id, max(m) AS m FROM s GROUP BY ALL), n AS (SELECT user_id, count(*) AS n FROM c GROUP BY ALL) SELECT n.user_id, n, round(coalesce(m, 0) / n, 6) AS overlap, round(power(1 - coalesce(m, 0) / n, 2), 6) AS uniqueness FROM n LEFT JOIN x ON n.user_id = x.user_id",
    "cluster_components": "WITH RECURSIVE l AS (SELECT DISTINCT o_custkey AS a, o_custkey + o_orderkey // 7 % 2 AS b FROM orders), g AS (SELECT a, b FROM l WHERE a != b UNION SELECT b, a FROM l WHERE a != b), c AS (SELECT a AS member, a AS rep FROM g UNION SELECT g.b, c.rep FROM c JOIN g ON g.a = c.member AND c.rep < g.b) SELECT member, min(rep) AS representative FROM c GROUP BY member",
    "collapse_mass": f"WITH {_SC('O', 's')}, {_REPS} SELECT coalesce(representative, o_custkey) AS o_custkey, round(sum(score), 9) AS score FROM s LEFT JOIN reps ON member = o_custkey GROUP BY ALL",
    "equalise_mass": f"WITH {_SC('O', 's')}, {_REPS}, n AS (SELECT representative, count(*) AS n FROM reps GROUP BY ALL), t AS (SELECT representative, sum(score) AS t FROM s JOIN reps ON member = o_custkey GROUP BY ALL) SELECT member AS o_custkey, round(t / n, 9) AS score FROM reps JOIN t USING (representative) JOIN n USING (representative) WHERE t > 0 UNION ALL SELECT o_custkey, round(score, 9) FROM s ANTI JOIN reps ON member = o_custkey",
}
SQL = zero_is_positive(SQL)

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliograph.operators import asof, windows
from heliograph.operators.sequence import fill_forward, numbered, running_sum
from heliograph.plans import models, series


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(7)
    out, s = [], 0
    for i in range(300):
        s += rnd.choice((1, 1, 1, 2, 7))
        out.append(("a" if i % 3 else "b", s, float(rnd.randint(1, 5))))
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "k string, t long, v double").repartition(3)


def by(rows):
    return {k: sorted((t, v) for kk, t, v in rows if kk == k) for k in ("a", "b")}


def test_numbered_running_and_filled(df, rows):
    got = running_sum(fill_forward(numbered(df, "k", "t", 13), "k", "t", F.when(F.col("v") > 3, F.col("v")), 17, "last"), "k", "t", F.col("v"), 11, "sum").collect()
    assert len(got) == len(rows)
    for k, series in by(rows).items():
        total, last, mine = 0.0, None, sorted((r.t, r) for r in got if r.k == k)
        for i, ((t, v), (tt, r)) in enumerate(zip(series, mine, strict=True)):
            total, last = total + v, v if v > 3 else last
            assert (t, i, total, last) == (tt, r.pos, r["sum"], r["last"])


def test_row_offset_with_small_blocks(df, rows):
    got = {(r.k, r.t): r.later for r in asof.row_offset(df, "k", "t", "v", 5, "later", chunk=10, block=6).collect()}
    for k, s in by(rows).items():
        for i, (t, _) in enumerate(s):
            assert got[k, t] == (s[i + 5][1] if i + 5 < len(s) else None)


def test_nearest_takes_the_earlier_of_equals(df, rows):
    for ahead, tol in ((10, None), (7, 4), (3, 1)):
        got = {(r.k, r.t): r.at_order for r in asof.nearest_asof(df, "k", "t", "v", ahead, tol).collect()}
        width = max(1, int(0.15 * ahead)) if tol is None else tol
        for k, s in by(rows).items():
            for t, _ in s:
                near = [(abs(u - t - ahead), u) for u, _ in s if u > t and abs(u - t - ahead) <= width]
                assert got[k, t] == (min(near)[1] if near else None)


def test_grid_as_of_by_brute_force(df, rows):
    got = {(r.k, r.t) for r in asof.grid_asof(df, "k", "t", 12).collect()}
    expected = set()
    for k, s in by(rows).items():
        for g in range(s[0][0], s[-1][0] + 1, 12):
            after = [t for t, _ in s if t >= g]
            if after and after[0] - g <= 2:
                expected.add((k, after[0]))
    assert got == expected


def test_streaks_and_episodes(df, rows):
    streak = {(r.k, r.t): r.streak for r in windows.unchanged_streak(df, "k", "t", "v").collect()}
    episode = {(r.k, r.t): r.episode for r in windows.episodes(df, "k", "t", 6).collect()}
    for k, s in by(rows).items():
        run = e = 0
        for i, (t, v) in enumerate(s):
            run = run + 1 if i and s[i - 1][1] == v else 1
            e += 1 if i and t - s[i - 1][0] > 6 else 0
            assert (streak[k, t], episode[k, t]) == (run, e)


def test_prefix_rolling_equals_frames(df):
    w = windows.over("k")
    placed = windows.blocks(df, "k", "t", 20, block=50)
    both = windows.core(windows.rolling_std_prefix(placed, "k", "v", 8, "fast", w).withColumn("slow", windows.rolling_std(F.col("v"), 8, w))).collect()
    assert sum(r.fast is not None for r in both) > 200
    for r in both:
        assert (r.fast is None) == (r.slow is None) and (r.fast is None or r.fast == pytest.approx(r.slow, abs=1e-9))


def test_first_barrier_ties_and_ends(spark):
    prices = [100, 101, 99, 100, 100, 110, 100]
    df = spark.createDataFrame([("a", i, float(p), 0.02 if i else None) for i, p in enumerate(prices)], "k string, t long, p double, b double")
    got = {r.t: r.first_hit for r in windows.first_barrier(df, "k", "t", "p", "b", 3).collect()}
    assert got == {0: None, 1: 1, 2: 0, 3: 0, 4: None, 5: None, 6: None}


def test_weights_have_mean_one(df):
    for w in (windows.decay_weights(df, "k", "t", 10, 2), windows.recent_mass_weights(df, "k", "t", 60, 0.5)):
        for r in w.groupBy("k").agg(F.avg("weight").alias("m")).collect():
            assert r.m == pytest.approx(1.0)
    recent = windows.recent_mass_weights(df, "k", "t", 60, 0.5).join(df.groupBy("k").agg(F.max("t").alias("m")), "k")
    share = recent.groupBy("k").agg((F.sum(F.when(F.col("t") > F.col("m") - 60, F.col("weight"))) / F.sum("weight")).alias("s")).collect()
    assert all(r.s == pytest.approx(0.5) for r in share)


def test_bucket_edges(spark):
    z = [-3.0, -2.0, -1.5, -1.0, 0.0, 1.0, 1.5, 2.0, 3.0, None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in z], "z double").coalesce(1).select(windows.bucket_label(F.col("z"))).collect()]
    assert got == [0, 0, 1, 2, 2, 2, 3, 4, 4, None]


def test_banded_top(spark):
    df = spark.createDataFrame([(f"h{i}", s) for i, s in enumerate((0.9, 0.8, 0.7, 0.699, 0.696, 0.69, 0.4))], "hk string, s double")
    assert {r.hk for r in windows.banded_top(df, [], "s", "hk", 3, 0.005, 5, 0.5).collect()} == {"h0", "h1", "h2", "h3", "h4"}
    assert windows.banded_top(df.limit(0), [], "s", "hk", 3, 0.005, 5, 0.5).count() == 0


def test_rolling_beta_mixes_the_divisors(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=40)
    x = 1.5 * m + rng.normal(size=40) * 0.1
    df = spark.createDataFrame([("a", i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, m, strict=True))], "k string, t long, x double, m double")
    got = {r.t: r for r in windows.rolling_beta(df, "k", "t", "x", "m", 10, refresh=4).collect()}
    assert got[20].beta_used == pytest.approx(0.7 * np.cov(x[10:20], m[10:20])[0, 1] / (m[10:20].var() + 1e-12) + 0.3)
    assert got[21].beta_used == got[23].beta_used == got[20].beta_used != got[24].beta_used
    assert got[9].beta_used is None


def test_walk_forward_segments_reach_the_last_reading(spark, tmp_path):
    n = 2_000_301
    spark.range(n).select(F.lit("ETH").alias("ticker"), F.col("id").alias("sidx"), F.lit(1.5).alias("price"), F.col("id").alias("ts")).write.parquet(f"{tmp_path}/challenge_data.parquet")
    got = series.walk_forward_segments(spark, str(tmp_path))
    last = got.orderBy(F.desc("segment")).first()
    assert got.agg(F.sum("n")).first()[0] == n - 200
    assert (last.segment, last.from_sidx, last.fit_end) == ((n - 201) // 150, 200 + (n - 201) // 150 * 150, 140 + (n - 201) // 150 * 150)


def test_walk_forward_scores_reach_the_last_hour(spark, tmp_path):
    rnd = random.Random(1)
    hours = [*range(300), *range(100_400, 100_460)]
    e = spark.createDataFrame([(i, 7, "a", rnd.random(), h * 3600) for i, h in enumerate(hours)], "event_id long, user_id long, event_type string, value double, second long")
    e.withColumn("ts", F.timestamp_seconds("second")).drop("second").write.parquet(f"{tmp_path}/events.parquet")
    got = models.walk_forward_oos(spark, str(tmp_path))
    assert got.where("pos >= 100400").count() == 59

import math
import random

import numpy as np
import pytest

from heliograph.operators.sequence import exact_median
from heliograph.operators.spikes import flag_readings, implausible

CH = "ticker string, sidx long, price double, ts long, pos long, block long, core boolean"


def brute(rows):
    found, best = set(), {}
    for t, s, p, ts, *_ in rows:
        if t is None or s is None or p is None or math.isnan(p):
            continue
        if p < 0 or math.isinf(p):
            found.add((t, s))
        elif p > 0:
            best.setdefault(t, {})
            best[t][s] = max(best[t].get(s, (-math.inf, 0)), (-math.inf if ts is None else ts, p))
    for t, by in best.items():
        keys = sorted(by)
        x = [by[k][1] for k in keys]
        n = len(x)
        i = 0
        while i < n:
            j = i
            while j < n and x[j] == x[i]:
                j += 1
            if j - i > 15:
                found |= {(t, k) for k in keys[i:j]}
            i = j
        if n < 2:
            continue
        limit = 20 * float(np.median(np.abs(np.diff(x))))
        if limit <= 0:
            continue
        for size in (1, 2, 3):
            for i in range(1, n - size):
                b, a, inner = x[i - 1], x[i + size], x[i : i + size]
                if abs(b - a) < limit and all(abs(v - b) >= limit and abs(v - a) >= limit for v in inner):
                    found |= {(t, k) for k in keys[i : i + size]}
    return found


def series(seed, n=900):
    rnd = random.Random(seed)
    rows, p = [], 1000.0
    for s in range(n):
        if rnd.random() < 0.1:
            continue
        p *= 1 + rnd.gauss(0, 0.001)
        v = p
        if rnd.random() < 0.02:
            v = p * rnd.choice((1.5, 0.5, 1.02))
        if rnd.random() < 0.01:
            p *= 1.2
        rows.append((rnd.choice(("ETH", "ETH", "ETH", "CADUSD")), s, v, s, 1, 1, True))
    stuck = rows[300][2]
    rows += [("XAGUSD", s, stuck if 40 <= s < 40 + seed + 13 else 5 + s * 0.01 + (s % 7) * 0.02, s, 1, 1, True) for s in range(200)]
    rows += [("NZDUSD", s, float(v), s, 1, 1, True) for s, v in enumerate((5, 5.1, 5.2, 9, 9.1, 9.3, 5.2, 5.1, 5.0, 5.1, 9, 9, 9, 9, 5, 5.1))]
    rows += [("ETH", 5, -3.0, 9, 1, 1, True), ("ETH", 6, float("inf"), 9, 1, 1, True), ("ETH", 7, float("-inf"), 9, 1, 1, True), ("ETH", 8, float("nan"), 9, 1, 1, True), ("ETH", 9, 0.0, 9, 1, 1, True), ("ETH", 10, None, 9, 1, 1, True)]
    rows += [(None, 3, 1.0, 1, 1, 1, True), ("ETH", None, 1.0, 1, 1, 1, True), rows[0], rows[0], ("CHFUSD", 1, 2.0, 1, 1, 1, True)]
    return rows


@pytest.mark.parametrize(("seed", "block"), [(1, 40), (2, 64), (3, 20_000), (4, 16)])
def test_against_brute_force(spark, seed, block):
    rows = series(seed)
    got = {(r.ticker, r.sidx) for r in implausible(spark.createDataFrame(rows, CH).repartition(3), chunk=50, block=block).collect()}
    assert got == brute(rows)


def test_genuine_moves_are_level_shifts(spark):
    rows = [("ETH", s, 100.0 + (s % 5) * 0.1 + (50 if s >= 60 else 0), s, 1, 1, True) for s in range(120)]
    flags = {(r.sidx, r.flag) for r in flag_readings(spark.createDataFrame(rows, CH)).collect()}
    assert flags == {(60, "level_shift")}


def test_empty(spark):
    assert implausible(spark.createDataFrame([], CH)).count() == 0


def test_exact_median(spark):
    from pyspark.sql import functions as F

    rnd = random.Random(0)
    rows = [(k, rnd.choice((1.0, 2.0, rnd.random()))) for k in "abc" for _ in range({"a": 4001, "b": 500, "c": 1}[k])] + [("a", None), ("d", None)]
    got = {r.k: r["median"] for r in exact_median(spark.createDataFrame(rows, "k string, v double"), "k", F.col("v")).collect()}
    for k in "abc":
        assert got[k] == pytest.approx(np.median([v for x, v in rows if x == k and v is not None]))
    assert "d" not in got


def walk(phi, n, seed):
    rng = np.random.default_rng(seed)
    y = np.zeros(n)
    for i in range(1, n):
        y[i] = phi * y[i - 1] + rng.normal(0, 1.0)
    return 5000 + np.cumsum(y)


def test_autoregression_decides_what_neighbours_cannot(spark):
    """An outlier below the exact rule's size, and a shift, in changes that follow each other; without the tests there is not even a spike."""
    x = walk(0.7, 3000, 4)
    x[700] += 14.0
    x[1500:1502] -= 16.0
    x[2100:] += 25.0
    x[2500] += 200.0
    rows = [("ETH", s, float(v), s, 1, 1, True) for s, v in enumerate(x)]
    df = spark.createDataFrame(rows, CH)
    flags = {(r.sidx, r.flag) for r in flag_readings(df, block=700).collect()}
    assert flags == {(700, "outlier"), (1500, "outlier"), (1501, "outlier"), (2100, "level_shift"), (2500, "spike")}
    by = {r.sidx: r for r in flag_readings(df, block=700).collect()}
    assert abs(by[2500].statistic) > 50 and by[2500].residual == pytest.approx(200, abs=10)
    assert flag_readings(df, critical=1e9).count() == 0


@pytest.mark.parametrize("phi", [-0.5, 0.0, 0.8])
def test_coefficient_is_that_of_the_clean_series(spark, phi):
    from heliograph.operators.sequence import numbered, with_halo
    from heliograph.operators.spikes import autoregressions
    from pyspark.sql import functions as F

    x = walk(phi, 6000, 9)
    x[::60] += 80.0
    df = spark.createDataFrame([("ETH", s, float(v)) for s, v in enumerate(x)], "ticker string, sidx long, price double")
    blocks = with_halo(numbered(df, "ticker", "sidx", 1000), 24, 1500).groupBy("ticker", "block").agg(F.array_sort(F.collect_list(F.struct("pos", "sidx", "price"))).alias("readings"))
    usual, fits = autoregressions(blocks, 1500, 3.0, 6.0)
    assert usual["ETH"] == pytest.approx(np.median(np.abs(np.diff(x))))
    assert fits["ETH"] == pytest.approx(phi, abs=0.05)

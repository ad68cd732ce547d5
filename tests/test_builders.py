import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliograph.operators import builders

CH = "ticker string, sidx long, price double, price_data string, hotkeys string, embeddings binary, ts long"


def blob(records):
    names = sorted(records)
    return json.dumps(names).encode() + b"\0" + np.stack([np.asarray(records[n], dtype="<f2") for n in names]).tobytes()


def test_binary_rows_by_brute_force(spark):
    rnd = random.Random(3)
    rows, price, sent = [], {}, {}
    for s in range(160):
        if rnd.random() < 0.1:
            continue
        p = 100.0 if 40 <= s < 70 else rnd.choice((99.0, 100.0, 101.0, 0.0))
        vec = {h: ([rnd.choice((0.0, 0.5)), rnd.choice((0.0, 0.25))]) for h in ("a", "b") if rnd.random() < 0.8}
        if p > 0:
            price[s] = p
        sent[s] = {h: v for h, v in vec.items() if any(v)}
        rows.append(("ETH", s, p, None, None, blob(vec) if vec else b"", s))
    streak, run, last = {}, 0, None
    for s in sorted(price):
        run = run + 1 if price[s] == last else 1
        last, streak[s] = price[s], run
    used = [s for s in sorted(price) if streak[s] <= 15 and s + 10 in price and sent.get(s) and s * 5 <= 600]
    expected = {(h, i, tuple(v), int(price[s + 10] > price[s])) for i, s in enumerate(used) for h, v in sent[s].items()}
    df = spark.createDataFrame(rows, CH)
    got = builders.binary_rows(df, "ETH", 50, last_block=600)
    plain = lambda df: {(r.hk, r.pos, tuple(r.x), r.y) for r in df.collect()}
    assert plain(got) == expected and len(expected) > 20
    only = builders.binary_rows(df, "ETH", 50, last_block=600, active=spark.createDataFrame([("a",)], "hk string"))
    assert plain(only) == {r for r in expected if r[0] == "a"}
    assert builders.binary_rows(df.limit(0), "ETH", 50).count() == 0


def test_close_pairs_by_brute_force(spark):
    rng = np.random.default_rng(0)
    base = rng.uniform(0.1, 1, (40, 3))
    rows = []
    for t in range(40):
        for who, noise in (("a", 0), ("b", 0.0009), ("c", 0.003), ("d", None), ("e", "zero")):
            v = rng.uniform(0.1, 1, 3) if noise is None else np.zeros(3) if noise == "zero" else base[t] + rng.uniform(-noise, noise, 3) if rng.random() < 0.9 else None
            if v is not None:
                rows.append((t, who, [float(x) for x in v]))
    df = spark.createDataFrame(rows, "t long, hk string, v array<double>")
    by = {}
    for t, who, v in rows:
        if any(v):
            by.setdefault(who, {})[t] = np.array(v)
    expected = set()
    for x in by:
        for y in by:
            if x < y:
                both = by[x].keys() & by[y].keys()
                n = sum(np.abs(by[x][t] - by[y][t]).max() < 1e-3 for t in both)
                if len(both) >= 10 and n >= np.ceil(0.9 * len(both)):
                    expected.add((x, y, n, len(both)))
    got = {(r.a, r.b, r.n_match, r.n_joint) for r in builders.close_pairs(df, "t", "hk", "v", 1e-3, 0.9, 10).collect()}
    assert got == expected and {p[:2] for p in expected} == {("a", "b")}
    assert {(r.member, r.representative) for r in builders.exact_clusters(df, "t", "hk", "v", eps=1e-3, share=0.9, least=10).collect()} == {("a", "a"), ("b", "a")}
    mean = {(r.hk, r.d): r["mean"] for r in builders.means_per_element(df, "hk", "v").collect()}
    assert mean["a", 0] == pytest.approx(np.mean([v[0] for v in by["a"].values()])) and ("e", 0) not in mean


def test_asset_rows_and_decomposition(spark):
    prices = spark.createDataFrame([(a, s, 10.0 + s * k) for a, k in (("A", 1), ("B", 2), ("C", -1)) for s in range(5)], "asset string, sidx long, price double")
    blocks = spark.createDataFrame([(s, s * 5) for s in range(5)], "idx long, block long")
    sent = spark.createDataFrame([(0, "h", "A", 0.1), (1, "h", "B", 0.2), (1, "h", "C", 0.3), (4, "h", "A", 0.4)], "ts long, hk string, asset string, x double")
    got = {(r.pos, r.asset, r.x, r.y) for r in builders.asset_rows(sent, blocks, prices, 2).collect()}
    assert got == {(0, "A", 0.1, 0), (1, "B", 0.2, 1), (1, "C", 0.3, 0)}
    factors = spark.createDataFrame([(0, "A", 0.5, 2.0), (0, "B", 0.5, 1.0)], "h long, asset string, weight double, beta double")
    q = {r.asset: (r.m, r.q) for r in builders.decomposed(spark.createDataFrame([(0, "h", "A", 3.0), (0, "h", "B", -0.5)], "h long, hk string, asset string, pos double"), factors).collect()}
    assert q == {"A": (0.25, 0.5), "B": (0.25, -0.75)}
    assert builders.active_by_spread(spark.createDataFrame([("h", 1.0), ("h", 0.0), ("k", 0.0)], "hk string, q double")).select(F.col("hk")).first().hk == "h"


def test_hourly_panel(spark):
    rng = np.random.default_rng(3)
    hours, assets = 60, ("A", "B")
    price = 100 * np.exp(np.cumsum(rng.normal(size=(hours, 2)) * 0.01, axis=0))
    rows = [(a, 7 + h * 60 + int(rng.integers(0, 5)) * (h > 0), float(price[h, k])) for h in range(hours) for k, a in enumerate(assets) if not (h == 20 and a == "B")]
    prices = spark.createDataFrame(rows, "asset string, sidx long, price double")
    blocks = spark.createDataFrame([(i, 5 * (7 + i)) for i in range(hours * 60)], "idx long, block long")
    sent = spark.createDataFrame([(30, "h", "A", 3.0), (10, "h", "A", 0.5), (75, "h", "B", -0.25)], "ts long, hk string, asset string, x double")
    positions, factors = builders.hourly_panel(sent, blocks, prices, 60, 12, 6)
    got = {(r.h, r.asset): (r.weight, r.beta, r.r) for r in factors.collect()}
    assert len(got) == 2 * (hours - 1) and got[0, "A"] == (0.5, 1.0, 0.0)
    kept = np.delete(price, 20, axis=0)
    r = np.diff(np.log(kept), axis=0, prepend=np.log(kept[:1]))
    assert [got[h, "A"][2] for h in range(hours - 1)] == pytest.approx(r[:, 0].tolist())
    vol = 1 / (r[6:18].std(axis=0) + 1e-12)
    assert got[18, "A"][0] == got[23, "A"][0] == pytest.approx(vol[0] / vol.sum())
    # The panel begins at minute 7: hours are counted from there, the last word of an hour counts, positions are clipped.
    assert {(x.h, x.asset, x.pos) for x in positions.collect()} == {(0, "A", 1.0), (1, "B", -0.25)}


def test_rows_of_paths_and_hits(spark):
    rng = np.random.default_rng(6)
    n, ahead, window = 400, 5, 20
    price = 100 * np.exp(np.cumsum(rng.normal(size=n) * 0.01))
    vec = {s: [float(x) for x in rng.uniform(0.05, 0.9, 17).astype("<f2")] for s in range(n)}
    rows = [("ETHLBFGS", s, float(price[s]), None, None, blob({"a": vec[s]}), s) for s in range(n)]
    df = spark.createDataFrame(rows, CH)
    lp = np.log(price)
    fwd = lp[ahead:] - lp[:-ahead]
    sigma = np.array([fwd[i - window + 1 : i + 1].std(ddof=1) if i >= window - 1 else np.nan for i in range(len(fwd))])
    hits = {}
    for t in range(window - 1, len(fwd)):
        path = lp[t + 1 : t + 1 + ahead] - lp[t]
        up, down = np.flatnonzero(path >= sigma[t]), np.flatnonzero(path <= -sigma[t])
        u, v = (up[0] if len(up) else 99), (down[0] if len(down) else 99)
        hits[t] = 2 if u == v == 99 else 0 if u < v else 1
    got = builders.hit_rows(df, "ETHLBFGS", ahead, window, 17).orderBy("pos").collect()
    assert [r.hit for r in got] == [hits[t] for t in sorted(hits)]
    q = builders.q_path_rows(df, "ETHLBFGS", ahead, window).collect()
    z = {t: fwd[t] / sigma[t - ahead] for t in range(window - 1 + ahead, len(fwd))}
    bucket = {t: 0 if x <= -2 else 1 if x < -1 else 2 if x <= 1 else 3 if x < 2 else 4 for t, x in z.items()}
    assert len(q) == 3 * sum(b != 2 for b in bucket.values()) > 0
    order = sorted(bucket)
    for r in q:
        t, b, k = order[r.pos], *map(int, r.model.split("|"))
        path = lp[t : t + ahead + 1] - lp[t - 1]
        reach = (0.5, 1.0, 2.0)[k] * sigma[t]
        assert bucket[t] == b and r.y == (path.min() <= -reach if b > 2 else path.max() >= reach)
        p = vec[t][{0: 5, 1: 8, 3: 11, 4: 14}[b] + k]
        assert r.x == pytest.approx(np.log(p / (1 - p)), rel=1e-6)

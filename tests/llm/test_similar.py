import json

import numpy as np
import pytest

from heliograph.llm import mixture
from heliograph.llm import similar
from heliograph.llm.similar import cell_groups, clusters, similar_pairs, unpack

CH = "ticker string, sidx long, embeddings binary, ts long, cell long, component int, bucket int"
W = 17


def blob(records):
    hotkeys = sorted(records)
    return json.dumps(hotkeys).encode() + b"\0" + np.stack([np.asarray(records[h], dtype="<f2") for h in hotkeys]).tobytes()


def data(seed, hot=0, n=160):
    rng = np.random.default_rng(seed)
    records, rows = {}, []
    bases = rng.uniform(0.1, 0.9, (40, W))
    for i in range(n):
        sidx, who = int(rng.integers(100, 160)), f"h{rng.integers(0, 30):02d}é"
        v = bases[rng.integers(0, 40)] + rng.uniform(-0.009, 0.009, W) if rng.random() < 0.7 else rng.uniform(0.1, 0.9, W)
        records[sidx, who] = v
    for i in range(hot):
        records[200 + i // 20, f"h{i % 20:02d}"] = 0.5 + rng.uniform(-0.009, 0.009, W)
    minutes = {}
    for (s, h), v in records.items():
        minutes.setdefault(s, {})[h] = v
    for s, m in minutes.items():
        rows.append(("ETHLBFGS", s, blob(m), s, 1, 1, 1))
        if s % 3 == 0:
            rows.append(("ETHLBFGS", s, blob(m), s + 5, 1, 1, 1))
    return {k: np.asarray(v, dtype="<f2").astype(float) for k, v in records.items()}, rows


def brute(records, ticker="ETHLBFGS"):
    keys = sorted(records, key=lambda k: (k[0], k[1].encode()))
    first, out = [], set()
    for k in keys:
        for f in first:
            if np.abs(records[k] - records[f]).max() <= 0.02:
                out.add((ticker, *f, *k))
                break
        else:
            first.append(k)
    return out


@pytest.mark.parametrize(("seed", "hot"), [(0, 0), (1, 0), (2, 900)])
def test_against_brute_force(spark, seed, hot):
    records, rows = data(seed, hot)
    df = spark.createDataFrame(rows, CH).repartition(3)
    got = [tuple(r) for r in similar_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(records)


def test_clusters_describe_groups(spark):
    records, rows = data(3)
    got = clusters(spark.createDataFrame(rows, CH), typical=2).collect()
    pairs = brute(records)
    sizes = {}
    for _, s, h, *_ in pairs:
        sizes[s, h] = sizes.get((s, h), 1) + 1
    assert {(r.sidx, r.hotkey): r["size"] for r in got} == sizes
    assert all(1 <= len(r.typical) <= 2 for r in got)


def test_typical_members_of_hot_groups_and_groups_of_one(spark):
    records, rows = data(6, hot=900)
    groups = {}
    for _, *key in brute(records):
        groups.setdefault(tuple(key[:2]), {tuple(key[:2])}).add(tuple(key[2:]))
    for key in records.keys() - {m for g in groups.values() for m in g}:
        groups[key] = {key}
    wanted = {}
    for first, members in groups.items():
        keys = sorted(members, key=lambda k: (k[0], k[1].encode()))
        x = np.stack([records[k] for k in keys])
        density = (-0.5 * (x - x.mean(axis=0)) ** 2 / np.maximum(x.var(axis=0), 0.02**2 / 12)).sum(axis=1)
        wanted[first] = (len(keys), [keys[i] for i in np.argsort(-density.round(8), kind="stable")[:3]])
    for parts in (1, 3):
        got = clusters(spark.createDataFrame(rows, CH).repartition(parts), least=1).collect()
        assert {(r.sidx, r.hotkey): (r["size"], [tuple(t) for t in r.typical]) for r in got} == wanted


def test_unusable_vectors_and_late_deliveries(spark):
    one, two = np.full(W, 0.3), np.full(W, 0.7)
    nan, inf = one.copy(), two.copy()
    nan[3], inf[3] = np.nan, np.inf
    rows = [
        ("ETHLBFGS", 1, blob({"a": one, "b": np.zeros(W), "c": nan, "d": inf}), 1, 1, 1, 1),
        ("ETHLBFGS", 2, blob({"a": one}), 1, 1, 1, 1), ("ETHLBFGS", 2, blob({"a": two}), 9, 1, 1, 1), ("ETHLBFGS", 2, blob({"a": one}), None, 1, 1, 1),
        ("ETHLBFGS", 3, blob({"a": one})[:-1], 1, 1, 1, 1), ("ETHLBFGS", 4, b"", 1, 1, 1, 1), ("ETHLBFGS", 5, None, 1, 1, 1, 1), ("ETHLBFGS", 6, b"no zero", 1, 1, 1, 1), ("ETHLBFGS", 7, b"[]\0", 1, 1, 1, 1),
        ("ETHLBFGS", 8, blob({"a": one}), 1, 1, 1, 1), ("ETH", 8, blob({"a": one}), 1, 1, 1, 1), (None, 8, blob({"a": one}), 1, 1, 1, 1), ("ETHLBFGS", None, blob({"a": one}), 1, 1, 1, 1), ("BTCLBFGS", 9, blob({"a": one}), 1, 1, 1, 1),
        ("ETHLBFGS", 10, blob({"d": inf}), 1, 1, 1, 1), ("ETHLBFGS", 11, blob({"a": two}), 1, 1, 1, 1),
    ]
    got = {tuple(r) for r in similar_pairs(spark.createDataFrame(rows, CH)).collect()}
    assert got == {("ETHLBFGS", 1, "a", 8, "a"), ("ETHLBFGS", 2, "a", 11, "a"), ("ETHLBFGS", 1, "d", 10, "d")}
    assert unpack(b'{"a":1}\0') is None and unpack(b"[1]\0" + bytes(34)) is None


def test_empty(spark):
    df = spark.createDataFrame([], CH)
    assert similar_pairs(df).count() == 0 and clusters(df).count() == 0


def test_groups_split_chains():
    x = np.zeros((40, W))
    x[:, 0] = np.arange(40) * 0.015
    label = cell_groups(mixture.Points.of(x), np.zeros(40, dtype=int))
    for k in np.unique(label):
        assert np.ptp(x[label == k, 0]) <= 0.02 + 1e-9


def test_groups_in_a_crowded_cell():
    rng = np.random.default_rng(5)
    truth = np.repeat(np.arange(1500), 3)
    x = rng.uniform(0.3, 0.46, (1500, W))[truth] + rng.uniform(-0.009, 0.009, (4500, W))
    x = np.asarray(x, dtype="<f2").astype(float)
    order = rng.permutation(4500)
    label = cell_groups(mixture.Points.of(x[order]), np.zeros(4500, dtype=int))
    pairs = {(t, k) for t, k in zip(truth[order].tolist(), label.tolist(), strict=True)}
    assert len(pairs) == 1500 and len(np.unique(label)) == 1500


def test_criterion_finds_the_components():
    rng = np.random.default_rng(0)
    z = np.concatenate([rng.normal(m, 0.3, (400, 2)) for m in ((0, 0), (4, 0), (0, 4))])
    cell = np.floor(z / 0.5).astype(int)
    _, inverse = np.unique(cell, axis=0, return_inverse=True)
    n = np.bincount(inverse.ravel()).astype(float)
    total = np.stack([np.bincount(inverse.ravel(), z[:, d]) for d in range(2)], axis=1)
    scatter = np.stack([[np.bincount(inverse.ravel(), z[:, i] * z[:, j]) for j in range(2)] for i in range(2)]).transpose(2, 0, 1)
    model = mixture.choose(n, total, scatter)
    assert len(model.weights) >= 3
    near = [np.abs(model.means - np.array(m)).sum(axis=1).min() for m in ((0, 0), (4, 0), (0, 4))]
    assert max(near) < 0.3


def test_groups_that_the_reduced_features_hide():
    rng = np.random.default_rng(6)
    base = np.full((40, W), 0.5)
    for i in range(40):
        base[i, i % 17] += 0.05 * (1 + i // 17)
    truth = np.repeat(np.arange(40), np.r_[3000, np.ones(39, dtype=int)])
    x = base[truth] + rng.uniform(-0.009, 0.009, (len(truth), W))
    label = cell_groups(mixture.Points.of(x), np.zeros(len(x), dtype=int))
    assert len(set(zip(truth.tolist(), label.tolist(), strict=True))) == 40 == len(np.unique(label))


def test_groups_come_from_the_fit(spark, monkeypatch):
    """Without the mixture's components there are no groups: the check alone finds none."""
    records, rows = data(1)
    x = np.stack(list(records.values()))
    assert len(np.unique(cell_groups(mixture.Points.of(x), np.zeros(len(x), dtype=int)))) < len(x)
    monkeypatch.setattr(mixture, "fit_local", lambda points, *_: np.zeros(len(points), dtype=np.int64))
    assert len(np.unique(cell_groups(mixture.Points.of(x), np.zeros(len(x), dtype=int)))) == len(x)


def test_batches_do_not_matter(spark):
    _, rows = data(6, hot=900)
    df = spark.createDataFrame(rows, CH).repartition(2)
    every = []
    for size in ("10000", "7"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        every.append(sorted(map(str, clusters(df.drop("component"), least=1).drop("component").collect())))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert every[0] == every[1]


def test_crowds_are_mutually_similar():
    rng = np.random.default_rng(2)
    x = np.concatenate([0.5 + rng.uniform(-0.009, 0.009, (500, W)), rng.uniform(0.4, 0.6, (200, W))])
    behind = similar._crowds(np.arange(700), x, np.zeros(700, dtype=int))
    for k in np.unique(behind):
        assert np.ptp(x[behind == k], axis=0).max() <= 0.02 + 1e-9
    assert len(np.unique(behind[:500])) == 1

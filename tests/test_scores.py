import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliograph.operators import fits, scorers, similarity, solvers, stats, windows


def test_auc_with_ties(spark):
    rnd = random.Random(1)
    rows = [(k, float(rnd.randint(0, 5)), rnd.random() < 0.4) for k in "ab" for _ in range(200)] + [("c", 1.0, True), ("a", None, True), ("a", 1.0, None)]
    got = {r.k: r for r in stats.auc(spark.createDataFrame(rows, "k string, s double, y boolean"), ["k"], "s", F.col("y")).collect()}
    for k in "ab":
        p = [s for kk, s, y in rows if kk == k and y and s is not None]
        q = [s for kk, s, y in rows if kk == k and y is False and s is not None]
        expected = sum((a > b) + 0.5 * (a == b) for a in p for b in q) / (len(p) * len(q))
        assert got[k].auc == pytest.approx(expected)
        assert solvers.auc(np.array(p + q), np.array([1] * len(p) + [0] * len(q))) == pytest.approx(expected)
    assert got["c"].auc is None


def test_mass_is_conserved(spark):
    df = spark.createDataFrame([(f"h{i}", float(i + 1)) for i in range(8)], "hk string, s double")
    reps = spark.createDataFrame([("h1", "h1"), ("h2", "h1"), ("h9", "h1"), ("h5", "h5"), ("h6", "h5"), ("x", "x"), ("y", "x")], "member string, representative string")
    folded = {r.hk: r.s for r in similarity.collapse_mass(df, "hk", "s", reps).collect()}
    shared = {r.hk: r.s for r in similarity.equalise_mass(df, "hk", "s", reps).collect()}
    assert sum(folded.values()) == sum(shared.values()) == 36 and folded["h1"] == 5
    assert shared["h1"] == shared["h2"] == shared["h9"] == pytest.approx(5 / 3) and "x" not in shared


def test_components_of_a_long_path(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, 1001), (5, 5), (1001, 1000)]
    got = {r.member: r.representative for r in similarity.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 1000: 1000, 1001: 1000}
    assert similarity.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_cosine_search_in_blocks(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(90, 6))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None)], "id long, v array<double>")
    got = {}
    for r in similarity.cosine_search(df, "id", "v", F.col("id") % 10 == 0, 3, rows_per_block=20, queries_per_block=2).collect():
        got.setdefault(r.query, []).append((r["rank"], r.key))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 90, 10):
        s = u @ u[q]
        s[q] = -2
        assert [k for _, k in sorted(got[q])] == np.argsort(-s)[:3].tolist()


def test_discoveries_and_caps(spark):
    p = [0.001, 0.012, 0.02, 0.2, 0.9, None]
    got = stats.discoveries(spark.createDataFrame(list(enumerate(p)), "k int, p double"), [], "p", "k", 0.05).collect()
    assert {r.k for r in got} == {0, 1, 2}
    shares = [0.5, 0.3, 0.15, 0.05]
    capped = {r.k: r.capped for r in stats.cap_shares(spark.createDataFrame(list(enumerate(shares)), "k int, s double"), [], "s", 0.25).collect()}
    assert capped[0] == capped[1] == 0.25 and max(capped.values()) <= 0.25 + 1e-12
    assert capped[2] == pytest.approx(min(0.25, 0.15 + 0.3 * 0.75)) and capped[3] == pytest.approx(0.05 + 0.3 * 0.25)


def test_newton_is_at_the_optimum():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 4))
    y = (x @ [1, -2, 0, 0.5] + rng.normal(size=300) > 0).astype(float)
    w = solvers.class_weights(y)
    b, a = solvers.logistic_l2(x, y, 0.7, w)
    p = 1 / (1 + np.exp(-(x @ b + a)))
    assert np.abs(b + 0.7 * x.T @ (w * (p - y))).max() < 1e-4 and abs((w * (p - y)).sum()) < 1e-4
    e, _ = solvers.logistic_elastic_net(x, y, 0.05, 0.9, w)
    assert abs(e[2]) < 1e-6 < abs(e[1])
    ridge, c = solvers.logistic_elastic_net(x, y, 0.7, 0.0, w, steps=5000, tol=1e-10)
    assert np.allclose(ridge, b, atol=1e-3) and c == pytest.approx(a, abs=1e-3)


def test_linkage_clusters_and_residuals():
    d = np.array([[0, 0.05, 0.2, 0.9], [0.05, 0, 0.06, 0.9], [0.2, 0.06, 0, 0.9], [0.9, 0.9, 0.9, 0]])
    label = solvers.complete_linkage(d, 0.08)
    assert label[0] == label[1] != label[2] and label[3] not in label[:3]
    assert solvers.greedy_clusters(1 - d, 0.9, np.array([2, 0, 1, 3])).tolist() == [0, 2, 2, 3]
    q = np.random.default_rng(1).normal(size=(5, 40))
    q[3] += 2 * q[0] + q[1]
    q[1] -= 0.8 * q[0]
    order = np.array([4, 0, 1, 3, 2])
    made = solvers.residualise(q @ q.T, order, 0.2) @ q
    size = np.linalg.norm(q, axis=1)
    wanted, cosine = q.copy(), q @ q.T / np.outer(size, size)
    for k, j in enumerate(order):
        for i in order[:k]:
            if abs(cosine[i, j]) >= 0.2:
                wanted[j] -= wanted[j] @ wanted[i] / (wanted[i] @ wanted[i]) * wanted[i]
    assert np.allclose(made, wanted) and not np.allclose(made, q)
    assert solvers.capped_credit(np.array([3.0, 1.0, 4.0, 0.0]), np.array([0, 0, 1, 2]), 0.6).tolist() == pytest.approx([0.2, 0.2, 0.6, 0.0])


def test_evidence_finds_the_signal():
    rng = np.random.default_rng(0)
    y = rng.normal(size=600)
    t, p = solvers.shift_evidence(y + rng.normal(size=600), [y, np.roll(y, 1)], [0.7, 0.3], 96)
    assert t > 4 and p < 0.01
    assert solvers.shift_evidence(rng.normal(size=600), [y], [1.0], 96)[1] > 0.01
    assert solvers.shift_evidence(np.zeros(600), [y], [1.0], 96) == (0.0, 1.0)
    assert solvers.shift_evidence(y[:100], [y[:100]], [1.0], 96) == (0.0, 1.0)


def test_informative_participants_earn_more(spark):
    rng = np.random.default_rng(3)
    n = 900
    y = rng.integers(0, 2, n)
    kinds = {"good": lambda i: y[i] - 0.5 + rng.normal() * 0.6, "fair": lambda i: y[i] - 0.5 + rng.normal() * 1.5, "noise": lambda i: rng.normal(), "constant": lambda i: 0.3, "silent": lambda i: 0.0}
    rows = [(k, i, float(f(i)), int(y[i]), "x") for k, f in kinds.items() for i in range(n) if rng.random() < 0.95]
    df = spark.createDataFrame(rows, "hk string, pos long, x double, y int, asset string")
    s = {r.hk: r.s for r in scorers.score("binary", df, chunk=150, lag=5, window=60, refit=120, fit_rows=600, per_day=60, least_rows=20, least_windows=3, top=3, extra=1, replicates=4, block=40).collect()}
    assert s["good"] > s.get("fair", 0) and s["good"] > 2 * s.get("noise", 0) and "silent" not in s and sum(s.values()) == pytest.approx(1)
    c = {r.hk: r.s for r in scorers.score("xsec_rank", df, chunk=150, lag=5, top=3, least_distinct=2, least_rows=50, block=40).collect()}
    assert c["good"] > c.get("fair", 0) and c.get("constant", 0) < 0.1 and sum(c.values()) == pytest.approx(1)
    g = df.where("hk != 'silent'").select("hk", "pos", (F.col("x") > 0).cast("int").alias("guess"), F.col("y").alias("truth")).withColumn("p", F.when(F.col("guess") == 1, F.array(F.lit(0.3), F.lit(0.7))).otherwise(F.array(F.lit(0.7), F.lit(0.3))))
    v = {r.hk: r.s for r in scorers.score("lbfgs", g, classes=2, warm_up=200, chunk=200, least_rows=50, block=40).collect()}
    assert v["good"] == max(v.values())
    h = df.select("hk", "pos", F.col("x").alias("up"), (-F.col("x")).alias("down"), F.when(F.col("y") == 1, 0).otherwise(1).alias("hit"))
    f = {r.hk: r.s for r in scorers.score("hitfirst", h).collect()}
    assert f["good"] == max(f.values())
    t = df.where("hk != 'silent'").withColumn("signal", F.col("x")).withColumn("ahead", F.col("y") - F.lit(0.5))
    e = {r.hk: r.s for r in scorers.score("trade_mix", t, labels=["ahead"], weights=[1.0]).collect()}
    assert "good" in e and "noise" not in e
    both = {r.hk: r.s for r in scorers.combined([(scorers.score("lbfgs", g, classes=2, warm_up=200, chunk=200, least_rows=50, block=40), 1.0)]).collect()}
    assert both["good"] == max(both.values()) and sum(both.values()) == pytest.approx(1)
    for kind in ("binary", "xsec_rank"):
        assert scorers.score(kind, df.limit(0)).count() == 0
    with pytest.raises(KeyError):
        scorers.score("unknown", df)


def test_breakout_scorer(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(120):
        y = int(rng.integers(0, 2))
        rows += [("good", "BTC", i * 1000, float(0.2 + 0.6 * y + rng.normal() * 0.1), y), ("noise", "BTC", i * 1000, float(rng.random()), y), ("flat", "BTC", i * 1000, 0.5, y)]
    s = {r.hk: r.s for r in scorers.score("range_breakout_multi", spark.createDataFrame(rows, "hk string, source string, trigger_sidx long, p double, label int"), gap=900).collect()}
    assert s["good"] > 0.5 and "flat" not in s


def test_bootstrap_importance(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 400)
    df = spark.createDataFrame([("g", i, int(v), float(v + rng.normal()), float(rng.normal())) for i, v in enumerate(y)], "k string, pos long, y int, v0 double, v1 double")
    for l1 in (None, 0.5):
        got = {r.feature: r for r in fits.bootstrap_importance(df, ["k"], "pos", ["v0", "v1"], "y", 8, 40, 0.1, l1).collect()}
        assert got["v0"].importance > 3 * got["v1"].importance and got["v0"].signed_mean > 0
    left = {r.feature: r.importance for r in fits.leave_block_out(df, [], "pos", ["v0", "v1"], "y").collect()}
    assert left["v0"] > left["v1"]


@pytest.mark.parametrize("l1", [None, 0.5])
def test_distributed_fit_equals_the_fit_of_each_replicate(spark, l1):
    rng = np.random.default_rng(4)
    n, k = 500, 3
    x = np.round(rng.normal(size=(n, k)), 3)
    y = (x @ [1, -0.5, 0] + rng.normal(size=n) > 0).astype(int)
    w = np.round(rng.uniform(0.5, 1.5, n), 3)
    cells = spark.createDataFrame([("g", 10 * i, int(y[i]), float(w[i])) for i in range(n)], "g string, at long, y int, w double").repartition(5)
    values = spark.createDataFrame([("g", 10 * i, j, float(x[i, j])) for i in range(n) for j in range(k) if (i + j) % 4], "g string, at long, slot int, x double")
    given = np.where([[(i + j) % 4 > 0 for j in range(k)] for i in range(n)], x, 0.25)
    for how in (fits.Resampling(5, 60, 0, 7), fits.Resampling(left_out=4)):
        coefs, intercepts = fits.logistic(fits.panel(cells, values), {"g": k}, how, 0.3, l1, penalise_intercept=l1 is None, fill=0.25, salt={"g": 3})["g"]
        for b in range(how.number(n)):
            often = how.counts(np.arange(n), n, b, 3)
            rows = np.repeat(np.arange(n), often.astype(int))
            weight = solvers.class_weights(y[rows], w[rows])
            if l1 is None:
                want, a = solvers.logistic_l2(given[rows], y[rows], 0.3, weight, penalise_intercept=True)
            else:
                want, a = solvers.logistic_elastic_net(given[rows], y[rows], 0.3, l1, weight, steps=20_000, tol=1e-12)
            assert coefs[b] == pytest.approx(want, abs=1e-5) and intercepts[b] == pytest.approx(a, abs=1e-5)


def test_resampled_blocks():
    how = fits.Resampling(3, 10, 0, 1)
    assert how.counts(np.arange(95), 95, 0, 0).sum() == 90 and how.number(19) == 1 and how.number(20) == 3
    out = fits.Resampling(left_out=4)
    assert sum(out.counts(np.arange(10), 10, b, 0) for b in range(4)).tolist() == [3.0] * 10 and out.number(7) == 1


def test_meta_fit_parts_copies_and_ignores_the_scored_segment(spark):
    """Two copies of one participant share what it earns alone; one that is good in the last segment only earns nothing from segments before."""
    rng = np.random.default_rng(8)
    n = 1200
    y = rng.integers(0, 2, n)
    signal = y - 0.5 + rng.normal(size=n)
    other = y - 0.5 + rng.normal(size=n)
    kinds = {"a": signal, "b": other, "late": np.where(np.arange(n) >= 900, (y - 0.5) * 3 + rng.normal(size=n), rng.normal(size=n))}
    options = dict(chunk=300, lag=5, top=10, least_rows=50, block=40, replicates=4)

    def shares(kinds):
        rows = [(k, i, "x", float(v[i]), int(y[i])) for k, v in kinds.items() for i in range(n)]
        return {r.hk: r.s for r in scorers.score("xsec_rank", spark.createDataFrame(rows, "hk string, pos long, asset string, x double, y int"), **options).collect()}

    alone, twice = shares(kinds), shares(kinds | {"a2": signal})
    assert twice["a"] == pytest.approx(twice["a2"], rel=1e-6) and twice["a"] + twice["a2"] < 1.3 * alone["a"]
    assert alone["late"] < 0.8 * min(alone["a"], alone["b"])
    f = {r.hk: r.s for r in scorers.score("funding_xsec", spark.createDataFrame([(k, i, "x", float(v[i]), int(y[i])) for k, v in kinds.items() for i in range(n)], "hk string, pos long, asset string, x double, y int"), ahead=20, **options).collect()}
    assert sum(f.values()) == pytest.approx(1) and f["a"] > f.get("late", 0)


def test_copies_of_votes_are_penalised(spark):
    rng = np.random.default_rng(9)
    n, rows = 900, []
    truth = rng.integers(0, 3, n)
    for who, right in (("a", 0.7), ("b", 0.65), ("noise", 0.33)):
        guess = np.where(rng.random(n) < right, truth, rng.integers(0, 3, n))
        p = [[0.8 if k == g else 0.1 for k in range(3)] for g in guess]
        rows += [(w, i, int(guess[i]), int(truth[i]), p[i]) for i in range(n) for w in ((who, "copy") if who == "a" else (who,))]
    df = spark.createDataFrame(rows, "hk string, pos long, guess int, truth int, p array<double>")
    s = {r.hk: r.s for r in scorers.score("lbfgs", df, classes=3, warm_up=300, chunk=300, longest=600, replicates=4, block=40).collect()}
    assert s["a"] > 0 and s.get("copy", 0) == 0 and s["b"] > 2 * s.get("noise", 0)


def test_more_participants_than_any_former_bound(spark):
    rng = np.random.default_rng(10)
    n, many = 300, 90
    y = rng.integers(0, 2, n)
    rows = [(f"h{j:03d}", i, float(rng.normal() + (2 * (y[i] - 0.5) if j == many - 1 else 0)), int(y[i])) for j in range(many) for i in range(n) if j < many - 1 or i % 2]
    df = spark.createDataFrame(rows, "hk string, pos long, up double, y int").select("hk", "pos", "up", (-F.col("up")).alias("down"), (1 - F.col("y")).alias("hit"))
    s = {r.hk: r.s for r in scorers.score("hitfirst", df).collect()}
    assert len(s) == many and s[f"h{many - 1:03d}"] == max(s.values())


def test_positions_are_paid_for_evidence_after_cost(spark):
    rng = np.random.default_rng(11)
    hours, assets = 700, ["A", "B", "C"]
    r = rng.normal(size=(hours, 3)) * 0.01
    factors = spark.createDataFrame([(h, a, 1 / 3, 1.0, float(r[h, k])) for h in range(hours) for k, a in enumerate(assets)], "h long, asset string, weight double, beta double, r double")
    ahead = np.vstack([r[1:], np.zeros((1, 3))])
    books = {"good": np.sign(ahead - ahead.mean(axis=1, keepdims=True)) * 0.5, "copy": np.sign(ahead - ahead.mean(axis=1, keepdims=True)) * 0.5, "noise": rng.uniform(-1, 1, (hours, 3)), "market": np.repeat(np.sign(ahead.mean(axis=1, keepdims=True)), 3, axis=1) * 0.5}
    rows = [(h, who, a, float(v[h, k])) for who, v in books.items() for h in range(hours) for k, a in enumerate(assets) if who != "copy" or h >= 100]
    s = {x.hk: x.s for x in scorers.score("trade_mix_panel", spark.createDataFrame(rows, "h long, hk string, asset string, pos double"), factors=factors, horizons=(1, 2), blend=(0.7, 0.3), beta_horizon=1, fee=0.0, cap=1.0).collect()}
    assert s["good"] == pytest.approx(0.8) and s["market"] == pytest.approx(0.2) and set(s) == {"good", "market"}


def test_centred_similarity(spark):
    rng = np.random.default_rng(12)
    t, w = 60, 3
    base = rng.normal(size=(t, w))
    v = {"a": base, "b": 2 * base + 1, "c": rng.normal(size=(t, w))}
    df = spark.createDataFrame([(i, k, [float(z) for z in x[i]]) for k, x in v.items() for i in range(t) if k != "c" or i % 2], "t long, hk string, v array<double>")
    got = {(r.a, r.b): (r.n_joint, r.similarity) for r in similarity.centred_similarity(df, "t", "hk", "v").collect()}
    assert got["a", "b"] == (t, pytest.approx(1.0)) and got["a", "c"][0] == t // 2 and got["a", "c"][1] < 0.5
    full = np.stack([np.where((np.arange(t) % 2 == 0)[:, None], 0, v["c"]) if k == "c" else v[k] for k in "abc"])
    centred = (full - full.mean(axis=0)).reshape(3, -1)
    unit = centred / np.linalg.norm(centred, axis=1, keepdims=True)
    whole = {(r.a, r.b): r.similarity for r in similarity.centred_similarity(df, "t", "hk", "v", joint=False).collect()}
    assert whole["a", "c"] == pytest.approx(abs(unit[0] @ unit[2])) and whole["a", "b"] == pytest.approx(abs(unit[0] @ unit[1]))


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "a long, b long")
    got = {r.member: r.representative for r in similarity.components(links).collect()}
    assert got == dict.fromkeys(range(301), 0) | {1000: 1000, 1001: 1000}
    assert similarity.components(links.limit(0)).count() == 0


def test_blends(spark):
    a = spark.createDataFrame([("x", 0.6), ("y", 0.4)], "k string, s double")
    b = spark.createDataFrame([("y", 0.5), ("z", 0.5)], "k string, s double")
    got = {r.k: r.s for r in stats.blend(a, b, "k", "s", 0.75).collect()}
    assert got == pytest.approx({"x": 0.45, "y": 0.425, "z": 0.125})
    kept = {r.k: r.s for r in stats.ema(a, b, "k", "s", 0.3).collect()}
    assert kept == pytest.approx({"x": 0.18 / 0.65, "y": 0.47 / 0.65})
    w = stats.task_average([a, b], [3.0, 1.0], "k", "s").collect()
    assert sum(r.s for r in w) == pytest.approx(1)
    shares = windows.rank_decay(a, [], "s", "k", 3).collect()
    assert sum(r.share for r in shares) == pytest.approx(1)


def test_gated_models_and_weights(spark):
    rng = np.random.default_rng(2)
    rows = []
    for model in ("up", "down", "tiny"):
        for i in range(300 if model != "tiny" else 20):
            y = int(rng.integers(0, 2))
            rows += [(model, "good", i, float(y + rng.normal()), y), (model, "noise", i, float(rng.normal()), y)]
    s = scorers.score("q_path", spark.createDataFrame(rows, "model string, hk string, pos long, x double, y int"), replicates=4, block=40)
    got = {r.hk: r.s for r in s.collect()}
    assert got["good"] > 3 * got["noise"] and sum(got.values()) == pytest.approx(1)
    exact = spark.createDataFrame([("good", "good"), ("copy", "good")], "member string, representative string")
    soft = spark.createDataFrame([("noise", "noise"), ("near", "noise"), ("copy", "noise")], "member string, representative string")
    tiers = {r.hk: r.s for r in scorers.clone_tiers(s.unionByName(spark.createDataFrame([("copy", 0.5)], "hk string, s double")), exact, soft).collect()}
    assert tiers == pytest.approx({"good": got["good"] + 0.5, "noise": got["noise"] / 2, "near": got["noise"] / 2})
    uids = spark.createDataFrame([(0, "owner"), (1, "good"), (2, "noise"), (3, "new")], "uid int, hk string")
    seen = spark.createDataFrame([("owner", 0), ("good", 0), ("noise", 0), ("new", 990)], "hk string, first_seen long")
    old = spark.createDataFrame([(1, 1.0)], "uid int, w double")
    w = {r.uid: r.w for r in scorers.final_weights(s, uids, seen, old, 1000, 100, 0.01, 0.35).collect()}
    assert sum(w.values()) == pytest.approx(1) and w[1] == max(w.values()) and w[3] == pytest.approx(0.3 * 0.01 * 0.65) and w[0] == pytest.approx(0.3 * 0.35)


def test_cohorts_are_scored_by_their_representatives(spark):
    rng = np.random.default_rng(13)
    y = rng.integers(0, 2, 300)
    rows = [("m", who, i, float(s * (y[i] - 0.5) + rng.normal()), int(y[i])) for who, s in (("a", 3), ("b", 3), ("c", 1)) for i in range(300)]
    cohorts = spark.createDataFrame([("a", "a"), ("b", "a")], "member string, representative string")
    got = {r.hk: r.s for r in scorers.cohort_score("q_path", spark.createDataFrame(rows, "model string, hk string, pos long, x double, y int"), cohorts, replicates=4, block=40).collect()}
    assert got["a"] == pytest.approx(got["b"]) and got["a"] > got["c"] / 2 and sum(got.values()) == pytest.approx(1)

"""Meta fits of many groups and of many columns."""

import numpy as np
import pytest

from heliograph.operators import fits, scorers, solvers, windows


def _panel(spark, groups, n, k, seed):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(groups, n, k)), 3)
    y = (x[:, :, 0] - x[:, :, 1] + rng.normal(size=(groups, n)) > 0).astype(int)
    rows = [(f"{g}", i, int(y[g, i]), 1.0, [(j, float(x[g, i, j])) for j in range(k) if (g + i + j) % 3]) for g in range(groups) for i in range(n)]
    return spark.createDataFrame(rows, "g string, row long, y int, w double, xs array<struct<slot: int, x: double>>").repartition(3)


def _refused(*_, **__):
    raise AssertionError("sums of all groups")


def test_many_small_groups_are_fitted_where_they_are(spark, monkeypatch):
    # Hessians of all groups and replicates filled a worker's memory.
    rows, how = _panel(spark, 60, 80, 4, 1).cache(), fits.Resampling(6, 20)
    width = {f"{g}": 4 for g in range(60)}
    with monkeypatch.context() as m:
        m.setattr(fits, "_newton_sums", _refused)
        got = fits.logistic(rows, width, how, 0.3, fill=0.2, penalise_intercept=True)
        brief = fits.logistic(rows, width, how, 0.3, fill=0.2, penalise_intercept=True, summary=lambda b: b.mean(axis=0))
    monkeypatch.setattr(fits, "_PAIRS", 0)
    want = fits.logistic(rows, width, how, 0.3, fill=0.2, penalise_intercept=True)
    assert list(got) == list(want) == list(width)
    for g, (coefs, intercepts) in want.items():
        assert got[g][0] == pytest.approx(coefs, abs=1e-6) and got[g][1] == pytest.approx(intercepts, abs=1e-6)
        assert brief[g] == pytest.approx(coefs.mean(axis=0), abs=1e-6)


@pytest.mark.parametrize("fill", [0.0, 0.2])
def test_groups_of_many_columns_have_no_hessian(spark, monkeypatch, fill):
    # It had the square of the columns in numbers.
    rows, how = _panel(spark, 3, 120, 6, 3).cache(), fits.Resampling(5, 20)
    want = fits.logistic(rows, dict.fromkeys("012", 6), how, 0.5, fill=fill, penalise_intercept=True)
    with monkeypatch.context() as m:
        m.setattr(fits, "_DENSE", 5)
        m.setattr(fits, "_PAIRS", 0)
        m.setattr(fits, "_newton_sums", _refused)
        got = fits.logistic(rows, dict.fromkeys("012", 6), how, 0.5, fill=fill, penalise_intercept=True)
    for g, (coefs, intercepts) in want.items():
        assert got[g][0] == pytest.approx(coefs, abs=1e-6) and got[g][1] == pytest.approx(intercepts, abs=1e-6)
    # Thirty thousand columns: 7 GB.
    many = spark.createDataFrame([("a", i, i % 2, 1.0, [(i * 100, 1.0 + i % 2), (29_999, 0.5)]) for i in range(300)], rows.schema).coalesce(1)
    coefs, _ = fits.logistic(many, {"a": 30_000}, fits.Resampling(), 0.5)["a"]
    assert coefs.shape == (1, 30_000) and np.count_nonzero(coefs) <= 301 and coefs[0, 100] > 0 > coefs[0, 200]


def test_hessians_of_wide_groups_go_in_waves(spark, monkeypatch):
    rows, how = _panel(spark, 2, 90, 5, 2).cache(), fits.Resampling(4, 20)
    want = fits.logistic(rows, {"0": 5, "1": 5}, how, 0.3)
    held, sums = [], fits._newton_sums
    monkeypatch.setattr(fits, "_PAIRS", 0)
    monkeypatch.setattr(fits, "_HESSIANS", 3 * 8 * 36)
    # Evaluated by the driver, which passes the trials of one wave on.
    monkeypatch.setattr(fits, "partial", lambda f, **o: held.append(len(o["trials"]) if o["classes"] else 0) or (lambda batches: sums(batches, **o)))
    got = fits.logistic(rows, {"0": 5, "1": 5}, how, 0.3)
    assert max(held) == 3
    for g, (coefs, _) in want.items():
        assert got[g][0] == pytest.approx(coefs, abs=1e-6)


def test_segments_of_a_long_history_are_fitted_where_they_are(spark, monkeypatch):
    # Each Newton step of all segments and replicates went over all executors.
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, (400, 3))
    rows = [(f"p{h}", t, f"a{a}", float((2 * y[t, a] - 1) * (h == 0) * 0.5 + rng.normal()), int(y[t, a])) for h in range(4) for t in range(400) for a in range(3)]
    monkeypatch.setattr(fits, "_newton_sums", _refused)
    got = {r.hk: r.s for r in scorers.score("xsec_rank", spark.createDataFrame(rows, "hk string, pos long, asset string, x double, y int"), chunk=20, lag=2, least_rows=50, replicates=4, block=10).collect()}
    assert sum(got.values()) == pytest.approx(1) and max(got, key=got.get) == "p0"


def test_participants_are_not_crossed_with_segments(spark, monkeypatch):
    # Every participant was ranked in every segment, whether or not it had rows there.
    rng = np.random.default_rng(8)
    y = rng.integers(0, 2, (400, 3))
    rows = [(f"p{h:03}", t, f"a{a}", float((2 * y[t, a] - 1) * (h % 7 == 0) * 0.5 + rng.normal()), int(y[t, a])) for h in range(120) for t in range(h // 2 * 6, h // 2 * 6 + 40) for a in range(3)]
    ranked, top_k = [], windows.top_k
    monkeypatch.setattr(windows, "top_k", lambda df, *o: ranked.append(df.cache()) or top_k(df, *o))
    scorers.score("xsec_rank", spark.createDataFrame(rows, "hk string, pos long, asset string, x double, y int"), chunk=20, lag=2, top=5, least_rows=50, replicates=4, block=10).collect()
    got = {(r.segment, r.hk): r.auc for r in ranked[0].collect()}
    segments, names = {s for s, _ in got}, [f"p{h:03}" for h in range(120)]
    assert len(segments) > 10 and len(got) < len(segments) * 40
    # Those left out are others, and later in the order of names.
    for s in segments:
        others = [h for h in names if got.get((s, h), 0.5) == 0.5]
        assert all((s, h) in got for h in others[:5])


def test_scores_outside_the_fit_by_brute_force(spark):
    rng = np.random.default_rng(9)
    rows = [(h, int(t), float(rng.integers(0, 4 + h)), int(rng.integers(0, 2)), 1.0 + h) for h in range(4) for t in np.flatnonzero(rng.random(300) < 0.2 + 0.2 * h)]
    segments = [fits.Segment(i, s, s + 25, max(0, s - 150) if i % 2 else 0, s - 3) for i, s in enumerate(range(0, 300, 25))]
    got = fits.out_of_sample(spark.createDataFrame(rows, "h long, t long, x double, y int, w double"), "h", "t", ["x"], "y", segments, least=15, weight="w", least_distinct=4).collect()
    want = {}
    for h in range(4):
        for s in segments:
            fit = [r for r in rows if r[0] == h and s.fit_start <= r[1] < s.fit_end]
            if len(fit) >= 15 and len({r[3] for r in fit}) == 2 and len({r[2] for r in fit}) >= 4:
                b, a = solvers.logistic_l2(np.array([[r[2]] for r in fit]), np.array([r[3] for r in fit]), 0.5, np.array([r[4] for r in fit]))
                want |= {(h, s.number, r[1]): r[2] * b[0] + a for r in rows if r[0] == h and s.start <= r[1] < s.end}
    assert {(r.h, r.segment, r.t): r.z for r in got} == pytest.approx(want, abs=1e-6) and len(want) > 50

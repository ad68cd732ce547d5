"""Pairs of more participants than one dense table holds, against brute force."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliograph.functions import vectors
from heliograph.operators import builders, fits, similarity, solvers
from heliograph.sources import sinks


def test_seniors_of_five_thousand(spark):
    rng = np.random.default_rng(4)
    rows = [(m, int(w), int(rng.integers(0, 3))) for m in range(40) for w in np.unique(rng.integers(0, 5000, 150))] + [(99, 4999, 1), (99, 2, 1)]
    # Neighbours share a rank, so neither is the other's senior.
    df = spark.createDataFrame([(m, w, c, w // 2) for m, w, c in rows], "m long, w long, c long, r long")
    got = {r.w: (r.n, r.overlap) for r in similarity.overlap_with_seniors(df, "m", "w", "c", "r").collect()}
    own, cells = defaultdict(set), defaultdict(set)
    for m, w, c in rows:
        own[w].add((m, c))
        cells[m, c].add(w)
    for w, mine in own.items():
        shared = defaultdict(int)
        for cell in mine:
            for other in cells[cell]:
                if other // 2 < w // 2:
                    shared[other] += 1
        assert got[w] == (len(mine), max(shared.values(), default=0) / len(mine))
    assert len(got) == len(own)


def _sparse(spark, n):
    """Each participant beside the next one in two moments."""
    rows = [(w + k * 10 * n, w + s, [float((w * 7 + s * 3 + k) % 11), 1.0]) for w in range(0, n - 1, 2) for s in (0, 1) for k in (0, 1)]
    return spark.createDataFrame(rows, "t long, w long, v array<double>")


def test_joint_similarity_of_more_than_4096(spark):
    got = similarity.centred_similarity(_sparse(spark, 4200), "t", "w", "v").collect()
    assert len(got) == 2100 and all(r.b == r.a + 1 and r.n_joint == 2 for r in got)


def test_history_similarity_of_more_than_4096(spark):
    n = 4200
    rows = [(0, w, [float(w % 5)]) for w in range(n)] + [(1, 7, [3.0])]
    df = spark.createDataFrame(rows, "t long, w long, v array<double>")
    got = similarity.centred_similarity(df, "t", "w", "v", joint=False)
    x = np.zeros((n, 2))
    for t, w, v in rows:
        x[w, t] = v[0]
    x -= x.mean(axis=0)
    some = {(r.a, r.b): r.similarity for r in got.where("a IN (3, 7) AND b > 4000").collect()}
    assert len(some) == 2 * 199 and got.agg(F.count("similarity")).first()[0] == n * (n - 1) // 2
    for (a, b), s in some.items():
        assert s == pytest.approx(abs(x[a] @ x[b]) / np.sqrt(x[a] @ x[a] * (x[b] @ x[b])), abs=1e-9)


def test_sparse_linkage_is_complete_linkage(spark):
    rng = np.random.default_rng(6)
    for n in (2, 9, 40):
        d = np.ones((n, n))
        i, j = np.nonzero(np.triu(rng.random((n, n)) < 0.6, 1))
        d[i, j] = d[j, i] = rng.integers(1, 9, len(i)) / 8  # many ties
        assert (solvers.sparse_linkage(n, i, j, d[i, j], 0.8) == solvers.complete_linkage(d, 0.8)).all()
    chain = spark.range(5000).selectExpr("id AS a", "id + 1 AS b", "0.5D AS s", "0L AS c")
    got = {r.member: r.cluster for r in fits.linked_clusters(chain, "a", "b", "s", "c", 0.95).collect()}
    assert got == {m: m // 2 * 2 for m in range(5001)}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_match_share_across_blocks(spark):
    rng = np.random.default_rng(1)
    rows = sorted({(int(m), int(w), None if c == 3 else float(c)) for m, w, c in rng.integers(0, (12, 1100, 4), (6000, 3))}, key=str)
    df = spark.createDataFrame(rows, "m long, w long, c double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = similarity.match_share(df, ["m"], "w", F.col("c"), 2)
        # Pairs are neither joined nor grouped.
        assert "SortMergeJoin" not in _plan(found) and "ShuffledHashJoin" not in _plan(found)
        got = {(r.a, r.b): (r.n_a, r.n_b, r.n_joint, r.n_match) for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    cells = defaultdict(lambda: defaultdict(set))
    for m, w, c in rows:
        cells[w][m].add(c)
    want = {}
    for a in cells:
        for b in cells:
            joint = cells[a].keys() & cells[b].keys() if a < b else ()
            n = sum(bool((cells[a][m] & cells[b][m]) - {None}) for m in joint)
            if len(joint) >= 2 and n:
                want[a, b] = len(cells[a]), len(cells[b]), len(joint), n
    assert got == want and got


def test_close_pairs_across_blocks(spark):
    rng = np.random.default_rng(7)
    v = {(t, w): [float(x) for x in rng.integers(1, 9, 2) / 4] for t in range(5) for w in rng.permutation(700)[:500].tolist()}
    df = spark.createDataFrame([(t, w, x) for (t, w), x in v.items()], "t long, w long, v array<double>")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = builders.close_pairs(df, "t", "w", "v", 0.5, 0.5, 3)
        assert "SortMergeJoin" not in _plan(found) and "ShuffledHashJoin" not in _plan(found)
        got = {(r.a, r.b): (r.n_match, r.n_joint) for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    x = np.array([[v.get((t, w), [np.nan] * 2) for t in range(5)] for w in range(700)])
    busy = (~np.isnan(x[:, :, 0])).sum(axis=1) >= 3
    want = {}
    for a in np.flatnonzero(busy):
        d = np.abs(x[a + 1 :] - x[a])
        joint, match = (~np.isnan(d[:, :, 0])).sum(axis=1), (d < 0.5).all(axis=2).sum(axis=1)
        for k in np.flatnonzero((joint >= 3) & (match > 0) & (match >= np.ceil(0.5 * joint)) & busy[a + 1 :]):
            want[int(a), int(a + 1 + k)] = int(match[k]), int(joint[k])
    assert got == want and got


def test_packing_needs_no_call_per_group(spark):
    df = spark.createDataFrame([(k, h, [float(k), 1.5]) for k in range(50) for h in ("b", "a", "ä")], "k long, h string, v array<float>")
    blobs = sinks.packed(df, ["k"], "h", "v")
    assert "FlatMapGroupsInPandas" not in _plan(blobs)
    got = {r.k: bytes(r.embeddings) for r in blobs.collect()}
    assert got == {k: b'["a", "b", "\\u00e4"]' + b"\0" + np.array([[k, 1.5]] * 3, "<f2").tobytes() for k in range(50)}


def test_blocks_are_not_copied_for_their_partners(spark):
    # Each block was shuffled once for every other block.
    df = spark.createDataFrame([(t, w, float((t * 7 + w) % 13)) for t in range(4) for w in range(1100)], "t long, w long, x double")
    sums = similarity.pair_sums(df, ["t"], "w", "x", ("n", "xy"), size=1100)
    assert "CartesianProduct" in _plan(sums) and "Exchange" not in _plan(sums)
    x = np.array([[(t * 7 + w) % 13 for t in range(4)] for w in range(1100)], float)
    got = sums.agg(F.count("*").alias("n"), F.sum("n").alias("joint"), F.sum("xy").alias("xy")).first()
    assert (got.n, got.joint) == (1100 * 1099 // 2, 4 * 1100 * 1099 // 2)
    assert got.xy == pytest.approx(np.triu(x @ x.T, 1).sum())


def test_blocks_of_close_pairs_are_not_copied(spark):
    df = spark.createDataFrame([(t, w, [float(w % 40 + 1), 1.0]) for t in range(3) for w in range(600)], "t long, w long, v array<double>")
    found = builders.close_pairs(df, "t", "w", "v", 0.5, 0.5, 3)
    assert "CartesianProduct" in _plan(found)
    assert {(r.n_match, r.n_joint) for r in found.collect()} == {(3, 3)} and found.count() == 40 * 15 * 14 // 2


def _joined_above(df):
    """Joins of what pairs of blocks give."""
    return _plan(df).split("CartesianProduct")[0].count("Join")


def _similar(n, seed, joint):
    """Rows and the brute force of named participants."""
    rng = np.random.default_rng(seed)
    rows = [(t, f"p{w:04}", [float(v) for v in rng.integers(0, 5, 2)]) for t in range(6) for w in rng.permutation(n)[: n // 2].tolist()]
    x, there = np.zeros((n, 6, 2)), np.zeros((n, 6), bool)
    for t, w, v in rows:
        x[int(w[1:]), t], there[int(w[1:]), t] = v, True
    known = np.flatnonzero(there.any(axis=1))
    x, there = x[known], there[known]
    if joint:
        x = np.where(there[:, :, None], x - x.sum(axis=1, keepdims=True) / there.sum(axis=1)[:, None, None], 0)
    else:
        x, there = x - x.mean(axis=0), np.ones_like(there)
    flat, both = x.reshape(len(x), -1), np.repeat(there, 2, axis=1).astype(float)
    size = ((flat**2) @ both.T) * (both @ (flat**2).T)
    s = np.divide(np.abs(flat @ flat.T), np.sqrt(size), out=np.zeros_like(size), where=size > 1e-12)
    n_joint = there.astype(int) @ there.T.astype(int)
    return rows, {(f"p{known[i]:04}", f"p{known[j]:04}"): (n_joint[i, j], s[i, j]) for i in range(len(x)) for j in range(i + 1, len(x))}


def _same_similarities(got, want, least):
    got = {(r.a, r.b): (r.n_joint, r.similarity) for r in got.collect()}
    want = {k: v for k, v in want.items() if v[0] >= least}
    assert got.keys() == want.keys() and want
    for k, (n, s) in want.items():
        assert got[k][0] == n and got[k][1] == pytest.approx(s, abs=1e-7)


@pytest.mark.parametrize("n", [60, 700])
def test_pairs_of_joint_similarity_are_named_where_they_are_summed(spark, n):
    # Every pair was joined twice to get its names.
    rows, want = _similar(n, 8, True)
    got = similarity.centred_similarity(spark.createDataFrame(rows, "t long, w string, v array<double>"), "t", "w", "v", 2)
    assert n == 60 or _joined_above(got) == 0
    _same_similarities(got, want, 2)


@pytest.mark.parametrize("n", [60, 700])
def test_pairs_of_history_similarity_are_named_where_they_are_summed(spark, n):
    rows, want = _similar(n, 9, False)
    got = similarity.centred_similarity(spark.createDataFrame(rows, "t long, w string, v array<double>"), "t", "w", "v", joint=False)
    assert n == 60 or _joined_above(got) == 0
    _same_similarities(got, want, 1)


def test_rounding_is_that_of_decimals(spark):
    # Each value was rounded as a decimal.
    x = [None, float("nan"), float("inf"), -0.123455, 0.0, 1.0, 1e9 + 0.123455, 0.999994999999, *((2 * k + 1) / 2e5 for k in range(500)), *np.random.default_rng(2).random(500).tolist()]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    assert df.where(~vectors.rounded(F.col("x"), 5).eqNullSafe(F.round("x", 5))).count() == 0

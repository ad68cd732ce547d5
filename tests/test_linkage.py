"""Complete linkage of components that no task holds, against brute force."""

import numpy as np
import pytest

from heliograph.operators import fits, linkage, solvers

HELD = 60


@pytest.fixture
def small_tasks(monkeypatch):
    """Tasks that are given more pairs than two times ``HELD`` fail; a component was one task, whatever its size."""
    monkeypatch.setattr(linkage, "_HELD", HELD)
    linked, most = linkage._linked, 2 * HELD

    def watched(n, upto):
        link, unpacked = linked(n, upto), linkage._unpacked

        def run(key, table):
            if sum(len(unpacked(raw, n)[0]) for raw in table.column("pack").to_pylist()) > most:
                raise ValueError("too many pairs in a task")
            return link(key, table)

        return run

    monkeypatch.setattr(linkage, "_linked", watched)


def _clusters(spark, d, listed, name="c"):
    i, j = np.nonzero(np.triu(listed, 1))
    pairs = spark.createDataFrame([(f"m{x:03}", f"m{y:03}", float(1 - d[x, y])) for x, y in zip(i.tolist(), j.tolist(), strict=True)], "a string, b string, s double").repartition(3)
    got = fits.linked_clusters(pairs, "a", "b", "s", name, 0.95).collect()
    return {int(r.member[1:]): (int(r[name][1:]), int(r.cluster[1:])) for r in got}


def _brute(d, listed, n):
    far = np.where(listed | listed.T, d, 1.0)
    label = solvers.complete_linkage(far, 0.95)
    component = np.arange(n)
    for _ in range(n):
        component = np.where(listed | listed.T | np.eye(n, dtype=bool), component[None, :], n).min(axis=1)
    return {k: (int(component[k]), int(label[k])) for k in np.flatnonzero((listed | listed.T).any(axis=1)).tolist()}


@pytest.mark.parametrize("n, share, levels", [(40, 0.4, 8), (60, 0.12, 1), (16, 1.0, 1), (60, 0.2, 1000), (90, 0.015, 5)])
def test_component_of_more_pairs_than_a_task_holds(spark, small_tasks, n, share, levels):
    rng = np.random.default_rng(n)
    listed = np.triu(rng.random((n, n)) < share, 1)
    d = rng.integers(1, levels + 1, (n, n)) / (levels + 1)
    d = np.triu(d) + np.triu(d, 1).T
    # Similarities are 1 - d, and distances 1 minus these.
    d = 1 - (1 - d)
    assert _clusters(spark, d, listed) == _brute(d, listed, n)


def test_copies_of_members_are_linked_on_their_own(spark, small_tasks):
    rng = np.random.default_rng(3)
    n, copies = 20, 6
    base = np.triu(rng.integers(1, 5, (n, n)) / 5, 1)
    base = base + base.T
    d = 1 - (1 - np.tile(base, (copies, copies)))
    listed = np.triu(np.tile(rng.random((n, n)) < 0.3, (copies, copies)) & (d > 0) | (d == 0), 1)
    assert _clusters(spark, d, listed) == _brute(d, listed, n * copies)


def test_ties_beyond_what_is_listed_stay_in_doubt():
    rng = np.random.default_rng(5)
    for n in (6, 15, 40):
        for share in (0.2, 0.6, 1.0):
            i, j = np.nonzero(np.triu(rng.random((n, n)) < share, 1))
            whole = solvers.sparse_linkage(n, i, j, np.full(len(i), 0.5), 0.9)
            for upto in range(n):
                some = i <= upto
                label = solvers.tied_linkage(n, i[some], j[some], upto)
                # Certain mergers are those of the whole: a cluster is inside one of these, and the first pair has merged.
                assert (whole[label] == whole).all() and (label <= np.arange(n)).all()
                assert not some.any() or label[j[0]] == i[0]
            assert (label == whole).all()


def test_members_without_near_pairs_are_their_own_cluster(spark):
    pairs = spark.createDataFrame([(3, 1, 0.5, "x"), (3, 4, 0.01, "x"), (8, 9, None, "y"), (6, 6, 0.9, "z")], "a long, b long, s double, c string")
    got = {r.member: (r.c, r.cluster) for r in fits.linked_clusters(pairs, "a", "b", "s", "c", 0.95).collect()}
    assert got == {1: ("x", 1), 3: ("x", 1), 4: ("x", 4), 8: ("y", 8), 9: ("y", 9), 6: ("z", 6)}
    assert fits.linked_clusters(pairs.where("a < 0"), "a", "b", "s", "c", 0.95).count() == 0

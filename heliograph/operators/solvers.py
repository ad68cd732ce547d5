"""Dense solvers on NumPy for the grouped fits: logistic regression, bootstraps, linkage, evidence by circular shifts.

Each works on one bounded group (a participant's segment, a replicate, a panel
of participants) inside ``applyInPandas``; the distribution is the caller's.
Results agree with other solvers of the same objective to tolerance, not bit
by bit.
"""

from __future__ import annotations

import heapq

import numpy as np


def class_weights(y: np.ndarray, w: np.ndarray | None = None) -> np.ndarray:
    """Balanced weights n / (2·n_class) times the sample weights (class sizes by count)."""
    w = np.ones(len(y)) if w is None else w
    n1 = max(int(y.sum()), 1)
    n0 = max(len(y) - int(y.sum()), 1)
    return w * np.where(y > 0, len(y) / (2 * n1), len(y) / (2 * n0))


def _standard(x: np.ndarray) -> np.ndarray:
    return np.column_stack((x, np.ones(len(x))))


def logistic_l2(x: np.ndarray, y: np.ndarray, c: float, weights: np.ndarray | None = None, steps: int = 100, tol: float = 1e-10, penalise_intercept: bool = False, start: tuple[np.ndarray, float] | None = None) -> tuple[np.ndarray, float]:
    """(coefficients, intercept) minimising ½‖b‖² + C·Σ w·log-loss by damped Newton steps."""
    a, w = _standard(np.asarray(x, dtype=np.float64)), np.ones(len(y)) if weights is None else weights
    sign, ridge = np.where(y > 0, 1.0, -1.0), np.ones(a.shape[1])
    ridge[-1] = 1.0 if penalise_intercept else 1e-12
    b = np.zeros(a.shape[1]) if start is None else np.append(start[0], start[1])

    def loss(b: np.ndarray) -> float:
        return 0.5 * float((ridge * b * b).sum()) + c * float((w * np.logaddexp(0, -sign * (a @ b))).sum())

    at = loss(b)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -500, 500)))
        g = ridge * b + c * (a.T @ (w * (p - (y > 0))))
        h = (a * (c * w * np.maximum(p * (1 - p), 1e-12))[:, None]).T @ a + np.diag(ridge)
        step, size = np.linalg.solve(h, g), 1.0
        while size > 1e-8 and (new := loss(b - size * step)) > at:
            size /= 2
        if size <= 1e-8 or at - new < tol * max(1.0, abs(at)):
            b = b - size * step if size > 1e-8 else b
            break
        b, at = b - size * step, new
    return b[:-1], float(b[-1])


def logistic_elastic_net(x: np.ndarray, y: np.ndarray, c: float, l1_ratio: float, weights: np.ndarray | None = None, steps: int = 800, tol: float = 1e-7) -> tuple[np.ndarray, float]:
    """Elastic net: l1_ratio·‖b‖₁ + ½(1 - l1_ratio)·‖b‖² + C·Σ w·log-loss, by accelerated proximal gradient."""
    a, w = _standard(np.asarray(x, dtype=np.float64)), np.ones(len(y)) if weights is None else weights
    lipschitz = 0.25 * c * np.linalg.norm(a * np.sqrt(w)[:, None], 2) ** 2 + (1 - l1_ratio)
    b = z = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ z, -500, 500)))
        g = c * (a.T @ (w * (p - (y > 0))))
        g[:-1] += (1 - l1_ratio) * z[:-1]
        new = z - g / lipschitz
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - l1_ratio / lipschitz, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t2 * (new - b)
        moved = np.abs(new - b).max()
        b, t = new, t2
        if moved < tol:
            break
    return b[:-1], float(b[-1])


def block_starts(n: int, block: int, seed: int) -> np.ndarray:
    """Sorted starts of the n // block blocks of one block bootstrap of n rows."""
    return np.sort(np.random.default_rng(seed).integers(0, n - block + 1, size=max(1, n // block)))


def descend(b: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, l1: np.ndarray, sweeps: int = 200, tol: float = 1e-10) -> np.ndarray:
    """Minimum of the quadratic model at ``b`` plus Σ l1·|b|, by coordinate descent."""
    out, step = b.copy(), np.zeros(len(b))
    for _ in range(sweeps):
        moved = 0.0
        for j in range(len(b)):
            h = hessian[j, j]
            free = out[j] - (gradient[j] + hessian[j] @ step) / h
            new = np.sign(free) * max(abs(free) - l1[j] / h, 0.0)
            step[j] += new - out[j]
            moved = max(moved, abs(new - out[j]))
            out[j] = new
        if moved < tol:
            break
    return out


def complete_linkage(distance: np.ndarray, cut: float) -> np.ndarray:
    """Labels of complete-linkage clusters in which no two members are farther apart than ``cut``."""
    n = len(distance)
    d = distance.astype(np.float64).copy()
    np.fill_diagonal(d, np.inf)
    label, alive = np.arange(n), np.ones(n, dtype=bool)
    while n > 1:
        i, j = divmod(int(np.argmin(d)), n)
        if not d[i, j] <= cut:
            break
        d[i] = np.maximum(d[i], d[j])
        d[:, i] = d[i]
        d[i, i] = np.inf
        d[j], d[:, j], alive[j] = np.inf, np.inf, False
        label[label == j] = i
    return label


def sparse_linkage(n: int, i: np.ndarray, j: np.ndarray, distance: np.ndarray, cut: float) -> np.ndarray:
    """The labels of ``complete_linkage`` where only pairs (i, j) are listed and all others are farther apart than ``cut``.

    Two clusters are listed while every pair between them is, so what is held
    shrinks with every merger. Ties go to the smallest members, as there.
    """
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, d in zip(i.tolist(), j.tolist(), distance.tolist(), strict=True):
        if a != b and d <= cut:
            near[a][b] = near[b][a] = d
    heap = [(d, a, b) for a, to in enumerate(near) for b, d in to.items() if a < b]
    heapq.heapify(heap)
    label = np.arange(n)
    while heap:
        d, a, b = heapq.heappop(heap)
        if near[a].get(b) != d:
            continue
        gone, old = near[b], near[a]
        merged = {k: max(x, gone[k]) for k, x in old.items() if k in gone}
        for k in gone:
            del near[k][b]
        for k in old:
            if k != b and k not in merged:
                del near[k][a]
        near[a], near[b] = merged, {}
        for k, x in merged.items():
            near[k][a] = x
            if x != old[k]:
                heapq.heappush(heap, (x, min(a, k), max(a, k)))
        label[b] = a
    return _resolved(label)


def _resolved(label: np.ndarray) -> np.ndarray:
    while (label[label] != label).any():
        label = label[label]
    return label


def tied_linkage(n: int, i: np.ndarray, j: np.ndarray, upto: int) -> np.ndarray:
    """Mergers that are certain among pairs i < j of one distance, the least there is, of which those with i <= ``upto`` are listed.

    Pairs go in the order of (i, j). After a merger a pair of clusters is in
    doubt if one of the pairs between them may be listed elsewhere; its members
    then merge no more, nor do those whose next pair is with one of them.
    """
    near: list[set[int]] = [set() for _ in range(n)]
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        near[a].add(b)
        near[b].add(a)
    label, doubt, frozen = np.arange(n), set(), set()
    pair = lambda x, y: (x, y) if x < y else (y, x)
    for a in range(min(n, upto + 1)):
        for b in sorted(k for k in near[a] if k > a):
            if b not in near[a]:
                continue
            if a in frozen or b in frozen or (a, b) in doubt:
                frozen |= {a, b}
                continue
            for k in near[a] - {b}:
                if k in near[b]:
                    if pair(b, k) in doubt:
                        doubt.add(pair(a, k))
                elif min(b, k) > upto:
                    doubt.add(pair(a, k))
                else:
                    near[a].remove(k)
                    near[k].remove(a)
            for k in near[b]:
                near[k].discard(b)
            near[b] = set()
            label[b] = a
    return _resolved(label)


def greedy_clusters(similarity: np.ndarray, least: float, priority: np.ndarray) -> np.ndarray:
    """In order of priority every unassigned row takes all unassigned rows at least ``least`` similar; the label is the leader."""
    label = np.full(len(similarity), -1)
    for i in priority:
        if label[i] < 0:
            near = (similarity[i] >= least) & (label < 0)
            near[i] = True
            label[near] = i
    return label


def residualise(gram: np.ndarray, order: np.ndarray, least: float, cosine: np.ndarray | None = None) -> np.ndarray:
    """Rows of coefficients that make each book of the originals, in order of seniority, lose its projection on every senior it resembles.

    ``gram`` holds the books' inner products; a book resembles another from
    |cosine| ``least`` on, as they were (or as ``cosine`` says). Seniors (already without their own
    seniors' parts) are projected off one after the other. Everything stays a
    combination of the originals, so inner products are enough.
    """
    size = np.sqrt(np.diag(gram)) + 1e-12
    alike = np.abs(gram / np.outer(size, size) if cosine is None else cosine) >= least
    made = np.eye(len(gram))
    for k, j in enumerate(order):
        for i in order[:k]:
            own = made[i] @ gram @ made[i]
            if alike[i, j] and own > 1e-12:
                made[j] -= (made[j] @ gram @ made[i]) / own * made[i]
    return made


def capped_credit(raw: np.ndarray, clusters: np.ndarray, cap: float) -> np.ndarray:
    """Members with credit get their cluster's total / n² each; normalised; what exceeds ``cap`` is offered once to the others."""
    raw = raw.astype(float).copy()
    for k in np.unique(clusters):
        rows = np.flatnonzero((clusters == k) & (raw > 0))
        if len(rows) > 1:
            raw[rows] = raw[rows].sum() / len(rows) ** 2
    if raw.sum() <= 0:
        return np.zeros(len(raw))
    shares = raw / raw.sum()
    over = shares > cap
    excess, under = float((shares[over] - cap).sum()), ~over & (shares > 0)
    shares[over] = cap
    if excess and under.any():
        shares[under] += np.minimum(cap - shares[under], excess * shares[under] / shares[under].sum())
    return shares


def shift_evidence(x: np.ndarray, labels: list[np.ndarray], weights: list[float], least_shift: int, least_offsets: int = 50) -> tuple[float, float]:
    """(t, p) of a signal (T, or T x assets) against labels, with circular shifts of the signal as the null.

    All shifts at once by FFT; per label the statistic is standardised by its
    own null, the labels are blended by weight and standardised again. p is the
    share of shifts that do as well (one added), for t > 0 at most the normal
    tail.
    """
    import math

    n = len(x)
    offsets = np.arange(least_shift, n - least_shift + 1)
    if n < 3 * least_shift or len(offsets) < least_offsets:
        return 0.0, 1.0
    columns = lambda v: np.nan_to_num(v).reshape(n, -1)
    fx = np.fft.rfft(columns(x), axis=0)
    now, null = 0.0, np.zeros(len(offsets))
    for y, w in zip(labels, weights, strict=True):
        s = np.fft.irfft(np.conj(fx) * np.fft.rfft(columns(y), axis=0), n, axis=0).sum(axis=1)
        spread = s[offsets].std()
        if spread > 0:
            now += w * (s[0] - s[offsets].mean()) / spread
            null += w * (s[offsets] - s[offsets].mean()) / spread
    spread = null.std()
    if not spread > 0:
        return 0.0, 1.0
    t = (now - null.mean()) / spread
    empirical = (1 + int((null >= now).sum())) / (1 + len(null))
    tail = 0.5 * math.erfc(t / math.sqrt(2))
    return float(t), min(empirical, max(tail, 1e-12)) if t > 0 else empirical


def auc(score: np.ndarray, label: np.ndarray) -> float:
    """A13 for one group: exact, ties count half; NaN without both classes."""
    n1 = int((label > 0).sum())
    n0 = len(label) - n1
    if not n1 or not n0:
        return float("nan")
    _, inverse, counts = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(counts) - (counts - 1) / 2)[inverse]
    return float((rank[label > 0].sum() - n1 * (n1 + 1) / 2) / (n1 * n0))


def median_of_means(values: np.ndarray, groups: int = 4) -> np.ndarray:
    """A18 along the first axis; the remainder of n // groups is dropped."""
    size = max(len(values) // groups, 1)
    kept = values[: size * groups]
    return np.median(kept.reshape(-1, size, *values.shape[1:]).mean(axis=1), axis=0)

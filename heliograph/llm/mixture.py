"""Gaussian mixtures by expectation-maximisation with regularised covariance, on weighted statistics.

``choose`` fits a whole ticker without its rows: a cell is the count, sum and
scatter of all rows that fall into one box of the reduced feature space, so
every row counts while the number of cells stays bounded. ``local_components``
fits the few hundred points of one neighbourhood, where a component is a group
of similar vectors. The Bayesian information criterion chooses the number of
components in both.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Features:
    """Standardisation and reduction: z = ((x - mean) / scale) @ axes."""

    mean: np.ndarray
    scale: np.ndarray
    axes: np.ndarray

    @classmethod
    def fit(cls, n: float, total: np.ndarray, scatter: np.ndarray, kept: int) -> Features:
        """From count, sum and sum of outer products: principal axes of the correlation matrix."""
        mean = total / n
        cov = scatter / n - np.outer(mean, mean)
        scale = np.sqrt(np.maximum(np.diag(cov), 1e-12))
        values, vectors = np.linalg.eigh(cov / np.outer(scale, scale))
        return cls(mean, scale, vectors[:, np.argsort(-values)[:kept]])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.axes


@dataclass(frozen=True)
class Mixture:
    """Weights, means and covariances of the components, and the criterion's value."""

    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    bic: float

    def log_densities(self, z: np.ndarray) -> np.ndarray:
        """Weighted log density of every point (rows) under every component (columns)."""
        return _log_densities(z, self.weights, self.means, self.covariances)


def _log_densities(z: np.ndarray, weights: np.ndarray, means: np.ndarray, covariances: np.ndarray) -> np.ndarray:
    out = np.empty((len(z), len(weights)))
    for k, (w, m, c) in enumerate(zip(weights, means, covariances, strict=True)):
        low = np.linalg.cholesky(c)
        y = np.linalg.solve(low, (z - m).T)
        out[:, k] = np.log(max(w, 1e-300)) - 0.5 * (y**2).sum(axis=0) - np.log(np.diag(low)).sum() - 0.5 * z.shape[1] * np.log(2 * np.pi)
    return out


def _normalise(logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    top = logs.max(axis=1, keepdims=True)
    total = top[:, 0] + np.log(np.exp(logs - top).sum(axis=1))
    return np.exp(logs - total[:, None]), total


def fit(count: np.ndarray, total: np.ndarray, scatter: np.ndarray, components: int, ridge: float = 1e-2, steps: int = 60) -> Mixture:
    """EM over cells (count, sum, sum of outer products per cell); ``ridge`` is added to every covariance."""
    n, d = float(count.sum()), total.shape[1]
    centre = total / count[:, None]
    # Farthest-point start: the heaviest cell, then whichever cell lies farthest from those chosen.
    chosen = [int(np.argmax(count))]
    distance = ((centre - centre[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < components:
        chosen.append(int(np.argmax(distance * np.sqrt(count))))
        distance = np.minimum(distance, ((centre - centre[chosen[-1]]) ** 2).sum(axis=1))
    overall = scatter.sum(axis=0) / n - np.outer(total.sum(axis=0) / n, total.sum(axis=0) / n)
    weights, means = np.full(components, 1.0 / components), centre[chosen]
    covariances = np.repeat((overall + ridge * np.eye(d))[None], components, axis=0)
    likelihood = -np.inf
    for _ in range(steps):
        shares, logs = _normalise(_log_densities(centre, weights, means, covariances))
        now = float((logs * count).sum())
        mass = shares * count[:, None]
        sums = np.maximum(mass.sum(axis=0), 1e-9)
        weights = sums / n
        means = (shares.T @ total) / sums[:, None]
        second = np.einsum("ck,cij->kij", shares, scatter) / sums[:, None, None]
        covariances = second - np.einsum("ki,kj->kij", means, means) + ridge * np.eye(d)
        if now - likelihood < 1e-6 * abs(now):
            break
        likelihood = now
    _, logs = _normalise(_log_densities(centre, weights, means, covariances))
    parameters = components * (1 + d + d * (d + 1) / 2) - 1
    return Mixture(weights, means, covariances, -2 * float((logs * count).sum()) + parameters * np.log(max(n, 2.0)))


def choose(count: np.ndarray, total: np.ndarray, scatter: np.ndarray) -> Mixture:
    """The mixture with the least criterion among 1, 2, 3, 4, 6, 8, 12, 16 ... components; two worse ones in a row end the search."""
    best, worse, k = fit(count, total, scatter, 1), 0, 2
    while k <= len(count) and worse < 2:
        model = fit(count, total, scatter, k)
        best, worse = (model, 0) if model.bic < best.bic else (best, worse + 1)
        k += max(1, 1 << (k.bit_length() - 2))
    return best


@dataclass(frozen=True)
class Points:
    """Weighted points: count, sum, sum of squares and extremes (per element) of the vectors that each stands for."""

    count: np.ndarray
    total: np.ndarray
    square: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Points:
        """Every vector as a point of its own."""
        return cls(np.ones(len(x)), x, x * x, x, x)

    def __getitem__(self, rows: np.ndarray) -> Points:
        return Points(self.count[rows], self.total[rows], self.square[rows], self.low[rows], self.high[rows])

    def __len__(self) -> int:
        return len(self.count)


def spans(points: Points, label: np.ndarray) -> np.ndarray:
    """Largest width of any element per label (labels 0, 1, 2, ... all in use)."""
    order = np.argsort(label, kind="stable")
    starts = np.searchsorted(label[order], np.arange(int(label[order[-1]]) + 1))
    return (np.maximum.reduceat(points.high[order], starts) - np.minimum.reduceat(points.low[order], starts)).max(axis=1)


def local_components(points: Points, tolerance: float, reduced: int) -> np.ndarray:
    """Component of every point under local mixtures, -1 where no component holds it within the tolerance.

    A mixture is fitted (``fit_local``) to all points; a component wider than
    the tolerance in some element is several groups that the reduced features
    or the criterion couldn't part, and gets a mixture of its own over its own
    features. Components whose union is within the tolerance are merged: the
    criterion of one is lower (the same likelihood from fewer parameters).
    """
    label, used = np.full(len(points), -1, dtype=np.int64), 0
    queue = [(np.arange(len(points)), reduced)]
    while queue:
        rows, kept = queue.pop()
        part = fit_local(points[rows], tolerance, kept)
        wide = spans(points[rows], part) > tolerance
        fine = ~wide[part]
        label[rows[fine]] = used + part[fine]
        used += len(wide)
        if len(wide) > 1 or kept < points.low.shape[1]:
            # What one fit left together is looked at in all its elements.
            queue += [(rows[part == k], points.low.shape[1]) for k in np.flatnonzero(wide)]
    return _merged(points, label, tolerance)


def _merged(points: Points, label: np.ndarray, tolerance: float) -> np.ndarray:
    """Labels after merging components whose union no element spans by more than the tolerance."""
    held = np.flatnonzero(label >= 0)
    if not len(held):
        return label
    _, own = np.unique(label[held], return_inverse=True)
    order = np.argsort(own, kind="stable")
    starts = np.searchsorted(own[order], np.arange(int(own.max()) + 1))
    low, high = np.minimum.reduceat(points.low[held[order]], starts), np.maximum.reduceat(points.high[held[order]], starts)
    # Only neighbours along the widest element can be close; a window along it slides over the sorted components.
    along = int(np.argmax(np.ptp(low, axis=0)))
    by = np.argsort(low[:, along], kind="stable")
    low, high = low[by], high[by]
    root, reach = np.arange(len(by)), np.searchsorted(low[:, along], low[:, along] + tolerance, side="right")
    step = 1
    while (more := np.flatnonzero(np.arange(len(by)) + step < reach)).size:
        near = (np.maximum(high[more], high[more + step]) - np.minimum(low[more], low[more + step])).max(axis=1) <= tolerance
        for i in more[near]:
            a, b = root[i], root[i + step]
            if a != b:
                both = np.flatnonzero((root == a) | (root == b))
                if (high[both].max(axis=0) - low[both].min(axis=0)).max() <= tolerance:
                    root[both] = min(a, b)
        step += 1
    new = np.empty(len(by), dtype=np.int64)
    new[by] = root
    label = label.copy()
    label[held] = new[own]
    return label


def fit_local(points: Points, tolerance: float, reduced: int, steps: int = 6) -> np.ndarray:
    """Components (0, 1, ... all in use) of points under the local mixture of least criterion.

    Features are the points' own: standardised by their spread and reduced to
    ``reduced`` principal axes (all elements as they are where nothing is
    reduced). Means start at points no two of which can be similar, each the
    farthest from those before, so that a coarser mixture has the first of a
    finer one's. Expectation-maximisation fits weights, means and a shared
    variance per axis, regularised by that of the tolerance; of ever coarser
    mixtures the one with the least Bayesian information criterion is taken,
    and every point goes to the component of its highest posterior.
    """
    n, total, size = points.count, float(points.count.sum()), len(points)
    if size == 1:
        return np.zeros(1, dtype=np.int64)
    noise = tolerance / np.sqrt(12)
    centre = points.total / n[:, None]
    mean = points.total.sum(axis=0) / total
    inside = np.maximum(points.square / n[:, None] - centre**2, 0.0)
    scale = np.sqrt(np.maximum((n @ ((centre - mean) ** 2 + inside)) / total, noise**2))
    u = (centre - mean) / scale
    if reduced < u.shape[1]:
        axes = np.linalg.eigh((u * n[:, None]).T @ u)[1][:, ::-1][:, :reduced]
        z, reach = u @ axes, (tolerance / scale) @ np.abs(axes)
        floor, within = (noise / scale) ** 2 @ axes**2, (inside / scale**2) @ axes**2
    else:
        z, reach, floor, within = u, tolerance / scale, (noise / scale) ** 2, inside / scale**2
    seeds, radii, nearest = _spread(z / reach)
    best, chosen, radius = np.inf, np.zeros(size, dtype=np.int64), 1.0
    count = len(seeds)
    while True:
        start = nearest if count == len(seeds) else _closest(z / reach, z[seeds[:count]] / reach)
        criterion, found = _tied(z, n, within, start, count, floor, steps)
        if criterion >= best:
            break
        best, chosen = criterion, found
        if count <= 2:
            break
        radius *= 2
        count = max(2, int(np.searchsorted(-radii, -radius)) + 1) if radii[count - 2] <= radius else count - 1
    return np.unique(chosen, return_inverse=True)[1]


def _spread(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Points of which each is the farthest (by its widest axis) from those before, until all are within 1 of one; the distances they had; each point's nearest."""
    z = np.ascontiguousarray(z.T, dtype=np.float32)
    seeds, radii = [0], []
    distance = np.abs(z - z[:, :1]).max(axis=0)
    nearest = np.zeros(z.shape[1], dtype=np.int64)
    while (far := distance[at := int(distance.argmax())]) > 1.0001:
        new = np.abs(z - z[:, at, None]).max(axis=0)
        closer = new < distance
        nearest[closer] = len(seeds)
        np.minimum(distance, new, out=distance)
        seeds.append(at)
        radii.append(far)
    return np.array(seeds), np.array(radii), nearest


def _closest(z: np.ndarray, to: np.ndarray) -> np.ndarray:
    return ((z**2).sum(axis=1)[:, None] - 2 * z @ to.T + (to**2).sum(axis=1)).argmin(axis=1)


def _tied(z: np.ndarray, n: np.ndarray, within: np.ndarray, start: np.ndarray, count: int, floor: np.ndarray, steps: int) -> tuple[float, np.ndarray]:
    """(criterion, component of highest posterior) after EM of ``count`` components with one shared, regularised variance per axis."""
    total, axes = float(n.sum()), z.shape[1]
    shares = np.zeros((len(z), count), dtype=np.float32)
    shares[np.arange(len(z)), start] = 1.0
    likelihood, inner, now = -np.inf, n @ within, 0.0
    # What is as large as points times components is kept in single precision: far more exact than posteriors need.
    weight, plain = n.astype(np.float32)[:, None], bool((n == 1).all())
    for _ in range(steps):
        mass = shares if plain else shares * weight
        sums = np.maximum(mass.sum(axis=0, dtype=np.float64), 1e-9)
        means = (mass.T @ z.astype(np.float32)) / sums[:, None]
        spread = np.maximum(n @ z**2 - sums @ means**2, 0.0) + inner
        var = spread / total + floor
        a, m = z / np.sqrt(var), means / np.sqrt(var)
        logs = a.astype(np.float32) @ m.T.astype(np.float32)
        logs += (np.log(sums / total) - 0.5 * (m**2).sum(axis=1)).astype(np.float32)
        top = logs.max(axis=1)
        logs -= top[:, None]
        shares = np.exp(logs, out=logs)
        mixed = shares.sum(axis=1)
        shares /= mixed[:, None]
        now = float(n @ (top + np.log(mixed) - 0.5 * (a**2).sum(axis=1))) - 0.5 * total * np.log(2 * np.pi * var).sum() - 0.5 * float((inner / var).sum())
        if now - likelihood < 1e-4 * abs(now):
            break
        likelihood = now
    return -2 * now + (count * (axes + 1) - 1 + axes) * np.log(max(total, 2.0)), shares.argmax(axis=1)

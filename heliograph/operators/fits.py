"""Fits: one participant's models in one task, and regularised logistic fits of many participants over all executors.

A participant's walk-forward models need its own rows only, which the scorers
trim to the tasks' history (W14), so ``applyInArrow`` per participant is
bounded. A meta fit of few entries is fitted in one task, with all replicates
of its bootstrap: a replicate is how often each row counts. One of many columns
is, too, and without its Hessian, which grows with their square: its Newton
steps are solved by conjugate gradients over the entries. One of many rows
needs sums only (gradient and Hessian) for its Newton steps, which every
executor forms over its own rows, for as many replicates at once as a worker's
memory holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.operators import linkage, solvers
from heliograph.operators.sequence import numbered
from heliograph.session import cut

SUMS_SCHEMA = "g string, b int, part binary"
#: A group whose rows have at most so many pairs of entries is fitted in one task. Bytes of Hessians that are summed at once.
_PAIRS, _HESSIANS = 1 << 22, 1 << 26
#: A group of more columns has no Hessian, and is fitted in one task up to so many entries (of any number if its Hessian alone would be too large).
_DENSE, _ENTRIES = 1024, 1 << 22


def _kinds(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def univariate(df: DataFrame, group: list[str], feature: str, label: str, c: float = 0.5, least: int = 50) -> DataFrame:
    """L2 logistic fit of one feature per group: group, n, coef, intercept (no row below ``least`` rows or with one class).

    A Newton iteration of one feature needs a handful of sums; rows are first
    combined to (feature, label) counts.
    """
    counted = df.where(F.col(feature).isNotNull() & F.col(label).isNotNull()).groupBy(*group, feature, label).agg(F.count("*").alias("_n"))

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        w, y = pdf["_n"].to_numpy(dtype=float), pdf[label].to_numpy(dtype=float)
        if w.sum() < least or len(np.unique(y)) < 2:
            return pd.DataFrame(columns=[*group, "n", "coef", "intercept"])
        b, a = solvers.logistic_l2(pdf[[feature]].to_numpy(dtype=float), y, c, w)
        return pd.DataFrame([[*key, int(w.sum()), b[0], a]], columns=[*group, "n", "coef", "intercept"])

    return counted.groupBy(*group).applyInPandas(fit, f"{_kinds(df, group)}, n bigint, coef double, intercept double")


@dataclass(frozen=True)
class Segment:
    """Rows of [start, end) are scored by a model of the rows in [fit_start, fit_end)."""

    number: int
    start: int
    end: int
    fit_start: int
    fit_end: int


def out_of_sample(df: DataFrame, who: str, pos: str, features: list[str], label: str, segments: list[Segment], c: float = 0.5, least: int = 50, keep: list[str] | None = None, balanced: bool = False, weight: str | None = None, least_distinct: int = 0) -> DataFrame:
    """(who, segment, pos, keep, label, z): decision values of each participant's models outside their fit.

    Every participant's rows are sorted once; a model starts from the last one.
    No model where there are fewer than ``least`` rows or one class, or a first
    feature of fewer than ``least_distinct`` values.
    """
    keep, columns = keep or [], [who, pos, *(keep or []), label, *features, *([weight] if weight else [])]
    told = [who, "segment", pos, *keep, label, "z"]
    bounds = np.array([(s.start, s.end, s.fit_start, s.fit_end) for s in segments], dtype=np.int64).reshape(-1, 4).T

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([pos, *keep], kind="stable")
        at, x, y = pdf[pos].to_numpy(), pdf[features].to_numpy(dtype=float), pdf[label].to_numpy(dtype=float)
        w = pdf[weight].to_numpy(dtype=float) if weight else np.ones(len(y))
        low, high, a, b = (np.searchsorted(at, v) for v in bounds)
        # A participant has rows in few of many segments: those are found for all at once.
        up, first = np.append(0, np.cumsum(y)), np.zeros(len(y) + 1, dtype=np.int64)
        first[np.unique(x[:, 0], return_index=True)[1] + 1] = 1
        upto = np.cumsum(first)
        ones = up[b] - up[a]
        rows, number, z, last = [], [], [], None
        for k in np.flatnonzero((high > low) & (b - a >= least) & (ones > 0) & (ones < b - a)):
            i, j = a[k], b[k]
            if least_distinct and (len(np.unique(x[i:j, 0])) if i else upto[j]) < least_distinct:
                continue
            last = solvers.logistic_l2(x[i:j], y[i:j], c, solvers.class_weights(y[i:j], w[i:j]) if balanced else w[i:j], start=last)
            rows.append(np.arange(low[k], high[k]))
            number.append(segments[k].number)
            z.append(x[low[k] : high[k]] @ last[0] + last[1])
        if not rows:
            return pd.DataFrame(columns=told)
        return pdf.iloc[np.concatenate(rows)].assign(segment=np.repeat(number, [len(r) for r in rows]), z=np.concatenate(z))[told]

    more = f", {_kinds(df, keep)}" if keep else ""
    return df.select(*columns).groupBy(who).applyInPandas(run, f"{_kinds(df, [who])}, segment bigint, {_kinds(df, [pos])}{more}, {_kinds(df, [label])}, z double")


def walk_forward_scores(df: DataFrame, who: str, pos: str, feature: str, label: str, segments: DataFrame, c: float = 0.5, least: int = 50) -> DataFrame:
    """Out-of-sample probabilities: per (participant, segment) fitted on rows before ``fit_end``, applied to the segment's rows.

    (segment, start, end, fit_end) come from ``windows.segments``, of which
    there are as many as chunks of the history.
    """
    listed = [Segment(r.segment, r.start, r.end, 0, r.fit_end) for r in segments.orderBy("segment").collect()]
    rows = df.where(F.col(feature).isNotNull() & F.col(label).isNotNull())
    scored = out_of_sample(rows, who, pos, [feature], label, listed, c, least)
    return scored.select(who, "segment", pos, label, (1 / (1 + F.exp(-F.col("z")))).alias("score"))


@dataclass(frozen=True)
class Resampling:
    """How often a replicate counts each row of a timeline of n rows.

    ``replicates`` block bootstraps: n // block sorted starts, each counting
    ``block`` rows (one plain fit below two blocks of rows); or ``left_out``
    fits that each leave one contiguous part out.
    """

    replicates: int = 1
    block: int = 120
    left_out: int = 0
    seed: int = 42

    def number(self, n: int) -> int:
        if self.left_out > 1:
            return self.left_out if n >= 2 * self.left_out else 1
        return self.replicates if n >= 2 * self.block else 1

    def counts(self, rows: np.ndarray, n: int, b: int, salt: int) -> np.ndarray:
        if self.number(n) == 1:
            return np.ones(len(rows))
        if self.left_out > 1:
            low, high = np.linspace(0, n, self.left_out + 1).astype(int)[b : b + 2]
            return ((rows < low) | (rows >= high)).astype(float)
        starts = solvers.block_starts(n, self.block, self.seed + salt + b)
        return (np.searchsorted(starts, rows, side="right") - np.searchsorted(starts, rows - self.block, side="right")).astype(float)


def panel(cells: DataFrame, values: DataFrame) -> DataFrame:
    """Rows of meta fits: ``cells`` (g, at, y, w) are all rows of a group in the order of ``at``, ``values`` (g, at, slot, x) what participants had there."""
    listed = values.groupBy("g", "at").agg(F.collect_list(F.struct(F.col("slot").cast("int").alias("slot"), F.col("x").cast("double").alias("x"))).alias("xs"))
    return numbered(cells.select("g", "at", "y", "w"), "g", "at", 1 << 16, "row").join(listed, ["g", "at"], "left").select("g", "row", "y", "w", F.coalesce("xs", F.array()).alias("xs"))


def _dense(batch: pa.RecordBatch, width: dict[str, int], fill: float) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(group, row, y, w, matrix with a last column of ones) of a batch of a panel."""
    groups = batch.column("g").dictionary_encode()
    codes, lists = groups.indices.to_numpy(), batch.column("xs")
    owner = np.repeat(np.arange(len(codes)), np.diff(lists.offsets.to_numpy()))
    flat = lists.flatten()
    slot, x = flat.field("slot").to_numpy(), flat.field("x").to_numpy()
    row, y, w = (batch.column(c).to_numpy().astype(float) for c in ("row", "y", "w"))
    place = np.empty(len(codes), dtype=np.int64)
    for code, g in enumerate(groups.dictionary.to_pylist()):
        if g in width:
            rows = np.flatnonzero(codes == code)
            place[rows] = np.arange(len(rows))
            mine = codes[owner] == code
            m = np.full((len(rows), width[g] + 1), fill)
            m[:, -1] = 1.0
            m[place[owner[mine]], slot[mine]] = x[mine]
            yield g, row[rows].astype(np.int64), y[rows], w[rows], m


def _newton_sums(batches: Iterator[pa.RecordBatch], resampling: Resampling, sizes: dict, trials: dict, classes: dict | None, fill: float) -> Iterator[pa.RecordBatch]:
    """Per (group, replicate) class counts, or loss, gradient and Hessian of the log-loss at the trial coefficients."""
    width = {g: k for g, (_, k, _) in sizes.items() if any(key[0] == g for key in trials)}
    sums: dict[tuple[str, int], np.ndarray] = {}
    for batch in batches:
        for g, row, y, w, m in _dense(batch, width, fill):
            n, _, salt = sizes[g]
            for b in range(resampling.number(n)):
                if (g, b) not in trials:
                    continue
                often = resampling.counts(row, n, b, salt)
                if classes is None:
                    part = np.array([often @ (y > 0), often @ (y <= 0)])
                else:
                    used = np.flatnonzero(often)
                    x, t = m[used], y[used] > 0
                    weight = often[used] * w[used] * np.where(t, classes[g, b][0], classes[g, b][1])
                    score = x @ trials[g, b]
                    p = 1 / (1 + np.exp(-np.clip(score, -500, 500)))
                    loss = weight @ np.logaddexp(0, np.where(t, -score, score))
                    part = np.concatenate(([loss], x.T @ (weight * (p - t)), ((x * (weight * np.maximum(p * (1 - p), 1e-12))[:, None]).T @ x).ravel()))
                sums[g, b] = sums[g, b] + part if (g, b) in sums else part
    yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["g", "b", "part"])


def _added(key: tuple, table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(raw) for raw in sorted(table.column("part").to_pylist()))
    return pa.table({"g": [key[0].as_py()], "b": pa.array([key[1].as_py()], pa.int32()), "part": pa.array([total.tobytes()], pa.binary())})


def _conjugate(product: Callable[[np.ndarray], np.ndarray], diagonal: np.ndarray, right: np.ndarray, tol: float = 1e-6, steps: int = 1000) -> np.ndarray:
    """x with product(x) = right, by conjugate gradients scaled by the diagonal; what remains is ``tol`` of it."""
    x, r = np.zeros_like(right), right.copy()
    z = r / diagonal
    d, size = z.copy(), r @ z
    end = tol * tol * size
    for _ in range(steps):
        if size <= end:
            break
        q = product(d)
        a = size / (d @ q)
        x += a * d
        r -= a * q
        z = r / diagonal
        last, size = size, r @ z
        d = z + size / last * d
    return x


Hessian = np.ndarray | tuple[Callable[[np.ndarray], np.ndarray], np.ndarray]


def _newton(b: np.ndarray, held: tuple[float, np.ndarray] | None, part: tuple[float, np.ndarray, Hessian], c: float, l1_ratio: float | None, penalise_intercept: bool, tol: float) -> tuple[np.ndarray, tuple[float, np.ndarray], np.ndarray | None]:
    """The next trial, the best point so far and the solution, once there is one, from loss, gradient and Hessian (or its product with a vector, and its diagonal) at ``b``."""
    k = len(b)
    ridge = np.full(k, 1.0 if l1_ratio is None else 1 - l1_ratio)
    ridge[-1] = 1.0 if penalise_intercept else 0.0
    l1 = np.append(np.full(k - 1, l1_ratio or 0.0), 0.0)
    value = c * part[0] + 0.5 * ridge @ b**2 + l1 @ np.abs(b)
    if held is not None and value > held[0] + 1e-10 * abs(held[0]):
        # Too far: half the step.
        half = (held[1] + b) / 2
        return half, held, held[1] if np.abs(half - held[1]).max() < tol else None
    gradient = c * part[1] + ridge * b
    if isinstance(part[2], tuple):
        product, diagonal = part[2]
        new = b - _conjugate(lambda v: c * product(v) + (ridge + 1e-10) * v, c * diagonal + ridge + 1e-10, gradient)
    else:
        hessian = c * part[2] + np.diag(ridge + 1e-10)
        new = b - np.linalg.solve(hessian, gradient) if l1_ratio is None else solvers.descend(b, gradient, hessian, l1)
    return new, (value, b), new if np.abs(new - b).max() < tol * max(1.0, np.abs(b).max()) else None


def _fitted(key: tuple, table: pa.Table, sizes: dict, wide: set[str], resampling: Resampling, c: float, l1_ratio: float | None, penalise_intercept: bool, fill: float, steps: int, tol: float, summary: Callable[[np.ndarray], np.ndarray] | None) -> pa.Table:
    """All replicates of one group: coefficients and intercepts, or their summary.

    Entries stay sparse: they are taken less ``fill``, which then counts for
    all columns at once. A ``wide`` group needs neither pairs of entries nor
    the Hessian, and each of its replicates starts from the last one.
    """
    g = key[0].as_py()
    n, k, salt = sizes.get(g, (0, 0, 0))
    table = table.sort_by("row").combine_chunks()
    row, y, w = (table.column(c).to_numpy().astype(float) for c in ("row", "y", "w"))
    lists = table.column("xs").combine_chunks()
    many = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten()
    # Every row ends with a one for the intercept.
    owner = np.concatenate((np.repeat(np.arange(len(y)), many), np.arange(len(y))))
    slot = np.concatenate((flat.field("slot").to_numpy(), np.full(len(y), k)))
    x = np.concatenate((flat.field("x").to_numpy() - fill, np.ones(len(y))))
    order = np.lexsort((slot, owner))
    owner, slot, x = owner[order], slot[order], x[order]
    del order
    if g not in wide:
        left_many = np.repeat(np.cumsum(many + 1), many + 1) - np.arange(len(owner))
        left = np.repeat(np.arange(len(owner)), left_many)
        right = left + np.arange(len(left)) - np.repeat(np.cumsum(left_many) - left_many, left_many)
        cell, product, at = slot[left].astype(np.int64) * (k + 1) + slot[right], x[left] * x[right], owner[left]
        del left, right, left_many

    def scores(b: np.ndarray) -> np.ndarray:
        return np.bincount(owner, x * b[slot], len(y)) + fill * b[:-1].sum()

    def over_columns(u: np.ndarray) -> np.ndarray:
        """Sum of the rows, each times its ``u``."""
        sums = np.bincount(slot, x * u[owner], k + 1)
        if fill:
            sums[:-1] += fill * sums[-1]
        return sums

    def part(b: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray, Hessian]:
        score = scores(b)
        p = 1 / (1 + np.exp(-np.clip(score, -500, 500)))
        loss = weight @ np.logaddexp(0, np.where(y > 0, -score, score))
        gradient, curve = over_columns(weight * (p - (y > 0))), weight * np.maximum(p * (1 - p), 1e-12)
        if g in wide:
            diagonal = np.bincount(slot, x * x * curve[owner], k + 1)
            if fill:
                diagonal[:-1] += 2 * fill * np.bincount(slot, x * curve[owner], k + 1)[:-1] + fill**2 * curve.sum()
            return loss, gradient, (lambda v: over_columns(curve * scores(v)), diagonal)
        half = np.bincount(cell, product * curve[at], (k + 1) ** 2).reshape(k + 1, k + 1)
        hessian = half + half.T - np.diag(np.diag(half))
        if fill:
            hessian[:-1] += fill * hessian[-1]
            hessian[:, :-1] += fill * hessian[:, -1:]
        return loss, gradient, hessian

    found = []
    for i in range(resampling.number(n)):
        often = resampling.counts(row.astype(np.int64), n, i, salt)
        up, down = often @ (y > 0), often @ (y <= 0)
        if not (up > 0 and down > 0):
            continue
        weight = often * w * np.where(y > 0, (up + down) / (2 * up), (up + down) / (2 * down))
        b, held, done = found[-1] if found and g in wide else np.zeros(k + 1), None, None
        for _ in range(steps):
            b, held, done = _newton(b, held, part(b, weight), c, l1_ratio, penalise_intercept, tol)
            if done is not None:
                break
        found.append(held[1] if done is None else done)
    told = [] if not found else [(np.stack(found) if summary is None else summary(np.stack(found)[:, :-1])).tobytes()]
    return pa.table({"g": pa.array([g] * len(told), pa.string()), "told": pa.array(told, pa.binary())})


def logistic(rows: DataFrame, width: dict[str, int], resampling: Resampling, c: float, l1_ratio: float | None = None, penalise_intercept: bool = False, fill: float = 0.0, salt: dict[str, int] | None = None, steps: int = 60, tol: float = 1e-7, summary: Callable[[np.ndarray], np.ndarray] | None = None) -> dict:
    """Balanced logistic fits of every group and replicate of a panel: (coefficients, intercepts), one row per replicate with both classes, or the ``summary`` of the coefficients, whose last axis is theirs.

    Minimises R(b) + C·Σ w·log-loss, R being ½‖b‖² or the elastic net's
    l1_ratio·‖b‖₁ + ½(1 - l1_ratio)·‖b‖², by damped (proximal) Newton steps.
    ``rows`` should be cut: it is read once for the groups of few entries, and
    once per step and part of the replicates for all others.
    """
    m = F.size("xs").cast("long")
    counted = {r.g: r for r in rows.groupBy("g").agg(F.count("*").alias("n"), F.sum((m + 1) * (m + 2) / 2).alias("pairs"), F.sum(m + 1).alias("entries")).collect()}
    sizes = {g: (counted[g].n, k, (salt or {}).get(g, 0)) for g, k in width.items() if g in counted and k}
    wide = {g for g, (_, k, _) in sizes.items() if l1_ratio is None and k > _DENSE and (counted[g].entries <= _ENTRIES or 8 * (k + 1) ** 2 > _HESSIANS)}
    large = [g for g in sizes if g not in wide and counted[g].pairs > _PAIRS]
    out: dict = {}
    if len(sizes) > len(large):
        few = {g: v for g, v in sizes.items() if g not in large}
        small = rows.where(~F.col("g").isin(*large)) if large else rows

        def fit(key: tuple, table: pa.Table) -> pa.Table:
            return _fitted(key, table, few, wide, resampling, c, l1_ratio, penalise_intercept, fill, steps, tol, summary)

        for r in small.repartition(min(240, len(sizes)), "g").groupBy("g").applyInArrow(fit, "g string, told binary").collect():
            told, k = np.frombuffer(r.told), sizes[r.g][1]
            if summary is None:
                told = told.reshape(-1, k + 1)
                out[r.g] = told[:, :-1], told[:, -1]
            else:
                out[r.g] = told.reshape(-1, k) if len(told) > k else told
    trials = {(g, b): np.zeros(sizes[g][1] + 1) for g in large for b in range(resampling.number(sizes[g][0]))}

    def sums(at: dict, classes: dict | None) -> dict[tuple[str, int], np.ndarray]:
        if not at:
            return {}
        parts = rows.mapInArrow(partial(_newton_sums, resampling=resampling, sizes=sizes, trials=at, classes=classes, fill=fill), SUMS_SCHEMA)
        return {(r.g, r.b): np.frombuffer(r.part) for r in parts.groupBy("g", "b").applyInArrow(_added, SUMS_SCHEMA).collect()}

    classes = {k: (sum(v) / (2 * v[0]), sum(v) / (2 * v[1])) for k, v in sums(trials, None).items() if v[0] > 0 and v[1] > 0}
    trials = {k: v for k, v in trials.items() if k in classes}
    done: dict[tuple[str, int], np.ndarray] = {}
    for wave in _waves(trials):
        held: dict[tuple[str, int], tuple[float, np.ndarray]] = {}
        for _ in range(steps):
            for key, part in sums(wave, classes).items():
                k = len(wave[key])
                wave[key], held[key], solved = _newton(wave[key], held.get(key), (part[0], part[1 : k + 1], part[k + 1 :].reshape(k, k)), c, l1_ratio, penalise_intercept, tol)
                if solved is not None:
                    done[key] = solved
            wave = {k: v for k, v in wave.items() if k not in done}
            if not wave:
                break
        done |= {k: held[k][1] for k in wave if k in held}
    for g in large:
        found = [done[k] for k in sorted(done) if k[0] == g]
        if found:
            coefs = np.stack(found)
            out[g] = (coefs[:, :-1], coefs[:, -1]) if summary is None else summary(coefs[:, :-1])
    return {g: out[g] for g in sizes if g in out}


def _waves(trials: dict[tuple[str, int], np.ndarray]) -> Iterator[dict[tuple[str, int], np.ndarray]]:
    """Parts of the replicates whose Hessians a worker holds at once."""
    wave, size = {}, 0
    for key, b in trials.items():
        if wave and size + 8 * len(b) ** 2 > _HESSIANS:
            yield wave
            wave, size = {}, 0
        wave[key] = b
        size += 8 * len(b) ** 2
    if wave:
        yield wave


def _fits_per_group(panel_: DataFrame, group: list[str], pos: str, features: list[str], label: str, resampling: Resampling, c: float, l1_ratio: float | None) -> DataFrame:
    """(group, feature, importance, signed_mean) of a panel with one column per participant."""
    g: Column = F.to_json(F.struct(*(F.col(k) for k in group))) if group else F.lit("all")
    cells = panel_.select(g.alias("g"), F.col(pos).alias("at"), F.col(label).alias("y"), F.lit(1.0).alias("w"), F.array(*(F.struct(F.lit(i).alias("slot"), F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias("x")) for i, f in enumerate(features))).alias("xs"))
    rows = cut(numbered(cells, "g", "at", 1 << 16, "row").select("g", "row", "y", "w", "xs"))
    keys = cut(panel_.select(g.alias("g"), *group).distinct())
    found = logistic(rows, {r.g: len(features) for r in keys.select("g").distinct().collect()}, resampling, c, l1_ratio)
    told = [(k, f, float(i), float(m)) for k, (coefs, _) in found.items() for f, i, m in zip(features, solvers.median_of_means(np.abs(coefs), min(4, len(coefs))) if resampling.left_out < 2 else np.abs(coefs).mean(axis=0), coefs.mean(axis=0), strict=True)]
    return keys.join(panel_.sparkSession.createDataFrame(told, "g string, feature string, importance double, signed_mean double"), "g").drop("g")


def bootstrap_importance(panel: DataFrame, group: list[str], pos: str, features: list[str], label: str, replicates: int = 10, block: int = 120, c: float = 1.0, l1_ratio: float | None = None, seed: int = 42) -> DataFrame:
    """Block-bootstrap meta fit per group: feature, importance (median of means of |coef|), signed mean. ``pos`` is unique inside a group."""
    return _fits_per_group(panel, group, pos, features, label, Resampling(replicates, block, 0, seed), c, l1_ratio)


def leave_block_out(panel: DataFrame, group: list[str], pos: str, features: list[str], label: str, blocks: int = 4) -> DataFrame:
    """Feature, importance per group: mean |coef| of fits that each leave a part of the timeline out."""
    return _fits_per_group(panel, group, pos, features, label, Resampling(left_out=blocks), 1.0, None).drop("signed_mean")


def shift_evidence(df: DataFrame, who: str, pos: str, signal: str, labels: list[str], weights: list[float], least_shift: int, asset: str | None = None) -> DataFrame:
    """Participant, t, p of its series, or with ``asset`` of all its assets' series shifted together (one group per participant: an hourly panel)."""

    def test(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if asset is None:
            pdf = pdf.sort_values(pos)
            x, ys = pdf[signal].to_numpy(dtype=float), [pdf[c].to_numpy(dtype=float) for c in labels]
        else:
            wide = lambda c: pdf.pivot(index=pos, columns=asset, values=c).to_numpy(dtype=float)
            x, ys = wide(signal), [wide(c) for c in labels]
        t, p = solvers.shift_evidence(x, ys, weights, least_shift)
        return pd.DataFrame([[key[0], t, p]], columns=[who, "t", "p"])

    return df.select(who, pos, signal, *labels, *([asset] if asset else [])).groupBy(who).applyInPandas(test, f"{_kinds(df, [who])}, t double, p double")


def linked_clusters(pairs: DataFrame, a: str, b: str, similarity: str, component: str, cut: float) -> DataFrame:
    """Complete-linkage clusters inside each connected component of similar pairs: component, member, cluster (its smallest member).

    ``pairs`` lists each pair once; without a column ``component`` a component
    is named after its smallest member. Members whose similarity is not listed
    count as fully dissimilar, so components are independent of each other, and
    ``cut`` is below 1. A component of many pairs is linked in parts.
    """
    if not cut < 1:
        raise ValueError("members that are not listed must be farther apart than the cut")
    return linkage.clusters(pairs, a, b, similarity, component, cut)

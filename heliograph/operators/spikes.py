"""Implausible readings: spikes, stuck values and impossible prices per source.

Method: a robust autoregression per source with iterative tests for additive
outliers and level shifts (joint estimation). The changes between successive
readings follow an AR(1); its spread comes from the exact median absolute
change (the usual move), its coefficient at first from changes clipped at
``clip`` usual moves. Then, until the coefficients stand still:

1. residuals of the readings are tested, at every reading, for an additive
   outlier of one to three readings, a level shift and an innovation; the
   strongest of each neighbourhood that exceeds ``critical`` spreads is taken
   out of the residuals, and the tests repeat until none is left;
2. the coefficient is fitted again to the changes without what was taken out.

What the tests take out are the candidates. A spike is a candidate of one to
three readings that also differ from both neighbours by ``far`` usual moves
while these are closer to each other (exact check); other additive outliers
are flagged ``outlier``, moves that stay ``level_shift``. Runs of equal values
and physically impossible prices are flagged apart from that.

Scale: the table is read once; a source is cut into blocks of equal row count
with a halo, each block one array, so later passes need no shuffle and no
source is one task. Coefficients are collected, one row per listed ticker.

Defined cases: null source or time rows are ignored; 0.0, NaN and null are
missing; repeated deliveries count once (the last one); a source with fewer
than two readings or a usual move of 0 has no spikes; an empty table gives an
empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.operators.prices import PRICE_TICKERS, impossible, last_delivery, price_rows
from heliograph.operators.sequence import exact_median, numbered, with_halo
from heliograph.session import cut

#: Largest number of readings of a spike; readings that two tests of one round are apart at least.
LONGEST, APART = 3, 6
#: A coefficient stands still when it moves by less; rounds of fitting at most (each is a pass over the blocks).
STILL, FITS = 0.005, 5
FLAG_SCHEMA = "ticker string, sidx bigint, price double, flag string, residual double, statistic double"
_KINDS = np.array(["outlier", "outlier", "outlier", "level_shift", "level_shift"])


def patterns(phi: float) -> list[np.ndarray]:
    """What a unit intervention leaves in the residuals from its reading on: additive outliers of 1, 2 and 3 readings, level shift, innovation."""
    out = []
    for n in range(1, LONGEST + 1):
        c = np.zeros(n + 2)
        c[0], c[n] = 1.0, -1.0
        c[1] -= phi
        c[n + 1] += phi
        out.append(c)
    return [*out, np.array([1.0, -phi]), np.array([1.0])]


def residuals(x: np.ndarray, phi: float) -> np.ndarray:
    """Change of each reading minus its prediction from the change before; 0 for the first reading."""
    y = np.diff(x, prepend=x[:1])
    return y - phi * np.r_[0.0, y[:-1]]


def interventions(e: np.ndarray, phi: float, sigma: float, critical: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(reading, kind, size, statistic) of what the iterated tests take out of the residuals ``e``, and what is left of these."""
    shapes, left, n = patterns(phi), e.copy(), len(e)
    norms = np.array([np.sqrt((c**2).sum()) for c in shapes])
    taken: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    active = np.arange(n)
    while len(active):
        padded = np.r_[left, np.zeros(LONGEST + 2)]
        fit = np.stack([sum(c[k] * padded[active + k] for k in range(len(c))) for c in shapes]) / norms[:, None]
        kind = np.abs(fit).argmax(axis=0)
        score = fit[kind, np.arange(len(active))]
        strong = np.flatnonzero(np.abs(score) >= critical * sigma)
        if not len(strong):
            break
        # The strongest first; a reading near a stronger one waits for the next round.
        whole = np.zeros(n + 2 * APART)
        whole[active[strong] + APART] = np.abs(score[strong])
        at = active[strong]
        near = np.max([whole[at + APART + k] for k in range(-APART, APART + 1)], axis=0)
        first = np.max([whole[at + APART - k] for k in range(1, APART + 1)], axis=0)
        pick = strong[(np.abs(score[strong]) >= near) & (np.abs(score[strong]) > first)]
        t, k = active[pick], kind[pick]
        size = score[pick] / norms[k]
        for which in np.unique(k):
            rows = k == which
            for j, c in enumerate(shapes[which]):
                inside = t[rows] + j < n
                left[t[rows][inside] + j] -= size[rows][inside] * c
        taken.append((t, k, size, score[pick] / sigma))
        active = np.unique(np.clip(t[:, None] + np.arange(-APART, APART + 1), 0, n - 1))
        active = np.union1d(active, at)
    parts = [np.concatenate(p) for p in zip(*taken, strict=True)] if taken else [np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0)]
    return parts[0], parts[1], parts[2], parts[3], left


def clean_changes(x: np.ndarray, phi: float, sigma: float, critical: float) -> np.ndarray:
    """Changes (0 for the first reading) without what the interventions add to them; an innovation fades by the coefficient."""
    y = np.diff(x, prepend=x[:1])
    t, kind, size, _, _ = interventions(residuals(x, phi), phi, sigma, critical)
    gone = [(t, size)]
    gone += [(t[kind == n - 1] + n, -size[kind == n - 1]) for n in range(1, LONGEST + 1)]
    fading = kind == LONGEST + 1
    gone += [(t[fading] + k, size[fading] * phi**k) for k in range(1, 2 * APART)]
    for at, what in gone:
        inside = at < len(y)
        np.subtract.at(y, at[inside], what[inside])
    return y


def spike_readings(x: np.ndarray, candidate: np.ndarray, limit: float) -> np.ndarray:
    """Exact check of the candidates that open a spike: which readings are one of one to three that leave both neighbours by ``limit``."""
    out = np.zeros(len(x), dtype=bool)
    for size in range(1, LONGEST + 1):
        at = candidate[(candidate >= 1) & (candidate + size < len(x))]
        before, after = x[at - 1], x[at + size]
        inner = x[at[:, None] + np.arange(size)]
        away = (np.abs(inner - before[:, None]) >= limit) & (np.abs(inner - after[:, None]) >= limit)
        hit = at[away.all(axis=1) & (np.abs(before - after) < limit)]
        out[(hit[:, None] + np.arange(size)).ravel()] = True
    return out


def _series(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """(ticker, core, sidx, price) of every block, in order."""
    for batch in batches:
        tickers, numbers, lists = (batch.column(c) for c in ("ticker", "block", "readings"))
        values, offsets = lists.values, lists.offsets.to_numpy()
        pos, sidx, price = (values.field(i).to_numpy() for i in range(3))
        for i, (ticker, number) in enumerate(zip(tickers.to_pylist(), numbers.to_pylist(), strict=True)):
            part = slice(offsets[i], offsets[i + 1])
            yield ticker, pos[part] // block == number, sidx[part], price[part]


def _sums(batches: Iterator[pa.RecordBatch], block: int, usual: dict[str, float], fits: dict[str, float] | None, clip: float, critical: float) -> Iterator[pa.RecordBatch]:
    """Per block the sums of the autoregression: of clipped changes, or (given coefficients) of changes without what the tests take out."""
    tickers, sums = [], []
    for ticker, core, _, x in _series(batches, block):
        m = usual.get(ticker) or 0.0
        if len(x) < 3 or m <= 0:
            continue
        y = np.diff(x)
        if fits is None:
            y = np.clip(y, -clip * m, clip * m)
        else:
            y = clean_changes(x, fits[ticker], spread(m, fits[ticker]), critical)[1:]
        now, before = y[1:][core[2:]], y[:-1][core[2:]]
        tickers.append(ticker)
        sums.append((float(now @ before), float(before @ before)))
    yield pa.RecordBatch.from_arrays([pa.array(tickers, pa.string()), pa.array([s[0] for s in sums], pa.float64()), pa.array([s[1] for s in sums], pa.float64())], names=["ticker", "xy", "xx"])


def spread(usual: float, phi: float) -> float:
    """Standard deviation of the residuals of a normal AR(1) whose changes have this median size."""
    return 1.4826 * usual * float(np.sqrt(1 - phi**2))


def _flags(batches: Iterator[pa.RecordBatch], block: int, usual: dict[str, float], fits: dict[str, float], far: float, critical: float, stuck: int) -> Iterator[pa.RecordBatch]:
    for ticker, core, sidx, x in _series(batches, block):
        begins = np.r_[True, x[1:] != x[:-1]]
        lengths = np.diff(np.r_[np.flatnonzero(begins), len(x)])
        found = [(np.flatnonzero(np.repeat(lengths > stuck, lengths)), "stuck", np.full(len(x), np.nan))]
        m, phi = usual.get(ticker) or 0.0, fits.get(ticker, 0.0)
        e = residuals(x, phi)
        if m > 0:
            t, kind, _, score, _ = interventions(e, phi, spread(m, phi), critical)
            # Readings at which an intervention acts may open a spike.
            touched = np.unique(np.concatenate([t, *(t[kind == k] + d for k in range(5) for d in ((1, k + 1, k + 2) if k < LONGEST else (1,)))]))
            spike = spike_readings(x, touched[touched < len(x)], far * m)
            best = np.full(len(x), np.nan)
            for strong in np.argsort(np.abs(score), kind="stable"):
                best[t[strong] : t[strong] + (kind[strong] + 1 if kind[strong] < LONGEST else 1)] = score[strong]
            found.append((np.flatnonzero(spike), "spike", best))
            for which in range(len(_KINDS)):
                at = t[kind == which]
                reach = which + 1 if which < LONGEST else 1
                rows = np.unique((at[:, None] + np.arange(reach)).ravel())
                rows = rows[rows < len(x)]
                # A spike and the return from it are one finding.
                back = np.zeros(len(x) + 1, dtype=bool)
                back[1:] = spike
                rows = rows[~spike[rows] & ~back[rows]]
                found.append((rows, str(_KINDS[which]), best))
        for rows, flag, statistic in found:
            rows = rows[core[rows]]
            shown = statistic[rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array([ticker] * len(rows), pa.string()), pa.array(sidx[rows]), pa.array(x[rows]), pa.array([flag] * len(rows), pa.string()), pa.array(e[rows]), pa.array(shown, mask=np.isnan(shown))],
                names=["ticker", "sidx", "price", "flag", "residual", "statistic"],
            )


def autoregressions(blocks: DataFrame, block: int, clip: float, critical: float) -> tuple[dict[str, float], dict[str, float]]:
    """Usual move and coefficient per ticker (as many rows as tickers are listed), refitted until nothing moves."""
    inner = F.zip_with(F.slice("readings", 1, F.greatest(F.size("readings") - 1, F.lit(0))), F.slice("readings", 2, F.greatest(F.size("readings") - 1, F.lit(0))), lambda a, b: F.when(F.floor(b["pos"] / block) == F.col("block"), F.abs(b["price"] - a["price"])))
    moves = blocks.select("ticker", F.explode(inner).alias("move"))
    usual = {r.ticker: r["median"] for r in exact_median(moves, "ticker", F.col("move")).collect()}
    fits: dict[str, float] | None = None
    for _ in range(FITS):
        sums = blocks.mapInArrow(partial(_sums, block=block, usual=usual, fits=fits, clip=clip, critical=critical), "ticker string, xy double, xx double")
        total = sums.groupBy("ticker").agg(F.sum("xy").alias("xy"), F.sum("xx").alias("xx")).collect()
        new = {r.ticker: min(max(r.xy / r.xx, -0.95), 0.95) if r.xx > 0 else 0.0 for r in total}
        still = fits is not None and all(abs(new[t] - fits[t]) < STILL for t in new)
        fits = new
        if still:
            break
    return usual, fits or {}


def flag_readings(
    challenge: DataFrame,
    tickers: tuple[str, ...] = PRICE_TICKERS,
    far: float = 20.0,
    critical: float = 6.0,
    clip: float = 3.0,
    stuck: int = 15,
    chunk: int = 10_080,
    block: int = 5_000,
) -> DataFrame:
    """Flagged readings: ticker, sidx, price, flag, residual, statistic. One row per reading and flag.

    ``flag`` is ``impossible`` (of any delivered row; the last such price),
    ``stuck`` (in a run of more than ``stuck`` equal readings), ``spike``,
    ``outlier`` (an additive outlier of the autoregression that is no spike) or
    ``level_shift`` (the first reading of a move that stays). ``residual`` is
    the reading's change minus its prediction, ``statistic`` that of the test.
    """
    broken = F.max(F.when(impossible(F.col("price")), F.struct("ts", "price")))["price"]
    seen = cut(price_rows(challenge, tickers).groupBy("ticker", "sidx").agg(last_delivery().alias("price"), broken.alias("broken")).where("price IS NOT NULL OR broken IS NOT NULL"))
    placed = with_halo(numbered(seen.where("price IS NOT NULL").select("ticker", "sidx", "price"), "ticker", "sidx", chunk), max(stuck, 4 * APART), max(block, stuck, 4 * APART))
    block = max(block, stuck, 4 * APART)
    blocks = cut(placed.groupBy("ticker", "block").agg(F.array_sort(F.collect_list(F.struct("pos", "sidx", "price"))).alias("readings")))
    usual, fits = autoregressions(blocks, block, clip, critical)
    flagged = blocks.mapInArrow(partial(_flags, block=block, usual=usual, fits=fits, far=far, critical=critical, stuck=stuck), FLAG_SCHEMA)
    nothing = F.lit(None).cast("double")
    return flagged.unionByName(seen.where("broken IS NOT NULL").select("ticker", "sidx", F.col("broken").alias("price"), F.lit("impossible").alias("flag"), nothing.alias("residual"), nothing.alias("statistic")))


def implausible(challenge: DataFrame, tickers: tuple[str, ...] = PRICE_TICKERS, **options: float) -> DataFrame:
    """Distinct (ticker, sidx) of impossible, stuck and spike readings; genuine moves are no cases."""
    flagged = flag_readings(challenge, tickers, **options)
    return flagged.where(F.col("flag").isin("impossible", "stuck", "spike")).select("ticker", "sidx").distinct()

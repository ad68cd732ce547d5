"""Clusters of mutually similar vectors, each with its size and most typical members.

Method: Gaussian mixtures fitted by expectation-maximisation with regularised
covariance on standardised, reduced features, on two levels, because a flat
mixture would need a component for each of hundreds of thousands of small
groups.

1. Over all vectors of a ticker a mixture is fitted to cell statistics (every
   vector counts; the number of cells is bounded). Its components route the
   data: they are the clusters' regions.
2. Inside a component vectors meet in cells of a grid over the widest elements,
   each in its own cell and in those that its tolerance reaches upwards, so a
   cell with all of a group always exists. In each cell a mixture is fitted
   whose components are the groups: the information criterion chooses their
   number, posteriors assign the vectors, and the tolerance is checked exactly
   (``mixture.local_components``). Cells of very many vectors are fitted in
   overlapping halves, and components that share a vector are one.

A vector that no component holds within the tolerance is in no group with
others. A cell may see a part of a group only; the smallest record any cell
names is that of the whole group. A group's most typical members are those of
the highest density under its component: mean and variances (regularised by
the tolerance's) of all its vectors.

Scale: work is split by (ticker, component, bucket of cells), never by
component alone. Where a batch holds many vectors of one cell, those similar to
each other travel as one weighted point (count, sum, sum of squares, extremes)
under their smallest record; the others behind it find their group by a join
on that record, of which there is one per batch and group, so a group that
holds a third of all rows meets nowhere as a whole. Records travel as (minute,
position) in one integer that orders like (sidx, hotkey); hotkeys are joined to
the final pairs.

Defined cases: null, empty or unusable blobs hold no vectors; all-zero vectors
and those with NaN are no records; of repeated deliveries of (ticker, sidx,
hotkey) the last (largest ts, then largest blob) counts; an infinite element
only equals itself; empty input gives empty results; extra columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heliograph.llm import mixture
from heliograph.session import cut

#: The tickers whose blobs hold vectors of 17 elements.
VECTOR_TICKERS, WIDTH = ("ETHLBFGS", "BTCLBFGS"), 17
#: Largest difference of an element inside a group (0.02) with room for rounding in the last place.
TOLERANCE = 0.02 + 1e-9
#: Reduced features; boxes per feature of the cell statistics; vectors per grid cell aimed at; rows per bucket aimed at.
REDUCED, BOXES, PER_CELL, PER_BUCKET = 6, 3, 160, 8000
#: Vectors of one cell in one batch from which similar ones travel as one point (the result is the same).
CROWDED = 64
#: Points up to which a cell is fitted as a whole, without halving.
DIRECT = 600
#: Positions per minute in a record id.
POSITIONS = 1 << 20


def _deliveries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated deliveries of one batch as one row (the largest ts)."""
    for batch in batches:
        if batch.num_rows:
            once = pa.Table.from_batches([batch]).group_by(["ticker", "sidx", "embeddings"]).aggregate([("ts", "max")])
            yield from once.select(["ticker", "sidx", "embeddings", "ts_max"]).rename_columns(["ticker", "sidx", "embeddings", "ts"]).to_batches()


def unpack(blob: bytes | None, width: int = WIDTH) -> tuple[list[str], np.ndarray] | None:
    """Hotkeys and float16 matrix of a blob, None where it holds no vectors."""
    if not blob:
        return None
    at = blob.find(b"\0")
    if at < 0:
        return None
    try:
        hotkeys = json.loads(blob[:at])
    except ValueError:
        return None
    if not isinstance(hotkeys, list) or not all(isinstance(h, str) for h in hotkeys) or len(blob) - at - 1 != len(hotkeys) * width * 2:
        return None
    return hotkeys, np.frombuffer(blob, dtype="<f2", offset=at + 1).reshape(len(hotkeys), width)


def _merged(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Deliveries of (ticker, sidx) -> its records: hotkeys in byte order and their vectors as one blob."""
    for batch in batches:
        tickers, minutes, names, blobs = [], [], [], []
        for ticker, sidx, sent in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            records: dict[str, np.ndarray] = {}
            for one in sorted(sent, key=lambda s: (s["ts"] is not None, s["ts"] or 0, s["embeddings"])):
                if (got := unpack(one["embeddings"], width)) is not None:
                    records.update(zip(*got, strict=True))
            kept = {h: v for h, v in records.items() if not np.isnan(v).any() and v.any()}
            if kept:
                order = sorted(kept, key=str.encode)
                if len(order) > POSITIONS:
                    raise ValueError(f"more than {POSITIONS} hotkeys in minute {sidx} of {ticker}")
                tickers.append(ticker)
                minutes.append(sidx)
                names.append(order)
                blobs.append(np.stack([kept[h] for h in order]).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(tickers, pa.string()), pa.array(minutes, pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(blobs, pa.binary())], names=["ticker", "sidx", "hotkeys", "data"])


def records(challenge: DataFrame, tickers: tuple[str, ...] = VECTOR_TICKERS, width: int = WIDTH) -> DataFrame:
    """One row per (ticker, sidx) with records: ticker, sidx, hotkeys, data (float16, row by row)."""
    rows = challenge.where(F.col("ticker").isin(*tickers) & F.col("sidx").isNotNull() & (F.length("embeddings") > 0)).select("ticker", "sidx", "embeddings", "ts")
    once = rows.mapInArrow(_deliveries, rows.schema).repartition("ticker", "sidx")
    sent = once.groupBy("ticker", "sidx").agg(F.collect_list(F.struct("ts", "embeddings")).alias("sent"))
    return sent.mapInArrow(partial(_merged, width=width), "ticker string, sidx bigint, hotkeys array<string>, data binary")


def _vectors(batch: pa.RecordBatch, width: int) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(ticker, record ids, vectors as float64) of a batch of ``records``."""
    tickers = np.array(batch.column("ticker").to_pylist(), dtype=object)
    minutes = batch.column("sidx").to_numpy()
    blobs = batch.column("data").to_pylist()
    for ticker in sorted(set(tickers.tolist())):
        rows = np.flatnonzero(tickers == ticker)
        counts = np.array([len(blobs[r]) // (2 * width) for r in rows])
        x = np.frombuffer(b"".join(blobs[r] for r in rows), dtype="<f2").reshape(-1, width).astype(np.float64)
        starts = np.cumsum(counts) - counts
        ids = np.repeat(minutes[rows] * POSITIONS - starts, counts) + np.arange(len(x))
        yield ticker, ids, x


def _moments(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Count (at -1), sums (0, 1, ...) and sums of products of the elements, one row each."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for ticker, _, x in _vectors(batch, width):
            x = x[np.isfinite(x).all(axis=1)]
            sums[ticker] = sums.get(ticker, 0.0) + np.concatenate(([len(x)], x.sum(axis=0), (x.T @ x).ravel()))
    for ticker, total in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([ticker] * len(total), pa.string()), pa.array(np.arange(-1, len(total) - 1, dtype=np.int32)), pa.array(total)], names=["ticker", "at", "total"])


def _boxes(batches: Iterator[pa.RecordBatch], width: int, features: dict[str, mixture.Features], boxes: int) -> Iterator[pa.RecordBatch]:
    """Count, sum and scatter of the reduced vectors per box of the reduced space."""
    sums: dict[tuple[str, int], list] = {}
    for batch in batches:
        for ticker, _, x in _vectors(batch, width):
            z = features[ticker](x[np.isfinite(x).all(axis=1)])
            d = z.shape[1]
            cell = np.clip(np.floor(z / 1.2 + boxes / 2), 0, boxes - 1).astype(np.int64) @ boxes ** np.arange(d)
            order = np.argsort(cell, kind="stable")
            z, cell = z[order], cell[order]
            starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, dtype=np.int64)
            outer = (z[:, :, None] * z[:, None, :]).reshape(len(z), -1)
            if len(starts):
                n, total, scatter = np.diff(np.r_[starts, len(cell)]), np.add.reduceat(z, starts), np.add.reduceat(outer, starts)
                for i, at in enumerate(starts):
                    s = sums.setdefault((ticker, int(cell[at])), [0.0, np.zeros(d), np.zeros(d * d)])
                    s[0] += float(n[i])
                    s[1] += total[i]
                    s[2] += scatter[i]
    yield pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.int64()), pa.array([s[0] for s in sums.values()], pa.float64()), pa.array([s[1].tolist() for s in sums.values()], pa.list_(pa.float64())), pa.array([s[2].tolist() for s in sums.values()], pa.list_(pa.float64()))],
        names=["ticker", "cell", "n", "total", "scatter"],
    )


class Grid:
    """Grid cells of one ticker, their mixture components and buckets."""

    def __init__(self, features: mixture.Features, model: mixture.Mixture, n: float) -> None:
        self.features, self.model = features, model
        order = np.argsort(-features.scale)
        self.width = np.maximum(8 * TOLERANCE, 0.9 * features.scale)
        # A spread of one cell width and more per element: about 3.5 standard deviations make 3.8 cells.
        wanted = int(np.clip(np.ceil(np.log(max(n / PER_CELL, 1.0)) / np.log(3.8)), 1, len(order)))
        self.elements = np.sort(order[:wanted])
        self.buckets = max(1, int(np.ceil(n * 1.7 / PER_BUCKET)))

    def corners(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's cell, and the cell that its tolerance reaches (finite elements only)."""
        part = np.nan_to_num(x[:, self.elements], posinf=1e6, neginf=-1e6)
        w = self.width[self.elements]
        return np.floor(part / w).astype(np.int64), np.floor((part + TOLERANCE) / w).astype(np.int64)

    def reached(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of every cell that a vector is in or reaches upwards."""
        low, high = self.corners(x)
        row, cell = np.arange(len(x)), low
        for d in range(low.shape[1]):
            more = high[row, d] > low[row, d]
            again = cell[more].copy()
            again[:, d] += 1
            row, cell = np.concatenate((row, row[more])), np.concatenate((cell, again))
        return row, cell

    @staticmethod
    def key(cell: np.ndarray) -> np.ndarray:
        """64-bit hash of each cell; its lower half travels, and a collision only brings two cells' vectors together."""
        h = np.full(len(cell), 0x9E3779B97F4A7C15, dtype=np.uint64)
        for d in range(cell.shape[1]):
            h ^= cell[:, d].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) + (h << np.uint64(6)) + (h >> np.uint64(2))
            h *= np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(33)
        return h.view(np.int64)

    def component(self, cell: np.ndarray) -> np.ndarray:
        """The mixture component with the highest density at each cell's centre."""
        centre = np.repeat(self.features.mean[None], len(cell), axis=0)
        centre[:, self.elements] = (np.clip(cell, -1e6, 1e6) + 0.5) * self.width[self.elements]
        return self.model.log_densities(self.features(centre)).argmax(axis=1)


def cell_groups(points: mixture.Points, cells: np.ndarray, reduced: int = REDUCED) -> np.ndarray:
    """Labels of the groups inside the cells that ``cells`` labels: no element of a group spans more than the tolerance."""
    label, used = np.empty(len(points), dtype=np.int64), 0
    if np.isinf(points.low).any():
        # An infinite element only equals itself: such points meet those infinite in the same places, in what is finite.
        signs = np.where(np.isinf(points.low), np.sign(points.low), 0.0)
        cells = np.unique(np.column_stack((cells, signs)), axis=0, return_inverse=True)[1].ravel()
        zeroed = np.where(signs != 0, 0.0, points.low), np.where(signs != 0, 0.0, points.high)
        plain = lambda v: np.where(signs != 0, 0.0, v)
        points = mixture.Points(points.count, plain(points.total), plain(points.square), *zeroed)
    order = np.argsort(cells, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(cells[order])) + 1) if len(order) else ():
        found = _fitted(points[rows], reduced)
        alone = np.flatnonzero(found < 0)
        found[alone] = len(rows) + alone
        label[rows] = used + found
        used += 2 * len(rows)
    return label


def _fitted(points: mixture.Points, reduced: int) -> np.ndarray:
    """Components of one cell's points (-1: in none), fitted in overlapping pieces, joined where pieces share a point, checked exactly."""
    if len(points) <= DIRECT:
        return mixture.local_components(points, TOLERANCE, reduced)
    low, high, queue = [], [], [np.arange(len(points))]
    while queue:
        rows = queue.pop()
        halves = _halves(points[rows]) if len(rows) > DIRECT else None
        if halves is not None:
            queue += [rows[half] for half in halves]
            continue
        label = mixture.local_components(points[rows], TOLERANCE, reduced)
        held = np.flatnonzero(label >= 0)
        if len(held):
            _, first, own = np.unique(label[held], return_index=True, return_inverse=True)
            low.append(rows[held[first]][own])
            high.append(rows[held])
    root = np.arange(len(points))
    if not low:
        return np.full(len(points), -1)
    a, b = np.concatenate(low), np.concatenate(high)
    while (root[a] != root[b]).any():
        least = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], least)
        np.minimum.at(root, root[b], least)
        while (root != root[root]).any():
            root = root[root]
    joined = np.unique(root, return_inverse=True)[1]
    wide = mixture.spans(points, joined)[joined] > TOLERANCE
    joined[wide] = -1
    return joined


def _halves(points: mixture.Points) -> tuple[np.ndarray, np.ndarray] | None:
    """Points on both sides of a border across one element, those within the tolerance of it on both; None where all borders leave too much on both."""
    best, n = None, len(points)
    lows, highs = np.sort(points.low, axis=0), np.sort(points.high, axis=0)
    for d in range(points.low.shape[1]):
        for border in lows[[n // 3, n // 2, 2 * n // 3], d]:
            left = int(np.searchsorted(lows[:, d], border, side="right"))
            right = n - int(np.searchsorted(highs[:, d], border - TOLERANCE, side="left"))
            if max(left, right) <= 0.75 * n and left + right <= 1.3 * n and (best is None or left + right < best[0]):
                best = left + right, d, border
    if best is None:
        return None
    _, d, border = best
    return np.flatnonzero(points.low[:, d] <= border), np.flatnonzero(points.high[:, d] >= border - TOLERANCE)


def _crowds(ids: np.ndarray, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """Row of the smallest record of each vector's crowd: vectors of a crowded cell that are all similar to each other."""
    behind = np.arange(len(x))
    _, inverse, counts = np.unique(cell, return_inverse=True, return_counts=True)
    crowded = np.flatnonzero(counts[inverse] > CROWDED)
    crowded = crowded[np.lexsort((ids[crowded], inverse[crowded]))]
    for rest in np.split(crowded, np.flatnonzero(np.diff(inverse[crowded])) + 1) if len(crowded) else ():
        while len(rest):
            with np.errstate(invalid="ignore"):
                near = np.abs(x[rest] - x[rest[0]]).max(axis=1) <= TOLERANCE
            near[0] = True
            rows = rest[near]
            if len(rows) > 1 and np.ptp(x[rows], axis=0).max() <= TOLERANCE:
                behind[rows] = rows[0]
            rest = rest[~near]
    return behind


_SENT = "ticker string, component int, bucket int, cell int, record bigint, vector binary, count bigint, crowd binary"
_NAMED = "ticker string, record bigint, first bigint, size bigint, crowd boolean, density double, component int, mean array<double>, var array<double>"
_BEHIND = "ticker string, record bigint, before bigint, vector array<float>"


def _rows_of(x: np.ndarray, kind: str) -> pa.Array:
    """Rows of a matrix as a binary column."""
    size = x.shape[1] * np.dtype(kind).itemsize
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(0, (len(x) + 1) * size, size, dtype=np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(x, dtype=kind).tobytes())])


def _sent(batches: Iterator[pa.RecordBatch], width: int, grids: dict[str, Grid]) -> Iterator[pa.RecordBatch]:
    """Vectors with the cells they reach; crowds as one point under their smallest record."""
    for batch in batches:
        for ticker, ids, x in _vectors(batch, width):
            grid = grids[ticker]
            behind = _crowds(ids, x, grid.key(grid.corners(x)[0]))
            rows, home, counts = np.unique(behind, return_inverse=True, return_counts=True)
            row, cell = grid.reached(x[rows])
            key = grid.key(cell)
            _, once, again = np.unique(key, return_index=True, return_inverse=True)
            crowd = pa.nulls(len(row), pa.binary())
            several = np.flatnonzero(counts[row] > 1)
            if len(several):
                order = np.argsort(home, kind="stable")
                starts = np.searchsorted(home[order], np.arange(len(rows)))
                part = x[order]
                whole = np.concatenate([f.reduceat(v, starts) for f, v in ((np.add, part), (np.add, part * part), (np.minimum, part), (np.maximum, part))], axis=1)
                crowd = pc.replace_with_mask(crowd, pa.array(counts[row] > 1), _rows_of(whole[row[several]], "<f8"))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ticker] * len(row), pa.string()),
                    pa.array(grid.component(cell[once])[again], pa.int32()),
                    pa.array(((key.view(np.uint64) >> np.uint64(20)) % np.uint64(grid.buckets)).astype(np.int32)),
                    pa.array(key.astype(np.int32)),
                    pa.array(ids[rows[row]]),
                    _rows_of(x[rows[row]], "<f2"),
                    pa.array(counts[row]),
                    crowd,
                ],
                names=["ticker", "component", "bucket", "cell", "record", "vector", "count", "crowd"],
            )


def _behind(batches: Iterator[pa.RecordBatch], width: int, grids: dict[str, Grid], vectors: bool) -> Iterator[pa.RecordBatch]:
    """Records that don't travel and the record of their crowd that does (the batches are those of ``_sent``)."""
    for batch in batches:
        for ticker, ids, x in _vectors(batch, width):
            grid = grids[ticker]
            behind = _crowds(ids, x, grid.key(grid.corners(x)[0]))
            rows = np.flatnonzero(behind != np.arange(len(x)))
            flat = x[rows].astype(np.float32).ravel() if vectors else np.zeros(0, dtype=np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, width, dtype=np.int32)), pa.array(flat)) if vectors else pa.nulls(len(rows), pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([pa.array([ticker] * len(rows), pa.string()), pa.array(ids[rows]), pa.array(ids[behind[rows]]), lists], names=["ticker", "record", "before", "vector"])


def _named(key: tuple, table: pa.Table, width: int, least: int) -> pa.Table:
    """Groups inside the cells of one bucket: every record that travelled with the smallest record its cell sees, and its density.

    Records of crowds also bring their component's mean and variances, for those behind them.
    """
    table = table.combine_chunks()
    ids, count = table.column("record").to_numpy(), table.column("count").to_numpy().astype(np.float64)
    x = np.frombuffer(b"".join(table.column("vector").to_pylist()), dtype="<f2").reshape(-1, width).astype(np.float64)
    points = mixture.Points.of(x)
    crowd = count > 1
    if crowd.any():
        total, square, low, high = np.frombuffer(b"".join(table.column("crowd").drop_null().to_pylist()), dtype="<f8").reshape(-1, 4, width).transpose(1, 0, 2)
        put = lambda v, w: np.where(crowd[:, None], w[np.maximum(np.cumsum(crowd) - 1, 0)], v)
        points = mixture.Points(count, put(x, total), put(x * x, square), put(x, low), put(x, high))
    label = cell_groups(points, table.column("cell").to_numpy(), min(REDUCED, width))
    order = np.lexsort((ids, label))
    starts = np.flatnonzero(np.r_[True, np.diff(label[order]) != 0])
    members = np.diff(np.r_[starts, len(order)])
    weight = np.add.reduceat(count[order], starts)
    with np.errstate(invalid="ignore"):
        mean = np.add.reduceat(points.total[order], starts) / weight[:, None]
        var = np.maximum(np.add.reduceat(points.square[order], starts) / weight[:, None] - mean**2, TOLERANCE**2 / 12)
        density = -0.5 * np.nan_to_num((x[order] - np.repeat(mean, members, axis=0)) ** 2 / np.repeat(var, members, axis=0)).sum(axis=1)
    group, size = np.repeat(np.arange(len(starts)), members), np.repeat(weight, members).astype(np.int64)
    keep = np.flatnonzero(size >= least)
    crowds = crowd[order][keep]

    def shown(v: np.ndarray) -> pa.Array:
        lengths = np.where(crowds, width, 0)
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), pa.array(v[group[keep][crowds]].ravel()))

    return pa.table(
        {
            "ticker": pa.array([key[0].as_py()] * len(keep), pa.string()),
            "record": pa.array(ids[order][keep]),
            "first": pa.array(ids[order][starts][group[keep]]),
            "size": pa.array(size[keep]),
            "crowd": pa.array(crowds),
            "density": pa.array(density[keep].round(9)),
            "component": pa.array(np.full(len(keep), key[1].as_py(), dtype=np.int32)),
            "mean": shown(mean),
            "var": shown(var),
        }
    )


def _grids(found: DataFrame, width: int) -> dict[str, Grid]:
    """Features, mixture and grid per ticker, from sums over all vectors."""
    shape = "ticker string, at int, total double"
    # Two tickers' sums of 1 + 17 + 17² numbers reach the driver.
    sums = found.mapInArrow(partial(_moments, width=width), shape).groupBy("ticker", "at").agg(F.sum("total").alias("total")).toPandas()
    features = {}
    for ticker, part in sums.sort_values(["ticker", "at"]).groupby("ticker"):
        s = part["total"].to_numpy()
        if s[0] > 0:
            features[ticker] = mixture.Features.fit(s[0], s[1 : width + 1], s[width + 1 :].reshape(width, width), min(REDUCED, width))
    if not features:
        return {}
    shape = "ticker string, cell bigint, n double, total array<double>, scatter array<double>"
    boxes = found.where(F.col("ticker").isin(*features)).mapInArrow(partial(_boxes, width=width, features=features, boxes=BOXES), shape)
    reduced = min(REDUCED, width)
    # At most BOXES ** REDUCED rows per ticker reach the driver.
    added = lambda c, size: F.array(*(F.sum(F.col(c)[i]) for i in range(size))).alias(c)
    cells = boxes.groupBy("ticker", "cell").agg(F.sum("n").alias("n"), added("total", reduced), added("scatter", reduced * reduced)).toPandas()
    grids = {}
    for ticker, part in cells.sort_values(["ticker", "cell"]).groupby("ticker"):
        count = part["n"].to_numpy()
        model = mixture.choose(count, np.stack(part["total"]), np.stack(part["scatter"]).reshape(len(part), reduced, reduced))
        grids[ticker] = Grid(features[ticker], model, float(count.sum()))
    return grids


def _memberships(found: DataFrame, width: int, least: int, vectors: bool) -> tuple[DataFrame, DataFrame]:
    """What ``_named`` says of the records that travelled, per cell; and (ticker, record, before, vector) of those behind them."""
    grids = _grids(found, width)
    usable = found.where(F.col("ticker").isin(*grids) if grids else F.lit(False))
    sent = usable.mapInArrow(partial(_sent, width=width, grids=grids), _SENT)

    def named(key, table):  # noqa: ANN001, ANN202
        return _named(key, table, width, least)

    return sent.groupBy("ticker", "component", "bucket").applyInArrow(named, _NAMED), usable.mapInArrow(partial(_behind, width=width, grids=grids, vectors=vectors), _BEHIND)


def _with_hotkey(pairs: DataFrame, found: DataFrame, record: str, suffix: str) -> DataFrame:
    """Replaces a record id by sidx and hotkey (columns with the suffix)."""
    names = found.select("ticker", F.col("sidx").alias(f"sidx{suffix}"), F.col("hotkeys").alias("_names"))
    split = pairs.withColumn(f"sidx{suffix}", F.floor(F.col(record) / POSITIONS).cast("long"))
    at = (F.col(record) - F.col(f"sidx{suffix}") * POSITIONS + 1).cast("int")
    return split.join(names, ["ticker", f"sidx{suffix}"]).withColumn(f"hotkey{suffix}", F.element_at("_names", at)).drop("_names", record)


def similar_pairs(challenge: DataFrame, tickers: tuple[str, ...] = VECTOR_TICKERS, width: int = WIDTH) -> DataFrame:
    """(ticker, sidx_a, hotkey_a, sidx_b, hotkey_b): every record of a group of two or more beside its smallest record."""
    found = cut(records(challenge, tickers, width))
    seen, behind = _memberships(found, width, 2, False)
    first = cut(seen.groupBy("ticker", "record").agg(F.min("first").alias("first"), F.max("crowd").alias("crowd")))
    hidden = behind.join(first.where("crowd").select("ticker", F.col("record").alias("before"), "first"), ["ticker", "before"]).select("ticker", "record", "first")
    pairs = first.select("ticker", "record", "first").where("first < record").unionByName(hidden)
    named = _with_hotkey(_with_hotkey(pairs, found, "first", "_a"), found, "record", "_b")
    return named.select("ticker", "sidx_a", "hotkey_a", "sidx_b", "hotkey_b")


def clusters(challenge: DataFrame, tickers: tuple[str, ...] = VECTOR_TICKERS, width: int = WIDTH, typical: int = 3, least: int = 2) -> DataFrame:
    """One row per group of ``least`` or more: its smallest record (sidx, hotkey), component, size and most typical members.

    ``typical`` lists up to that many (sidx, hotkey), by density (to nine
    decimals, so that the order of sums doesn't decide), then by record.
    """
    found = cut(records(challenge, tickers, width))
    seen, behind = _memberships(found, width, least, True)
    # The cell that sees most of a group sees all of it.
    whole = cut(seen.groupBy("ticker", "record").agg(F.min("first").alias("first"), F.max(F.struct("size", F.col("first") * -1, "crowd", "density", "component", "mean", "var")).alias("at")))
    crowd = whole.where("at.crowd").select("ticker", F.col("record").alias("before"), "first", "at.size", "at.component", "at.mean", "at.var")
    terms = [F.nanvl((F.col("vector")[i] - F.col("mean")[i]) ** 2 / F.col("var")[i], F.lit(0.0)) for i in range(width)]
    hidden = behind.join(crowd, ["ticker", "before"]).select("ticker", "record", "first", "size", "component", F.round(-0.5 * sum(terms[1:], terms[0]), 9).alias("density"))
    scored = whole.select("ticker", "record", "first", "at.size", "at.component", "at.density").unionByName(hidden)
    rank = Window.partitionBy("ticker", "first").orderBy(F.desc("density"), "record")
    # The limit on the rank is applied before the shuffle, too, so that no task holds a whole group.
    top = scored.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= typical)
    shown = _with_hotkey(top, found, "record", "_m").groupBy("ticker", "first").agg(F.max("size").alias("size"), F.min("component").alias("component"), F.sort_array(F.collect_list(F.struct("rank", F.col("sidx_m").alias("sidx"), F.col("hotkey_m").alias("hotkey")))).alias("typical"))
    both = _with_hotkey(shown, found, "first", "")
    return both.select("ticker", "sidx", "hotkey", "component", "size", F.transform("typical", lambda t: F.struct(t["sidx"].alias("sidx"), t["hotkey"].alias("hotkey"))).alias("typical"))

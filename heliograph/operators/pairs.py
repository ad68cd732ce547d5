"""All pairs of participants, block by block.

Participants get dense slots in the order of their names, and slots form
blocks. What a block did is packed once, moments in chunks, and stored once;
each pair of blocks is one task that reads both from the shared folder, goes
through the chunks and adds up dense matrices of counts or sums. So neither
the pairs of a moment nor those of all participants are ever shuffled, blocks
aren't copied for each of their partners, and a worker holds a few matrices of
a block's size, whatever the number of participants.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliograph.session import cut

BLOCK = 2048
#: Moments, entries of a pair of blocks, and rows of output, that are dense or listed at once.
_MOMENTS, _LISTED, _OUT = 512, 1 << 21, 1 << 16

Side = tuple[np.ndarray, np.ndarray, np.ndarray]
Totals = dict[str, np.ndarray]


def slots(df: DataFrame, who: str) -> DataFrame:
    """(who, _slot): participants numbered from 0 in their order."""
    return df.where(F.col(who).isNotNull()).select(who).distinct().withColumn("_slot", F.row_number().over(Window.orderBy(who)) - 1)


def _packed(batches: Iterator[pa.RecordBatch], block: int, coded: bool) -> Iterator[pa.RecordBatch]:
    """Per batch of moments and block: moment in the batch, slot in the block and values of its entries."""
    for number, batch in enumerate(batches):
        lists = batch.column(0)
        at = np.repeat(np.arange(len(lists), dtype=np.uint32), np.diff(lists.offsets.to_numpy()))
        flat = lists.flatten()
        slot = flat.field(0).to_numpy()
        if flat.type.num_fields < 2:
            v = np.empty((len(slot), 0))
        elif coded:
            code = flat.field(1).dictionary_encode().indices.fill_null(-1)
            v = code.to_numpy().astype(float)[:, None]
        elif pa.types.is_list(flat.field(1).type):
            # A vector's length goes before it; no missing element is near another.
            vectors = flat.field(1)
            size = np.diff(vectors.offsets.to_numpy())
            v = np.zeros((len(slot), int(size.max(initial=0)) + 1))
            v[:, 0] = size
            v[:, 1:][np.arange(v.shape[1] - 1) < size[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
        else:
            v = flat.field(1).to_numpy(zero_copy_only=False).astype(float)[:, None]
        out = []
        for b in np.unique(slot // block):
            mine = slot // block == b
            out.append((number * 1_000_003 + TaskContext.get().partitionId(), int(b), v.shape[1], at[mine].tobytes(), (slot[mine] % block).astype(np.uint16).tobytes(), v[mine].tobytes()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _PACKED_TYPES, strict=True)], names=_PACKED_NAMES)


_PACKED_NAMES = ["chunk", "block", "width", "at", "slot", "v"]
_PACKED_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
_PACKED = "chunk bigint, block int, width int, at binary, slot binary, v binary"


def _pairs(batches: Iterator[pa.RecordBatch], add: Callable[[Totals, Side, Side, bool], None], names: list[str], block: int, finish: Callable[..., Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    now, totals, first = None, {}, None
    for batch in batches:
        for row in batch.to_pylist():
            key = row["i"], row["j"], row["part"]
            if key != now:
                if totals:
                    yield from finish(totals, now[0] * block, now[1] * block, now[0] == now[1])
                now, first = key, None
                totals = {}
            at = np.frombuffer(row["at"], np.uint32)
            side = at, np.frombuffer(row["slot"], np.uint16), np.frombuffer(row["v"]).reshape(len(at), row["width"])
            if row["i"] == row["j"] or (first is not None and first[0] == row["chunk"]):
                totals = totals or {c: np.zeros((block, block), np.float64 if c in ("x", "y", "xx", "yy", "xy") else np.int32) for c in names}
                add(totals, side if row["i"] == row["j"] else first[1], side, row["i"] == row["j"])
                first = None
            elif not row["side"]:
                first = row["chunk"], side
    if totals:
        yield from finish(totals, now[0] * block, now[1] * block, now[0] == now[1])


def listed(totals: Totals, i0: int, j0: int, same: bool, test: Callable[[Totals], np.ndarray], diagonal: bool = False, then: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None) -> Iterator[pa.RecordBatch]:
    """The pairs of a block that ``test`` keeps: i, j and the totals, or what ``then`` makes of them."""
    kept = test(totals)
    i, j = np.nonzero(np.triu(kept, 0 if diagonal else 1) if same else kept)
    for k in range(0, len(i), _OUT):
        a, b = i[k : k + _OUT], j[k : k + _OUT]
        columns = [(a + i0).astype(np.int32), (b + j0).astype(np.int32), *(m[a, b] for m in totals.values())]
        batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["i", "j", *totals])
        yield batch if then is None else then(batch)


def pairwise(df: DataFrame, moment: list[str], slot: str, value: Column | None, n: int, add: Callable[[Totals, Side, Side, bool], None], names: list[str], test: Callable[[Totals], np.ndarray], coded: bool = False, diagonal: bool = False, finish: Callable[..., Iterator[pa.RecordBatch]] | None = None, then: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None, schema: str = "", block: int = BLOCK) -> DataFrame:
    """(i, j, totals) of all pairs i < j of ``n`` slots, totals added up by ``add`` over the moments; pairs for which ``test`` fails are left out.

    Few participants are one pair of blocks, so its chunks are shared among
    several tasks and their totals are added; ``test`` must hold for a part
    if it holds for the whole of one part only. ``finish`` replaces the list;
    ``then`` makes rows of ``schema`` of a batch of it, whose totals are whole.
    """
    block = min(max(1, n), max(min(512, block), min(block, -(-n // 8))))
    blocks = -(-max(1, n) // block)
    parts = 1 if finish or blocks > 1 else max(1, min(16, (1 << 21) // (block * block)))
    entry = F.struct(F.col(slot).cast("int").alias("s"), *([value.alias("v")] if value is not None else []))
    known = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [*moment, slot]))
    rows = known.groupBy(*moment).agg(F.collect_list(entry).alias("l")).select("l")
    packed = rows.mapInArrow(partial(_packed, block=block, coded=coded), _PACKED)
    content = ["width", "at", "slot", "v"]
    if blocks == 1:
        # One block meets itself only; its chunks are shared.
        own = cut(packed).select(F.col("block").alias("i"), F.col("block").alias("j"), F.pmod("chunk", F.lit(parts)).cast("int").alias("part"), "chunk", F.lit(False).alias("side"), *content)
        placed = own.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "chunk")
    else:
        # A partition of the stored blocks is one block. Partitions meet as they are, without an exchange: an equality would make it a join by chunk.
        stored = cut(packed.repartitionById(blocks, F.col("block")))
        left, right = (stored.select(*(F.col(c).alias(f"{x}_{c}") for c in stored.columns)) for x in "lr")
        met = left.join(right.hint("shuffle_replicate_nl"), F.expr("l_block <= r_block AND l_chunk <= r_chunk AND l_chunk >= r_chunk"))
        sides = F.array(*(F.struct(F.lit(x == "r").alias("side"), *(F.col(f"{x}_{c}").alias(c) for c in content)) for x in "lr"))
        kept = F.when(F.col("l_block") == F.col("r_block"), F.slice(sides, 2, 1)).otherwise(sides)
        placed = met.select(F.col("l_block").alias("i"), F.col("r_block").alias("j"), F.lit(0).alias("part"), F.col("l_chunk").alias("chunk"), F.inline(kept))
    shape = schema if schema and parts == 1 else "i int, j int, " + ", ".join(f"{c} {'double' if c in ('x', 'y', 'xx', 'yy', 'xy') else 'int'}" for c in names)
    run = partial(_pairs, add=add, names=names, block=block, finish=finish or partial(listed, test=(lambda t: t["n"] > 0) if parts > 1 else test, diagonal=diagonal, then=then if parts == 1 else None))
    out = placed.mapInArrow(run, shape)
    if parts == 1:
        return out
    whole = out.groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in names))
    return whole if then is None else whole.mapInArrow(partial(map, then), schema)


def _spread(side: Side, low: int, high: int, block: int, kind: type = np.float32) -> tuple[np.ndarray, slice]:
    """Matrix (moment, slot) of how many entries there are, and which entries these moments have."""
    at, slot, _ = side
    part = slice(*np.searchsorted(at, [low, high]))
    there = np.zeros((high - low, block), kind)
    np.add.at(there, (at[part].astype(np.int64) - low, slot[part]), 1)
    return there, part


def _steps(a: Side, b: Side) -> Iterator[tuple[int, int]]:
    end = int(min(a[0][-1], b[0][-1])) + 1 if len(a[0]) and len(b[0]) else 0
    yield from ((low, min(low + _MOMENTS, end)) for low in range(0, end, _MOMENTS))


def add_sums(totals: Totals, a: Side, b: Side, same: bool) -> None:
    """Joint moments and sums of x, y, x², y², xy over these, those of them that ``totals`` has."""
    block = len(totals["n"])
    for low, high in _steps(a, b):
        (ta, pa_), (tb, pb) = _spread(a, low, high, block), _spread(b, low, high, block)
        np.minimum(ta, 1, out=ta), np.minimum(tb, 1, out=tb)
        totals["n"] += (ta.T @ tb).astype(np.int32)
        if len(totals) == 1:
            continue
        x, y = np.zeros(ta.shape), np.zeros(tb.shape)
        x[a[0][pa_].astype(np.int64) - low, a[1][pa_]] = a[2][pa_, 0]
        y[b[0][pb].astype(np.int64) - low, b[1][pb]] = b[2][pb, 0]
        for c, left, right in (("x", x, tb), ("y", ta, y), ("xy", x, y)):
            if c in totals:
                totals[c] += left.T @ right
        for c, left, right in (("xx", x, tb), ("yy", ta, y)):
            if c in totals:
                totals[c] += (left * left).T @ right if c == "xx" else left.T @ (right * right)


def _ranges(low: np.ndarray, many: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, place) for the ``many`` places from ``low`` on of every row, some million at once."""
    ends = np.cumsum(many)
    row = 0
    while row < len(many):
        stop = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + _LISTED)))
        some = many[row:stop]
        owner = np.repeat(np.arange(row, stop), some)
        yield owner, np.arange(len(owner)) - np.repeat(np.cumsum(some) - some, some) + np.repeat(low[row:stop], some)
        row = stop


def add_matches(totals: Totals, a: Side, b: Side, same: bool) -> None:
    """n: moments both have; n_match: those in which they have an equal code (-1: none)."""
    block = len(totals["n"])
    for low, high in _steps(a, b):
        (ta, pa_), (tb, pb) = _spread(a, low, high, block), _spread(b, low, high, block)
        several = [ta > 1, tb > 1]
        np.minimum(ta, 1, out=ta), np.minimum(tb, 1, out=tb)
        totals["n"] += (ta.T @ tb).astype(np.int32)
        most = int(max(a[2][:, 0].max(initial=0), b[2][:, 0].max(initial=0))) + 1

        def keyed(side: Side, part: slice) -> tuple[np.ndarray, ...]:
            at, slot, code = side[0][part].astype(np.int64) - low, side[1][part].astype(np.int64), side[2][part, 0].astype(np.int64)
            known = code >= 0
            return at[known], slot[known], at[known] * most + code[known]

        (at, sa, ka), (bt, sb, kb) = keyed(a, pa_), keyed(b, pb)
        order = np.argsort(kb, kind="stable")
        bt, sb, kb = bt[order], sb[order], kb[order]
        first = np.searchsorted(kb, ka)
        many_a, many_b = several[0][at, sa], several[1][bt, sb]
        flat = totals["n_match"].reshape(-1)
        # Rows of one moment and slot stand together: equal triples are only possible where both have several codes.
        twice = [np.empty(0, np.int64)]
        for i, j in _ranges(first, np.searchsorted(kb, ka, side="right") - first):
            if same:
                up = sa[i] < sb[j]
                i, j = i[up], j[up]
            pair = sa[i] * block + sb[j]
            both = many_a[i] & many_b[j]
            np.add.at(flat, pair[~both], 1)
            twice.append(np.unique(at[i[both]] * (block * block) + pair[both]))
        np.add.at(flat, np.unique(np.concatenate(twice)) % (block * block), 1)


def add_close(totals: Totals, a: Side, b: Side, same: bool, eps: float) -> None:
    """n: moments both have; n_match: those in which all elements differ by less than ``eps``. Candidates are near in the first element."""
    block = len(totals["n"])
    width = max(a[2].shape[1], b[2].shape[1])
    for low, high in _steps(a, b):
        (ta, pa_), (tb, pb) = _spread(a, low, high, block), _spread(b, low, high, block)
        totals["n"] += (ta.T @ tb).astype(np.int32)
        flat = totals["n_match"].reshape(-1)
        at, bt = a[0][pa_], b[0][pb]
        for m in np.intersect1d(at, bt):
            sa, sb = slice(*(np.searchsorted(at, [m, m + 1]) + pa_.start)), slice(*(np.searchsorted(bt, [m, m + 1]) + pb.start))
            va, vb, ia, ib = a[2][sa], b[2][sb], a[1][sa].astype(np.int64), b[1][sb].astype(np.int64)
            if width < 2:
                continue
            order = np.argsort(vb[:, 1])
            vb, ib = vb[order], ib[order]
            wide = eps + 1e-9 * (eps + np.abs(va[:, 1]))
            first = np.searchsorted(vb[:, 1], va[:, 1] - wide)
            for i, j in _ranges(first, np.maximum(np.searchsorted(vb[:, 1], va[:, 1] + wide, side="right") - first, 0)):
                keep = va[i, 0] == vb[j, 0]
                if same:
                    keep &= ia[i] < ib[j]
                for k in range(1, width):
                    i, j = i[keep], j[keep]
                    keep = (np.abs(va[i, k] - vb[j, k]) < eps) | (k > va[i, 0])
                i, j = i[keep], j[keep]
                np.add.at(flat, ia[i] * block + ib[j], 1)

"""Complete linkage of listed pairs, whatever the size of a connected component.

Pairs are stored once, packed: some hundred thousand in a few bytes each. Two
facts let tasks link parts of them, with the clusters and the ties of one
sequential pass (``solvers.sparse_linkage``):

- Mergers up to some distance need the pairs up to that distance only, and
  connected components of these don't touch each other.
- Of pairs of one distance, those of the smallest members come first.

So each round links what tasks can hold: components of few pairs to their end,
of larger ones the nearest pairs. Then all pairs are relabelled: two clusters
stay listed if all pairs between them were, at the largest distance. Pairs in
clusters and most pairs of clusters go away with every round. What is held by
the driver and by all tasks is a few numbers per member.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.operators import solvers
from heliograph.session import cut

#: Pairs that one task links, that are packed together at first, and that are relabelled together; steps between distances in which pairs are counted.
_HELD, _STORED, _MERGED, _STEPS = 1 << 19, 1 << 18, 1 << 21, 4096
_PACKS = "n bigint, pack binary"

Pairs = tuple[np.ndarray, np.ndarray, np.ndarray]


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def _written(columns: dict[str, pa.Array | np.ndarray]) -> bytes:
    table, sink = pa.table(columns), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _coded(column: pa.ChunkedArray) -> pa.DictionaryArray:
    coded = pa.concat_arrays(column.chunks).dictionary_encode()
    return pa.DictionaryArray.from_arrays(coded.indices.cast(pa.uint16() if len(coded.dictionary) < 1 << 16 else pa.int32()), coded.dictionary)


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs of rows as they come."""

    def told() -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        return pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "pack": pa.array([_written({c: _coded(table.column(c)) for c in table.column_names})], pa.binary())})

    held, n = [], 0
    for batch in batches:
        if len(batch):
            held.append(batch)
            n += len(batch)
        if n >= _STORED:
            yield told()
            held, n = [], 0
    if held:
        yield told()


def _packed(i: np.ndarray, j: np.ndarray, d: np.ndarray, n: int) -> bytes:
    """A pack of pairs of slots, which are ordered."""
    code = pa.array(d).dictionary_encode()
    return _written({"step": _narrow(np.diff(i * n + j, prepend=0)), "d": pa.DictionaryArray.from_arrays(code.indices.cast(pa.uint16() if len(code.dictionary) < 1 << 16 else pa.int32()), code.dictionary)})


def _values(column: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([c.dictionary.to_numpy(zero_copy_only=False)[c.indices.to_numpy()] for c in column.chunks])


def _unpacked(raw: bytes, n: int) -> Pairs:
    table = pa.ipc.open_stream(raw).read_all()
    i, j = np.divmod(np.cumsum(table.column("step").to_numpy().astype(np.int64)), n)
    return i, j, _values(table.column("d"))


def _read(batches: Iterator[pa.RecordBatch], names: pa.Array | None, n: int) -> Iterator[Pairs]:
    """Slots i < j and distances, pack by pack; the first packs have names and similarities."""
    slot = {name: k for k, name in enumerate(names.to_pylist())} if names is not None else {}
    for batch in batches:
        for raw in batch.column("pack"):
            if names is None:
                yield _unpacked(raw.as_py(), n)
                continue
            table = pa.ipc.open_stream(raw.as_py()).read_all()
            sides = []
            for c in ("a", "b"):
                each = [np.fromiter(map(slot.__getitem__, x.dictionary.to_pylist()), np.int64, len(x.dictionary))[x.indices.to_numpy()] for x in table.column(c).chunks]
                sides.append(np.concatenate(each))
            s = np.concatenate([x.dictionary_decode().to_numpy(zero_copy_only=False) for x in table.column("s").chunks]).astype(float)
            i, j = np.minimum(*sides), np.maximum(*sides)
            use = i != j
            yield i[use], j[use], 1 - s[use]


def _connect(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Each slot's smallest connected one, with these links too."""
    while True:
        a, b = label[i], label[j]
        open_ = a != b
        if not open_.any():
            return label
        i, j = i[open_], j[open_]
        np.minimum.at(label, np.maximum(a[open_], b[open_]), np.minimum(a[open_], b[open_]))
        while (label[label] != label).any():
            label = label[label]


_SURVEY = "label binary, many binary, step binary, low binary, high binary"


def _told(parts: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({c: pa.array([x.tobytes()], pa.binary()) for c, x in zip(("label", "many", "step", "low", "high"), parts, strict=True)})


def _surveyed(batches: Iterator[pa.RecordBatch], names: pa.Array | None, n: int, near: float, low: float, high: float, all_linked: bool) -> Iterator[pa.RecordBatch]:
    label, many = np.arange(n), np.zeros(n, np.int64)
    step, least, most = np.zeros(_STEPS, np.int64), np.full(_STEPS, np.inf), np.full(_STEPS, -np.inf)
    for i, j, d in _read(batches, names, n):
        close = d <= near
        label = _connect(label, i, j) if all_linked else _connect(label, i[close], j[close])
        many += np.bincount(i[close], minlength=n)
        value, often = np.unique(d[d <= high], return_counts=True)
        at = np.clip((value - low) / max(high - low, 1e-300) * _STEPS, 0, _STEPS - 1).astype(int)
        np.add.at(step, at, often), np.minimum.at(least, at, value), np.maximum.at(most, at, value)
    yield _told((label, many, step, least, most))


def _added(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    label, many = np.arange(n), np.zeros(n, np.int64)
    step, least, most = np.zeros(_STEPS, np.int64), np.full(_STEPS, np.inf), np.full(_STEPS, -np.inf)
    for batch in batches:
        for row in batch.to_pylist():
            label = _connect(label, np.arange(n), np.frombuffer(row["label"], np.int64))
            many += np.frombuffer(row["many"], np.int64)
            step += np.frombuffer(row["step"], np.int64)
            least, most = np.minimum(least, np.frombuffer(row["low"])), np.maximum(most, np.frombuffer(row["high"]))
    yield _told((label, many, step, least, most))


def _chosen(batches: Iterator[pa.RecordBatch], names: pa.Array | None, n: int, group: np.ndarray, near: np.ndarray, upto: int) -> Iterator[pa.RecordBatch]:
    """Pairs that a group links: those up to the distance of their smaller slot, of slots not ``near`` infinity those up to ``upto``."""
    for i, j, d in _read(batches, names, n):
        use = np.flatnonzero((d <= near[i]) & (group[i] == group[j]) & ((i <= upto) | (group[i] > 0)))
        use = use[np.lexsort((j[use], i[use], group[i[use]]))]
        own = group[i[use]]
        starts = np.flatnonzero(np.diff(own, prepend=-1))
        rows = [(int(own[k[0]]), _packed(i[use[k]], j[use[k]], d[use[k]], n)) for k in np.split(np.arange(len(use)), starts[1:]) if len(k)]
        if rows:
            yield pa.RecordBatch.from_pydict({"g": pa.array([r[0] for r in rows], pa.int64()), "pack": pa.array([r[1] for r in rows], pa.binary())})


def _linked(n: int, upto: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """Slots of a group that are no longer the smallest of their cluster, and that one."""

    def link(key: tuple, table: pa.Table) -> pa.Table:
        i, j, d = (np.concatenate(x) for x in zip(*(_unpacked(raw, n) for raw in table.column("pack").to_pylist()), strict=True))
        members = np.unique(np.concatenate((i, j)))
        i, j = np.searchsorted(members, i), np.searchsorted(members, j)
        if key[0].as_py() == 0 and upto < n:
            label = solvers.tied_linkage(len(members), i, j, int(np.searchsorted(members, upto, side="right")) - 1)
        else:
            label = solvers.sparse_linkage(len(members), i, j, d, np.inf)
        gone = np.flatnonzero(label != np.arange(len(members)))
        return pa.table({"slot": members[gone], "cluster": members[label[gone]]})

    return link


def _relabelled(batches: Iterator[pa.RecordBatch], names: pa.Array | None, n: int, label: np.ndarray, open_: np.ndarray, far: float, parts: int) -> Iterator[pa.RecordBatch]:
    """Packs of pairs of clusters, each pair of clusters in one part; how many pairs they stand for."""

    def told() -> Iterator[pa.RecordBatch]:
        i, j, d = (np.concatenate(x) for x in zip(*held, strict=True))
        part = (i + j) % parts
        order = np.lexsort((i * n + j, part))
        i, j, d, part = i[order], j[order], d[order], part[order]
        bounds = np.searchsorted(part, np.arange(parts + 1))
        rows = [(p, _packed(i[a:b], j[a:b], d[a:b], n)) for p, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if b > a]
        yield pa.RecordBatch.from_pydict({"part": pa.array([r[0] for r in rows], pa.int32()), "pack": pa.array([r[1] for r in rows], pa.binary())})

    held, many = [], 0
    for i, j, d in _read(batches, names, n):
        use = (d <= far) & open_[i] & (label[i] != label[j])
        i, j = label[i[use]], label[j[use]]
        if len(i):
            held.append((np.minimum(i, j), np.maximum(i, j), d[use]))
            many += len(i)
        if many >= _MERGED:
            yield from told()
            held, many = [], 0
    if held:
        yield from told()


def _complete(batches: Iterator[pa.RecordBatch], n: int, size: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Pairs of clusters of a part between which all pairs are listed, at the largest distance."""
    held = [_unpacked(raw.as_py(), n) for batch in batches for raw in batch.column("pack")]
    if held:
        key, d = np.concatenate([i * n + j for i, j, _ in held]), np.concatenate([x[2] for x in held])
        del held
        order = np.argsort(key, kind="stable")
        key, d = key[order], d[order]
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        often, most, key = np.diff(starts, append=len(key)), np.maximum.reduceat(d, starts), key[starts]
        i, j = np.divmod(key, n)
        whole = often == size[i] * size[j]
        i, j, d = i[whole], j[whole], most[whole]
        for k in range(0, len(i), _STORED):
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(i[k : k + _STORED])], pa.int64()), "pack": pa.array([_packed(i[k : k + _STORED], j[k : k + _STORED], d[k : k + _STORED], n)], pa.binary())})


def _names(batches: Iterator[pa.RecordBatch], kind: pa.DataType, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """The members of each pack, with their component if pairs have one."""
    for batch in batches:
        for raw in batch.column("pack"):
            table = pa.ipc.open_stream(raw.as_py()).read_all()
            sides = [pa.table([table.column(c).cast(kind), *(table.column(x).cast(table.column(x).type.value_type) for x in columns)], ["member", *columns]) for c in ("a", "b")]
            yield from pa.concat_tables(sides).group_by(["member", *columns]).aggregate([]).select(["member", *columns]).to_batches()


def clusters(pairs: DataFrame, a: str, b: str, similarity: str, component: str, far: float) -> DataFrame:
    """(component, member, cluster): see ``fits.linked_clusters``. ``pairs`` lists a pair once and is read once."""
    spark, given = pairs.sparkSession, component in pairs.columns
    kind = pairs.schema[a].dataType.simpleString()
    of = pairs.schema[component].dataType.simpleString() if given else kind
    stored = cut(pairs.select(F.col(a).alias("a"), F.col(b).cast(kind).alias("b"), F.col(similarity).cast("double").alias("s"), *([F.col(component).alias("_g")] if given else [])).mapInArrow(_stored, _PACKS))
    # Many small files, as pairs of blocks leave them, are read by as many tasks as there are cores.
    tasks = max(1, spark.sparkContext.defaultParallelism * 4)
    known = stored.coalesce(tasks).mapInArrow(partial(_names, kind=_arrow(pairs, a), columns=["_g"] if given else []), f"member {kind}" + f", _g {of}" * given).distinct()
    names_table = known.orderBy("member").toArrow()
    if given:
        names_table = names_table.group_by("member", use_threads=False).aggregate([("_g", "min")])
    names = pa.concat_arrays(names_table.column("member").chunks) if names_table.num_rows else pa.array([], _arrow(pairs, a))
    n = len(names)
    found, connected = np.arange(n), np.arange(n)
    edges, listed = stored.coalesce(tasks), names
    first = True
    while n:
        survey = lambda near, low, high, all_linked=False: _survey(edges, listed, n, near, low, high, all_linked)  # noqa: B023, E731
        label, many, step, least, most = survey(far, 0.0, far, first)
        connected = label if first else connected
        first = False
        if not many.sum():
            break
        inside = np.bincount(label, many, n).astype(np.int64)
        large = inside[label] > _HELD
        near, group, upto, weight = np.full(n, far), label + 1, n, inside
        if large.any():
            near[large], part, upto = _nearest(survey, many, large, step, least, most, n)
            group = np.where(large, 0 if part is None else part[0] + 1, group)
            if part is not None:
                weight = np.where(large, part[1], inside)
        # Components of few pairs share a task.
        roots = np.flatnonzero(np.bincount(group, minlength=n + 1)[1:])
        bins = np.zeros(n + 1, np.int64)
        bins[roots + 1] = np.cumsum(weight[roots]) // _HELD + 1
        chosen = edges.mapInArrow(partial(_chosen, names=listed, n=n, group=bins[group], near=near, upto=upto), "g bigint, pack binary")
        got = chosen.groupBy("g").applyInArrow(_linked(n, upto), "slot bigint, cluster bigint").toArrow()
        now = np.arange(n)
        now[got.column("slot").to_numpy()] = got.column("cluster").to_numpy()
        found = now[found]
        if not large.any():
            break
        parts = int(max(tasks // 2, -(-int(many[large].sum()) // _MERGED)))
        moved = edges.mapInArrow(partial(_relabelled, names=listed, n=n, label=now, open_=large, far=far, parts=parts), "part int, pack binary")
        size = np.bincount(now, minlength=n)
        edges, listed = cut(moved.repartitionById(parts, F.col("part")).mapInArrow(partial(_complete, n=n, size=size), _PACKS)).coalesce(tasks), None
    group_of = pa.concat_arrays(names_table.column("_g_min").chunks) if given and n else names.take(pa.array(connected))
    out = pa.table({component: group_of, "member": names, "cluster": names.take(pa.array(found))})
    return spark.createDataFrame(out, f"`{component}` {of}, member {kind}, cluster {kind}")


def _arrow(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def _survey(edges: DataFrame, names: pa.Array | None, n: int, near: float, low: float, high: float, all_linked: bool) -> tuple[np.ndarray, ...]:
    """Of the pairs up to ``near``: components and how many have each smaller slot; number, least and most of the distances in steps from ``low`` to ``high``."""
    own = edges.mapInArrow(partial(_surveyed, names=names, n=n, near=near, low=low, high=high, all_linked=all_linked), _SURVEY)
    r = own.repartition(1).mapInArrow(partial(_added, n=n), _SURVEY).first()
    return tuple(np.frombuffer(raw, kind) for raw, kind in zip(r, (np.int64, np.int64, np.int64, np.float64, np.float64), strict=True))


def _nearest(survey: Callable[..., tuple[np.ndarray, ...]], many: np.ndarray, large: np.ndarray, step: np.ndarray, least: np.ndarray, most: np.ndarray, n: int) -> tuple[float, tuple[np.ndarray, np.ndarray] | None, int]:
    """What is linked of the components of many pairs: up to which distance, its components and their numbers of pairs if these are linked on their own, and up to which smaller slot."""
    while True:
        used = np.flatnonzero(step)
        over = used[np.searchsorted(np.cumsum(step[used]), _HELD, side="right").clip(max=len(used) - 1)]
        label, close, *_ = survey(most[over], 0.0, most[over])
        inside = np.bincount(label, close, n).astype(np.int64)
        if inside[label][large].max() <= _HELD:
            return float(most[over]), (label, inside), n
        below = used[used < over]
        if len(below):
            return float(most[below].max()), None, n
        if least[over] == most[over]:
            # Equal distances: those of the smallest slots.
            upto = int(np.searchsorted(np.cumsum(np.where(large, close, 0)), _HELD, side="right")) - 1
            return float(most[over]), None, max(upto, int(np.flatnonzero(large & (close > 0))[0]))
        _, _, step, least, most = survey(most[over], float(least[over]), float(most[over]))

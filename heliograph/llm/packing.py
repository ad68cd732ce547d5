"""Filling containers of fixed capacity with texts: lexical retrieval packing.

The corpus is encoded once. A sharded BM25 inverted index over token ids holds
every text (term statistics of *all* texts). A text's shard is a lexical one:
the nearest centroid of its weighted bag, projected to ``WIDTH`` axes. Then:

1. The largest texts are seeds, one per container that the tokens make. Each
   asks the ``PROBES`` nearest shards for its neighbours; a text that several
   seeds retrieve goes to the one it is nearest to, and a seed takes them in
   the order of their scores while its window has room for more than the last.
2. Inside each shard the windows are filled on with the shard's own unused
   neighbours, greedily; near the end of a window the choice narrows to one or
   two texts whose sizes fill the rest exactly, the best scored first. Texts
   that no window takes seed further windows.
3. Windows that stay open are dissolved and packed once more by their sizes
   alone, so that unused space doesn't grow with the number of shards.

A text is never split unless it alone exceeds the capacity; then it fills whole
containers and only its last piece is packed with others.

Scale: texts travel as sorted bags of two bytes a token; a seed asks with its
distinct terms. A shard holds about ``SHARD`` texts: centroids are fitted to a
sample of ``SAMPLE`` signatures and split until none holds more, copies by
hash; the third step takes ``BY_SIZE`` texts a task in linear time. Centroids
(at most ``CENTROIDS``) and term weights (one per vocabulary entry) are what is
broadcast.

Defined cases: null and empty texts take no space and get no container; ties
are decided by the order of (size, id); repeated rows are packed as often as
they occur; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heliograph.llm.bpe import VOCABULARY, encode
from heliograph.session import cut

#: Tokens per container; texts per shard aimed at; texts per task of the last step.
CAPACITY, SHARD, BY_SIZE = 2048, 4000, 1 << 16
#: Shards a seed asks; neighbours it asks of each.
PROBES, NEAR = 5, 24
#: Seeds that one task answers from a shard; a shard that more seeds ask is given to several tasks.
ASKS = 16_384
#: Axes of a signature; signatures that centroids are fitted to (a bounded sample; every text is placed and indexed); most centroids.
WIDTH, SAMPLE, CENTROIDS = 64, 16_384, 4096
#: Seeds per container that the tokens make.
SEEDS = 0.97
#: A window with at most this many unused tokens stays closed.
CLOSED = 8
#: The usual BM25 constants.
K1, B = 1.2, 0.75
PACKED_SCHEMA = "container string, doc_id bigint, part int, n_tokens int"
BAG_SCHEMA = "doc_id bigint, n int, bag binary, term int, texts bigint"
PLACED_SCHEMA = "row bigint, doc_id bigint, part int, n_tokens int, bag binary, shard int, asks array<int>, terms binary, n_terms int"
NEAR_SCHEMA = "row bigint, doc_id bigint, part int, n_tokens int, shard int, seed bigint, seed_shard int, room int, score double"


def _weights(counts: np.ndarray, idf: np.ndarray, length: np.ndarray | float, mean_length: float) -> np.ndarray:
    return idf * counts * (K1 + 1) / (counts + K1 * (1 - B + B * length / max(mean_length, 1.0)))


class Index:
    """BM25 inverted index of one shard: postings by term, weights ready to be summed; terms of many texts as dense rows."""

    def __init__(self, bags: list[np.ndarray], idf: np.ndarray, mean_length: float) -> None:
        terms, counts = zip(*(np.unique(b, return_counts=True) for b in bags), strict=True) if bags else ((), ())
        self.terms = terms
        self.size = len(bags)
        term = np.concatenate(terms) if bags else np.zeros(0, dtype=np.int64)
        tf = np.concatenate(counts).astype(np.float64) if bags else np.zeros(0)
        doc = np.repeat(np.arange(len(bags)), [len(t) for t in terms])
        length = np.array([len(b) for b in bags], dtype=np.float64)
        weight = _weights(tf, idf[term], length[doc], mean_length).astype(np.float32)
        texts = np.bincount(term, minlength=len(idf))
        common = np.flatnonzero(texts > max(self.size // 16, 8))
        self.slot = np.full(len(idf), -1)
        self.slot[common] = np.arange(len(common))
        dense = self.slot[term] >= 0
        self.dense = np.zeros((len(common), self.size), dtype=np.float32)
        self.dense[self.slot[term[dense]], doc[dense]] = weight[dense]
        term, doc, weight = term[~dense], doc[~dense], weight[~dense]
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        self.start = np.searchsorted(term[order], np.arange(len(idf) + 1))

    def scores(self, queries: list[np.ndarray]) -> np.ndarray:
        """BM25 score of every text of the shard (columns) for the distinct terms of each query (rows)."""
        asked = np.zeros((len(queries), len(self.dense)), dtype=np.float32)
        for i, terms in enumerate(queries):
            slots = self.slot[terms]
            asked[i, slots[slots >= 0]] = 1.0
        out = asked @ self.dense
        for i, terms in enumerate(queries):
            begin, sizes = self.start[terms], self.start[terms + 1] - self.start[terms]
            total = int(sizes.sum())
            if total:
                at = np.arange(total) + np.repeat(begin - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
                out[i] += np.bincount(self.doc[at], weights=self.weight[at], minlength=self.size)
        return out


def _finish(room: int, candidates: np.ndarray, sizes: np.ndarray) -> list[int]:
    """One or two of the candidates (best first) that leave the least of ``room``; the best scored of equals."""
    fit = candidates[sizes[candidates] <= room]
    if not len(fit):
        return []
    best = np.full(room + 1, -1, dtype=np.int64)
    second = np.full(room + 1, -1, dtype=np.int64)
    kinds, first = np.unique(sizes[fit], return_index=True)
    best[kinds] = first
    rest = np.delete(np.arange(len(fit)), first)
    twice, again = np.unique(sizes[fit[rest]], return_index=True)
    second[twice] = rest[again]
    have = best >= 0
    for total in range(room, 0, -1):
        if have[total]:
            return [int(fit[best[total]])]
        low = np.arange(1, total // 2 + 1)
        ok = have[low] & have[total - low]
        if total % 2 == 0 and second[total // 2] < 0:
            ok[-1] = False
        pairs = low[ok]
        if len(pairs):
            a = best[pairs]
            b = np.where(pairs * 2 == total, second[pairs], best[total - pairs])
            pick = int(np.argmin(np.maximum(a, b)))
            return [int(fit[a[pick]]), int(fit[b[pick]])]
    return []


def pack(sizes: np.ndarray, index: Index, capacity: int, begun: np.ndarray | None = None) -> list[list[int]]:
    """Windows of item positions; every item is in exactly one. ``begun`` (0: none) is what windows that an item seeds hold besides it."""
    unused = np.ones(len(sizes), dtype=bool)
    begun = np.zeros(len(sizes), dtype=np.int64) if begun is None else begun
    tail = 2 * int(np.median(sizes)) if len(sizes) else 0
    windows: list[list[int]] = []
    # Begun windows first; their seeds are in no other window.
    order = np.lexsort((np.arange(len(sizes)), -sizes, begun == 0))
    unused[begun > 0] = False
    for seed in order:
        if not unused[seed] and not begun[seed]:
            continue
        window, room = [int(seed)], capacity - int(sizes[seed]) - int(begun[seed])
        unused[seed] = False
        free = np.flatnonzero(unused & (sizes <= room)) if room else ()
        if len(free):
            score = index.scores([index.terms[seed]])[0]
            near = free[np.lexsort((free, -score[free]))]
            while room and len(near):
                near = near[sizes[near] <= room]
                if room > tail and len(near):
                    take = [int(near[0])]
                else:
                    take = _finish(room, near, sizes)
                if not take:
                    break
                for t in take:
                    window.append(t)
                    unused[t] = False
                    room -= int(sizes[t])
                near = near[unused[near]]
        windows.append(window)
    return windows


def pack_sizes(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Window of every item by size alone: the largest first, then whatever fills the rest best; linear in the number of items."""
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i in np.argsort(-sizes, kind="stable").tolist():
        stacks[sizes[i]].append(i)
    count = np.bincount(sizes, minlength=capacity + 1)
    out, window, left, tail = np.empty(len(sizes), dtype=np.int64), -1, len(sizes), 2 * int(np.median(sizes)) if len(sizes) else 0

    def put(size: int) -> None:
        nonlocal left
        out[stacks[size].pop()] = window
        count[size] -= 1
        left -= 1

    largest = capacity
    while left:
        while not count[largest]:
            largest -= 1
        window += 1
        room = capacity - largest
        put(largest)
        while room and left:
            have = np.flatnonzero(count[: room + 1])
            if not len(have):
                break
            best, pair = int(have[-1]), (int(have[-1]),)
            if best < room and room <= max(tail, best):
                # Two sizes that leave less: for each the largest other that still fits.
                other = have[np.searchsorted(have, room - have, side="right") - 1]
                fits = (other + have <= room) & (have <= room - have[0]) & ((other != have) | (count[have] > 1))
                if fits.any():
                    at = int(np.argmax(np.where(fits, have + other, -1)))
                    if have[at] + other[at] > best:
                        pair = (int(have[at]), int(other[at]))
            for size in pair:
                put(size)
                room -= size
    return out


@lru_cache(maxsize=2)
def _axes(terms: int) -> np.ndarray:
    """Fixed pseudo-random signs that project a bag to ``WIDTH`` axes."""
    return np.random.default_rng(7).choice(np.array([-1, 1], dtype=np.float32), size=(terms, WIDTH))


def _raw(tokens: np.ndarray) -> bytes:
    """Tokens in two bytes each where all fit, else in four."""
    return tokens.astype("<u2" if not len(tokens) or tokens.max() < 1 << 16 else "<u4").tobytes()


def _tokens(raw: bytes, count: int) -> np.ndarray:
    return np.frombuffer(raw, dtype="<u2" if len(raw) == 2 * count else "<u4").astype(np.int64)


def signatures(bags: list[np.ndarray], idf: np.ndarray, mean_length: float) -> np.ndarray:
    """Unit vectors of the projected BM25 weights of bags."""
    axes, out = _axes(len(idf)), np.zeros((len(bags), WIDTH), dtype=np.float32)
    for i, bag in enumerate(bags):
        term, count = np.unique(bag, return_counts=True)
        out[i] = _weights(count, idf[term], len(bag), mean_length).astype(np.float32) @ axes[term]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def centroids(sample: np.ndarray, texts: int, shard: int) -> tuple[np.ndarray, np.ndarray]:
    """(unit centroids, shards per centroid) of a sample of signatures: spherical k-means, clusters of too many texts split until they are small or hold copies only."""
    each = texts / max(len(sample), 1)
    queue, done = [np.arange(len(sample))], []
    k = max(2, min(CENTROIDS, -(-texts // shard)))
    while queue:
        rows = queue.pop()
        spread = len(rows) and float(np.abs(sample[rows] - sample[rows[0]]).max()) > 1e-6
        if len(rows) * each <= 1.5 * shard or not spread or len(done) + len(queue) >= CENTROIDS:
            done.append(rows)
            continue
        labels, k = _means(sample[rows], min(k, len(rows))), 2
        kinds = np.unique(labels)
        if len(kinds) < 2:
            done.append(rows)
        else:
            queue += [rows[labels == c] for c in kinds]
    centre = np.stack([sample[rows].sum(axis=0) if len(rows) else np.zeros(WIDTH, dtype=np.float32) for rows in done])
    parts = np.array([max(1, int(np.ceil(len(rows) * each / (1.5 * shard)))) for rows in done])
    return centre / np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-9), parts


def _means(x: np.ndarray, k: int, steps: int = 10) -> np.ndarray:
    """Labels of spherical k-means; starts at evenly drawn points, equal results for equal input."""
    centre = x[np.random.default_rng(len(x)).choice(len(x), k, replace=False)]
    for _ in range(steps):
        label = (x @ centre.T).argmax(axis=1)
        order = np.argsort(label, kind="stable")
        used, starts = np.unique(label[order], return_index=True)
        centre = centre.copy()
        centre[used] = np.add.reduceat(x[order], starts)
        centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-9)
    return (x @ centre.T).argmax(axis=1)


def _bagged(batches: Iterator[pa.RecordBatch], capacity: int) -> Iterator[pa.RecordBatch]:
    """Texts as (doc_id, n, sorted tokens of what is left after whole containers); and per batch how many texts have each term."""
    for batch in batches:
        lists = batch.column(1)
        ids, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
        n = np.diff(offsets)
        bags, seen = [], [np.zeros(0, dtype=np.int32)]
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            rest = np.sort(ids[b - (b - a) % capacity : b])
            bags.append(_raw(rest) if len(rest) else None)
            every = rest if b - a == len(rest) else np.sort(ids[a:b])
            seen.append(every[np.append(True, every[1:] != every[:-1])] if len(every) else every)
        texts = np.bincount(np.concatenate(seen))
        term = np.flatnonzero(texts)
        texts = texts[term]
        names, k = ["doc_id", "n", "bag", "term", "texts"], len(term)
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n.astype(np.int32)), pa.array(bags, pa.binary()), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.int64())], names=names)
        yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()), pa.array(term.astype(np.int32)), pa.array(texts.astype(np.int64))], names=names)


@dataclass(frozen=True)
class Corpus:
    """A corpus as placed bags: (row, doc_id, part, n_tokens, bag, shard), of seeds with the shards they ask and their distinct terms."""

    texts: DataFrame
    placed: DataFrame
    idf: Broadcast
    mean_length: float
    tail: int


def corpus(encoded: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> Corpus:
    """Places the texts given as (doc_id, ids)."""
    context = encoded.sparkSession.sparkContext
    both = cut(encoded.select("doc_id", "ids").mapInArrow(partial(_bagged, capacity=capacity), BAG_SCHEMA))
    # Row numbers of the cut table are stable.
    texts = both.withColumn("row", F.monotonically_increasing_id()).where("term IS NULL").select("row", "doc_id", "n", "bag", F.floor(F.col("n") / capacity).cast("int").alias("whole"))
    rest = texts.where("bag IS NOT NULL")
    counted = both.where("term IS NOT NULL").groupBy("term").agg(F.sum("texts").alias("n")).toPandas()
    found = np.zeros(int(counted["term"].max()) + 1 if len(counted) else 1)
    found[counted["term"].to_numpy(dtype=np.int64)] = counted["n"].to_numpy()
    kinds = rest.groupBy((F.col("n") - F.col("whole") * capacity).alias("size")).agg(F.count("*").alias("k")).toPandas().sort_values("size", ascending=False)
    size, k = kinds["size"].to_numpy(dtype=np.int64), kinds["k"].to_numpy(dtype=np.int64)
    n, tokens, upto = int(k.sum()), int((size * k).sum()), np.cumsum(k)
    mean_length = tokens / max(n, 1)
    idf = context.broadcast(np.log1p((max(n, found.max()) - found + 0.5) / (found + 0.5)))
    # The largest texts are seeds; of those of the border size a share by hash.
    wanted = int(SEEDS * -(-tokens // capacity))
    at = int(np.searchsorted(upto, wanted)) if wanted else 0
    border, share = (int(size[at]), (wanted - (int(upto[at - 1]) if at else 0)) / int(k[at])) if n else (0, 0.0)
    least, tail = int(size[-1]) if n else 0, 2 * int(size[np.searchsorted(upto, n / 2)]) if n else 0

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [_tokens(raw, z) for raw, z in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            flat = signatures(bags, idf.value, mean_length).ravel()
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, WIDTH, dtype=np.int32)), pa.array(flat))], names=["s"])

    drawn = rest.where(F.pmod(F.xxhash64("row"), F.lit(1 << 20)) < int(min(1.0, SAMPLE / max(n, 1)) * (1 << 20)))
    points = np.array([r.s for r in drawn.select("bag", (F.col("n") - F.col("whole") * capacity).alias("size")).mapInArrow(sample, "s array<float>").collect()], dtype=np.float32).reshape(-1, WIDTH)
    centre, parts = centroids(points[np.lexsort(points.T)], n, shard)
    placing = context.broadcast((centre, parts, np.cumsum(parts) - parts))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, parts, base = placing.value
        for batch in batches:
            if not batch.num_rows:
                continue
            z, spread = batch.column("n_tokens").to_numpy(), batch.column("spread").to_numpy()
            bags = [_tokens(raw, s) for raw, s in zip(batch.column("bag").to_pylist(), z.tolist(), strict=True)]
            near = np.argsort(-(signatures(bags, idf.value, mean_length) @ centre.T), axis=1, kind="stable")[:, :PROBES]
            shards = (base[near] + spread[:, None] % parts[near]).astype(np.int32)
            asking = ((z > border) | ((z == border) & (spread % (1 << 20) < share * (1 << 20)))) & (capacity - z >= least)
            distinct = [np.unique(b) if a else None for b, a in zip(bags, asking.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("row", "doc_id", "part", "n_tokens", "bag")),
                    pa.array(shards[:, 0]),
                    pa.array([s if a else [] for s, a in zip(shards.tolist(), asking.tolist(), strict=True)], pa.list_(pa.int32())),
                    pa.array([None if t is None else _raw(t) for t in distinct], pa.binary()),
                    pa.array([0 if t is None else len(t) for t in distinct], pa.int32()),
                ],
                names=["row", "doc_id", "part", "n_tokens", "bag", "shard", "asks", "terms", "n_terms"],
            )

    asked = rest.select("row", "doc_id", F.col("whole").alias("part"), (F.col("n") - F.col("whole") * capacity).cast("int").alias("n_tokens"), "bag", F.pmod(F.xxhash64("row"), F.lit(1 << 40)).alias("spread"))
    return Corpus(texts, cut(asked.mapInArrow(place, PLACED_SCHEMA)), idf, mean_length, tail)


def _index(table: pa.Table, idf: np.ndarray, mean_length: float) -> tuple[Index, np.ndarray]:
    sizes = table.column("n_tokens").to_numpy().astype(np.int64)
    return Index([_tokens(raw, z) for raw, z in zip(table.column("bag").to_pylist(), sizes.tolist(), strict=True)], idf, mean_length), sizes


def retrieved(placed: Corpus, capacity: int = CAPACITY, near: int = NEAR) -> DataFrame:
    """The ``near`` best texts, by BM25, of each shard that a seed asks, for every seed: rows of ``NEAR_SCHEMA``; texts that are no seeds and fit beside the seed."""
    offered = placed.placed.where("cardinality(asks) = 0").select("row", "doc_id", "part", "n_tokens", "bag", "shard")
    asked = placed.placed.where("cardinality(asks) > 0").select(F.explode("asks").alias("asked"), F.col("row").alias("seed"), F.col("shard").alias("seed_shard"), (capacity - F.col("n_tokens")).alias("room"), "terms", "n_terms")
    # Few shards are asked by very many seeds (at most as many as there are shards are listed).
    busy = {r.asked: -(-r.n // ASKS) for r in asked.groupBy("asked").agg(F.count("*").alias("n")).where(F.col("n") > ASKS).collect()}
    tasks = F.coalesce(F.create_map(*(F.lit(v) for pair in busy.items() for v in pair))[F.col("s")], F.lit(1)) if busy else F.lit(1)
    asked = asked.withColumn("s", F.col("asked")).withColumn("task", F.pmod(F.xxhash64("seed"), tasks).cast("int")).drop("s")
    offered = offered.withColumn("s", F.col("shard")).withColumn("task", F.explode(F.sequence(F.lit(0), (tasks - 1).cast("int")))).drop("s")
    idf, mean_length = placed.idf, placed.mean_length

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.sort_by("row").combine_chunks(), right.combine_chunks()
        index, sizes = _index(left, idf.value, mean_length)
        seeds, found, scores = [], [], []
        queries = [_tokens(raw, z) for raw, z in zip(right.column("terms").to_pylist(), right.column("n_terms").to_pylist(), strict=True)]
        rooms = right.column("room").to_numpy()
        for at in range(0, len(queries) if len(sizes) else 0, 256):
            block = queries[at : at + 256]
            score = index.scores(block)
            score[sizes[None, :] > rooms[at : at + 256, None]] = 0.0
            best = np.argpartition(-score, near - 1, axis=1)[:, :near] if len(sizes) > near else np.tile(np.arange(len(sizes)), (len(block), 1))
            value = np.take_along_axis(score, best, axis=1)
            i, j = np.nonzero(value > 0)
            seeds.append(at + i)
            found.append(best[i, j])
            # Long seeds score higher with everybody; what counts for a text is which seed it is nearest to.
            scores.append(value[i, j] / np.sqrt([max(len(q), 1) for q in block])[i])
        who, what = (np.concatenate(v) if v else np.zeros(0, dtype=np.int64) for v in (seeds, found))
        parts = [left.select(["row", "doc_id", "part", "n_tokens", "shard"]).take(pa.array(what)), right.select(["seed", "seed_shard", "room"]).take(pa.array(who))]
        return pa.Table.from_arrays([*parts[0].columns, *parts[1].columns, pa.array(np.concatenate(scores).astype(np.float64).round(4) if scores else np.zeros(0))], names=["row", "doc_id", "part", "n_tokens", "shard", "seed", "seed_shard", "room", "score"])

    return offered.groupBy("shard", "task").cogroup(asked.groupBy("asked", "task")).applyInArrow(answer, NEAR_SCHEMA)


def lexical_packing(encoded: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """(container, doc_id, part, n_tokens) of texts given as (doc_id, ids).

    ``container`` is null and ``n_tokens`` 0 for texts without tokens.
    """
    placed = corpus(encoded, capacity, shard)
    idf, mean_length = placed.idf, placed.mean_length
    # Every text goes to the seed it is nearest to; a seed asks few shards for few texts, so these groups are small.
    best = retrieved(placed, capacity).groupBy("row").agg(F.max(F.struct("score", (-F.col("seed")).alias("minus"), "seed_shard", "room", "doc_id", "part", "n_tokens", "shard")).alias("m"))
    offers = best.select("row", "m.*")
    nearest = Window.partitionBy("minus").orderBy(F.desc("score"), "row")
    taken = cut(offers.withColumn("used", F.sum("n_tokens").over(nearest)).where(F.col("used") <= F.col("room") - placed.tail).select("row", "doc_id", "part", "n_tokens", "shard", (-F.col("minus")).alias("seed"), "seed_shard"))
    # A shard hears which of its texts are gone, and what its seeds have taken.
    gone = taken.select("shard", "row", F.lit(None).cast("bigint").alias("seed"), "doc_id", "part", "n_tokens")
    notes = gone.unionByName(taken.select(F.col("seed_shard").alias("shard"), "row", "seed", "doc_id", "part", "n_tokens"))

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.sort_by([("doc_id", "ascending"), ("part", "ascending"), ("row", "ascending")]), right.sort_by("row")
        here = pc.is_valid(right.column("seed"))
        left = left.filter(pc.invert(pc.is_in(left.column("row"), value_set=right.filter(pc.invert(here)).column("row").combine_chunks()))).combine_chunks()
        kept = right.filter(here).combine_chunks()
        index, sizes = _index(left, idf.value, mean_length)
        rows = left.column("row").to_numpy()
        order = np.argsort(rows)
        owner = order[np.searchsorted(rows[order], kept.column("seed").to_numpy())] if len(kept) else np.zeros(0, dtype=np.int64)
        more = kept.column("n_tokens").to_numpy().astype(np.int64) if len(kept) else np.zeros(0, dtype=np.int64)
        begun = np.bincount(owner, weights=more, minlength=len(sizes)).astype(np.int64)
        label = np.empty(len(sizes), dtype=np.int64)
        windows = pack(sizes, index, capacity, begun)
        used = np.empty(len(windows), dtype=np.int64)
        for w, items in enumerate(windows):
            label[items] = w
            used[w] = sizes[items].sum() + begun[items].sum()
        whole = np.concatenate((label, label[owner]))
        number = left.column("shard")[0].as_py() if len(left) else 0
        names = pa.array([f"a{number}-{w}" if capacity - used[w] <= CLOSED else None for w in range(len(windows))], pa.string()).take(pa.array(whole))
        both = [pa.chunked_array([*left.column(c).chunks, *kept.column(c).chunks], left.schema.field(c).type) for c in ("doc_id", "part", "n_tokens")]
        return pa.Table.from_arrays([names, *both], names=["container", "doc_id", "part", "n_tokens"])

    asked = placed.placed.select("row", "doc_id", "part", "n_tokens", "bag", "shard")
    once = cut(asked.groupBy("shard").cogroup(notes.groupBy("shard")).applyInArrow(work, PACKED_SCHEMA))
    left = once.where("container IS NULL")
    groups = max(1, -(-left.count() // BY_SIZE))

    def by_size(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("part", "ascending")])
        window = pack_sizes(table.column("n_tokens").to_numpy().astype(np.int64), capacity)
        return pa.Table.from_arrays([pa.array([f"b{key[0].as_py()}-{w}" for w in window.tolist()], pa.string()), *(table.column(c) for c in ("doc_id", "part", "n_tokens"))], names=["container", "doc_id", "part", "n_tokens"])

    twice = left.withColumn("group", F.pmod(F.xxhash64("doc_id", "part", "n_tokens"), F.lit(groups)).cast("int")).groupBy("group").applyInArrow(by_size, PACKED_SCHEMA)
    alone = placed.texts.where("whole > 0").select("doc_id", "row", F.explode(F.sequence(F.lit(0), F.col("whole") - 1)).alias("part"))
    alone = alone.select(F.concat_ws("-", F.lit("w"), "row", "part").alias("container"), "doc_id", "part", F.lit(capacity).alias("n_tokens"))
    blank = placed.texts.where("n = 0").select(F.lit(None).cast("string").alias("container"), "doc_id", F.lit(0).alias("part"), F.lit(0).alias("n_tokens"))
    return alone.unionByName(once.where("container IS NOT NULL")).unionByName(twice).unionByName(blank)


def containers(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, **options: int) -> DataFrame:
    """Containers of all texts of (doc_id, text), measured in tokens of ``vocabulary``."""
    return lexical_packing(encode(documents, vocabulary=vocabulary, keep=["doc_id"]), capacity, **options)


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, the least possible number of containers, and the share of unused space."""
    used = packed.where("container IS NOT NULL").groupBy("container").agg(F.sum("n_tokens").alias("used"))
    total = used.agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"))
    return total.select("containers", "tokens", "fullest", F.ceil(F.col("tokens") / capacity).alias("least_containers"), (1 - F.col("tokens") / (F.col("containers") * capacity)).alias("unused_share"))

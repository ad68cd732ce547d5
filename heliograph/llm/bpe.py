"""Byte-level BPE of a whole corpus by speculation and verification.

Speculation: each distinct word of a batch is cut greedily into the longest
vocabulary entries. Verification: such a cut is exactly what merging would give
if and only if every entry alone encodes to itself and every adjacent pair is
compatible, that is, undoing both sides' merges in reverse order never meets a
merge across the border that would have come earlier. Distinct pairs of a batch
are tested together on NumPy arrays and remembered. Only words with an
incompatible pair are merged exactly, with a heap, in O(n log n) however long.

Defined cases: null and empty texts give an empty list; strings that look like
special tokens are ordinary text; texts and words of any length are encoded as
a whole; the order of rows doesn't matter; extra columns pass through, and a
column that clashes with the result's name is replaced by it.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Default place of the public vocabulary; a parameter of every operator here.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: the public pattern that cuts text into words before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words remembered per worker; the memory is emptied when full. Longer words are not remembered.
REMEMBERED, LONG = 400_000, 64


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of every byte: printable Latin-1 stands for itself, the rest follow from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Encoder of one vocabulary; ``vocabulary`` is the text of its JSON file."""

    def __init__(self, vocabulary: str) -> None:
        model = json.loads(vocabulary)["model"]
        letters = _byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        self.ids = {as_bytes(t): i for t, i in model["vocab"].items() if all(c in letters for c in t)}
        size = max(self.ids.values()) + 1
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left = np.array([self.ids[as_bytes(a)] for a, _ in pairs], dtype=np.int64)
        right = np.array([self.ids[as_bytes(b)] for _, b in pairs], dtype=np.int64)
        made = np.array([self.ids[as_bytes(a + b)] for a, b in pairs], dtype=np.int64)
        #: Rank of the merge that makes a token (-1: a byte), and its two parts.
        self.rank = np.full(size, -1, dtype=np.int64)
        self.part = np.zeros((size, 2), dtype=np.int64)
        self.rank[made], self.part[made, 0], self.part[made, 1] = np.arange(len(pairs)), left, right
        keys = left << 32 | right
        order = np.argsort(keys)
        self._keys, self._ranks = keys[order], np.arange(len(pairs))[order]
        self._merge = {(int(a), int(b)): (k, int(m)) for k, (a, b, m) in enumerate(zip(left, right, made, strict=True))}
        self._byte = [self.ids[bytes([b])] for b in range(256)]
        #: A token stands for itself when its parts do and merging them is what would happen at its rank.
        whole = self.rank < 0
        sound = np.zeros(size, dtype=bool)
        sound[made] = self._compatible(left, right, np.arange(len(pairs)))
        for k in range(len(pairs)):
            m = made[k]
            whole[m] = sound[m] and whole[left[k]] and whole[right[k]]
        self.valid = {t: i for t, i in self.ids.items() if whole[i]}
        self._longest: dict[bytes, int] = {}
        for t in self.valid:
            self._longest[t[:2]] = max(self._longest.get(t[:2], 1), len(t))
        self._checked: dict[int, bool] = {}
        self._known: dict[str, tuple[int, ...]] = {}
        self._words = regex.compile(PATTERN)

    def _rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair; a rank beyond all where there is none."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._ranks[at], np.iinfo(np.int64).max)

    def _compatible(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """For each pair of tokens whether the border between them survives all merges with a rank below ``before``."""
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), np.iinfo(np.int64).max - 1) if before is None else before.astype(np.int64)
        good, open_ = np.ones(len(a), dtype=bool), np.arange(len(a))
        while len(open_):
            x, y = a[open_], b[open_]
            broken = self._rank_of(x, y) < limit[open_]
            good[open_[broken]] = False
            age_x, age_y = self.rank[x], self.rank[y]
            going = ~broken & ((age_x >= 0) | (age_y >= 0))
            open_, age_x, age_y = open_[going], age_x[going], age_y[going]
            # The younger side falls apart first; of equal merges the left one was made first, so it stays longer.
            of_left = age_x > age_y
            l, r = open_[of_left], open_[~of_left]
            limit[l], a[l] = age_x[of_left], self.part[a[l], 1]
            limit[r], b[r] = age_y[~of_left] + 1, self.part[b[r], 0]
        return good

    def _greedy(self, raw: bytes) -> list[int]:
        """Longest vocabulary entries from left to right."""
        out, at, end = [], 0, len(raw)
        while at < end:
            size = min(self._longest.get(raw[at : at + 2], 1), end - at)
            while size > 1 and raw[at : at + size] not in self.valid:
                size -= 1
            out.append(self.valid[raw[at : at + size]])
            at += size
        return out

    def _exact(self, raw: bytes) -> list[int]:
        """Merging by rank, leftmost first, on a linked list with a heap of possible merges."""
        token = [self._byte[b] for b in raw]
        n = len(token)
        after, ahead, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = []
        for i in range(n - 1):
            if merge := self._merge.get((token[i], token[i + 1])):
                heap.append((merge[0], i, token[i], token[i + 1]))
        heapq.heapify(heap)
        while heap:
            _, i, x, y = heapq.heappop(heap)
            if not alive[i] or token[i] != x:
                continue
            j = after[i]
            if j >= n or token[j] != y:
                continue
            token[i], alive[j] = self._merge[(x, y)][1], False
            after[i] = after[j]
            if after[i] < n:
                ahead[after[i]] = i
            for k in (ahead[i], i):
                if k >= 0 and after[k] < n and (merge := self._merge.get((token[k], token[after[k]]))):
                    heapq.heappush(heap, (merge[0], k, token[k], token[after[k]]))
        return [t for t, a in zip(token, alive, strict=True) if a]

    def _encode_words(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        """Tokens of distinct words: cut greedily, test all adjacent pairs together, merge exactly where one fails."""
        raws = [w.encode() for w in words]
        done: dict[str, tuple[int, ...]] = {}
        cut: list[tuple[int, list[int]]] = []
        for k, raw in enumerate(raws):
            one = self.valid.get(raw)
            if one is not None:
                done[words[k]] = (one,)
            else:
                cut.append((k, self._greedy(raw)))
        if not cut:
            return done
        sizes = np.array([len(t) for _, t in cut])
        flat = np.fromiter((t for _, ts in cut for t in ts), dtype=np.int64, count=int(sizes.sum()))
        owner = np.repeat(np.arange(len(cut)), sizes)
        inside = owner[:-1] == owner[1:]
        keys = (flat[:-1] << 32 | flat[1:])[inside]
        distinct, back = np.unique(keys, return_inverse=True)
        verdict = np.array([self._checked.get(int(k), -1) for k in distinct], dtype=np.int8)
        fresh = np.flatnonzero(verdict < 0)
        if len(fresh):
            pairs = distinct[fresh]
            verdict[fresh] = self._compatible(pairs >> 32, pairs & 0xFFFFFFFF)
            if len(self._checked) > REMEMBERED:
                self._checked.clear()
            self._checked.update(zip(pairs.tolist(), (verdict[fresh] > 0).tolist(), strict=True))
        failed = np.zeros(len(cut), dtype=bool)
        failed[owner[:-1][inside][verdict[back] == 0]] = True
        for (k, tokens), wrong in zip(cut, failed, strict=True):
            done[words[k]] = tuple(self._exact(raws[k]) if wrong else tokens)
        return done

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of all texts, in the layout of an Arrow list array."""
        cut = [self._words.findall(t) if t else [] for t in texts]
        new = {w for words in cut for w in words if w not in self._known}
        here: dict[str, tuple[int, ...]] = {}
        if new:
            encoded = self._encode_words(list(new))
            if len(self._known) + len(encoded) > REMEMBERED:
                here = self._known
                self._known = {}
            for w, ids in encoded.items():
                (self._known if len(w) <= LONG else here)[w] = ids
        known = self._known
        ids: list[int] = []
        offsets = np.zeros(len(texts) + 1, dtype=np.int64)
        for i, words in enumerate(cut):
            for w in words:
                got = known.get(w)
                ids.extend(got if got is not None else here[w])
            offsets[i + 1] = len(ids)
        return offsets, np.array(ids, dtype=np.int32)


@lru_cache(maxsize=2)
def worker_coder(vocabulary: str) -> ByteBpe:
    """The encoder of a Python worker, kept from task to task with its remembered words and pairs."""
    return ByteBpe(vocabulary)


def _portions(texts: pa.Array, rows: int = 256, size: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """(start, rows) of portions of at most ``rows`` texts and about ``size`` bytes (one longer text is a portion of its own)."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and (i - start >= rows or held + n > size):
            yield start, i - start
            start, held = i, 0
        held += int(n)
    if len(sizes) > start:
        yield start, len(sizes) - start


def encode(documents: DataFrame, text: str = "text", to: str = "ids", vocabulary: str = VOCABULARY, keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all others than ``text`` by default) and ``to``, the texts' token ids (ARRAY<INT>, never null).

    The vocabulary file is read once, by the driver, and broadcast: its size is
    fixed (1.6 MB) and no executor needs the file.
    """
    context = documents.sparkSession.sparkContext
    shipped = context.broadcast(Path(vocabulary).read_text(encoding="utf-8"))
    kept = [c for c in (documents.columns if keep is None else keep) if c not in (text, to)]
    fields = [documents.schema[c] for c in kept]
    schema = T.StructType([*fields, T.StructField(to, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = worker_coder(shipped.value)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for start, rows in _portions(texts):
                offsets, ids = coder.encode_batch(texts.slice(start, rows).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(start, rows) for i in range(len(kept))), lists], names=[*kept, to])

    return documents.select(*kept, text).mapInArrow(run, schema)

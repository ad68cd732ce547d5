"""Text garbled by a wrong character decoding: find it and restore it.

A text is cut into words (ASCII blanks end a word; Chinese, Japanese and Korean
runs are words of their own). For each word with characters beyond ASCII a
best-first search walks the graph of its possible earlier states: an edge
encodes the word with one codec and decodes the bytes with another, or
unescapes HTML entities. States are hashed, visited once, and expanded in the
order of their cost, the implausibility of their characters; the cheapest
state reachable is the word's restored form. A document holds a garbled
passage when its words' gains under one path add up to clear evidence, or when
it holds U+FFFD, the mark of bytes that a decoder couldn't read (such passages
are found, though what was lost can't be restored).

The cost comes from trigram counts of all *different* texts, hashed into a table
of fixed size (``BUCKETS`` counters, 8 MB), which is sent to the executors.
Garbled text is part of those counts, but rarer than what it stands for, and
longer; only differences of costs are used. Texts of which there are copies are
told by their hashes and are the only ones that are shuffled to count once.

A word is searched once, not once per text or worker: the ``REMEMBERED`` words
of most texts are searched first, in parallel, and their results travel to all
executors; what is rarer is searched where it occurs. A path has at most
``DEPTH`` steps, a word at most ``EXPANSIONS`` expanded states of a price up to
``SLACK`` above the word's; README has the cases found under wider bounds.

Defined cases: null, empty and blank texts are never garbled; texts of any
length are read as a whole; repeated rows are judged alike; correct text in
other scripts, decomposed accents, box drawings, formulas and emoji are no
cases; extra columns pass through ``restore`` unless they clash with its own
(``garbled``, ``restored``, ``path``), which then replace them.
"""

from __future__ import annotations

import heapq
import html
import math
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.session import cut

#: Size of the hashed trigram table.
BUCKETS = 1 << 20
#: Codecs that a wrong decoder may have used, and those that the bytes may have been written in.
READ_AS = ("cp1252", "latin-1", "cp1251", "cp1250", "cp1254", "cp437", "cp850", "mac_roman", "koi8-r", "cp866", "cp932", "gbk")
WRITTEN_IN = ("utf-8", "cp1251", "cp1250", "cp1252", "cp1254", "koi8-r", "cp866", "cp932", "euc_jp", "cp850", "mac_roman")
#: Nats per trigram that a step must win before it counts. UTF-8 leaves a structure that chance hardly makes (valid bytes are evidence of their own), other codecs don't.
STEP_COST = {"utf-8": -0.2, "unescape": 0.1, "lossy": 0.6, "refill": 0.8, "": 1.5}
#: Evidence that one path must collect over a document's different words, without and with UTF-8.
EVIDENCE, EVIDENCE_UTF8 = 1.5, 0.0
#: Characters of a word that may give evidence without UTF-8.
LEAST = 3
#: Words whose results are sent to all executors (a bound of memory: others are searched where they occur).
REMEMBERED = 1 << 16
#: Steps of the search: depth of a path, states expanded per word, and how much dearer than the start a state may be.
DEPTH, EXPANSIONS, SLACK = 3, 24, 3.0

#: Blanks that end a word; NO-BREAK SPACE and NEXT LINE may be bytes of a garbled word.
_BLANK = " \t\n\r\x0b\x0c"
_CJK = "ᄀ-ᇿ⺀-꓏가-퟿豈-﫿︰-﹏！-￯\U00020000-\U0003ffff"
_WORD = re.compile(rf"[{_CJK}]+|[^{_BLANK}{_CJK}]+")
_DIGITS = re.compile("[0-9]")
_ENTITY = re.compile(r"&#?\w+;")
#: U+FFFD and C1 controls: what a decoder couldn't read, or read as the wrong single-byte set.
_LOST = re.compile("[\x80-\x84\x86-\x9f\ufffd]")
_C1 = re.compile("[\x80-\x9f]")


def _lossy_forms() -> dict[str, list[str]]:
    """What is left of a UTF-8 character read as Latin-1 without C1 controls, or as Windows-1252 without its unused bytes -> the characters it may stand for."""
    forms: dict[str, list[str]] = {}
    blocks = ((0xA0, 0x180), (0x2010, 0x2045), (0x20AC, 0x20AD), (0x2116, 0x2117), (0x2122, 0x2123), (0x2190, 0x2194), (0x26A0, 0x26A1), (0x2713, 0x2718))
    for low, high in blocks:
        for code in range(low, high):
            raw = chr(code).encode()
            for left in {_C1.sub("", raw.decode("latin-1")), raw.decode("cp1252", "ignore")}:
                if len(left) < len(raw):
                    forms.setdefault(left, []).append(chr(code))
    return forms


_FORMS = _lossy_forms()
_FORM = re.compile("|".join(sorted(map(re.escape, _FORMS), key=len, reverse=True)))


def _hashes(codes: np.ndarray) -> np.ndarray:
    """Bucket of every trigram of code points."""
    c = np.where((codes >= 48) & (codes <= 57), 48, np.where((codes >= 9) & (codes <= 13), 32, codes)).astype(np.uint64)
    a, b, d = c[:-2], c[1:-1], c[2:]
    mixed = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (d * np.uint64(0x165667B19E3779F9))
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(44)).astype(np.int64)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _parts(texts: list[str], size: int = 1 << 20) -> Iterator[str]:
    """Texts joined by blanks in parts of about ``size`` characters that overlap by two: each trigram is in one part, and a text has the same trigrams wherever it stands."""
    held, length = ["  "], 2
    for text in texts:
        for at in range(0, len(text), size):
            piece = text[at : at + size] + ("  " if at + size >= len(text) else "")
            held.append(piece)
            length += len(piece)
            if length >= size:
                joined = "".join(held)
                yield joined
                held, length = [joined[-2:]], 2
    yield "".join(held)


def _bits(hashes: np.ndarray) -> np.ndarray:
    return (hashes.astype(np.uint64) >> np.uint64(64 - 20)).astype(np.int64)


def _copied(documents: DataFrame, text: str) -> np.ndarray:
    """Which of 2^20 classes of text hashes have texts of several copies (all those texts, and few others)."""

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_bits(batch.column(0).to_numpy())))], names=["bit"])

    twice = documents.where(F.length(text) > 0).groupBy(F.xxhash64(text).alias("h")).agg(F.count("*").alias("n")).where("n > 1").select("h")
    found = np.zeros(1 << 20, dtype=bool)
    found[twice.mapInArrow(classes, "bit bigint").distinct().toPandas()["bit"].to_numpy(dtype=np.int64)] = True
    return found


def statistics(documents: DataFrame, text: str = "text") -> tuple[np.ndarray, list[str]]:
    """Counts of all different texts' hashed trigrams (array of ``BUCKETS``; the last place holds the sum), and the words of most texts.

    One pass over the texts, after one over their hashes; texts in a class of
    copied ones meet by their text and count there.
    """
    copied = documents.sparkSession.sparkContext.broadcast(_copied(documents, text))
    hashed = documents.where(F.length(text) > 0).select(F.col(text).alias("text"), F.xxhash64(text).alias("h"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            words: Counter[str] = Counter()
            for t in texts:
                words.update({_core(w) for w in suspects(t)})
            again = copied.value[_bits(batch.column(1).to_numpy())] if batch.num_columns > 1 else np.zeros(len(texts), dtype=bool)
            for part in _parts([t for t, twice in zip(texts, again.tolist(), strict=True) if not twice]):
                total += np.bincount(_hashes(_codes(part)), minlength=BUCKETS)
            if batch.num_columns > 1:
                yield pa.RecordBatch.from_arrays([pa.nulls(len(words), pa.int64()), pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["bucket", "word", "n"])
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.nulls(len(hit), pa.string()), pa.array(total[hit])], names=["bucket", "word", "n"])

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(copied.value[_bits(batch.column(1).to_numpy())]))], names=["text"])

    shape = "bucket bigint, word string, n bigint"
    once = hashed.mapInArrow(kept, "text string").distinct().mapInArrow(count, shape)
    sums = cut(hashed.mapInArrow(count, shape).unionByName(once).groupBy("bucket", "word").agg(F.sum("n").alias("n")))
    counts = sums.where("bucket IS NOT NULL").select("bucket", "n").toPandas()
    table = np.zeros(BUCKETS + 1, dtype=np.int64)
    table[counts["bucket"].to_numpy(dtype=np.int64)] = counts["n"].to_numpy(dtype=np.int64)
    table[BUCKETS] = table[:BUCKETS].sum()
    frequent = sums.where("word IS NOT NULL AND n > 1").orderBy(F.desc("n"), "word").limit(REMEMBERED).select("word")
    return table, [r.word for r in frequent.collect()]


def suspects(text: str | None) -> list[str]:
    """The different words of a text that have characters beyond ASCII or entities, in order."""
    if not text or (text.isascii() and "&" not in text):
        return []
    for blank in _BLANK[1:]:
        if blank in text:
            text = text.replace(blank, " ")
    runs = [r for r in dict.fromkeys(text.split(" ")) if not r.isascii() or "&" in r]
    return list(dict.fromkeys(w for r in runs for w in _WORD.findall(r) if not w.isascii() or _ENTITY.search(w)))


class Search:
    """Best-first search for the most plausible earlier state of a word."""

    def __init__(self, counts: np.ndarray, known: dict[str, tuple[float, tuple[str, ...]]] | None = None) -> None:
        total = max(int(counts[-1]), 1)
        self.table = math.log(total + 1.0) - np.log(counts[:-1] + 0.5)
        self.known = known or {}
        self._searched = lru_cache(maxsize=1 << 16)(self._best)
        self.judged = lru_cache(maxsize=1 << 17)(self._judged)

    def best(self, word: str) -> tuple[float, tuple[str, ...]]:
        """(gain, operations) of the cheapest reachable state of a word."""
        found = self.known.get(word)
        return found if found is not None else self._searched(word)

    def _judged(self, word: str) -> tuple[float, tuple[str, ...], tuple[str, ...]]:
        """(gain, operations, family; () where the word is no evidence) of a word by its core."""
        gain, path = self.best(_core(word))
        family = _family(path)
        return gain, path, family if family and (len(word) >= LEAST or _structured(family)) else ()

    def costs(self, words: list[str]) -> np.ndarray:
        """Per word the mean over the trigrams of the word and a blank on both sides."""
        sizes = np.array([len(w) for w in words])
        each = self.table[_hashes(_codes(f" {' '.join(words)} "))]
        starts = np.cumsum(sizes + 1) - sizes - 1
        # The trigram across two words' border belongs to neither.
        each[starts[1:] - 1] = 0.0
        return np.add.reduceat(each, starts) / sizes

    def cost(self, word: str) -> float:
        return float(self.costs([word])[0])

    @staticmethod
    def moves(word: str) -> Iterator[tuple[str, str]]:
        """(operation, earlier state) for every codec pair that fits the whole word, and for entities."""
        if _ENTITY.search(word) and (plain := html.unescape(word)) != word:
            yield "unescape", plain
        seen_bytes: dict[bytes, str] = {}
        for read in READ_AS:
            try:
                raw = _encode(word, read)
            except UnicodeError:
                continue
            if raw in seen_bytes:
                continue
            seen_bytes[raw] = read
            for written in WRITTEN_IN:
                try:
                    earlier = raw.decode(written)
                except UnicodeError:
                    continue
                if earlier != word:
                    yield f"{written}>{read}", earlier
            if read in ("cp1252", "latin-1") and 0 < len(part := raw.decode("utf-8", "ignore")) < len(word) and not part.isascii():
                yield f"lossy>{read}", part
        for form in set(_FORM.findall(word)):
            for char in _FORMS[form]:
                yield f"refill:{form}:{char}", word.replace(form, char)

    def _best(self, word: str) -> tuple[float, tuple[str, ...]]:
        start = self.cost(word)
        heap: list[tuple[float, int, str, tuple[str, ...]]] = [(start, 0, word, ())]
        visited, found, expanded, order = {word}, (start, ()), 0, 0
        while heap and expanded < EXPANSIONS:
            at, _, state, path = heapq.heappop(heap)
            if at < found[0] and _family(path):
                found = (at, path)
            if len(path) >= DEPTH or state.isascii() and "&" not in state:
                continue
            expanded += 1
            paid = sum(_step_cost(op) for op in path)
            fresh: dict[str, str] = {}
            for op, earlier in self.moves(state):
                if earlier and earlier not in visited:
                    visited.add(earlier)
                    fresh[earlier] = op
            if not fresh:
                continue
            for (earlier, op), cost in zip(fresh.items(), self.costs(list(fresh)).tolist(), strict=True):
                price = cost + paid + _step_cost(op)
                if price < start + SLACK:
                    order += 1
                    heapq.heappush(heap, (price, order, earlier, (*path, op)))
        return start - found[0], found[1]


@lru_cache(maxsize=1 << 12)
def _step_cost(op: str) -> float:
    return STEP_COST.get(re.split("[>:]", op)[0], STEP_COST[""])


def _applied(word: str, ops: tuple[str, ...]) -> str:
    """A word after the operations of a path; UnicodeError where one doesn't fit it."""
    for op in ops:
        if op == "unescape":
            word = html.unescape(word)
        elif op.startswith("refill:"):
            _, form, char = op.split(":", 2)
            word = word.replace(form, char)
        elif not op.startswith("lossy"):
            written, read = op.split(">")
            word = _encode(word, read).decode(written)
    return word


def _encode(word: str, codec: str) -> bytes:
    """Bytes of a word as ``codec`` reads them; bytes that a Windows codec leaves open stay as C1 controls do in practice."""
    if codec.startswith("cp125"):
        return b"".join(_one(c, codec) for c in word)
    return word.encode(codec)


@lru_cache(maxsize=1 << 16)
def _one(char: str, codec: str) -> bytes:
    try:
        return char.encode(codec)
    except UnicodeError:
        if "\x80" <= char <= "\x9f":
            return bytes([ord(char)])
        raise


@lru_cache(maxsize=1 << 16)
def _core(word: str) -> str:
    """A word's characters beyond ASCII with what lies between and up to two around them; digits become 0."""
    first = next((i for i, c in enumerate(word) if c > "\x7f"), 0)
    last = next((i for i in range(len(word) - 1, -1, -1) if word[i] > "\x7f"), len(word) - 1)
    if _ENTITY.search(word):
        return word
    return _DIGITS.sub("0", word[max(0, first - 2) : last + 3])


def judge(text: str | None, search: Search, restore: bool = False) -> tuple[bool, str | None, str | None]:
    """(garbled, restored text, path) of one text; ``restore`` False leaves the second out."""
    if not text or (text.isascii() and "&" not in text):
        return False, text, None
    lost = _LOST.search(text) is not None
    evidence: dict[tuple[str, ...], float] = {}
    fixes: dict[str, tuple[str, ...]] = {}
    for word in suspects(text):
        gain, path, family = search.judged(word)
        if family:
            evidence[family] = evidence.get(family, 0.0) + gain
        fixes[word] = path
    sure = {family for family, total in evidence.items() if total >= (EVIDENCE_UTF8 if _structured(family) else EVIDENCE)}
    if not sure and not lost:
        return False, text, None
    path = " ".join(max(sure, key=lambda f: (evidence[f], f))) if sure else "lost"
    if not restore:
        return True, None, path
    codecs = sorted(f for f in sure if all(">" in op and not op.startswith("lossy") for op in f))

    def fixed(match: re.Match[str]) -> str:
        word = match.group()
        if word not in fixes:
            return word
        ops = [fixes[word]] if _family(fixes[word]) in sure else codecs
        for path in ops:
            try:
                earlier = _applied(word, path)
            except UnicodeError:
                continue
            if ops is not codecs or search.cost(_core(earlier)) < search.cost(_core(word)):
                return earlier
        return word

    return True, _WORD.sub(fixed, text), path


def _family(path: tuple[str, ...]) -> tuple[str, ...]:
    """A path without unescaping, and with all refills as one."""
    return tuple("refill" if op.startswith("refill") else op for op in path if op != "unescape")


def _structured(family: tuple[str, ...]) -> bool:
    """Whether every step of the path undoes the structure that UTF-8 leaves."""
    return all(op.startswith(("utf-8", "lossy", "refill")) for op in family)


_SEARCHES: dict[str, Search] = {}


def _worker_search(token: str, counts: Broadcast, known: Broadcast | None) -> Search:
    """The search of a Python worker, kept from task to task with its remembered words; only the last corpus is kept."""
    if token not in _SEARCHES:
        _SEARCHES.clear()
        _SEARCHES[token] = Search(counts.value, known.value if known else None)
    return _SEARCHES[token]


def prepared(documents: DataFrame, text: str = "text") -> Callable[[], Search]:
    """What a worker calls for its search: trigram counts of all texts, and the results for the words of most texts."""
    spark = documents.sparkSession
    table, frequent = statistics(documents, text)
    counts, early = spark.sparkContext.broadcast(table), uuid.uuid4().hex

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = _worker_search(early, counts, None)
        for batch in batches:
            words = batch.column(0).to_pylist()
            found = [worker.best(w) for w in words]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.float64()), pa.array([list(f[1]) for f in found], pa.list_(pa.string()))], names=["word", "gain", "path"])

    found: dict[str, tuple[float, tuple[str, ...]]] = {}
    if frequent:
        slices = max(1, min(len(frequent) // 64, 4 * spark.sparkContext.defaultParallelism))
        words = spark.createDataFrame([(w,) for w in frequent], "word string").repartition(slices)
        found = {r.word: (r.gain, tuple(r.path)) for r in words.mapInArrow(search, "word string, gain double, path array<string>").collect()}
    known, token = spark.sparkContext.broadcast(found), uuid.uuid4().hex
    return lambda: _worker_search(token, counts, known)


def restore(documents: DataFrame, text: str = "text") -> DataFrame:
    """All columns with ``garbled`` BOOLEAN, ``restored`` STRING (the text as far as it can be restored) and ``path`` STRING."""
    searcher = prepared(documents, text)
    kept = [c for c in documents.columns if c.lower() not in ("garbled", "restored", "path") or c == text]
    schema = documents.select(*kept).schema
    for field in ("garbled boolean", "restored string", "path string"):
        schema = schema.add(*field.split())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        search = searcher()
        for pdf in batches:
            rows = [judge(t, search, True) for t in pdf[text]]
            yield pdf.assign(garbled=[r[0] for r in rows], restored=[r[1] for r in rows], path=[r[2] for r in rows])

    return documents.select(*kept).mapInPandas(run, schema)


def found(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Distinct ids of documents with at least one garbled passage."""
    searcher = prepared(documents, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = searcher()
        for batch in batches:
            hit = [judge(t, search)[0] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(hit, pa.bool_()))], names=[doc_id])

    kind = documents.schema[doc_id].dataType.simpleString()
    return documents.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {kind}").distinct()

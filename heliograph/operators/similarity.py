"""Participants that resemble each other: searches, match shares, correlations, components and their representatives.

Pairs come from equi-joins on what two participants share (a minute and a
quantised value, a link), never from pairing everybody with everybody.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliograph.operators import pairs
from heliograph.session import cut


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a)) + F.lit(1e-12)


def cosine_search(df: DataFrame, key: str, vector: str, queries: Column, k: int, rows_per_block: int = 4096, queries_per_block: int = 512) -> DataFrame:
    """For every row that ``queries`` marks the ``k`` nearest other rows by cosine, against all rows: query, key, cosine, rank.

    A stated query set against all rows, in blocks: a task multiplies at most
    ``queries_per_block`` queries with ``rows_per_block`` rows and keeps the k
    best per query, whatever the table's size.
    """
    rows = df.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(key, vector)
    asked = df.where(queries & F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("q"), F.col(vector).alias("_v"))
    n_rows, n_asked = rows.count(), asked.count()
    row_blocks, query_blocks = max(1, -(-n_rows // rows_per_block)), max(1, -(-n_asked // queries_per_block))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select("*", F.pmod(F.xxhash64(key), F.lit(row_blocks)).cast("int").alias("_r"), upto(query_blocks).alias("_q"))
    right = asked.select("*", F.pmod(F.xxhash64("q"), F.lit(query_blocks)).cast("int").alias("_q"), upto(row_blocks).alias("_r"))

    def near(_: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            unit = lambda c: (m := np.stack([np.asarray(v, dtype=np.float64) for v in c])) / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-12)
            x, y, ids = unit(left[vector]), unit(right["_v"]), left[key].to_numpy()
            for q, sims in zip(right["q"].to_numpy(), y @ x.T, strict=True):
                others = np.flatnonzero(ids != q)
                for i in others[np.lexsort((ids[others], -sims[others]))[:k]]:
                    out.append((q, ids[i], sims[i]))
        return pd.DataFrame(out, columns=["query", "key", "cosine"])

    kind = df.schema[key].dataType.simpleString()
    best = left.groupBy("_q", "_r").cogroup(right.groupBy("_q", "_r")).applyInPandas(near, f"query {kind}, key {kind}, cosine double")
    w = Window.partitionBy("query").orderBy(F.desc("cosine"), "key")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def match_share(df: DataFrame, moment: list[str], who: str, cell: Column, least_joint: int, least_share: float = 0.0) -> DataFrame:
    """For pairs that agree at least once (and in ``least_share`` of the moments): moments both were active in, moments in which they agree, and the share.

    ``cell`` is the value at the precision that counts as equal. Both counts
    are summed as matrices, block by block; only pairs that agree are listed.
    """
    acts = df.select(*moment, who, cell.alias("_cell")).distinct()
    counts = df.select(*moment, who).distinct().groupBy(who).agg(F.count("*").alias("_n"))
    named = cut(pairs.slots(df, who).join(counts, who))
    test = lambda t: (t["n_match"] > 0) & (t["n"] >= least_joint) & (t["n_match"] >= least_share * t["n"] * (1 - 1e-9))
    both = pairs.pairwise(acts.join(F.broadcast(named), who), moment, "_slot", F.col("_cell"), named.count(), pairs.add_matches, ["n", "n_match"], test, coded=True)
    listed = both.where((F.col("n_match") > 0) & (F.col("n") >= least_joint)).select("i", "j", F.col("n").cast("long").alias("n_joint"), F.col("n_match").cast("long").alias("n_match"))
    a, b = (named.select(F.col("_slot").alias(i), F.col(who).alias(x), F.col("_n").alias(f"n_{x}")) for i, x in (("i", "a"), ("j", "b")))
    if least_share > 0:
        listed = listed.where(F.col("n_match") / F.col("n_joint") >= least_share)
    return listed.join(F.broadcast(a), "i").join(F.broadcast(b), "j").select("a", "b", "n_a", "n_b", "n_joint", "n_match", (F.col("n_match") / F.col("n_joint")).alias("share"))


def pair_sums(df: DataFrame, moment: list[str], slot: str, value: str, sums: tuple[str, ...] = ("n", "x", "y", "xx", "yy", "xy"), diagonal: bool = False, size: int | None = None) -> DataFrame:
    """(i, j, <sums>) for i < j (with ``diagonal`` i <= j): sums over the moments that both slots have; pairs are summed as matrices, never listed per moment."""
    known = df.where(F.col(value).isNotNull())
    n = size if size is not None else (known.agg(F.max(slot) + 1).first()[0] or 0)
    return pairs.pairwise(known, moment, slot, F.col(value), n, pairs.add_sums, list(sums), lambda t: t["n"] > 0, diagonal=diagonal)


def gram(df: DataFrame, moment: list[str], slot: str, value: str, size: int) -> np.ndarray:
    """Inner products of all slots' values (absent ones are 0), size x size on the driver."""
    out = np.zeros((size, size))
    for r in pair_sums(df, moment, slot, value, ("n", "xy"), True, size).select("i", "j", "xy").collect():
        out[r.i, r.j] = out[r.j, r.i] = r.xy
    return out


def joint_correlation(df: DataFrame, moment: str, who: str, value: str, least_joint: int) -> DataFrame:
    """Correlation of two participants over joint moments, from pair sums."""
    named = cut(pairs.slots(df.where(F.col(value).isNotNull()), who))
    sums = pair_sums(df.join(named, who), [moment], "_slot", value).where(F.col("n") >= least_joint)
    a, b = named.select(F.col(who).alias("a"), F.col("_slot").alias("i")), named.select(F.col(who).alias("b"), F.col("_slot").alias("j"))
    spread = lambda s, q: F.greatest(F.col("n") * F.col(q) - F.col(s) ** 2, F.lit(0.0))
    corr = (F.col("n") * F.col("xy") - F.col("x") * F.col("y")) / F.sqrt(spread("x", "xx") * spread("y", "yy"))
    return sums.join(a, "i").join(b, "j").select("a", "b", F.col("n").cast("long").alias("n_joint"), F.when(F.isnan(corr), None).otherwise(corr).alias("corr"))


def _cosines(batch: pa.RecordBatch, names: pa.Array, width: int, least_joint: int) -> pa.RecordBatch:
    """(a, b, n_joint, similarity) of a batch of pair sums."""
    joint = np.floor(batch.column("n").to_numpy() / width + 0.5).astype(np.int64)
    kept = np.flatnonzero(joint >= least_joint)
    i, j, xx, yy, xy = (batch.column(c).to_numpy()[kept] for c in ("i", "j", "xx", "yy", "xy"))
    size = xx * yy
    similarity = np.divide(np.abs(xy), np.sqrt(size), out=np.zeros(len(kept)), where=~(size <= 0))
    return pa.RecordBatch.from_arrays([names.take(pa.array(i)), names.take(pa.array(j)), pa.array(joint[kept]), pa.array(similarity)], names=["a", "b", "n_joint", "similarity"])


def centred_similarity(df: DataFrame, moment: str, who: str, vec: str, least_joint: int = 1, joint: bool = True) -> DataFrame:
    """(a, b, n_joint, similarity): |cosine| of two participants' vectors over all moments and elements, after the mean of the participants (A10) or each one's own mean (``joint``, A11: over the moments both have) is taken out.

    A row of the pair sums is a (moment, element); so nothing is as long as a history.
    """
    flat = df.select(moment, who, F.posexplode(vec).alias("_d", "_v")).withColumn("_v", F.col("_v").cast("double"))
    centre = [who, "_d"] if joint else [moment, "_d"]
    if joint:
        mean = flat.groupBy(*centre).agg(F.avg("_v").alias("_m"))
    else:
        # Those absent count as zeros in the mean of a moment.
        mean = flat.groupBy(*centre).agg((F.sum("_v") / df.agg(F.countDistinct(who)).scalar()).alias("_m"))
    free = flat.join(mean, centre).withColumn("_v", F.col("_v") - F.col("_m"))
    if not joint:
        grid = mean.select(moment, "_d", F.explode(df.agg(F.collect_set(who).alias("w")).scalar()).alias(who), (-F.col("_m")).alias("_z"))
        free = grid.join(free.select(moment, "_d", who, "_v"), [moment, "_d", who], "left").withColumn("_v", F.coalesce("_v", "_z"))
    named = cut(pairs.slots(free, who))
    names = named.orderBy("_slot").select(who).toArrow().column(0).combine_chunks()
    width = df.agg(F.max(F.size(vec))).first()[0] or 1
    # The tasks that add up a pair of blocks name its pairs, too: joins of all pairs cost as much as their sums.
    kind = df.schema[who].dataType.simpleString()
    return pairs.pairwise(
        free.where("_v IS NOT NULL").join(F.broadcast(named), who), [moment, "_d"], "_slot", F.col("_v"), len(names), pairs.add_sums, ["n", "xx", "yy", "xy"], lambda t: t["n"] > 0,
        then=partial(_cosines, names=names, width=width, least_joint=least_joint), schema=f"a {kind}, b {kind}, n_joint bigint, similarity double",
    )


def _equal(batches: Iterator[pa.RecordBatch], classes: int, size: int) -> Iterator[pa.RecordBatch]:
    """How often two slots have the same choice, absent ones having choice 0."""
    total = np.zeros((size, size))
    for batch in batches:
        lists = batch.column(0)
        choice = np.zeros((len(lists), size), dtype=np.int64)
        flat = lists.flatten()
        choice[np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), flat.field(0).to_numpy()] = flat.field(1).to_numpy()
        for k in range(classes):
            same = (choice == k).astype(np.float32)
            total += same.T @ same
    i, j = np.nonzero(np.triu(total, 1))
    yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "n"])


def agreement(moments: DataFrame, df: DataFrame, moment: str, who: str, rank: str, choice: str, classes: int) -> DataFrame:
    """(who, overlap, uniqueness): the largest share of the ``moments`` in which a participant of better rank (1, 2, ...) made the same choice; absent ones have choice 0. Summed as matrices."""
    names = df.select(who, rank).distinct()
    size = int(names.agg(F.max(rank)).first()[0] or 0)
    listed = df.groupBy(moment).agg(F.collect_list(F.struct((F.col(rank) - 1).cast("int").alias("s"), F.col(choice).cast("int").alias("c"))).alias("l"))
    rows = moments.join(listed, moment, "left").select(F.coalesce("l", F.array()).alias("l"))
    same = rows.mapInArrow(partial(_equal, classes=classes, size=size), "i int, j int, n double").groupBy("i", "j").agg(F.sum("n").alias("n"))
    most = same.groupBy((F.col("j") + 1).alias(rank)).agg(F.max("n").alias("n"))
    overlap = F.coalesce(F.col("n") / moments.agg(F.count("*").cast("double")).scalar(), F.lit(0.0))
    return names.join(most, rank, "left").select(who, overlap.alias("overlap"), F.pow(1 - overlap, 2).alias("uniqueness"))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(member, representative): connected components, each under its smallest member.

    Alternating large-star and small-star steps to the fixed point; all joins
    are on one node's links and every round is cut in the shared checkpoint
    folder. The number of rounds grows with the logarithm of the longest path.
    A round without effect leaves the links as they were, which their count
    and a sum of their hashes tell.
    """
    edges = cut(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct())
    told = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.sum(F.xxhash64("v", "u", F.lit(1)).cast("decimal(20,0)"))).first())
    before = told(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(low.where("m < u").select("u", F.col("m").alias("v"))).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = cut(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct())
        now = told(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("member"), F.col("v").alias("representative")).unionByName(edges.select(F.col("v").alias("member"), F.col("v").alias("representative"))).distinct()


def collapse_mass(df: DataFrame, key: str, value: str, representatives: DataFrame) -> DataFrame:
    """Values summed into each key's representative (itself by default)."""
    joined = df.join(representatives.withColumnRenamed("member", key), key, "left")
    return joined.groupBy(F.coalesce("representative", key).alias(key)).agg(F.sum(value).alias(value))


def equalise_mass(df: DataFrame, key: str, value: str, representatives: DataFrame) -> DataFrame:
    """Members of a cluster share its total equally, members without a value included; clusters without mass are dropped; other keys pass through."""
    reps = representatives.withColumnRenamed("member", key)
    sizes = reps.groupBy("representative").agg(F.count("*").alias("_n"))
    totals = df.join(reps, key).groupBy("representative").agg(F.sum(value).alias("_t")).where("_t > 0")
    shared = reps.join(totals, "representative").join(sizes, "representative").select(key, (F.col("_t") / F.col("_n")).alias(value))
    return shared.unionByName(df.join(reps, key, "left_anti").select(key, value))


def _best_senior(totals: pairs.Totals, i0: int, j0: int, same: bool, ties: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """Per junior slot j of a pair of blocks the most moments shared with one slot of better rank."""
    n = totals["n"]
    first = np.array([ties.get(j, j) for j in range(j0, j0 + n.shape[1])])
    most = np.where(np.arange(i0, i0 + n.shape[0])[:, None] < first, n, 0).max(axis=0)
    j = np.flatnonzero(most)
    yield pa.RecordBatch.from_arrays([pa.array((j + j0).astype(np.int32)), pa.array(most[j].astype(np.int32))], names=["j", "n"])


def overlap_with_seniors(df: DataFrame, moment: str, who: str, choice: str, rank: str) -> DataFrame:
    """The largest share of a participant's own moments in which one higher-ranked participant made the same choice, and (1 - overlap)².

    Slots are ordered by rank; a row of the pair sums is a (moment, choice).
    Blocks of pairs only tell each junior's maximum. Slots that share their
    rank with an earlier one reach the driver, one number each.
    """
    order = F.row_number().over(Window.orderBy(rank, who)) - 1
    named = cut(df.select(who, rank).distinct().withColumn("_slot", order).withColumn("_first", F.min("_slot").over(Window.partitionBy(rank))))
    ties = {r[0]: r[1] for r in named.where("_first < _slot").select("_slot", "_first").collect()}
    chosen = df.join(F.broadcast(named.select(who, "_slot")), who)
    most = pairs.pairwise(chosen, [moment, choice], "_slot", None, named.count(), pairs.add_sums, ["n"], lambda t: t["n"] > 0, finish=partial(_best_senior, ties=ties), schema="j int, n int")
    most = most.groupBy(F.col("j").alias("_slot")).agg(F.max("n").alias("_m"))
    n = df.groupBy(who).agg(F.count("*").alias("n")).join(F.broadcast(named.select(who, "_slot")), who)
    overlap = F.coalesce(F.col("_m"), F.lit(0)) / F.col("n")
    return n.join(most, "_slot", "left").select(who, "n", overlap.alias("overlap"), F.pow(1 - overlap, 2).alias("uniqueness"))

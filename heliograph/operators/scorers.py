"""Walk-forward scorers: from participants' long history to one non-negative share per participant.

All take a long table and return (hk, s) with the shares summing to 1 (or no
rows). Selection, labels, votes and recency run as DataFrame operations, meta
fits as sums over all executors (``fits.logistic``); what is collected has a
size that the number of participants, classes and segments bounds.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliograph.functions import vectors
from heliograph.operators import events, filters, fits, similarity, solvers, stats, windows
from heliograph.session import cut

REGISTRY: dict[str, Callable[..., DataFrame]] = {}


def scorer(*kinds: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Registers a scorer under its loss functions (the extension point of §2.15)."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        REGISTRY.update(dict.fromkeys(kinds, f))
        return f

    return add


def _members(rows: DataFrame, group: str | None = None) -> DataFrame:
    """Participants of each group with their column (slot) in its meta fit, in the order of their names."""
    keys = [group] if group else []
    order = Window.partitionBy(*keys).orderBy("hk")
    return rows.select(*keys, "hk").distinct().withColumn("slot", F.row_number().over(order) - 1)


def _widths(members: DataFrame, group: str | None = None) -> dict[str, int]:
    """Columns per group: the groups are models, classes or segments of one task."""
    keys = [F.col(group).cast("string").alias("g")] if group else [F.lit("all").alias("g")]
    return {r.g: r.k for r in members.groupBy(*keys).agg(F.count("*").alias("k")).collect()}


def _importance(members: DataFrame, found: dict[str, np.ndarray], group: str | None = None) -> DataFrame:
    """(group, hk, s) of one value per group and slot."""
    told = members.sparkSession.createDataFrame([(g, i, float(v)) for g, values in found.items() for i, v in enumerate(values)], "g string, slot int, s double")
    keyed = members.withColumn("g", F.col(group).cast("string") if group else F.lit("all"))
    return keyed.join(told, ["g", "slot"]).select(*([group] if group else []), "hk", "s")


def _median(coefs: np.ndarray) -> np.ndarray:
    """A18 of a group's absolute coefficients."""
    return solvers.median_of_means(np.abs(coefs), min(4, len(coefs)))


def _median_and_mean(coefs: np.ndarray) -> np.ndarray:
    return np.stack((_median(coefs), coefs.mean(axis=0)))


def _shares(df: DataFrame, least: float = 0.0) -> DataFrame:
    return stats.normalise(df.where(F.col("s") > least), [], "s", "share").select("hk", F.col("share").alias("s"))


def _trimmed(rows: DataFrame, history: int) -> tuple[DataFrame, int]:
    """The last ``history`` positions, counted from 0; and how many there are."""
    span = rows.agg(F.max("pos").alias("m")).first()["m"]
    if span is None:
        return rows, 0
    first = max(0, span + 1 - history)
    return rows.where(F.col("pos") >= first).withColumn("pos", F.col("pos") - first), span + 1 - first


def selection(rows: DataFrame, length: int, window: int, refit: int, fit_rows: int, lag: int, half_life: float, per_day: float, least_rows: int, least_windows: int, features: list[str]) -> DataFrame:
    """X01 steps 4-5/W24: per participant the recency-weighted AUC of scores outside the fit in windows of ``window`` rows: hk, n, score.

    Models are refitted every ``refit`` rows on the ``fit_rows`` before (less
    ``lag``); windows of fewer than ``least_rows`` scored rows or one class don't
    count; below ``least_windows`` the score is 0.5. ``rows`` bring ``w``.
    """
    begins = range(min(fit_rows // 2, length // 2), length - lag, refit)
    listed = [fits.Segment(i, b, min(b + refit, length), max(0, b - fit_rows), max(0, b - lag)) for i, b in enumerate(begins)]
    scored = fits.out_of_sample(rows, "hk", "pos", features, "y", listed, balanced=True, weight="w")
    daily = stats.auc(scored.withColumn("window", F.floor(F.col("pos") / window)), ["hk", "window"], "z", F.col("y") == 1)
    enough = daily.where((F.col("n1") + F.col("n0") >= least_rows) & F.col("auc").isNotNull())
    age = (F.lit(length) - F.least((F.col("window") + 1) * window, F.lit(length))) / F.lit(float(per_day))
    mean = stats.recency_mean(enough, ["hk"], age, "auc", half_life, least_windows)
    return mean.select("hk", "n", F.coalesce("recency_mean", F.lit(0.5)).alias("score"))


@scorer("binary")
def walk_forward(rows: DataFrame, chunk: int = 4000, lag: int = 60, window: int = 1440, refit: int = 7200, fit_rows: int = 43_200, half_life: float = 15.0, per_day: float = 1440.0, least_rows: int = 80, least_windows: int = 5, top: int = 50, margin: float = 0.005, extra: int = 15, replicates: int = 10, block: int = 120, history: int = 86_400, weight_half_life: float = 15.0) -> DataFrame:
    """Rows (hk, pos, x, y), x a number or both elements of a vector: selection by decayed AUC, banded top, columns outside the fit, bootstrapped elastic net.

    Base fits are balanced and weighted by time (W11); so is the meta fit.
    """
    vector = rows.schema["x"].dataType.typeName() == "array"
    features = ["x0", "x1"] if vector else ["x0"]
    given = [F.col("x")[i].cast("double").alias(f) for i, f in enumerate(features)] if vector else [F.col("x").cast("double").alias("x0")]
    rows, length = _trimmed(cut(rows.select("hk", "pos", *given, F.col("y").cast("int").alias("y"))), history)
    empty = rows.select("hk", F.col("x0").alias("s")).limit(0)
    if not length:
        return empty
    # Weights of mean 1 over the positions; ages count back from the last one.
    step = math.log(2) / (per_day * weight_half_life)
    scale = length / sum(math.exp(-step * age) for age in range(1, length + 1))
    weighted = rows.withColumn("w", F.lit(scale) * F.exp(F.lit(-step) * (F.lit(length) - F.col("pos"))))
    active = weighted.where(" OR ".join(f"{f} != 0" for f in features))
    best = windows.banded_top(selection(active, length, window, refit, fit_rows, lag, half_life, per_day, least_rows, least_windows, features), [], "score", "hk", top, margin, extra, 0.5)
    members = cut(_members(best))
    listed = [fits.Segment(i, s + lag, min(s + chunk, length), 0, s) for i, s in enumerate(range(0, length - lag, chunk))]
    oos = cut(fits.out_of_sample(active.join(members.select("hk"), "hk", "left_semi"), "hk", "pos", features, "y", listed, balanced=True, weight="w"))
    values = oos.join(members, "hk").select(F.lit("all").alias("g"), F.col("pos").alias("at"), "slot", F.col("z").alias("x"))
    cells = oos.select(F.lit("all").alias("g"), F.col("pos").alias("at"), "y").distinct().withColumn("w", F.lit(scale) * F.exp(F.lit(-step) * (F.lit(length) - F.col("at"))))
    found = fits.logistic(cut(fits.panel(cells, values)), _widths(members), fits.Resampling(replicates, block), 1.0, 0.5, summary=_median)
    return _shares(_importance(members, found), 1e-6) if found else empty


def _candidates(sent: DataFrame, aucs: DataFrame, segments: DataFrame, top: int) -> DataFrame:
    """(segment, hk, auc): participants with an AUC in a segment and, at 0.5, the first ``top`` names of all others: none of these others can be among the ``top``."""
    named, known = cut(_members(sent)), cut(aucs.where("auc IS NOT NULL"))
    listed = known.join(named, "hk").groupBy("segment").agg(F.collect_set("slot").alias("known"))
    none = F.array().cast("array<int>")
    given = segments.join(listed, "segment", "left").select("segment", F.coalesce("known", none).alias("known"))
    last = F.least(F.lit(named.count()), F.size("known") + top) - 1
    others = F.slice(F.array_sort(F.array_except(F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(none), "known")), 1, top)
    return known.unionByName(given.select("segment", F.explode(others).alias("slot")).join(named, "slot").select("segment", "hk", F.lit(0.5).alias("auc")))


@scorer("xsec_rank")
def cross_section(rows: DataFrame, chunk: int = 8000, lag: int = 60, top: int = 20, half_life: float = 3.0, replicates: int = 20, block: int = 120, least_distinct: int = 0, embargo: int = 0, history: int = 86_400, least_rows: int = 200, seed: int = 42) -> DataFrame:
    """Rows (hk, pos, asset, x, y) pooled over assets. Per segment: selection on the rows before it, columns outside the fit, bootstrapped L2 meta fit, AUC of its votes; importance |coef| · AUC gain, weighted by recency.

    ``embargo`` (X09) keeps labels that reach that far ahead out of every fit.
    A segment counts when selection, training and validation have
    ``least_rows`` rows and both classes.
    """
    empty = rows.select("hk", F.lit(0.0).alias("s")).limit(0)
    rows, length = _trimmed(cut(rows.where("y IS NOT NULL").select("hk", "pos", "asset", F.coalesce(F.col("x").cast("double"), F.lit(0.0)).alias("x"), F.col("y").cast("int").alias("y"))), history)
    lead, gap = max(lag, embargo), embargo or lag
    segs = [(i, s, s + lead, min(s + chunk, length)) for i, s in enumerate(range(0, length, chunk)) if s + lead < min(s + chunk, length)]
    if not segs:
        return empty
    judge = {}
    for i, _, start, _ in segs:
        end = max(0, start - embargo)
        judge[i] = fits.Segment(i, max(0, end - chunk), end, 0, max(0, max(0, end - chunk) - gap))
    # Rows of all participants: how many there are where, a number per class and position of the history.
    cells = cut(rows.groupBy("pos", "asset").agg(F.max("y").alias("y")))
    upto = np.zeros((2, length + 1), dtype=np.int64)
    for r in cells.groupBy("pos").agg(F.count_if(F.col("y") == 0).alias("n0"), F.count_if(F.col("y") == 1).alias("n1")).toLocalIterator():
        upto[:, r.pos + 1] = r.n0, r.n1
    upto = upto.cumsum(axis=1)
    inside = lambda low, high: upto[:, max(low, high)] - upto[:, low]
    counts = {i: (inside(0, judge[i].fit_end), inside(judge[i].start, judge[i].end), inside(start, end)) for i, _, start, end in segs}
    usable = [x for x in segs if all(n.min() > 0 and n.sum() >= least_rows for n in counts[x[0]])]
    if not usable:
        return empty
    sent = rows.where("x != 0")
    tried = fits.out_of_sample(sent, "hk", "pos", ["x"], "y", [judge[i] for i, *_ in usable], keep=["asset"], least_distinct=least_distinct)
    aucs = stats.auc(tried, ["segment", "hk"], "z", F.col("y") == 1).where("n1 + n0 >= 20").select("segment", "hk", "auc")
    spark = rows.sparkSession
    numbers = spark.createDataFrame([(i,) for i, *_ in usable], "segment long")
    members = cut(_members(windows.top_k(_candidates(sent, aucs, numbers, top), ["segment"], "auc", "hk", top), "segment"))
    # Scores outside the fit, chunk by chunk: those of earlier chunks train a segment's meta fit, those of its own validate it.
    listed = [fits.Segment(i, start, end, 0, start - embargo) for i, _, start, end in segs]
    base = cut(fits.out_of_sample(sent.join(members.select("hk").distinct(), "hk", "left_semi"), "hk", "pos", ["x"], "y", listed, keep=["asset"]).withColumnRenamed("segment", "chunk"))
    placed = cut(base.join(members, "hk").where("chunk <= segment"))
    assets = {r.asset: k for k, r in enumerate(cells.select("asset").distinct().orderBy("asset").collect())}
    at = F.col("pos") * len(assets) + F.create_map(*(F.lit(v) for pair in assets.items() for v in pair))[F.col("asset")]
    train = placed.where("chunk < segment").select(F.col("segment").cast("string").alias("g"), at.alias("at"), "y", "slot", F.col("z").alias("x"))
    rows_ = cut(fits.panel(train.select("g", "at", "y").distinct().withColumn("w", F.lit(1.0)), train.select("g", "at", "slot", "x")))
    found = fits.logistic(rows_, _widths(members, "segment"), fits.Resampling(replicates, block, 0, seed), 0.5, salt={str(i): 7919 * (i + 1) for i, *_ in usable}, summary=_median_and_mean)
    enough = {r.g for r in rows_.groupBy("g").agg(F.count("*").alias("n")).collect() if r.n >= least_rows}
    found = {g: f for g, f in found.items() if g in enough}
    if not found:
        return empty
    votes = placed.where("chunk = segment").join(_importance(members, {g: f.reshape(2, -1)[1] for g, f in found.items()}, "segment"), ["segment", "hk"])
    voted = votes.groupBy("segment", "pos", "asset").agg(F.sum(F.col("z") * F.col("s")).alias("vote"))
    # A position is validated by its own segment only.
    own = F.floor(F.col("pos") / chunk).cast("long")
    fitted = spark.createDataFrame([(int(g),) for g in found], "segment long")
    judged = cells.withColumn("segment", own).where(F.col("pos") >= F.col("segment") * chunk + lead).join(F.broadcast(fitted), "segment").select("segment", "pos", "asset", "y")
    gains = stats.auc(judged.join(voted, ["segment", "pos", "asset"], "left").withColumn("vote", F.coalesce("vote", F.lit(0.0))), ["segment"], "vote", F.col("y") == 1)
    weight = F.pow(F.lit(0.5), (F.lit(segs[-1][0]) - F.col("segment")) / half_life) * stats.auc_scale(F.col("auc"))
    total = _importance(members, {g: f.reshape(2, -1)[0] for g, f in found.items()}, "segment").join(gains, "segment").groupBy("hk").agg(F.sum(weight * F.col("s")).alias("s"))
    return _shares(total, 0.0)


@scorer("funding_xsec")
def funding_cross_section(rows: DataFrame, ahead: int = 480, least_distinct: int = 5, **options: float) -> DataFrame:
    """X08 with labels ``ahead`` rows ahead kept out of all fits, stale columns zeroed (F18) and enough distinct values asked for."""
    fresh = filters.unstale(rows, ["hk", "asset"], "x").withColumn("x", F.col("fresh")).drop("fresh")
    return cross_section(fresh, embargo=ahead, least_distinct=least_distinct, **options)


@scorer("hitfirst")
def first_hit(rows: DataFrame, blocks: int = 4) -> DataFrame:
    """Rows (hk, pos, up, down, hit) with logits of both probabilities: leave-one-block-out importance for up (0) and down (1) hits, summed. All participants are columns."""
    rows = cut(rows.where("hit IS NOT NULL"))
    members = cut(_members(rows))
    sides = F.explode(F.array(F.struct(F.lit("0").alias("g"), F.col("up").alias("x")), F.struct(F.lit("1").alias("g"), F.col("down").alias("x"))))
    values = rows.join(members, "hk").select("pos", "slot", sides.alias("t")).select("t.g", F.col("pos").alias("at"), "slot", "t.x").where("x IS NOT NULL")
    cells = rows.groupBy("pos").agg(F.max("hit").alias("hit")).select(F.explode(F.array(F.lit(0), F.lit(1))).alias("side"), F.col("pos").alias("at"), "hit").select(F.col("side").cast("string").alias("g"), "at", (F.col("hit") == F.col("side")).cast("int").alias("y"), F.lit(1.0).alias("w"))
    k = members.count()
    found = fits.logistic(cut(fits.panel(cells, values)), {"0": k, "1": k}, fits.Resampling(left_out=blocks), 1.0)
    if not found:
        return rows.select("hk", F.lit(0.0).alias("s")).limit(0)
    return _shares(_importance(members, {"all": sum(np.abs(coefs).mean(axis=0) for coefs, _ in found.values())}))


@scorer("range_breakout_multi")
def breakout(samples: DataFrame, gap: int = 1440, least_episodes: int = 2, least_spread: float = 0.03, c: float = 0.01) -> DataFrame:
    """Samples (hk, source, trigger_sidx, p, label): qualification, z-scores, episode-weighted L2 fit, |coef| shares."""
    times = samples.select(F.lit("all").alias("one"), "trigger_sidx").distinct()
    episode = windows.episodes(times, "one", "trigger_sidx", gap).select("trigger_sidx", "episode")
    rows = cut(samples.join(episode, "trigger_sidx"))
    ok = events.qualified(rows, "hk", "p", "label", "episode", least_episodes, least_spread)
    good = stats.auc(rows, ["hk"], "p", F.col("label") == 1).where("auc > 0.5").join(ok.select("hk"), "hk", "left_semi")
    members = cut(_members(good))
    z = stats.zscore(rows.join(members, "hk"), ["hk"], "p")
    cells = events.episode_weights(z.groupBy("source", "trigger_sidx", "episode").agg(F.max("label").alias("y")), "episode").withColumn("at", F.row_number().over(Window.orderBy("trigger_sidx", "source")).cast("long"))
    # One row per resolved event: a few thousand, whatever the readings' number.
    cells = cut(cells.select(F.lit("all").alias("g"), "at", "y", F.col("weight").alias("w"), "source", "trigger_sidx"))
    values = z.join(cells.select("g", "at", "source", "trigger_sidx"), ["source", "trigger_sidx"]).select("g", "at", "slot", F.col("z").alias("x"))
    found = fits.logistic(cut(fits.panel(cells, values)), _widths(members), fits.Resampling(), c, summary=_median)
    if not found:
        return rows.select("hk", F.lit(0.0).alias("s")).limit(0)
    return _shares(_importance(members, found), 1e-6)


@scorer("lbfgs")
def bucket_votes(rows: DataFrame, classes: int = 5, warm_up: int = 24_000, chunk: int = 12_000, longest: int = 36_000, gamma: float = 0.681, top: int = 25, meta_top: int = 100, replicates: int = 20, block: int = 120, recent: int = 14_000, recent_mass: float = 0.5, c: float = 0.1, least_rows: int = 200, history: int = 432_000) -> DataFrame:
    """Rows (hk, pos, guess, truth, p), p the probabilities of the classes. Per segment: lift of the balanced accuracy, weighted by a bootstrapped L2 meta fit of each class on the rows before (squared coefficients, so that copies share); segments whose weighted vote beats chance count, by recency; uniqueness against better participants; top.

    A participant without a row at a position counts as guessing class 0 with
    even probabilities, as an empty vector does.
    """
    empty = rows.select("hk", F.lit(0.0).alias("s")).limit(0)
    rows, length = _trimmed(cut(rows.select("hk", "pos", "guess", "truth", "p")), history)
    segs = [(i, s, min(s + chunk, length)) for i, s in enumerate(range(warm_up, length, chunk)) if min(s + chunk, length) - s >= least_rows]
    if not segs:
        return empty
    truths = cut(rows.groupBy("pos").agg(F.max("truth").alias("truth")))
    everyone = rows.select("hk").distinct()

    def spans(first: Column, last: Column, low: Callable[[Column], Column], high: Callable[[Column], Column]) -> Column:
        """A row per segment from ``first`` to ``last``, with its bounds."""
        first, last = F.greatest(first, F.lit(0)).cast("int"), F.least(last, F.lit(len(segs) - 1)).cast("int")
        start = lambda i: F.lit(warm_up) + i * chunk
        return F.explode(F.transform(F.when(first <= last, F.sequence(first, last)), lambda i: F.struct(i.alias("segment"), low(start(i)).alias("low"), high(start(i)).alias("high"))))

    at = lambda more: F.floor((F.col("pos") - warm_up + more) / chunk)
    own = spans(F.when(F.col("pos") >= warm_up, at(0)).otherwise(len(segs)), at(0), lambda s: s, lambda s: F.least(s + chunk, F.lit(length)))
    before = spans(at(0) + 1, at(longest), lambda s: F.greatest(s - longest, F.lit(0)), lambda s: s)

    def lifts(within: Column) -> DataFrame:
        """(segment, hk, ba): mean recall over all classes, absent rows as class 0."""
        place = lambda df: df.withColumn("t", within).withColumn("segment", F.col("t.segment")).drop("t")
        all_ = place(truths).groupBy("segment", "truth").agg(F.count("*").alias("n"))
        hits = place(rows).groupBy("segment", "hk", "truth").agg(F.count("*").alias("sent"), F.count_if(F.col("guess") == F.col("truth")).alias("hit"))
        recall = all_.join(everyone.select("hk", F.explode(F.sequence(F.lit(0), F.lit(len(segs) - 1))).alias("segment")), "segment").join(hits, ["segment", "hk", "truth"], "left")
        right = F.coalesce("hit", F.lit(0)) + F.when(F.col("truth") == 0, F.col("n") - F.coalesce("sent", F.lit(0))).otherwise(0)
        return recall.groupBy("segment", "hk").agg((F.sum(right / F.col("n")) / F.lit(float(classes))).alias("ba"))

    lift = cut(lifts(own).select("segment", "hk", F.greatest(F.col("ba") - 1.0 / classes, F.lit(0.0)).alias("lift")))
    members = cut(_members(windows.top_k(lifts(before), ["segment"], "ba", "hk", meta_top), "segment"))
    # One meta fit per segment and class, weighted towards the recent rows.
    placed = truths.withColumn("t", before).select(F.col("t.segment").alias("segment"), "pos", "truth", F.col("t.high").alias("end"), (F.col("t.high") - F.col("t.low")).alias("n"))
    new = F.col("pos") >= F.col("end") - recent
    old = F.greatest(F.col("n") - recent, F.lit(0))
    mass = F.when(old == 0, F.lit(1.0)).otherwise(F.when(new, recent_mass * F.col("n") / recent).otherwise((1 - recent_mass) * F.col("n") / old))
    kinds = F.explode(F.sequence(F.lit(0), F.lit(classes - 1)))
    g = F.concat_ws("|", F.col("segment").cast("string"), F.col("k").cast("string")).alias("g")
    cells = placed.withColumn("w", mass).withColumn("k", kinds).select(g, F.col("pos").alias("at"), (F.col("truth") == F.col("k")).cast("int").alias("y"), "w")
    sent = rows.withColumn("t", before).select(F.col("t.segment").alias("segment"), "pos", "hk", "p").join(members, ["segment", "hk"])
    values = sent.select("segment", "pos", "slot", F.posexplode("p").alias("k", "x")).select(g, F.col("pos").alias("at"), "slot", "x")
    width = {f"{s}|{k}": n for s, n in _widths(members, "segment").items() for k in range(classes)}
    salt = {f"{i}|{k}": 1000 * (i + 1) + k for i, *_ in segs for k in range(classes)}
    found = fits.logistic(cut(fits.panel(cells, values)), width, fits.Resampling(replicates, block), c, penalise_intercept=True, fill=1.0 / classes, salt=salt, summary=_median)
    squared: dict[str, np.ndarray] = {}
    for name, value in found.items():
        squared[name.split("|")[0]] = squared.get(name.split("|")[0], 0.0) + value**2
    peak = {s: v / v.max() for s, v in squared.items() if v.max() > 0}
    meta = _importance(members, peak, "segment").withColumnRenamed("s", "meta")
    told = F.col("segment").cast("string").isin(*peak)
    weighed = cut(lift.where("lift > 0").join(meta, ["segment", "hk"], "left").withColumn("s", F.col("lift") * F.when(told, F.coalesce("meta", F.lit(0.0))).otherwise(1.0)).where("s > 0").select("segment", "hk", "s"))
    total = weighed.groupBy("segment").agg(F.sum("s").alias("total"))
    # The vote of everybody with weight; those absent vote for class 0.
    cast = rows.withColumn("t", own).select(F.col("t.segment").alias("segment"), "pos", "hk", "guess").join(weighed, ["segment", "hk"]).groupBy("segment", "pos").agg(*(F.sum(F.when(F.col("guess") == k, F.col("s")).otherwise(0.0)).alias(f"v{k}") for k in range(classes)))
    voted = truths.withColumn("t", own).select(F.col("t.segment").alias("segment"), "pos", "truth").join(total, "segment").join(cast, ["segment", "pos"], "left").fillna(0.0)
    absent = F.col("total") - sum((F.col(f"v{k}") for k in range(1, classes)), F.lit(0.0))
    best = F.greatest(absent, *(F.col(f"v{k}") for k in range(1, classes)))
    choice = F.coalesce(*(F.when((absent if k == 0 else F.col(f"v{k}")) == best, F.lit(k)) for k in range(classes)))
    won = stats.balanced_accuracy(voted.withColumn("vote", choice), ["segment"], "truth", "vote", classes).where(F.col("ba_present") > 1.0 / classes)
    recency = F.pow(F.lit(gamma), F.lit(segs[-1][0]) - F.col("segment"))
    scored = cut(weighed.join(won.select("segment"), "segment", "left_semi").groupBy("hk").agg(F.sum(recency * F.col("s")).alias("s")).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("s"), "hk"))))
    tail = truths.where(F.col("pos") >= length - chunk).select("pos")
    unique = similarity.agreement(tail, rows.join(scored.select("hk", "rank"), "hk"), "pos", "hk", "rank", "guess", classes)
    final = scored.join(unique, "hk").select("hk", (F.col("s") * F.col("uniqueness")).alias("s"))
    return _shares(windows.top_k(final.where("s > 0"), [], "s", "hk", top).select("hk", "s"))


@scorer("q_path")
def gated_models(rows: DataFrame, least_rows: int = 100, top: int = 25, replicates: int = 20, block: int = 120, c: float = 0.5, recent: int = 14_000, recent_mass: float = 0.5) -> DataFrame:
    """Rows (model, hk, pos, x, y): one bootstrapped fit of all participants per gated sub-model, weighted towards the recent rows (W12), each normalised, averaged over the models, top."""
    rows = cut(rows.where("y IS NOT NULL"))
    cells = rows.groupBy("model", "pos").agg(F.max("y").alias("y"))
    size = cells.groupBy("model").agg(F.count("*").alias("n"), F.countDistinct("y").alias("classes")).where((F.col("n") >= least_rows) & (F.col("classes") == 2))
    members = cut(_members(rows))
    weighed = windows.recent_mass_weights(cells.join(size.select("model"), "model", "left_semi"), "model", "pos", recent, recent_mass)
    values = rows.join(members, "hk").where("x IS NOT NULL").select(F.col("model").alias("g"), F.col("pos").alias("at"), "slot", "x")
    k = members.count()
    found = fits.logistic(cut(fits.panel(weighed.select(F.col("model").alias("g"), F.col("pos").alias("at"), "y", F.col("weight").alias("w")), values)), {r.model: k for r in size.collect()}, fits.Resampling(replicates, block), c, penalise_intercept=True, summary=_median)
    each = [v / v.sum() for v in found.values() if v.sum() > 0]
    if not each:
        return rows.select("hk", F.lit(0.0).alias("s")).limit(0)
    return _shares(windows.top_k(_importance(members, {"all": np.mean(each, axis=0)}).where("s > 0"), [], "s", "hk", top).select("hk", "s"))


@scorer("trade_mix")
def position_evidence(rows: DataFrame, labels: list[str], weights: list[float], least_shift: int = 96, q: float = 0.05, cap: float = 0.2) -> DataFrame:
    """X11, last part: rows (hk, pos, signal, <labels>): circular-shift evidence, discoveries, softplus payment, capped shares."""
    tested = fits.shift_evidence(rows, "hk", "pos", "signal", labels, weights, least_shift)
    found = stats.discoveries(tested, [], "p", "hk", q).withColumn("s", stats.softplus(F.col("t") - 2))
    capped = stats.cap_shares(_shares(found), [], "s", cap, "capped")
    return capped.select("hk", F.col("capped").alias("s"))


@scorer("trade_mix_panel")
def trade_mix(positions: DataFrame, factors: DataFrame, horizons: tuple[int, ...] = (4, 12, 24), blend: tuple[float, ...] = (0.5, 0.3, 0.2), beta_horizon: int = 12, least_shift: int = 96, q: float = 0.05, least_age: int = 504, least_cover: float = 0.9, cover_window: int = 504, dedup_window: int = 720, attr_window: int = 720, fee: float = 0.0005, senior: float = 0.2, same: float = 0.95, least_spread: float = 1e-4, shift: float = 2.0, cap: float = 0.2, split: tuple[float, float] = (0.8, 0.2)) -> DataFrame:
    """X11: positions (h, hk, asset, pos) on the hours of factors (h, asset, weight, beta, r), h counting from 0: evidence, costs and clusters of the residual and the market channel, blended.

    P20/P21 decompose positions; juniors' residual books lose what they share
    with seniors (M14); per channel: circular-shift evidence (M15),
    discoveries among those past probation (F23, A30), payment by evidence,
    profit after cost (A27) and coverage (A28), credit shared inside clusters
    of equal books (M13, A33), capped (A32). Inner products of books are
    summed by the executors; a panel has as many participants as tickers' slots.
    """
    empty = positions.select("hk", F.lit(0.0).alias("s")).limit(0)
    positions = cut(positions.where("pos IS NOT NULL AND pos != 0"))
    hours = factors.agg((F.max("h") + 1).alias("n")).first()["n"] or 0
    if hours < 3 * least_shift or positions.isEmpty():
        return empty
    market = factors.groupBy("h").agg(F.sum(F.col("weight") * F.col("r")).alias("mkt"))
    members = cut(_members(positions))
    # Every participant has a book of every hour and asset; absent is flat.
    book = factors.select("h", "asset", "weight", "beta", "r").join(market, "h").withColumn("resid", F.col("r") - F.col("beta") * F.col("mkt"))
    held = positions.join(book.select("h", "asset", "weight", "beta"), ["h", "asset"]).withColumn("pos", vectors.clip(F.col("pos"), -1.0, 1.0))
    m = cut(held.groupBy("h", "hk").agg(F.sum(F.col("weight") * F.col("pos")).alias("m")))
    exposed = m.join(book.select("h", "asset", "beta"), "h").join(held.select("h", "hk", "asset", "pos"), ["h", "hk", "asset"], "left")
    books = cut(exposed.select("h", "hk", "asset", (F.coalesce("pos", F.lit(0.0)) - F.col("m") * F.col("beta")).alias("q")).join(members, "hk"))
    names = [r.hk for r in members.orderBy("slot").collect()]
    seen = m.groupBy("hk").agg(F.min("h").alias("first"), (F.count_if(F.col("h") >= hours - cover_window) / min(cover_window, hours)).alias("cover"), (F.count_if(F.col("h") >= hours - least_age) / min(least_age, hours)).alias("recent"))
    ages = {r.hk: r for r in seen.collect()}
    gram = similarity.gram(books, ["h", "asset"], "slot", "q", len(names))
    late = similarity.gram(books.where(F.col("h") >= hours - dedup_window), ["h", "asset"], "slot", "q", len(names))
    size = np.sqrt(np.diag(late)) + 1e-12
    alike = late / np.outer(size, size)
    order = np.lexsort((np.argsort(np.argsort(names, kind="stable")), [ages[n].first for n in names]))
    made = solvers.residualise(gram, order, senior, alike)
    mix = positions.sparkSession.createDataFrame([(int(i), names[j], float(made[j, i])) for j in range(len(names)) for i in np.flatnonzero(made[j])], "slot int, hk string, c double")
    own = books.drop("hk").join(mix, "slot").groupBy("h", "hk", "asset").agg(F.sum(F.col("c") * F.col("q")).alias("q"))
    spread = books.groupBy("hk").agg(F.sum("q").alias("a"), F.sum(F.col("q") ** 2).alias("b")).select("hk", F.sqrt(F.greatest(F.col("b") / (hours * F.lit(1.0)), F.lit(0.0))).alias("spread"))
    active = {r.hk for r in spread.where(F.col("spread") >= least_spread).collect()}

    def ahead(df: DataFrame, source: str, value: str, n: int, to: str) -> DataFrame:
        placed = windows.blocks(df, source, "h", n + 1)
        return windows.core(placed.withColumn(to, windows.forward_sum(F.col(value), n, windows.over(source)))).drop("pos")

    labelled = book.select("h", "asset", "resid")
    for n in horizons:
        labelled = ahead(labelled, "asset", "resid", n, f"y{n}")
    full = _filled(own, labelled, members.select("hk"), ["h", "asset"], "q")
    rv = fits.shift_evidence(full, "hk", "h", "q", [f"y{n}" for n in horizons], list(blend), least_shift, "asset")
    beta = ahead(market.withColumn("one", F.lit(0)), "one", "mkt", beta_horizon, "y").select("h", "y")
    be = fits.shift_evidence(_filled(m, beta, members.select("hk"), ["h"], "m"), "hk", "h", "m", ["y"], [1.0], least_shift)
    since = hours - attr_window
    gains = _profit(books.where(F.col("h") >= since).select("h", "hk", "asset", "q"), book.select("h", "asset", "resid"), ["asset"], "q", "resid", fee), _profit(m.where(F.col("h") >= since), market, [], "m", "mkt", fee)
    old = [n for n in names if hours - ages[n].first >= least_age and ages[n].recent >= least_cover]
    shares: dict[str, float] = {}
    for part, tested, gain, who in ((split[0], rv, gains[0], [n for n in old if n in active]), (split[1], be, gains[1], old)):
        every = {r.hk: (r.t, r.p) for r in tested.collect()}
        paid = {r.hk: max(0.0, r.gain) for r in gain.collect()}
        passed = {r.hk for r in stats.discoveries(tested.where(F.col("hk").isin(who)), [], "p", "hk", q).select("hk").collect()} if who else set()
        t = np.array([every.get(n, (0.0, 1.0))[0] for n in names])
        raw = np.array([(np.logaddexp(0.0, t[i] - shift) * paid.get(n, 0.0) * ages[n].cover) if n in passed else 0.0 for i, n in enumerate(names)])
        for name, share in zip(names, solvers.capped_credit(raw, solvers.greedy_clusters(alike, same, np.argsort(-t, kind="stable")), cap), strict=True):
            shares[name] = shares.get(name, 0.0) + part * share
    told = [(n, float(v)) for n, v in shares.items() if v > 1e-9]
    return positions.sparkSession.createDataFrame(told, "hk string, s double") if told else empty


def _filled(values: DataFrame, grid: DataFrame, who: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The whole grid for every participant of a panel, 0 where there is no value."""
    listed = who.agg(F.collect_list("hk").alias("hks"))
    every = grid.withColumn("hk", F.explode(listed.scalar()))
    return every.join(values, [*keys, "hk"], "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def _profit(book: DataFrame, moves: DataFrame, keys: list[str], value: str, move: str, fee: float) -> DataFrame:
    """(hk, gain): what each book earned by the next hour's moves, less the cost of its changes (absent hours are flat)."""
    nxt = moves.select((F.col("h") - 1).alias("h"), *keys, F.col(move).alias("_next"))
    span = moves.agg(F.max("h")).scalar()
    earned = book.join(nxt, ["h", *keys]).groupBy("hk").agg(F.sum(F.col(value) * F.col("_next")).alias("pnl"))
    steps = book.select("h", "hk", *keys, F.col(value).alias("d")).unionByName(book.where(F.col("h") < span).select((F.col("h") + 1).alias("h"), "hk", *keys, (-F.col(value)).alias("d")))
    first = book.agg(F.min("h")).scalar()
    turned = steps.groupBy("h", "hk", *keys).agg(F.sum("d").alias("d")).where(F.col("h") > first).groupBy("hk").agg(F.sum(F.abs("d")).alias("turn"))
    return earned.join(turned, "hk", "full_outer").select("hk", (F.coalesce("pnl", F.lit(0.0)) - fee * F.coalesce("turn", F.lit(0.0))).alias("gain"))


def cohort_score(kind: str, rows: DataFrame, cohorts: DataFrame, **options) -> DataFrame:  # noqa: ANN003
    """The score of a task of which only cohorts' representatives take part (member, representative); members share their cohort's equally."""
    others = cohorts.where("member != representative").select(F.col("member").alias("hk"))
    return similarity.equalise_mass(score(kind, rows.join(others, "hk", "left_anti"), **options), "hk", "s", cohorts)


def combined(parts: list[tuple[DataFrame, float]], k: int = 50) -> DataFrame:
    """Near-uniform maps dropped, each decayed by rank, weighted over the tasks that gave a score, normalised."""
    kept = []
    for part, weight in parts:
        guard = stats.uniform_guard(part, [], "s").first()
        if guard is not None and guard["n"] and not (guard["near_uniform"] and guard["n"] > 1):
            kept.append((windows.rank_decay(part, [], "s", "hk", k).select("hk", F.col("share").alias("s")), weight))
    if not kept:
        return parts[0][0].limit(0)
    return stats.task_average([p for p, _ in kept], [w for _, w in kept], "hk", "s")


def clone_tiers(scores: DataFrame, exact: DataFrame, cohorts: DataFrame) -> DataFrame:
    """Exact clones (member, representative) collapse into their representative; the other members of soft cohorts share equally."""
    collapsed = similarity.collapse_mass(scores, "hk", "s", exact)
    clones = exact.where("member != representative").select("member")
    return similarity.equalise_mass(collapsed, "hk", "s", cohorts.join(clones, "member", "left_anti"))


def final_weights(scores: DataFrame, uids: DataFrame, first_seen: DataFrame, previous: DataFrame, now: int, young_age: int, young_share: float, burn: float, burn_uid: int = 0, alpha: float = 0.3) -> DataFrame:
    """(uid, w) from (hk, s): known participants only, young ones a fixed share, a burned share, smoothed over ``previous`` (uid, w), sum 1."""
    known = uids.join(scores, "hk", "left").join(first_seen, "hk", "left")
    young = F.coalesce(F.lit(now) - F.col("first_seen") < young_age, F.lit(True))
    per = known.groupBy("uid").agg(F.sum(F.coalesce("s", F.lit(0.0))).alias("s"), F.max(young).alias("young"))
    shared = stats.compose_shares(per, "uid", "s", F.col("young"), young_share)
    burned = shared.withColumn("w", F.col("share") * (1 - burn) + F.when(F.col("uid") == burn_uid, F.lit(burn)).otherwise(0.0))
    return stats.ema(stats.normalise(burned, [], "w", "w1").select("uid", F.col("w1").alias("w")), previous, "uid", "w", alpha)


def score(kind: str, rows: DataFrame, **options) -> DataFrame:  # noqa: ANN003
    """The registered scorer of a loss function."""
    if kind not in REGISTRY:
        raise KeyError(f"no scorer for {kind!r}; known: {', '.join(sorted(REGISTRY))}")
    return REGISTRY[kind](rows, **options)

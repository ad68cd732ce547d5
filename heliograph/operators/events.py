"""Range-breakout events per source: batch replay, and the same machine on a stream.

A fold over a source's readings in time: one pending event per side, armed when
the price leaves the trailing range, resolved by its barriers or dropped when
stale. The fold is sequential by nature; batch and stream share ``Tracker``.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EVENT_SCHEMA = "trigger_sidx bigint, resolved_sidx bigint, direction int, trigger_price double, range_high double, range_low double, label int"


@dataclass
class Tracker:
    """State of one source: pending events by side and the trailing window of readings."""

    lookback: int = 5760
    barrier: float = 0.25
    least_range: float = 0.01
    stale: int = 8640
    replay: bool = True
    pending: dict[int, dict] = field(default_factory=dict)
    highs: deque = field(default_factory=deque)
    lows: deque = field(default_factory=deque)
    times: deque = field(default_factory=deque)

    def _range(self, sidx: int) -> tuple[float, float, int]:
        """High, low and count of readings in [sidx - lookback, sidx); monotone queues, O(1) per reading."""
        for queue in (self.highs, self.lows):
            while queue and queue[0][0] < sidx - self.lookback:
                queue.popleft()
        while self.times and self.times[0] < sidx - self.lookback:
            self.times.popleft()
        return (self.highs[0][1], self.lows[0][1], len(self.times)) if self.times else (0.0, 0.0, 0)

    def _resolve(self, sidx: int, price: float) -> list[dict]:
        done = []
        for side in (1, -1):
            event = self.pending.get(side)
            if event is None:
                continue
            if sidx - event["trigger_sidx"] > self.stale:
                del self.pending[side]
                continue
            width = (event["range_high"] - event["range_low"]) * self.barrier
            moved = side * (price - event["trigger_price"])
            if moved >= width or moved <= -width:
                done.append({**event, "resolved_sidx": sidx, "label": int(moved >= width)})
                del self.pending[side]
        return done

    def _arm(self, sidx: int, price: float, high: float, low: float, n: int) -> None:
        if n < self.lookback // 2 or high - low < self.least_range * price:
            return
        side = 1 if price > high else -1 if price < low else 0
        if side and side not in self.pending:
            self.pending[side] = {"trigger_sidx": sidx, "direction": side, "trigger_price": price, "range_high": high, "range_low": low}

    def update(self, sidx: int, price: float) -> list[dict]:
        """Events that one reading resolves. Replay resolves before it arms, a live tracker the other way round."""
        high, low, n = self._range(sidx)
        done: list[dict] = []
        if self.replay:
            done += self._resolve(sidx, price)
            self._arm(sidx, price, high, low, n)
        else:
            self._arm(sidx, price, high, low, n)
            done += self._resolve(sidx, price)
        while self.highs and self.highs[-1][1] <= price:
            self.highs.pop()
        while self.lows and self.lows[-1][1] >= price:
            self.lows.pop()
        self.highs.append((sidx, price))
        self.lows.append((sidx, price))
        self.times.append(sidx)
        return done

    def dump(self) -> dict:
        """The state as plain lists and numbers."""
        return {**asdict(self), "pending": {str(k): v for k, v in self.pending.items()}, "highs": list(self.highs), "lows": list(self.lows), "times": list(self.times)}

    @classmethod
    def load(cls, state: dict) -> Tracker:
        return cls(**{**state, "pending": {int(k): v for k, v in state["pending"].items()}, "highs": deque(map(tuple, state["highs"])), "lows": deque(map(tuple, state["lows"])), "times": deque(state["times"])})


def replay(readings: DataFrame, source: str, order: str, price: str, **options: float) -> DataFrame:
    """Resolved events of all readings in order: source and ``EVENT_SCHEMA``.

    Rows stream through one task per source in Arrow batches (an iterator, not
    a collected group), sorted by Spark with spilling.
    """

    kind = readings.schema[source].dataType.simpleString()
    rows = readings.where(F.col(price) > 0).select(source, order, price).repartition(source).sortWithinPartitions(source, order)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, tracker = None, Tracker(**options)
        for pdf in batches:
            out = []
            for who, sidx, p in zip(pdf[source], pdf[order], pdf[price], strict=True):
                if who != now:
                    now, tracker = who, Tracker(**options)
                out += [{source: who, **e} for e in tracker.update(int(sidx), float(p))]
            yield pd.DataFrame(out, columns=[source, "trigger_sidx", "resolved_sidx", "direction", "trigger_price", "range_high", "range_low", "label"])

    return rows.mapInPandas(fold, f"`{source}` {kind}, {EVENT_SCHEMA}")


def with_vectors(events: DataFrame, vectors: DataFrame, source: str, columns: list[str]) -> DataFrame:
    """Events beside the vectors submitted at their trigger (left join; late vectors are found whenever the join runs)."""
    at = vectors.select(F.col(source), F.col("sidx").alias("trigger_sidx"), *columns)
    return events.join(at, [source, "trigger_sidx"], "left")


def qualified(samples: DataFrame, who: str, score: str, label: str, episode: str, least_episodes: int = 2, least_spread: float = 0.03) -> DataFrame:
    """Participants with enough episodes, spread and both classes."""
    s = samples.groupBy(who).agg(F.countDistinct(episode).alias("episodes"), F.stddev_pop(score).alias("spread"), F.countDistinct(label).alias("classes"))
    return s.where((F.col("episodes") >= least_episodes) & (F.col("spread") >= least_spread) & (F.col("classes") == 2))


def episode_weights(samples: DataFrame, episode: str, to: str = "weight") -> DataFrame:
    """1 / rows of the episode, scaled so that all weights sum to the number of rows."""
    n = samples.groupBy(episode).agg(F.count("*").alias("_n"))
    scale = n.agg(F.sum("_n") / F.count("*")).scalar()
    return samples.join(n, episode).withColumn(to, scale / F.col("_n")).drop("_n")


def latest_state(states: DataFrame, source: str) -> DataFrame:
    """The last snapshot of each source."""
    w = Window.partitionBy(source).orderBy(F.desc("ts"), F.desc("state_json"))
    return states.where("state_json IS NOT NULL").withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")

"""The breakout machine on a stream, one state per source."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from heliograph.operators.events import EVENT_SCHEMA, Tracker


def track(stream: DataFrame, source: str, order: str, price: str, **options: float) -> DataFrame:
    """Events as their barriers are crossed. A micro-batch's readings of a source are taken in order; the state is the tracker's."""
    kind = stream.schema[source].dataType.simpleString()

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tracker = Tracker.load(json.loads(state.get[0])) if state.exists else Tracker(**{"replay": False, **options})
        rows = pd.concat(list(batches)).sort_values(order)
        out = []
        for sidx, p in zip(rows[order], rows[price], strict=True):
            out += [{source: key[0], **e} for e in tracker.update(int(sidx), float(p))]
        state.update((json.dumps(tracker.dump()),))
        yield pd.DataFrame(out, columns=[source, "trigger_sidx", "resolved_sidx", "direction", "trigger_price", "range_high", "range_low", "label"])

    rows = stream.where(f"`{price}` > 0").select(source, order, price)
    return rows.groupBy(source).applyInPandasWithState(step, f"`{source}` {kind}, {EVENT_SCHEMA}", "tracker string", "append", GroupStateTimeout.NoTimeout)

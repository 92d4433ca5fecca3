"""The state of keyed trackers on Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from flatspan.functions.tracking import STATE_SCHEMA, TrackerOptions, TrackerState
from flatspan.operators.keyed_tracking import follow

FIELDS = [f.strip().split(" ")[0] for f in STATE_SCHEMA.split(",")]
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def keyed_state(spark: SparkSession) -> None:
    """Choose the RocksDB state store, which state by key needs; it keeps a changelog by batch in the query's checkpoint."""
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class KeyedTracker(StatefulProcessor):
    """A key's tracker, and, where it waits for the watermark, the vectors whose time has not passed yet."""

    def __init__(self, options: TrackerOptions, waits: bool):
        self.options, self.waits = options, waits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tracker = handle.getValueState("tracker", STATE_SCHEMA)
        if self.waits:
            self.waiting = handle.getListState("waiting", "at long, id long, features array<double>")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        came = [r for b in rows for r in self._entries(b)]
        if not self.waits:
            yield from self._seen(key, came)
        else:
            self.waiting.appendList(came)
            for at in {at // 1000 for at, _, _ in came}:
                self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed, held = timerValues.getCurrentWatermarkInMs(), list(self.waiting.get())
        ripe = [tuple(r) for r in held if r[0] // 1000 <= passed]
        if ripe:  # the first of several timers sees all that have passed
            rest = [tuple(r) for r in held if r[0] // 1000 > passed]
            self.waiting.clear()
            if rest:
                self.waiting.put(rest)
            yield from self._seen(key, ripe)

    def _entries(self, b: pd.DataFrame) -> list[tuple]:
        """(microseconds, id, features) of a batch."""
        return [(int(t), int(i), None if f is None else [None if v is None or np.isnan(v) else float(v) for v in f]) for t, i, f in zip(b["at"], b["id"], b["features"], strict=True)]

    def _seen(self, key, entries: list[tuple]) -> Iterator[pd.DataFrame]:
        entries = sorted(entries, key=lambda e: e[:2])
        state = TrackerState.from_row(dict(zip(FIELDS, self.tracker.get(), strict=True))) if self.tracker.exists() else None
        state, low = follow(state, [e[1] for e in entries], [e[2] for e in entries], self.options)
        if state is not None:
            row = state.to_row()
            self.tracker.update(tuple(row[f] for f in FIELDS))
        yield pd.DataFrame({"key": [key[0]] * len(entries), "id": [e[1] for e in entries], "low_rank": low})

"""A subspace tracker for every key of a table or stream: many sources train side by side."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flatspan.functions.tracking import TrackerOptions, TrackerState, draws, start, step


def follow(state: TrackerState | None, ids: list[int], features: list, options: TrackerOptions) -> tuple[TrackerState | None, list[np.ndarray]]:
    """(state after the vectors in turn, each one's low-rank part by the basis it has turned). A null vector has no observed coordinate and changes nothing."""
    low = []
    for i, f in zip(ids, features, strict=True):
        if f is None:
            low.append(None)
            continue
        x = np.array([np.nan if v is None else v for v in f], dtype=float)
        state = state or start(options, len(x))
        state, part = step(state, x, options, draws(options, int(i)))
        low.append(part)
    return state, low


def output_schema(df: DataFrame) -> str:
    return f"key {df.schema['key'].dataType.simpleString()}, id long, low_rank array<double>"


def track_by_key(df: DataFrame, **options) -> DataFrame:
    """(key, id, low_rank): every vector separated by its key's own tracker, which learns from it and goes on to the next.

    df: key, time, id, features. A key's vectors come in order of time, then id (null first). Keys are independent: one shuffle
    puts a key's rows together, sorted by Spark (which spills), and a task streams through them holding one state. A null key
    is a key; repeated rows are seen each time, and an empty table gives an empty result. One key's rows follow each
    other, as the method demands, so the largest key bounds the time (never the memory) of a task.
    """
    given = TrackerOptions(**options)
    rows = df.select("key", F.col("id").cast("long").alias("id"), "features", "time").repartition("key").sortWithinPartitions("key", "time", "id")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        now, state = None, None
        for b in batches:
            low = []
            for key, i, f in zip(*(b.column(c).to_pylist() for c in ("key", "id", "features")), strict=True):
                if (key,) != now:
                    now, state = (key,), None
                state, part = follow(state, [i or 0], [f], given)
                low.append(None if part[0] is None else part[0].tolist())
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("id"), pa.array(low, type=pa.list_(pa.float64()))], names=["key", "id", "low_rank"])

    return rows.mapInArrow(run, output_schema(df))


def tracked_stream(stream: DataFrame, delay: str | None = None, **options) -> DataFrame:
    """The same on a streaming frame of key, time, id, features: one tracker a key in the stream's versioned state store.

    Without ``delay`` a micro-batch's vectors of a key are seen at once, in order of time and id. With it (such as
    "10 minutes") they wait in state until the watermark has passed their time, and a timer sees them in order: however
    arrivals are shuffled within the delay, and however batches are cut, the result is that of ``track_by_key``. What is later
    than the delay is dropped by the watermark, as in any windowed aggregation. What a key holds are its vectors of one
    micro-batch or one delay, and the state. Times and ids must not be null. Needs the RocksDB state store (``keyed_state``).
    """
    from flatspan.streaming.keyed import KeyedTracker

    timed = stream.withWatermark("time", delay) if delay else stream
    rows = timed.select("key", "time", F.unix_micros("time").alias("at"), F.col("id").cast("long").alias("id"), F.col("features").cast("array<double>").alias("features"))
    processor = KeyedTracker(TrackerOptions(**options), delay is not None)
    return rows.groupBy("key").transformWithStateInPandas(processor, output_schema(stream), "append", "EventTime" if delay else "None")

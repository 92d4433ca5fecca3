from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from flatspan.functions.tracking import TrackerOptions, start, step
from flatspan.operators.keyed_tracking import track_by_key, tracked_stream
from flatspan.streaming.keyed import keyed_state

SCHEMA = "key string, time timestamp, id long, features array<double>"


def sources(n: int = 120) -> list[tuple]:
    """Vectors of three keys near a line each; time runs with the id. One coordinate is missing now and then."""
    rng = np.random.default_rng(3)
    lines = {k: rng.normal(size=5) for k in ("a", "b", None)}
    out = []
    for i in range(n):
        key = ("a", "a", "b", None)[i % 4]
        x = lines[key] * rng.normal() + 0.01 * rng.normal(size=5)
        out.append((key, 1_700_000_000 + 60 * i, i, [None if (i + j) % 17 == 0 else float(v) for j, v in enumerate(x)]))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA.replace("timestamp", "long")).withColumn("time", F.timestamp_seconds("time"))


def alone(rows, options) -> dict[int, np.ndarray]:
    """Separate trackers, one after the other."""
    out = {}
    for key in {r[0] for r in rows}:
        state = start(options, 5)
        for _, _, i, f in sorted((r for r in rows if r[0] == key), key=lambda r: r[1:3]):
            state, out[i] = step(state, np.array(f, dtype=float), options, np.random.default_rng([0, i]))
    return out


def test_keys_are_tracked_as_if_alone(spark):
    rows = sources()
    want = alone(rows, TrackerOptions(rank=1))
    got = {r.id: r for r in track_by_key(frame(spark, rows).repartition(7).withColumn("mark", F.lit(1)), rank=1).collect()}
    assert set(got) == set(want) and all(np.allclose(got[i].low_rank, w) for i, w in want.items())
    assert {i: r.key for i, r in got.items()} == {r[2]: r[0] for r in rows}
    assert track_by_key(frame(spark, []), rank=1).count() == 0
    odd = track_by_key(frame(spark, [("a", 1, 5, None), ("a", 1, 5, [None] * 3), ("b", 1, 2**53 + 1, [1.0, 2.0, 3.0]), (None, None, None, [1.0, 2.0, 3.0])]), rank=1).collect()
    assert {r.id for r in odd} == {5, 2**53 + 1, None} and len(odd) == 4 and sum(r.low_rank is None for r in odd) == 1


@pytest.mark.parametrize("delay", [None, "20 minutes"])
def test_stream_equals_batch(spark, tmp_path, delay):
    """Batches cut anyhow; with a delay, arrivals are out of order too. State lives on over a restart of the query."""
    keyed_state(spark)
    rows = [r for r in sources() if r[0] is not None]
    want = alone(rows, TrackerOptions(rank=1))
    if delay:  # swap neighbours, far less than the delay apart
        rows = [r for k in range(0, len(rows), 4) for r in rows[k : k + 4][::-1]]
    for part in range(2):
        half = rows[part * 45 :][:45]
        for k in range(0, 45, 15):
            frame(spark, half[k : k + 15]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = tracked_stream(source, delay, rank=1).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state"))
        assert out.trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination(120)
    found = spark.read.parquet(str(tmp_path / "out")).collect()
    got = {r.id: r for r in found}
    assert len(got) == len(found) and all(np.allclose(r.low_rank, want[i]) for i, r in got.items())
    last = max(r[1] for r in rows)
    waiting = {r[2] for r in rows if delay and r[1] >= last - 20 * 60}
    assert set(want) - set(got) <= waiting

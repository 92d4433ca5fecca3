"""The tracker on Structured Streaming: state carried over micro-batches, scores written as they come."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flatspan.functions.tracking import STATE_SCHEMA, TrackerOptions, TrackerState, start
from flatspan.operators.tracking import CHUNK_ROWS, SubspaceTrackerModel


@dataclass
class TrackerStream:
    """Vectors (id, features) in, states and separated vectors out.

    Each micro-batch first advances the state over its rows in id order, then scores its rows in parallel with
    that state. State and scores are stored under the batch's number, so a batch that is run again after a
    failure starts from the same earlier state and replaces its own output: nothing is counted twice.
    """

    spark: SparkSession
    options: TrackerOptions
    dim: int
    folder: str
    chunk_rows: int = CHUNK_ROWS

    def state_before(self, batch: int) -> TrackerState:
        try:
            stored = self.spark.read.schema(f"{STATE_SCHEMA}, batch long").parquet(f"{self.folder}/state")
            row = stored.where(F.col("batch") < batch).orderBy(F.desc("batch")).first()
        except Exception as e:  # no state has been written yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            row = None
        return TrackerState.from_row(row) if row else start(self.options, self.dim)

    def process(self, rows: DataFrame, batch: int) -> None:
        rows = rows.persist()
        try:
            model = SubspaceTrackerModel(self.options, self.state_before(batch)).advance(rows, self.chunk_rows)
            one = self.spark.createDataFrame([model.state.to_row()], STATE_SCHEMA)
            one.write.mode("overwrite").parquet(f"{self.folder}/state/batch={batch}")
            model.transform(rows).write.mode("overwrite").parquet(f"{self.folder}/scored/batch={batch}")
        finally:
            rows.unpersist()

    def start(self, vectors: DataFrame, once: bool = False) -> StreamingQuery:
        """Start on a streaming frame; once: all that is there, in batches, then stop."""
        writer = vectors.writeStream.foreachBatch(self.process).option("checkpointLocation", f"{self.folder}/checkpoint")
        return (writer.trigger(availableNow=True) if once else writer).start()

    def scored(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/scored")

    def model(self) -> SubspaceTrackerModel:
        return SubspaceTrackerModel(self.options, self.state_before(2**62))

"""Counts and positions of every micro-batch, kept as a table."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

SCHEMA = (
    "name string, id string, run string, batch_id bigint, at string, input_rows bigint, late_rows bigint, state_rows bigint, "
    "watermark string, positions string, metrics map<string, map<string, bigint>>"
)


class BatchLog(StreamingQueryListener):
    """Writes a row for each batch of each query that has a name, or of the queries named.

    A query keeps only its last hundred batches itself, and forgets them when it ends.  The folder of a
    batch is replaced when the batch is done again after a restart.
    """

    def __init__(self, spark: SparkSession, path: str, names: tuple[str, ...] | None = None):
        super().__init__()
        self.spark, self.path, self.names = spark, path.rstrip("/"), names

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if not p.name or (self.names is not None and p.name not in self.names):
            return
        metrics = {
            name: {k: int(v) for k, v in row.asDict().items() if isinstance(v, int)} for name, row in p.observedMetrics.items()}
        row = (
            p.name, str(p.id), str(p.runId), int(p.batchId), p.timestamp, int(p.numInputRows),
            sum(int(s.numRowsDroppedByWatermark) for s in p.stateOperators), sum(int(s.numRowsTotal) for s in p.stateOperators),
            p.eventTime.get("watermark"), json.dumps([{"source": s.description, "end": s.endOffset} for s in p.sources]), metrics,
        )
        self.spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/query={p.name}/batch={p.batchId}")

    def attach(self) -> BatchLog:
        self.spark.streams.addListener(self)
        return self

    def detach(self) -> None:
        """Stop listening, once the events so far have been written."""
        self.spark._jsc.sc().listenerBus().waitUntilEmpty(60_000)
        self.spark.streams.removeListener(self)


def batches(spark: SparkSession, path: str) -> DataFrame:
    """The log, one row per query and batch."""
    return spark.read.schema(f"{SCHEMA}, query string, batch bigint").parquet(path).drop("query", "batch")

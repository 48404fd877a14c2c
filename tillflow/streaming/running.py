"""Starting queries."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tillflow.session import state_partitions, state_settings
from tillflow.sinks.folders import delete

Trigger = dict[str, object]
Output = Callable[[DataFrame, int], None]

# Micro-batch intervals.
DEVICE_TRIGGER: Trigger = {"processingTime": "3 seconds"}
TABLE_TRIGGER: Trigger = {"processingTime": "5 seconds"}
# Everything that is there, then stop.
ONCE: Trigger = {"availableNow": True}


def state_of(trigger: Trigger, count_state: bool = True) -> dict[str, str]:
    """Settings of the state stores for a query's trigger.

    A query that takes everything there is and stops is started anew each time, and would play all changes since
    the last snapshot back; it commits its state files instead, of which a commit copies only the new ones.  Both kinds of
    checkpoint can follow each other.  Without ``count_state`` no row is looked up just to count the rows.
    """
    settings = {} if count_state else {"trackTotalNumberOfRows": "false"}
    return settings | {"changelogCheckpointing__enabled": "false"} if "processingTime" not in trigger else settings


def start_batches(
    stream: DataFrame, each: Output, checkpoint: str, trigger: Trigger = TABLE_TRIGGER, name: str | None = None,
    partitions: int | None = None, mode: str = "append", count_state: bool = True,
) -> StreamingQuery:
    """Run ``each(batch, batch_id)`` for every micro-batch.

    The checkpoint holds the source position.  After a failure the same rows
    come again under the same batch id, so every output must be idempotent by
    batch id.  ``partitions`` is the number of state partitions at the first start
    (by default the session's shuffle partitions); it stays for good.  Without ``count_state``
    the rows of the state are not counted, which spares a look-up for each of them.
    """
    writer = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**trigger)
    with state_partitions(stream.sparkSession, partitions), state_settings(stream.sparkSession, **state_of(trigger, count_state)):
        return (writer.queryName(name) if name else writer).start()


def start_files(
    stream: DataFrame, path: str, checkpoint: str, trigger: Trigger = TABLE_TRIGGER,
    partition_by: Sequence[str] = (), name: str | None = None, partitions: int | None = None, count_state: bool = True,
) -> StreamingQuery:
    """Append to a Parquet table; the sink's own log makes it exactly-once."""
    writer = (
        stream.writeStream.format("parquet").option("path", path).outputMode("append")
        .option("checkpointLocation", checkpoint).trigger(**trigger)
    )
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with state_partitions(stream.sparkSession, partitions), state_settings(stream.sparkSession, **state_of(trigger, count_state)):
        return (writer.queryName(name) if name else writer).start()


def late_rows(query: StreamingQuery) -> int:
    """Rows that came after the watermark and were left out, over the query's recent batches.

    ``progress.BatchLog`` keeps the counts of all batches.
    """
    return sum(
        int(state.numRowsDroppedByWatermark)
        for progress in query.recentProgress for state in progress.stateOperators
    )


# When a row came in: the time of its micro-batch, which a replay of the batch gets again.
ARRIVED = "_arrived"


def with_arrival(stream: DataFrame) -> DataFrame:
    return stream.withColumn(ARRIVED, F.current_timestamp())


def beside(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Rows of a stream, and what they changed in the state of an aggregation over the same stream, as one stream.

    The columns are ``row`` and ``state``, one of them null.  Both read the same source in the
    same steps, so a batch (in update mode) has a batch's rows and the new state of their keys.
    """
    both = (("row", rows), ("state", state))
    sides = []
    for name, df in both:
        struct = F.struct(*(F.col(f"`{c}`") for c in df.columns))
        sides.append(df.select(*((struct if other == name else F.lit(None).cast(o.schema)).alias(other) for other, o in both)))
    return sides[0].unionByName(sides[1])


def row_side(batch: DataFrame, name: str) -> DataFrame:
    """One side of a batch of ``beside``."""
    return batch.where(F.col(name).isNotNull()).select(f"{name}.*")


# Copies of an order in the state of a stream join; more state partitions do not mean more of them.
ORDER_COPIES = 2


def salt_count(stream: DataFrame, salt_buckets: int | None) -> int:
    """Parts a hot key of a stateful operator is split into.

    A key with a third of all rows is then no more than two average state
    partitions, of which there are as many as the session's shuffle partitions.
    """
    if salt_buckets is not None:
        return salt_buckets
    return max(1, -(-int(stream.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 6))


def landing_of(checkpoint: str) -> str:
    """Where the batches of a query are landed: beside its checkpoint."""
    return f"{checkpoint.rstrip('/')}-landing"


@contextlib.contextmanager
def landed(batch: DataFrame, spark: SparkSession, folder: str, batch_id: int):
    """The rows of a batch as a Parquet table, for steps that need them several times.

    Writing them cuts the lineage: a lost executor never makes Spark run the
    stateful part of a stream again, and what follows is an ordinary batch job of
    ``spark``, with adaptive execution and column pruning.
    """
    path = f"{folder}/batch_id={batch_id}"
    batch.write.mode("overwrite").parquet(path)
    try:
        yield spark.read.schema(batch.schema).parquet(path)
    finally:
        delete(spark, path)


@contextlib.contextmanager
def kept(df: DataFrame):
    """A result used more than once in a batch, computed once."""
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield held
    finally:
        held.unpersist()


def fan_out(df: DataFrame, batch_id: int, outputs: Sequence[Output]) -> None:
    """Several outputs of one batch, computed once."""
    if len(outputs) == 1:
        outputs[0](df, batch_id)
        return
    with kept(df) as rows:
        for output in outputs:
            output(rows, batch_id)


def sorted_batch(spark: SparkSession, landing: str, outputs: Sequence[Output], dead_letters: Sequence[Output]) -> Output:
    """Per-batch step for ``parsing.sorted_rows``: typed rows one way, rejected texts with the reason another."""

    def each(batch: DataFrame, batch_id: int) -> None:
        with landed(batch, spark, landing, batch_id) as arrived:
            fan_out(arrived.where("reason IS NULL").select("row.*"), batch_id, outputs)
            fan_out(arrived.where("reason IS NOT NULL").select("value", "reason"), batch_id, dead_letters)

    return each


def start_sorted(
    rows: DataFrame, outputs: Sequence[Output], dead_letters: Sequence[Output], checkpoint: str,
    trigger: Trigger = TABLE_TRIGGER, name: str | None = None,
) -> StreamingQuery:
    """A stream of ``parsing.sorted_rows``: texts are parsed once, and none is lost."""
    return start_batches(rows, sorted_batch(rows.sparkSession, landing_of(checkpoint), outputs, dead_letters), checkpoint, trigger, name)

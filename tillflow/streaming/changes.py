"""Change records split by table as a stream, and dimensions kept current."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tillflow import schemas
from tillflow.operators import cdc
from tillflow.operators.dims import dimension_rows
from tillflow.sinks import kafka
from tillflow.sinks.latest import LatestTable
from tillflow.streaming.running import TABLE_TRIGGER, Trigger, start_batches, start_files

FORMS = {"array": cdc.explode_images, "object": cdc.route_image}


def split(raw: DataFrame, form: str) -> DataFrame:
    """(topic, value) rows; ``form`` is "array" or "object"."""
    return FORMS[form](raw, observe=f"cdc_{form}")


def start_split_files(
    raw: DataFrame, form: str, path: str, checkpoint: str, trigger: Trigger = TABLE_TRIGGER
) -> StreamingQuery:
    """Row images into one folder per topic."""
    return start_files(split(raw, form), path, checkpoint, trigger, partition_by=["topic"])


def start_split_topics(
    raw: DataFrame, form: str, servers: str, checkpoint: str, trigger: Trigger = TABLE_TRIGGER
) -> StreamingQuery:
    """Row images into their topics."""
    return kafka.append_stream(split(raw, form), servers, checkpoint).trigger(**trigger).start()


def dimension_table(spark: SparkSession, path: str, dimension: str, seq: str = "seq") -> LatestTable:
    """A dimension of which the latest row per key counts: by batch, then by ``seq``."""
    ddl, key = schemas.DIMENSIONS[dimension]
    return LatestTable(spark, path, f"{ddl}, {seq} bigint", (key,), (seq,))


def load_batch(table: LatestTable, dimension: str, seq: str = "seq"):
    """Per-batch step: parse row images and record the latest one of each key."""
    return lambda batch, batch_id: table.write(dimension_rows(batch, dimension, keep=(seq,)), batch_id)


def start_load(
    raw: DataFrame, dimension: str, table: LatestTable, checkpoint: str,
    seq: str = "seq", trigger: Trigger = TABLE_TRIGGER,
) -> StreamingQuery:
    """Row images (``value``, ``seq``) into a dimension table.

    ``seq`` orders the changes within a batch, for instance the topic offset.
    """
    return start_batches(raw, load_batch(table, dimension, seq), checkpoint, trigger)

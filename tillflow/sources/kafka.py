"""Topic streams.

The position of a running query is kept by its checkpoint.  Explicit offsets
matter only for the first start.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

TopicOffsets = Mapping[str, Mapping[int, int]]


def offsets_json(offsets: TopicOffsets) -> str:
    """``{topic: {partition: offset}}`` as the connector's ``startingOffsets`` text."""
    return json.dumps(
        {topic: {str(p): int(o) for p, o in sorted(parts.items())} for topic, parts in sorted(offsets.items())}
    )


def stream_options(
    servers: str,
    topic: str,
    group: str | None = None,
    offsets: TopicOffsets | None = None,
    max_offsets_per_trigger: int | None = None,
    fail_on_data_loss: bool = True,
) -> dict[str, str]:
    """Connector options of a topic stream."""
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": offsets_json(offsets) if offsets else "latest",
        "failOnDataLoss": str(fail_on_data_loss).lower(),
    }
    if group:
        options["groupIdPrefix"] = group
    if max_offsets_per_trigger:
        options["maxOffsetsPerTrigger"] = str(max_offsets_per_trigger)
    return options


def topic_stream(spark: SparkSession, servers: str, topic: str, **kwargs) -> DataFrame:
    """Unbounded (key, value) text rows of a topic; needs the Kafka connector on the class path."""
    reader = spark.readStream.format("kafka").options(**stream_options(servers, topic, **kwargs))
    return reader.load().select(
        F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"),
        "topic", "partition", "offset", "timestamp",
    )

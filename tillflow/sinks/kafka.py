"""Topic appends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import DataStreamWriter

from tillflow.operators.parsing import json_column


def message_rows(df: DataFrame, key: str | Column | None = None, topic: str | Column | None = None) -> DataFrame:
    """Rows as (key, value[, topic]) messages; the value is the whole row as JSON."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    out = []
    if key is not None:
        out.append(col(key).cast("string").alias("key"))
    out.append(json_column().alias("value"))
    if topic is not None:
        out.append(col(topic).alias("topic"))
    return df.select(*out)


def sink_options(servers: str, topic: str | None = None) -> dict[str, str]:
    """Connector options; without ``topic`` every row names its own in column ``topic``."""
    options = {"kafka.bootstrap.servers": servers, "kafka.acks": "all"}
    return {**options, "topic": topic} if topic else options


def append(messages: DataFrame, servers: str, topic: str | None = None) -> None:
    """Append a batch of messages; needs the Kafka connector on the class path."""
    messages.write.format("kafka").options(**sink_options(servers, topic)).save()


def append_stream(messages: DataFrame, servers: str, checkpoint: str, topic: str | None = None) -> DataStreamWriter:
    """Writer of a message stream (call ``start``)."""
    return (
        messages.writeStream.format("kafka").options(**sink_options(servers, topic))
        .option("checkpointLocation", checkpoint).outputMode("append")
    )

"""Ready-made outputs of a micro-batch, to be passed to the streaming steps.

A batch may have several: the wide table, for instance, goes to a topic and to
a database.  Files are replaced on a replay; topics and databases get the rows
again under the same ``batch_id``, by which (and the row's key) readers tell copies.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from tillflow.sinks import jdbc, kafka
from tillflow.sinks.tables import write_batch

Output = Callable[[DataFrame, int], None]


def to_table(path: str, sort_by: str | None = None) -> Output:
    """A Parquet table, a folder per batch; sorted by day, readers skip what they do not need.

    ``tables.pack_days`` puts closed batches into packs of days.
    """

    def output(df: DataFrame, batch_id: int) -> None:
        write_batch(df.sortWithinPartitions(sort_by) if sort_by else df, path, batch_id)

    return output


def _numbered(df: DataFrame, batch_id: int) -> DataFrame:
    return df.withColumn("batch_id", F.lit(batch_id))


def to_messages(path: str, key: str | None = None) -> Output:
    """JSON messages as files, for readers that take a folder for a topic."""
    return lambda df, batch_id: write_batch(kafka.message_rows(_numbered(df, batch_id), key), path, batch_id)


def to_topic(servers: str, topic: str, key: str | None = None) -> Output:
    """JSON messages to a topic."""
    return lambda df, batch_id: kafka.append(kafka.message_rows(_numbered(df, batch_id), key), servers, topic)


def to_jdbc(url: str, table: str, numbered: bool = False, **options) -> Output:
    """Rows to a database table; ``numbered`` for tables with a column ``batch_id``."""
    return lambda df, batch_id: jdbc.append(_numbered(df, batch_id) if numbered else df, url, table, **options)

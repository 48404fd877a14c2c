"""Change-record envelopes split into row images, each routed to its table's topic.

Operation types are not told apart: inserts, updates and deletes are forwarded
alike.  Envelopes without table or data are dropped and counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tillflow import schemas
from tillflow.functions import ods_topic
from tillflow.operators.parsing import parse_json


def _checked(df: DataFrame, schema: str, value: str, observe: str | None) -> DataFrame:
    parsed = parse_json(df, schema, value, into="_envelope")
    usable = F.col("_envelope.table").isNotNull() & F.col("_envelope.data").isNotNull()
    if observe:
        parsed = parsed.observe(
            observe,
            F.count_if(usable).alias("forwarded"),
            F.count_if(~usable).alias("dropped"),
        )
    return parsed.where(usable)


def explode_images(df: DataFrame, value: str = "value", observe: str | None = None) -> DataFrame:
    """Envelopes whose ``data`` is an array: one (topic, value) row per element."""
    return (
        _checked(df, schemas.CDC_ARRAY, value, observe)
        .select(
            ods_topic(F.col("_envelope.table")).alias("topic"),
            F.explode("_envelope.data").alias("value"),
        )
        .where(F.col("value").isNotNull())
    )


def route_image(df: DataFrame, value: str = "value", observe: str | None = None) -> DataFrame:
    """Envelopes whose ``data`` is one object: one (topic, value) row each."""
    return _checked(df, schemas.CDC_OBJECT, value, observe).select(
        ods_topic(F.col("_envelope.table")).alias("topic"),
        F.col("_envelope.data").alias("value"),
    )

"""Dimension tables: parsing, scans, upserts and keyed lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tillflow import schemas
from tillflow.operators.parsing import typed_rows
from tillflow.operators.ranking import latest_per_key


def dimension_rows(
    df: DataFrame, dimension: str, value: str = "value",
    observe: str | None = None, keep: tuple[str, ...] = (),
) -> DataFrame:
    """Typed rows of a dimension from JSON row images; rows without key are left out."""
    ddl, key = schemas.DIMENSIONS[dimension]
    renames = schemas.SOURCE_FIELDS.get(dimension, {})
    back = {column: field for field, column in renames.items()}
    rows = typed_rows(df, schemas.source_schema(dimension), back.get(key, key), value, observe, keep)
    return rows.withColumnsRenamed(renames)


def scan(table: DataFrame, dimension: str) -> DataFrame:
    """The dimension's own columns only."""
    return table.select(*schemas.columns(schemas.DIMENSIONS[dimension][0]))


def upsert(current: DataFrame, changes: DataFrame, key: str, seq: str) -> DataFrame:
    """Latest row per key of ``current`` and ``changes``; rows without key are ignored."""
    both = current.unionByName(changes, allowMissingColumns=True)
    return latest_per_key(both.where(F.col(key).isNotNull()), [key], [seq])


def lookup(table: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Rows of ``table`` for the keys present in ``batch``."""
    return table.join(batch.select(key).distinct(), key, "left_semi")

"""Topic names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ODS_PREFIX = "ODS_"  # fixed value


def ods_topic(table: Column) -> Column:
    """Topic of a source table."""
    return F.concat(F.lit(ODS_PREFIX), F.upper(table))

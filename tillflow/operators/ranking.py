"""First or latest row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Exactly one row per key: the first one in ``order``.

    The ``= 1`` filter on the rank makes Spark drop all but one row per key in
    every map task before the exchange, so that a hot key is never shuffled or
    sorted whole.
    """
    ranked = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_rank", F.row_number().over(ranked))
        .where(F.col("_rank") == 1)
        .drop("_rank")
    )


def latest_per_key(df: DataFrame, keys: Sequence[str], seq: Sequence[str]) -> DataFrame:
    """Last write wins, by descending ``seq``."""
    return first_per_key(df, keys, [F.col(c).desc() for c in seq])

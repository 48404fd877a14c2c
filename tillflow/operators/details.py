"""Order lines with product, brand and category."""

from __future__ import annotations

from pyspark.sql import DataFrame


def with_sku(details: DataFrame, sku: DataFrame) -> DataFrame:
    """Add the three foreign keys of the product; unknown products keep nulls."""
    return details.join(sku.select("sku_id", "spu_id", "tm_id", "category3_id"), "sku_id", "left")


def product_dim(sku: DataFrame, spu: DataFrame, trademark: DataFrame, category3: DataFrame) -> DataFrame:
    """The product snowflake flattened to one row per sku."""
    return (
        sku.select("sku_id", "spu_id", "tm_id", "category3_id")
        .join(spu.select("spu_id", "spu_name"), "spu_id", "left")
        .join(trademark.select("tm_id", "tm_name"), "tm_id", "left")
        .join(category3.select("category3_id", "category3_name"), "category3_id", "left")
    )


def enrich(
    details: DataFrame, sku: DataFrame, spu: DataFrame, trademark: DataFrame, category3: DataFrame
) -> DataFrame:
    """Complete order lines.

    The dimensions are joined to each other first, so the lines are joined, and
    at most shuffled, once instead of four times.
    """
    return details.join(product_dim(sku, spu, trademark, category3), "sku_id", "left")

"""Tables and streams in files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def table(
    spark: SparkSession, path: str, columns: list[str] | None = None, schema: str | StructType | None = None
) -> DataFrame:
    """A Parquet table, or some columns of it; a declared schema saves the look into the files."""
    df = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    return df.select(*columns) if columns else df


def file_stream(
    spark: SparkSession, path: str, schema: str | StructType, fmt: str = "parquet", max_files: int | None = None
) -> DataFrame:
    """Files appearing in a folder as a stream; ``schema`` is declared, never inferred."""
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)

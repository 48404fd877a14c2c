"""Queries against a relational database."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def query_options(
    url: str,
    query: str,
    driver: str | None = None,
    partition_column: str | None = None,
    lower: int | str | None = None,
    upper: int | str | None = None,
    partitions: int | None = None,
    fetch_size: int = 10_000,
) -> dict[str, str]:
    """Reader options; with ``partition_column`` the query is read in parallel ranges."""
    options = {"url": url, "fetchsize": str(fetch_size)}
    if driver:
        options["driver"] = driver
    if partition_column is None:
        return {**options, "query": query}
    if lower is None or upper is None or not partitions:
        raise ValueError("a partitioned read needs lower, upper and partitions")
    # Ranges need a table expression; the connector rejects them next to `query`.
    return {
        **options,
        "dbtable": f"({query}) q",
        "partitionColumn": partition_column,
        "lowerBound": str(lower),
        "upperBound": str(upper),
        "numPartitions": str(partitions),
    }


def bounds_query(sql: str, column: str) -> str:
    """What asks the database for the range of a column: one row."""
    return f"SELECT min({column}) AS low, max({column}) AS high FROM ({sql}) q"


def query(
    spark: SparkSession, url: str, sql: str, driver: str | None = None, partition_column: str | None = None,
    lower: int | str | None = None, upper: int | str | None = None, partitions: int | None = None, **kwargs,
) -> DataFrame:
    """Rows of any SQL the database understands.

    With ``partition_column`` and ``partitions`` alone the database is asked for the range first, so
    a large result is read by as many tasks; rows without a value in the column belong to the first.
    """
    if partition_column and partitions and lower is None and upper is None:
        lower, upper = query(spark, url, bounds_query(sql, partition_column), driver).first()
        if lower is None:
            partition_column = None
    options = query_options(url, sql, driver, partition_column, lower, upper, partitions, **kwargs)
    return spark.read.format("jdbc").options(**options).load()

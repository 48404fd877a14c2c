"""Connected components of an edge table, in rounds of grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillflow.llm.tables import land


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u))")).first())


def _lowest(edges: DataFrame) -> DataFrame:
    """Each node's smallest neighbour, written, so that the joins on it have plain exchanges that can be split."""
    return land(edges.groupBy("u").agg(F.min("v").alias("m")), "lowest")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the edges ``(u, v)``; root is the smallest node reachable.

    Two steps alternate: every node's larger neighbours are hung below its
    smallest one, then its smaller neighbours.  Each round at least halves the
    depth, and the edges never become more.  No component is gathered in one
    task; minima are reduced before the exchange.  Edges are written after every
    step.  Loops are ignored; an empty table gives an empty result.
    """
    def tidy(rows: DataFrame) -> DataFrame:
        return rows.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    edges = land(tidy(edges), "edges")
    before = None
    while (now := _state(edges)) != before:
        before = now
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _lowest(both).withColumn("m", F.least("u", "m"))
        edges = land(tidy(both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))), "edges")
        low = _lowest(edges)
        hung = edges.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = land(tidy(hung.union(low.select("u", F.col("m").alias("v")))), "edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

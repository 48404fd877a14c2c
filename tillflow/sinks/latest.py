"""A table of which the latest row per key counts.

Every batch writes its changes to a folder of its own, under the folder of their key's
hash, and readers keep the latest row of each key.  A replay of a batch writes the
same folders again.  A look-up by keys reads only the folders its keys hash to.
``rewrite`` puts the folded rows into a new table when the changes have added up.
With a table format that knows MERGE, use ``merge_into`` instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tillflow.operators.ranking import latest_per_key
from tillflow.sinks.folders import exists
from tillflow.sinks.tables import write_batch

# Folders by key hash.  The number is part of the layout and not a choice.
BUCKETS = 32
BUCKET, BATCH = "bucket", "batch_id"
SEED = -1  # batch number of the rows a table starts with


class LatestTable:
    """``schema`` as DDL, its ``keys``, and columns ``seq`` that order changes within a batch."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: tuple[str, ...], seq: tuple[str, ...] = ()):
        self.spark, self.path, self.keys, self.seq = spark, path.rstrip("/"), keys, seq
        self.schema = T.StructType.fromDDL(schema)

    def _bucket(self) -> Column:
        keys = (F.col(k).cast(self.schema[k].dataType) for k in self.keys)
        return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")

    def write(self, changes: DataFrame, batch_id: int) -> None:
        """Record the changes of a batch; only the latest one of a key is kept."""
        rows = changes.select(*(F.col(f.name).cast(f.dataType) for f in self.schema))
        rows = latest_per_key(rows, self.keys, self.seq) if self.seq else rows
        write_batch(rows.withColumn(BUCKET, self._bucket()).hint("rebalance", BUCKET), self.path, batch_id, (BUCKET,))

    def seed(self, rows: DataFrame) -> None:
        """Rows known before the first batch; does nothing if the table was begun already."""
        if not exists(self.spark, self.path):
            self.write(rows, SEED)

    def changes(self) -> DataFrame:
        """All changes with the number of their batch."""
        schema = T.StructType([*self.schema.fields]).add(BUCKET, T.IntegerType()).add(BATCH, T.LongType())
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path)

    def read(self, keys: DataFrame | None = None) -> DataFrame:
        """One row per key; ``keys``, columns named like the keys, narrows what is read.

        The folders to read are found from the keys' hashes, at most one number per folder.
        """
        rows = self.changes()
        if keys is not None:
            wanted = keys.select(*self.keys).distinct()
            buckets = sorted(r[0] for r in wanted.select(self._bucket().alias("b")).distinct().collect())
            rows = rows.where(F.col(BUCKET).isin(buckets)).join(wanted, list(self.keys), "left_semi")
        return latest_per_key(rows, self.keys, (BATCH, *self.seq)).select(*self.schema.names)

    def rewrite(self, path: str) -> LatestTable:
        """The same rows as a new table, one change per key."""
        fresh = LatestTable(self.spark, path, self.schema.simpleString()[7:-1], self.keys, self.seq)
        fresh.write(self.read(), SEED)
        return fresh


def merge_into(changes: DataFrame, table: str, key: str) -> None:
    """The same upsert for a catalog table whose format supports MERGE.

    ``changes`` must hold one row per key.
    """
    target = F.col(f"{table}.{key}") if "." not in table else F.col(f"{table.split('.')[-1]}.{key}")
    (
        changes.alias("changes").mergeInto(table, target == F.col(f"changes.{key}"))
        .whenMatched().updateAll().whenNotMatched().insertAll().merge()
    )

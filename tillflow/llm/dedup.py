"""Exact duplicates by a stateful stream: keyed state without expiry, full bytes checked on hits.

The stream keeps one state row per digest in a disk-backed store and never lets
it expire: the digest, the stable identifier of the row that stays, and that
row's locator (file and position).  Texts never enter the state.  A digest seen
twice is only a hit; the texts behind it are compared byte for byte, and rows
whose bytes differ are told apart again.

Defined results.  A null text is the empty text.  Null identifiers are allowed
and stay only where a group has nothing else.  Of fully repeated rows (same
identifier, same text) the one with the largest locator stays.  An empty table
gives an empty result.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillflow.llm.tables import FILE, ROW, empty, land, located, text_of, without
from tillflow.session import scratch_dir
from tillflow.sources.files import file_stream


# State on disk, committed as changes.  Digests spread evenly over many small stores,
# which must not reserve megabytes each for files that hold kilobytes.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def arrivals(rows: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    """What the stream reads of each located row: identifier, digest, locator."""
    return rows.select(F.col(id_col).alias("doc_id"), digest(text_of(text_col)).alias("digest"), FILE, ROW)


def keyed_state(stream: DataFrame) -> DataFrame:
    """One state row per digest, kept for ever: the row that stays, and the number of rows seen.

    Rows of one digest are reduced in each task before the exchange, so a text
    with a third of all rows is one row per task.
    """
    return stream.groupBy("digest").agg(
        F.max(F.struct("doc_id", FILE, ROW)).alias("keeper"), F.count(F.lit(1)).alias("group_size"))


def advance(spark: SparkSession, incoming: str, schema, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Run the stream over all files of ``incoming`` and return the current groups.

    ``folder`` holds the stream's checkpoint, its state and the groups changed by
    each micro-batch.  Called again with the same folder, only new files are read
    and old rows still count.  A micro-batch is replaced under its own number if
    it has to run again.
    """
    changes = f"{folder}/changes"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{changes}/batch_id={batch_id}")

    state = keyed_state(file_stream(spark, incoming, schema, max_files=files_per_batch))
    before = {name: spark.conf.get(name, None) for name in STORE}
    for name, value in STORE.items():
        spark.conf.set(name, value)
    try:
        query = (
            state.writeStream.outputMode("update").foreachBatch(write)
            .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    try:
        rows = spark.read.schema(f"{_ddl(state.schema)}, batch_id LONG").parquet(changes)
    except AnalysisException:  # no file has ever had a row
        return empty(spark, state.schema)
    batches = rows.agg(F.countDistinct("batch_id")).first()[0]
    if batches < 2:
        return rows.drop("batch_id")
    latest = rows.groupBy("digest").agg(F.max_by(F.struct("keeper", "group_size"), "batch_id").alias("last"))
    return land(latest.select("digest", "last.*"), "groups")


def _ddl(schema) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)


def colliding(rows: DataFrame, groups: DataFrame, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    """Digests with more than one text: the smallest and the largest text of a group differ."""
    # A short form of the digests keeps the list small; what it lets through besides does no harm.
    repeated = land(groups.filter("group_size > 1").select(F.xxhash64("digest").alias("hit")).distinct(), "hits")
    texts = rows.select(digest(text_of(text_col)).alias("digest"), text_of(text_col).alias("text"))
    return (
        texts.withColumn("hit", F.xxhash64("digest")).join(repeated, "hit", "left_semi")
        .groupBy("digest").agg(F.min("text").alias("low"), F.max("text").alias("high"))
        .filter("low <> high").select("digest")
    )


def members(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    digest: Callable[[Column], Column] = sha256, files_per_batch: int | None = None,
) -> DataFrame:
    """One row per input row: ``doc_id, digest, keep_id, group_size, kept`` and the locator."""
    spark = docs.sparkSession
    rows = located(docs)
    folder = scratch_dir(spark, "exact-dedup")
    incoming = f"{folder}/incoming"
    arrivals(rows, id_col, text_col, digest).write.parquet(incoming)
    seen = spark.read.parquet(incoming)
    groups = advance(spark, incoming, seen.schema, folder, files_per_batch)
    hits = land(colliding(rows, groups, text_col, digest), "collisions")
    if not hits.isEmpty():
        # Told apart by the bytes themselves.
        texts = rows.withColumns({"_digest": digest(text_of(text_col)), "_text": text_of(text_col)}).join(
            hits.withColumnRenamed("digest", "_digest"), "_digest", "left_semi"
        ).select(F.col(id_col).alias("doc_id"), F.col("_digest").alias("digest"), F.col("_text").alias("text"), FILE, ROW)
        parts = texts.groupBy("digest", "text").agg(
            F.max(F.struct("doc_id", FILE, ROW)).alias("keeper"), F.count(F.lit(1)).alias("group_size"))
        apart = land(texts.join(parts, ["digest", "text"]).select("doc_id", "digest", FILE, ROW, "keeper", "group_size"), "apart")
        joined = seen.join(hits, "digest", "left_anti").join(groups, "digest").select(*apart.columns).unionByName(apart)
    else:
        joined = seen.join(groups, "digest")
    return joined.select(
        "doc_id", "digest", F.col("keeper.doc_id").alias("keep_id"), "group_size",
        ((F.col(FILE) == F.col(f"keeper.{FILE}")) & (F.col(ROW) == F.col(f"keeper.{ROW}"))).alias("kept"), FILE, ROW,
    )


def unique(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without their exact copies."""
    rows = located(docs)
    return without(rows, members(rows, id_col, text_col).filter("not kept"))

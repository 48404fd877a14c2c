"""Shards by fixed virtual slots and a versioned map.

A record's hash puts it into one of ``slots`` virtual slots, once and for all.  The
bytes of each slot are added up.  Which shard holds a slot is said by a map that is
stored version by version: the first deals slots out in turn, and ``rebalance`` edits
it, moving or swapping single slots between the emptiest shard and the fullest one that this
helps, until none does.  Only moved slots change shards.  A later run with the same folder
begins with the newest version, and an edit is stored as the next one; none is ever overwritten.
Growing by a shard is one more edit, with an empty shard to fill; the slots of a shard that is
taken away go to the emptiest ones.

The map has ``slots`` rows, however large the table, so it alone is edited on the
driver and broadcast.  Records are numbered within slots, and slots within shards by
running sums over the map; no shard is gathered in one task.

Defined results.  A null text has no bytes.  Records are hashed by identifier and
text, so null or equal identifiers spread too; rows repeated whole are spread by
their place in the files.  An empty table gives an empty result.  Fewer records than
shards leave shards empty.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillflow.llm.tables import FILE, ROW, land, located, text_of
from tillflow.session import scratch_dir
from tillflow.sinks.folders import names

SLOTS = 4096
# Bytes of a record besides its text.
OVERHEAD = 8


def placed(docs: DataFrame, id_col: str, text_col: str, slots: int) -> DataFrame:
    """``doc_id, size, text_crc32, virtual_slot`` of each record."""
    text = text_of(text_col)
    rows = land(located(docs).select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.col(id_col), text).alias("hash"), FILE, ROW), "records")
    # Each hash that comes more than once, reduced in every task before the exchange.
    repeated = land(rows.groupBy("hash").count().filter("count > 1").select("hash"), "repeated").withColumn("again", F.lit(True))
    own = F.when(F.col("again"), F.xxhash64("hash", FILE, ROW)).otherwise(F.col("hash"))
    return rows.join(repeated, "hash", "left").select(
        "doc_id", "size", "text_crc32", F.pmod(own, F.lit(slots)).cast("int").alias("virtual_slot"))


def loads(records: DataFrame) -> DataFrame:
    """``virtual_slot, bytes, records``: sums per slot, reduced in each task first."""
    return records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("records"))


def dealt(slots: int, shards: int) -> list[int]:
    """The first version of a map: slots in turn."""
    return [slot % shards for slot in range(slots)]


def _better(held: list[list[int]], weight: Sequence[int], full: int, low: int, gap: int) -> tuple[int, int]:
    """A slot to move from one shard to another, and one to give back (or -1), that bring them closest; (-1, -1) if nothing does."""
    # Moving w leaves a difference of gap - 2 w; a swap moves the difference of two slots.
    best = min(((abs(gap - 2 * weight[s]), s, -1) for s in held[full] if 0 < weight[s] < gap), default=(gap, -1, -1))
    if best[0] > gap // 50:
        inner = sorted(held[low], key=lambda s: weight[s])
        for s in held[full]:
            want, lo, hi = weight[s] - gap / 2, 0, len(inner)
            while lo < hi:
                mid = (lo + hi) // 2
                lo, hi = (mid + 1, hi) if weight[inner[mid]] < want else (lo, mid)
            for other in inner[max(lo - 1, 0):lo + 1]:
                moved = weight[s] - weight[other]
                if 0 < moved < gap:
                    best = min(best, (abs(gap - 2 * moved), s, other))
    return best[1:] if best[0] < gap else (-1, -1)


def rebalance(owner: Sequence[int], weight: Sequence[int], shards: int) -> list[int]:
    """The map edited until no single move or swap between any shard and the emptiest one helps, the fullest first."""
    owner = list(owner)
    held = [[slot for slot, shard in enumerate(owner) if shard == k] for k in range(shards)]
    total = [sum(weight[slot] for slot in slots) for slots in held]
    while True:
        low = min(range(shards), key=lambda k: (total[k], k))
        for full in sorted(range(shards), key=lambda k: (-total[k], k)):
            out, back = _better(held, weight, full, low, total[full] - total[low]) if full != low else (-1, -1)
            if out >= 0:
                break
        else:
            return owner
        for slot, to, source in ((out, low, full), (back, full, low)):
            if slot >= 0:
                held[source].remove(slot)
                held[to].append(slot)
                owner[slot] = to
                total[source] -= weight[slot]
                total[to] += weight[slot]


def store_map(spark: SparkSession, folder: str, version: int, owner: Sequence[int]) -> None:
    """Write a version of the map: ``virtual_slot, shard`` under ``version=N``."""
    whole = F.lit(",".join(map(str, owner)))
    spark.range(1).select(F.posexplode(F.split(whole, ",")).alias("virtual_slot", "shard")).select(
        "virtual_slot", F.col("shard").cast("int")).write.mode("overwrite").parquet(f"{folder}/version={version}")


def load_map(spark: SparkSession, folder: str, version: int) -> DataFrame:
    return spark.read.schema("virtual_slot int, shard int").parquet(f"{folder}/version={version}")


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The versions of a map that are stored, oldest first."""
    return sorted(int(n.split("=")[1]) for n in names(spark, folder) if n.startswith("version=") and names(spark, f"{folder}/{n}").count("_SUCCESS"))


def edited(spark: SparkSession, folder: str, weight: Sequence[int], shards: int) -> int:
    """Bring the map in ``folder`` up to date with the slots' bytes; the version that holds now."""
    slots = len(weight)
    known = versions(spark, folder)
    if not known:
        store_map(spark, folder, 1, dealt(slots, shards))
        known = [1]
    owner = [r.shard for r in load_map(spark, folder, known[-1]).orderBy("virtual_slot").collect()]
    if len(owner) != slots:
        raise ValueError(f"the map in {folder} has {len(owner)} slots, not {slots}")
    total = [0] * shards
    for slot, shard in enumerate(owner):
        if shard < shards:
            total[shard] += weight[slot]
    new = list(owner)
    for slot in sorted((s for s in range(slots) if owner[s] >= shards), key=lambda s: -weight[s]):
        new[slot] = min(range(shards), key=lambda k: (total[k], k))
        total[new[slot]] += weight[slot]
    new = rebalance(new, weight, shards)
    if new != owner:
        known.append(known[-1] + 1)
        store_map(spark, folder, known[-1], new)
    return known[-1]


def sharded(
    docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, folder: str | None = None,
) -> DataFrame:
    """``doc_id, size, text_crc32, virtual_slot, shard, slot``; ``slot`` numbers a shard's records from 0 without gaps.

    ``folder`` keeps the map from run to run.
    """
    spark = docs.sparkSession
    folder = folder or scratch_dir(spark, "slot-map")
    records = land(placed(docs, id_col, text_col, slots), "placed")
    weights = land(loads(records), "slot-loads")
    # One row per slot: at most ``slots``.
    weight = [0] * slots
    for slot, size in weights.select("virtual_slot", "bytes").collect():
        weight[slot] = size
    newest = edited(spark, folder, weight, shards)

    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = load_map(spark, folder, newest).join(weights, "virtual_slot").select(
        "virtual_slot", "shard", F.coalesce(F.sum("records").over(before), F.lit(0)).alias("start"))
    number = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    return records.withColumn("number", number - 1).join(F.broadcast(starts), "virtual_slot").select(
        "doc_id", "size", "text_crc32", "virtual_slot", "shard", (F.col("start") + F.col("number")).cast("long").alias("slot"))

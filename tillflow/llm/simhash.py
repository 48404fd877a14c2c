"""SimHash near duplicates with the generalised pigeonhole principle.

Fingerprints have 64 bits.  Bits that go together are grouped into partitions.
If the thresholds of the partitions add up to ``distance - partitions + 1``, any
two fingerprints within the distance agree up to the threshold in at least one
partition; a threshold of -1 leaves a partition out.  Dynamic programming over
the candidate counts, taken from the value counts of all fingerprints, picks the
cheapest thresholds.  Fingerprints probe the buckets within each threshold, and
every candidate pair is verified on all 64 bits.

``total`` adds a second fingerprint and the number of shingles to the test of a pair.
Bits only estimate similarity, and equal fingerprints need not be near copies:
where a similarity is asked for, as in the pipeline, ``copies`` takes the links as
proposals and decides on the sets.

Equal fingerprints are one node, so exact copies make no pairs.  A bucket emits
only a spanning forest of its links, which keeps every link's two ends in one
component.  A bucket above ``bucket_rows`` is dealt to several tasks, one for each
pair of its chunks.

Defined results.  A null text is the empty text; no words give fingerprint 0,
which links like any other.  Fewer words than a shingle are one shingle.  Null
identifiers count as larger than others.  Repeated rows get the same
component.  An empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillflow.llm.components import components
from tillflow.llm.tables import FILE, ROW, land, located, small_batches, text_of, without

BITS = 64
SEED = 42
# Shingles hashed at a time; bounds the memory of a long text.
BLOCK = 1 << 16
# An odd number that spreads bits.
MIX = 0x9E3779B97F4A7C15
# Buckets up to this size are compared many at a time.
SMALL = 128


def shingle_hashes(text: str | None, shingle: int) -> Iterator[np.ndarray]:
    """The hashes of all shingles in order, with repeats, a block at a time.

    Words are runs without ASCII white space, A to Z in lower case.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return
    size = min(shingle, len(words))
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - size + 1]
    ends = ends[size - 1:]
    for at in range(0, len(starts), BLOCK):
        pieces = [joined[a:b] for a, b in zip(starts[at:at + BLOCK].tolist(), ends[at:at + BLOCK].tolist(), strict=True)]
        yield np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), np.uint64, len(pieces))


def fingerprint(text: str | None, shingle: int, second: bool = False) -> tuple[int, int, int]:
    """The fingerprint, another one if wanted (else 0), and the number of shingles."""
    ones, more, n = np.zeros(BITS, np.int64), np.zeros(BITS, np.int64), 0
    for hashes in shingle_hashes(text, shingle):
        n += len(hashes)
        ones += bits_of(hashes).sum(axis=0, dtype=np.int64)
        if second:
            mixed = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(MIX)
            more += bits_of(mixed ^ (mixed >> np.uint64(32))).sum(axis=0, dtype=np.int64)
    fp, other = (int(np.packbits(2 * x > n, bitorder="little").view("<u8")[0]) for x in (ones, more))
    return fp, other, n


def set_fingerprint(hashes: np.ndarray) -> int:
    """The fingerprint of a set of shingles, from their hashes."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), BLOCK):
        ones += bits_of(hashes[at:at + BLOCK]).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def bits_of(hashes: np.ndarray) -> np.ndarray:
    """A row of 64 zeros and ones for each number, lowest bit first."""
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def fingerprints(rows: DataFrame, id_col: str, text_col: str, shingle: int, second: bool) -> DataFrame:
    """``doc_id, fp, other, n`` and the locator of each located row; signed longs hold the bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t, shingle, second) for t in batch.column("text").to_pylist()]
            fp, other, n = (np.array(x, np.uint64).view(np.int64) for x in (zip(*found, strict=True) if found else [[]] * 3))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", FILE, ROW)), *map(pa.array, (fp, other, n))], ["doc_id", FILE, ROW, "fp", "other", "n"])

    inputs = rows.select(F.col(id_col).alias("doc_id"), FILE, ROW, text_of(text_col).alias("text"))
    kind = inputs.schema["doc_id"].dataType.simpleString()
    return small_batches(inputs).mapInArrow(run, f"doc_id {kind}, {FILE} string, {ROW} long, fp long, other long, n long")


def together(fps: DataFrame) -> np.ndarray:
    """How often two bits are both set, over all fingerprints: 64 x 64, and the count of fingerprints at [64, 64]."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS + 1, BITS + 1))
        for batch in batches:
            bits = bits_of(batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)).astype(np.float32)
            for at in range(0, len(bits), BLOCK):
                part = bits[at:at + BLOCK]
                total[:BITS, :BITS] += part.T @ part
            total[BITS, BITS] += len(bits)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel().astype(np.int64))], ["cell", "n"])

    sums = fps.select("fp").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((BITS + 1) ** 2)
    out[sums.column("cell").to_numpy()] = sums.column("n").to_numpy()
    return out.reshape(BITS + 1, BITS + 1)


def group_bits(counts: np.ndarray, parts: int) -> list[list[int]]:
    """Partitions of nearly equal width; each takes the bits most correlated with what it has."""
    n = max(counts[BITS, BITS], 1)
    p = np.diag(counts)[:BITS] / n
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((counts[:BITS, :BITS] / n - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    free, groups = set(range(BITS)), []
    for k in range(parts):
        width = BITS // parts + (k < BITS % parts)
        group = [max(sorted(free), key=lambda b: corr[b, sorted(free)].sum())]
        free.remove(group[0])
        while len(group) < width:
            group.append(best := max(sorted(free), key=lambda b: corr[b, group].sum()))
            free.remove(best)
        groups.append(sorted(group))
    return groups


def value_of(bits: list[int]) -> Column:
    """The bits of a partition as a number."""
    taken = [F.shiftleft(F.shiftrightunsigned("fp", b).bitwiseAND(F.lit(1)), i) for i, b in enumerate(bits)]
    out = taken[0]
    for bit in taken[1:]:
        out = out.bitwiseOR(bit)
    return out.cast("long")


def value_counts(fps: DataFrame, groups: list[list[int]]) -> list[np.ndarray]:
    """How many fingerprints have each value of each partition: at most 2 ** width numbers for each."""
    cells = fps.select(F.explode(F.array(*(
        F.struct(F.lit(k).alias("part"), value_of(bits).alias("value")) for k, bits in enumerate(groups)))).alias("c"))
    table = cells.groupBy("c.part", "c.value").count().toArrow()
    part, value, n = (table.column(i).to_numpy() for i in range(3))
    out = [np.zeros(1 << len(bits), np.float64) for bits in groups]
    for k, counts in enumerate(out):
        counts[value[part == k]] = n[part == k]
    return out


def candidates(counts: np.ndarray, distance: int) -> list[float]:
    """Candidate pairs plus probes of a partition for the thresholds -1, 0, ..., distance."""
    width = int(counts.size).bit_length() - 1
    near = [counts.copy()] + [np.zeros_like(counts) for _ in range(distance)]
    values = np.arange(counts.size)
    for b in range(width):
        for t in range(distance, 0, -1):
            near[t] = near[t] + near[t - 1][values ^ (1 << b)]
    out, pairs, probes, ball = [0.0], 0.0, 0.0, 1.0
    for t in range(distance + 1):
        pairs += float((counts * near[t]).sum())
        probes += ball * float(counts.sum())
        ball = ball * (width - t) / (t + 1)
        out.append(pairs + probes)
    return out


def allocate(costs: list[list[float]], distance: int) -> list[int]:
    """Thresholds that add up to ``distance - partitions + 1`` at the least total cost."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for total, (spent, chosen) in best.items():
            for t in range(-1, distance + 1):
                new = (spent + cost[t + 1], [*chosen, t])
                if total + t not in step or new < step[total + t]:
                    step[total + t] = new
        best = step
    return best[distance - len(costs) + 1][1]


def probes(fps: DataFrame, groups: list[list[int]], thresholds: list[int]) -> DataFrame:
    """``key, role`` and the columns: each fingerprint in its own bucket (role 0) and in those within the threshold (role 1)."""
    rows = []
    for k, (bits, threshold) in enumerate(zip(groups, thresholds, strict=True)):
        if threshold < 0:
            continue
        masks = [sum(1 << b for b in flips) for t in range(threshold + 1) for flips in combinations(range(len(bits)), t)]
        at = F.explode(F.array(*(F.lit(m).cast("long") for m in masks))).alias("mask")
        rows.append(fps.select("*", value_of(bits).alias("value"), at).select(
            (F.lit(k << BITS // 2).cast("long") + F.col("value").bitwiseXOR(F.col("mask"))).alias("key"),
            F.when(F.col("mask") == 0, 0).otherwise(1).cast("int").alias("role"), *fps.columns))
    out = rows[0]
    for more in rows[1:]:
        out = out.union(more)
    return out


def dealt(table: DataFrame, bucket_rows: int) -> DataFrame:
    """Buckets with a sub-bucket: one for each pair of chunks, so that a large bucket is many tasks."""
    large = land(table.groupBy("key").count().filter(F.col("count") > bucket_rows), "large-buckets")
    chunks = F.ceil(F.coalesce("count", F.lit(1)) / F.lit(bucket_rows)).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    return (
        table.join(large, "key", "left").withColumn("chunks", chunks).withColumn("own", own)
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("key", F.least("own", "with").alias("low"), F.greatest("own", "with").alias("high"), "role", "fp", "other", "n")
    )


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges between numbers, replaced by each node's edge to the smallest node of its component."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = np.split(ends, 2)
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def links(table: DataFrame, distance: int, total: int | None) -> DataFrame:
    """Verified links ``(u, v)`` of all buckets, as a forest for each stretch of buckets.

    ``total`` bounds the differing bits of both fingerprints; the numbers of shingles
    then have to agree too.
    """
    def near(a: np.ndarray, b: np.ndarray, one: tuple, two: tuple) -> tuple[np.ndarray, np.ndarray]:
        """Of candidate positions ``a`` and ``b`` in two stretches those that link."""
        if total is None or not len(a):
            return a, b
        bits = np.bitwise_count(one[0][a] ^ two[0][b]).astype(np.int64) + np.bitwise_count(one[1][a] ^ two[1][b])
        x, y = one[2][a], two[2][b]
        keep = (bits <= total) & (5 * np.minimum(x, y) >= 4 * np.maximum(x, y))
        return a[keep], b[keep]

    def verify(key: np.ndarray, role: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
        fp = columns[0]
        last = np.append(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, len(fp))
        first = np.insert(last[:-1], 0, 0)
        u, v, held = [], [], 0

        def add(a: np.ndarray, b: np.ndarray) -> None:
            nonlocal u, v, held
            if len(a):
                u.append(a)
                v.append(b)
                held += len(a)
                if held > 1 << 20:
                    a, b = forest(np.concatenate(u), np.concatenate(v))
                    u, v, held = [a], [b], len(a)

        # Small buckets all at once: each row with the next, the one after that, and so on.
        end = np.repeat(last, last - first)
        small = np.repeat(last - first <= SMALL, last - first)
        at, step = np.flatnonzero((role == 0) & small), 1
        while len(at := at[at + step < end[at]]):
            a = at[np.bitwise_count(fp[at] ^ fp[at + step]) <= distance]
            a, b = near(a, a + step, columns, columns)
            add(fp[a], fp[b])
            step += 1
        # Large ones block by block.
        for lo, hi in zip(first.tolist(), last.tolist(), strict=True):
            own = lo + int((role[lo:hi] == 0).sum())
            if hi - lo > SMALL:
                rows = max(1, (1 << 20) // (hi - lo))
                for top in range(lo, own, rows):
                    block = fp[top:min(top + rows, own)]
                    a, b = np.nonzero(np.bitwise_count(block[:, None] ^ fp[None, top:hi]) <= distance)
                    a, b = near(a[a < b] + top, b[a < b] + top, columns, columns)
                    add(fp[a], fp[b])
        a, b = forest(np.concatenate(u), np.concatenate(v)) if held else (fp[:0], fp[:0])
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A bucket may go on in the next batch; its rows are carried over.
        rest = None
        for batch in batches:
            parts = (
                np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "low", "high")], axis=1),
                batch.column("role").to_numpy(), *(batch.column(c).to_numpy().view(np.uint64) for c in ("fp", "other")), batch.column("n").to_numpy())
            if rest is not None:
                parts = tuple(np.concatenate(x) for x in zip(rest, parts, strict=True))
            cut = np.flatnonzero((parts[0] != parts[0][-1]).any(axis=1)) if len(parts[0]) else []
            cut = cut[-1] + 1 if len(cut) else 0
            if cut:
                yield verify(*(x[:cut] for x in parts))
            rest = tuple(x[cut:] for x in parts)
        if rest is not None and len(rest[0]):
            yield verify(*rest)

    # Numbers only: large batches are small.
    table.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    spread = table.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "role")
    return spread.mapInArrow(run, "u long, v long")


def linked(fps: DataFrame, distance: int, total: int | None, parts: int, bucket_rows: int = 1 << 14) -> DataFrame:
    """Links ``(u, v)`` of distinct fingerprints ``fp, other, n``, a forest of them for each stretch of buckets."""
    groups = group_bits(together(fps), parts)
    thresholds = allocate([candidates(c, distance) for c in value_counts(fps.select("fp"), groups)], distance)
    return land(links(dealt(probes(fps, groups, thresholds), bucket_rows), distance, total), "links")


def near_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5,
    distance: int = 12, total: int | None = 24, parts: int = 6, bucket_rows: int = 1 << 14,
) -> DataFrame:
    """One row per input row: ``doc_id, fp, component_id, kept`` and the locator.

    ``component_id`` is the smallest identifier reachable over links of at most
    ``distance`` differing bits, and ``total`` with the second fingerprint (None: no
    second one); the row that carries it is kept.
    """
    rows = land(fingerprints(located(docs), id_col, text_col, shingle, total is not None), "fingerprints")
    fps = land(rows.groupBy("fp").agg(F.min(F.struct("other", "n")).alias("m")).select("fp", "m.other", "m.n"), "distinct-fingerprints")
    roots = land(components(linked(fps, distance, total, parts, bucket_rows)), "components")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", FILE, ROW)).alias("first")
    firsts = land(rows.groupBy("fp").agg(first), "firsts")
    root = F.coalesce("root", "fp").alias("root")
    classes = firsts.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", root)
    heads = land(classes.groupBy("root").agg(F.min("first").alias("head")), "heads")
    named = land(classes.select("fp", "root").join(heads, "root").select("fp", "head"), "named")
    return rows.join(named, "fp").select(
        "doc_id", "fp", F.col("head.doc_id").alias("component_id"),
        ((F.col(FILE) == F.col(f"head.{FILE}")) & (F.col(ROW) == F.col(f"head.{ROW}"))).alias("kept"), FILE, ROW)


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The documents with one of each group of near duplicates, the one with the smallest identifier."""
    rows = located(docs)
    return without(rows, near_components(rows, **options).filter("not kept"))

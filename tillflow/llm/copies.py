"""Near copies by exact Jaccard similarity of shingle sets.

Two texts link if their sets of word shingles have a Jaccard similarity of
``SHARE`` or more, 0.8.  Pairs are proposed by SimHash first: the links of the
fingerprints of the sets at ``NEAR`` differing bits, and of nodes with equal fingerprints.
Fingerprints that near find the closest pairs only, and those at 0.8 differ in some ten bits,
so MinHash bands propose the rest, for nodes that SimHash has not joined: 32 bands of 5 minima
leave out a pair of similarity 0.8 three times in a million, and closer pairs
less often.  Two bits of each of the 160 minima are a sketch of 48 bytes that goes with the
node into its buckets, and pairs are screened there: a pair whose sketches differ in
more places than a pair of similarity 0.8 does once in a million (``LOST``) goes no
further.  What is left is decided on the two whole sets, before any component is
formed; no sketch links anything.  Sets are made for nodes that share a bucket with another component only.

Texts with equal sets are one node, named by 128 bits of the set.  A group of
copies makes no square of pairs: in each bucket one node is compared with the
others first, and after that only nodes of different components, inside the
bucket's task; a large bucket is dealt to a task for each pair of its chunks.
All of those are compared, so no candidate pair is left open except inside a component.

Defined results.  Shingles count once, as 64-bit hashes.  A null text is the
empty text; texts without words are copies of each other.  Fewer words than a
shingle are one shingle.  Null identifiers count as larger than others.  Repeated
rows get the same component.  An empty table gives an empty result.  Other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillflow.llm import simhash
from tillflow.llm.components import components
from tillflow.llm.simhash import MIX, SEED, forest, set_fingerprint, shingle_hashes
from tillflow.llm.tables import FILE, ROW, land, located, passing, small_batches, text_of

# The least similarity of a link, as a fraction.
SHARE = (4, 5)
BANDS, MINIMA = 32, 5
# Differing bits of fingerprints that propose a pair, and the partitions of the bits, as of ``op9``: buckets of more bits make a large group of near copies a square.
NEAR, PARTS = 4, 4
# Hashes permuted at a time.
BLOCK = 512
# Further rounds of one against the others, while open pairs are more than so many for each row of a bucket.
OPEN = 256
# Rows of a chunk of a large bucket; buckets up to SMALL rows are compared many at a time.
CHUNK, SMALL = 2048, 128
# Columns of the sketch: three with the first bits of the minima, three with the second ones.
SKETCH = [f"s{k}" for k in range(6)]
# Written tables of so many rows are broadcast: keys, or nodes with the place of a text.
BROADCAST_ROWS = 500_000
# Odd multipliers: each orders the hashes anew.
FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * MINIMA, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def lost(minima: int, share: float, chance: float) -> int:
    """In so many places two sketches of sets of similarity ``share`` differ at most, but for a chance."""
    # Different minima agree in both bits one time in four.
    p, tail, k = (1 - share) * 3 / 4, 0.0, minima
    while (tail := tail + math.comb(minima, k) * p ** k * (1 - p) ** (minima - k)) <= chance:
        k -= 1
    return k


LOST = lost(BANDS * MINIMA, SHARE[0] / SHARE[1], 1e-6)


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The hashes of the shingles, ascending, each once."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, shingle)]))


def lowest(hashes: np.ndarray) -> np.ndarray:
    """The minima of the hashes in each of the orders."""
    low = np.full(BANDS * MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), BLOCK):
        low = np.minimum(low, (hashes[at:at + BLOCK, None] * FACTORS).min(axis=0))
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    """A number for each band, made from its minima."""
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in low.reshape(BANDS, MINIMA).T:
        keys = (keys ^ column) * np.uint64(MIX)
        keys ^= keys >> np.uint64(29)
    return keys


def sketch(low: np.ndarray) -> np.ndarray:
    """Two bits of each of the minima, as the numbers of ``SKETCH``."""
    two = (low * np.uint64(MIX)) >> np.uint64(62)
    planes = np.zeros((2, 192), np.uint8)
    planes[:, :len(low)] = two & np.uint64(1), two >> np.uint64(1)
    return np.packbits(planes, axis=1).view(np.uint64).ravel()


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint64), *arrays]).view(np.int64)))


def marks(rows: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """``doc_id`` and the locator of each located row, its ``node``, the size ``n`` of its set, its bands' ``keys``, its fingerprint ``fp`` and its sketch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, keys, prints, sketches = [], [], [], [], np.zeros((batch.num_rows, len(SKETCH)), np.uint64)
            for at, text in enumerate(batch.column("text").to_pylist()):
                hashes = shingle_set(text, shingle)
                low = lowest(hashes)
                nodes.append(xxhash.xxh3_128_digest(hashes.astype("<u8").tobytes()))
                sizes.append(len(hashes))
                keys.append(band_keys(low))
                prints.append(set_fingerprint(hashes))
                sketches[at] = sketch(low)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", FILE, ROW)), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), _lists(keys),
                 pa.array(np.array(prints, np.uint64).view(np.int64)), *map(pa.array, sketches.T.copy().view(np.int64))],
                ["doc_id", FILE, ROW, "node", "n", "keys", "fp", *SKETCH])

    inputs = rows.select(F.col(id_col).alias("doc_id"), FILE, ROW, text_of(text_col).alias("text"))
    kind = inputs.schema["doc_id"].dataType.simpleString()
    numbers = ", ".join(f"{c} long" for c in SKETCH)
    return small_batches(inputs).mapInArrow(run, f"doc_id {kind}, {FILE} string, {ROW} long, node binary, n long, keys array<long>, fp long, {numbers}")


def shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """``node, hashes`` of ``node, text``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, shingle) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), _lists(sets)], ["node", "hashes"])

    return small_batches(texts).mapInArrow(run, "node binary, hashes array<long>")


def buckets(nodes: DataFrame) -> DataFrame:
    """``key, node, n`` and the sketch: each node in its bands' buckets, of which those with one node only are left out.

    Only the keys are exchanged for all nodes; sketches join those that share a bucket.
    """
    every = nodes.select(F.explode("keys").alias("key"), "node")
    mark = F.xxhash64("node")
    shared = land(every.groupBy("key").agg(F.min(mark).alias("low"), F.max(mark).alias("high")).filter("low <> high").select("key"), "shared-keys")
    return every.join(_small(shared), "key", "left_semi").join(nodes.drop("keys", "fp"), "node")


def _small(table: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it has few rows; otherwise Spark joins by an exchange."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _alike(common: Column | int, x: Column, y: Column) -> Column:
    """Whether sets of these sizes with so much in common are similar enough."""
    part, whole = SHARE
    return F.lit(whole) * common >= F.lit(part) * (x + y - common)


def _pairs(rows: DataFrame) -> DataFrame:
    """Distinct pairs ``(u, v)`` of rows with a node, its size and sketch, and the same under ``first``, that could link."""
    bits = [F.col(c).bitwiseXOR(F.col(f"first.{c}")) for c in SKETCH]
    differ = reduce(Column.__add__, (F.bit_count(a.bitwiseOR(b)) for a, b in zip(bits[:3], bits[3:], strict=True)))
    return rows.filter(_alike(F.least("n", "first.n"), F.col("n"), F.col("first.n")) & (differ <= LOST)).select(
        F.greatest("node", "first.node").alias("u"), F.least("node", "first.node").alias("v")).distinct()


def proposed(nodes: DataFrame) -> DataFrame:
    """Pairs ``(u, v)`` of nodes with the same fingerprint or linked ones, by the SimHash operator.

    One node stands for a fingerprint; the others of it are paired with that one.
    """
    first = F.min(F.struct("node", "n", *SKETCH)).alias("first")
    heads = land(nodes.groupBy("fp").agg(first), "heads-of-fingerprints")
    links = simhash.linked(heads.select("fp", F.lit(0).cast("long").alias("other"), F.lit(0).cast("long").alias("n")), NEAR, None, PARTS)
    far = links.join(heads.select(F.col("fp").alias("u"), F.col("first").alias("one")), "u").select("v", "one.*")
    same = nodes.join(heads, "fp").filter("node <> first.node")
    columns = ["node", "n", *SKETCH, "first"]
    return _pairs(same.select(*columns).union(far.join(heads.withColumnRenamed("fp", "v"), "v").select(*columns)))


def sets_of(nodes: DataFrame, docs: DataFrame, firsts: DataFrame, shingle: int) -> DataFrame:
    """``node, hashes`` of the nodes; ``firsts`` says where a text of each is."""
    wanted = land(firsts.join(nodes, "node").select("node", F.xxhash64(f"first.{FILE}").alias("place"), f"first.{ROW}"), "wanted")
    texts = docs.select(F.xxhash64(FILE).alias("place"), ROW, "text").join(_small(wanted), ["place", ROW]).select("node", "text")
    return land(shingle_sets(texts, shingle), "shingle-sets")


def verified(pairs: DataFrame, sets: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The pairs whose sets are similar enough."""
    found = sets(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct())
    one, two = (found.select(F.col("node").alias(end), F.col("hashes").alias(name)) for end, name in (("u", "a"), ("v", "b")))
    return pairs.join(one, "u").join(two, "v").filter(
        _alike(F.size(F.array_intersect("a", "b")), F.size("a"), F.size("b"))).select("u", "v")


def stars(rows: DataFrame, turn: int) -> DataFrame:
    """Pairs of one node of each bucket, another one each turn, with the others that are not in its component."""
    first = F.min(F.struct(F.xxhash64("node", F.lit(turn)), "node", "n", "root", *SKETCH)).alias("first")
    heads = land(rows.groupBy("key").agg(first), "heads-of-buckets")
    return _pairs(rows.join(heads, "key").filter("root <> first.root"))


def screen(key: np.ndarray, root: np.ndarray, n: np.ndarray, sketches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of rows of one bucket and of different components that could link."""
    part, whole = SHARE

    def near(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        small, large = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
        keep = (root[a] != root[b]) & (whole * small >= part * large)
        a, b = a[keep], b[keep]
        bits = sketches[a] ^ sketches[b]
        keep = np.bitwise_count(bits[:, :3] | bits[:, 3:]).sum(axis=1) <= LOST
        return a[keep], b[keep]

    last = np.append(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, len(key))
    first = np.insert(last[:-1], 0, 0)
    found = []
    # Small buckets all at once: each row with the next, the one after that, and so on.
    end = np.repeat(last, last - first)
    at, step = np.flatnonzero(np.repeat(last - first <= SMALL, last - first)), 1
    while len(at := at[at + step < end[at]]):
        found.append(near(at, at + step))
        step += 1
    # Of large ones what is not in the largest component, with all the others, block by block.
    for lo, hi in zip(first.tolist(), last.tolist(), strict=True):
        if hi - lo > SMALL:
            names, counts = np.unique(root[lo:hi], return_counts=True)
            asks = lo + np.flatnonzero(root[lo:hi] != names[counts.argmax()])
            rows = max(1, (1 << 18) // (hi - lo))
            for top in range(0, len(asks), rows):
                block = asks[top:top + rows]
                found.append(near(np.repeat(block, hi - lo), np.tile(np.arange(lo, hi), len(block))))
    empty = np.zeros(0, np.int64)
    return tuple(np.concatenate([empty, *x]) for x in (zip(*found, strict=True) if found else ((), ())))


def alike(a: np.ndarray, b: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Which pairs of positions have sets that are similar enough: decided on all hashes."""
    part, whole = SHARE
    order = np.argsort(a, kind="stable")
    keep = np.zeros(len(a), bool)
    cuts = [*np.flatnonzero(np.diff(a[order], prepend=-1)).tolist(), len(a)]
    for lo, hi in pairwise(cuts):
        mine = sets[a[order[lo]]]
        others = [sets[k] for k in b[order[lo:hi]].tolist()]
        sizes = np.fromiter(map(len, others), np.int64, len(others))
        every = np.concatenate(others)
        at = np.minimum(np.searchsorted(mine, every), len(mine) - 1) if len(mine) else np.zeros(len(every), np.int64)
        hits = np.insert(np.cumsum(mine[at] == every), 0, 0) if len(mine) else np.zeros(len(every) + 1, np.int64)
        ends = np.cumsum(sizes)
        common = hits[ends] - hits[ends - sizes]
        keep[order[lo:hi]] = whole * common >= part * (sizes + len(mine) - common)
    return keep


def crossing(rows: DataFrame, sizes: DataFrame, sets: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links between nodes of a bucket that are in different components, as a forest for each stretch of buckets.

    ``sizes`` has the rows ``s`` of open buckets.  The rows take their whole sets along, so what the
    sketches let pass is decided where it is found.
    """
    cell = ["key", "low", "high"]
    chunks = F.ceil(F.col("s") / F.lit(CHUNK)).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    asks = land(rows.join(sizes.select("key", chunks.alias("chunks")), "key").withColumn("own", own), "open-rows")
    held = asks.join(sets(asks.select("node").distinct()), "node")
    dealt = held.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "key", F.least("own", "with").alias("low"), F.greatest("own", "with").alias("high"), "node", F.xxhash64("root").alias("root"), "n", *SKETCH, "hashes")

    def links(table: pa.Table) -> pa.RecordBatch:
        numbers = lambda *names: [table.column(c).to_numpy().astype(np.int64) for c in names]
        root, n = numbers("root", "n")
        a, b = screen(np.stack(numbers(*cell), axis=1), root, n, np.stack(numbers(*SKETCH), axis=1).view(np.uint64))
        hashes = table.column("hashes").combine_chunks()
        values, ends = hashes.flatten().to_numpy().view(np.uint64), np.cumsum(pc.list_value_length(hashes).to_numpy())
        sets = np.split(values, ends[:-1])
        keep = alike(a, b, sets)
        u, v = forest(a[keep], b[keep])
        nodes = table.column("node").combine_chunks()
        u, v = nodes.take(pa.array(u)), nodes.take(pa.array(v))
        more = pc.greater(u, v)
        return pa.RecordBatch.from_arrays([pc.if_else(more, u, v), pc.if_else(more, v, u)], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A bucket may go on in the next batch; its rows are carried over.
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy() for c in cell], axis=1)
            cut = np.flatnonzero((key != key[-1]).any(axis=1))
            if len(cut):
                yield links(pa.Table.from_batches([*held, batch.slice(0, cut[-1] + 1)]))
                held = [batch.slice(cut[-1] + 1)]
            elif held and [held[-1].column(c)[-1] for c in cell] != [batch.column(c)[0] for c in cell]:
                yield links(pa.Table.from_batches(held))
                held = [batch]
            else:
                held.append(batch)
        if held:
            yield links(pa.Table.from_batches(held))

    return small_batches(dealt.repartition(*cell).sortWithinPartitions(*cell)).mapInArrow(run, "u binary, v binary")


def linked(table: DataFrame, pairs: DataFrame, sets: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``node, root`` for the nodes that have a link; the components of all candidates whose ``sets`` are similar enough.

    Candidates are the given pairs first, then nodes of a bucket that those have not joined.
    """
    found = [land(verified(land(pairs, "proposed"), sets), "proposed-links")]

    def joined() -> tuple[DataFrame, DataFrame]:
        roots = land(components(reduce(DataFrame.union, found)), "components")
        labels = roots.select("node", F.col("root").alias("label"))
        return roots, land(table.join(labels, "node", "left").select(
            "key", "node", "n", *SKETCH, F.coalesce("label", "node").alias("root")), "labelled")

    roots, rows = joined()
    before = None
    for turn in range(1 << 30):
        found.append(land(verified(land(stars(rows, turn), "stars"), sets), "star-links"))
        roots, rows = joined()
        parts = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("count"))
        sums = parts.groupBy("key").agg(F.sum("count").alias("s"), F.sum(F.col("count") * F.col("count")).alias("q"), F.count(F.lit(1)).alias("k"))
        still = land(sums.filter("k > 1"), "open-buckets")
        size, now = still.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum((F.col("s").cast("double") * F.col("s") - F.col("q")) / 2), F.lit(0.0))).first()
        if now <= OPEN * size or before is not None and 2 * now > before:
            break
        before = now
    if not now:
        return roots
    found.append(land(crossing(rows, still, sets), "crossing-links"))
    return land(components(reduce(DataFrame.union, found)), "components")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """One row per input row: ``doc_id, component_id, kept`` and the locator.

    ``component_id`` is the smallest identifier reachable over links; the row that carries it is kept.
    """
    docs = located(docs)
    rows = land(marks(docs, id_col, text_col, shingle), "marks")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", FILE, ROW)).alias("first")
    firsts = land(rows.groupBy("node").agg(first), "firsts")
    nodes = land(rows.dropDuplicates(["node"]).select("node", "n", "keys", "fp", *SKETCH), "nodes")
    table = land(buckets(nodes), "buckets")
    texts = docs.select(FILE, ROW, text_of(text_col).alias("text"))
    roots = linked(table, proposed(nodes), lambda nodes: sets_of(nodes, texts, firsts, shingle))
    classes = firsts.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    heads = land(classes.groupBy("root").agg(F.min("first").alias("head")), "heads")
    named = land(classes.select("node", "root").join(heads, "root").select("node", "head"), "named")
    return rows.join(named, "node").select(
        "doc_id", F.col("head.doc_id").alias("component_id"),
        ((F.col(FILE) == F.col(f"head.{FILE}")) & (F.col(ROW) == F.col(f"head.{ROW}"))).alias("kept"), FILE, ROW)


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The documents with one of each group of near copies, the one with the smallest identifier.

    Of the tables written on the way only the list of dropped rows stays.
    """
    rows = located(docs)
    with passing(docs.sparkSession):
        dropped = land(near_copies(rows, **options).filter("not kept").select(FILE, ROW), "dropped", stays=True)
    return rows.join(dropped, [FILE, ROW], "left_anti").drop(FILE, ROW)

"""Alignment of the tokens of two tokenizers over the bytes of the same texts.

Both tokenizers cut ``space + text`` into tokens (the second one adds the space itself).  Neither has
a token that runs over a space from what comes before it, so texts fall into units at such
spaces, and a run of texts has each different unit tokenized and aligned once.  Of the units, token lists are
flattened beside the index of their unit, and segmented cumulative sums of the token
lengths give where tokens end.  An Acero hash join on (unit, end) puts the ends of both in one
table: ends that both have cut the unit into groups, and every distinct end closes one
link, the overlap of one token with one other.  Texts take the results of their units in
a row.  ``Table.group_by`` counts the id pairs of each partition, and Spark adds the counts up.

A pair's count is needed again for each link.  The most frequent pairs, ``top`` at most, a number that does
not grow with the data, are broadcast; links of other pairs are joined to the counts.

Defined results.  Texts that are null or empty, or that one of the tokenizers does not give back
byte for byte, have no tokens: zeros, and no groups.  Texts of any length are aligned
whole.  Repeated rows count as often as they are there, null identifiers are kept, an
empty table gives an empty result, other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain, pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillflow.llm.bpe import byte_letters
from tillflow.llm.merges import slices
from tillflow.llm.tables import land, most_frequent, small_batches, text_of

COUNTS = ("n_a", "n_b", "n_groups", "n_links")
# Pairs that are broadcast.
TOP = 1 << 18
# Letters of the texts that are in work at a time; a longer text is in work alone.
LETTERS = 4_000_000
# Units aligned together, and links of a batch that is handed on.
TOGETHER, HANDED = 20_000, 200_000
# Different pairs that a task counts before it hands its counts on.
PAIRS = 1 << 20
# Small row groups: the lists of a task are long.
STORED = {"compression": "zstd", "parquet.block.size": str(16 << 20)}
SPACE = "▁"  # how pieces write a space
# From a space after something that is no white space up to the next such space.
UNIT = re.compile(r" *[^ ]+(?:(?<=\s) +[^ ]*)*| +")


class Tokens:
    """Both tokenizers, with the bytes of every token."""

    def __init__(self, first: str, second: str):
        # Spark's tasks use the cores already.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_file(first)
        self.first.encode_special_tokens = True
        self.first.no_truncation()
        self.first.no_padding()
        self.second = SentencePieceProcessor(model_file=second)
        value = {letter: byte for byte, letter in enumerate(byte_letters())}
        with open(first, encoding="utf-8") as file:
            spec = json.load(file)
        added = {t["content"] for t in spec["added_tokens"]}
        a = [b""] * self.first.get_vocab_size()
        for name, number in self.first.get_vocab().items():
            a[number] = b"" if name in added else bytes(value[c] for c in name)
        pieces = [self.second.id_to_piece(number) for number in range(self.second.get_piece_size())]
        b = [bytes([int(p[3:5], 16)]) if self.second.is_byte(n) else p.replace(SPACE, " ").encode() for n, p in enumerate(pieces)]
        cut = (spec["pre_tokenizer"] or {}).get("type") == "ByteLevel" and spec["pre_tokenizer"].get("use_regex", True)
        if not cut or any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("tokens that run over a space are not known here")
        self.bytes = pa.array(a, pa.binary()), pa.array(b, pa.binary())
        self.lengths = tuple(pc.binary_length(x).to_numpy().astype(np.int64) for x in self.bytes)
        self.decimals = tuple(pc.cast(pa.array(range(len(x))), pa.string()) for x in (a, b))
        self.width = len(b)
        # The second tokenizer gives nothing for nothing; what it makes of a space at the end of a text:
        self.space = self.second.encode("a ")[len(self.second.encode("a")):]

    def both(self, units: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """For each tokenizer the ids of all units in a row and the number of ids of each unit; the units
        that both give back."""
        lists = [
            [e.ids for e in self.first.encode_batch_fast(units, add_special_tokens=False)],
            [ids if len(unit) > 1 else self.space for ids, unit in zip(self.second.encode([u[1:] for u in units], num_threads=1), units, strict=True)],
        ]
        want = pa.array([u.encode() for u in units], pa.binary())
        flat, good = [], np.ones(len(units), bool)
        for ids, names in zip(lists, self.bytes, strict=True):
            counts = np.fromiter(map(len, ids), np.int64, len(ids))
            row = np.fromiter(chain.from_iterable(ids), np.int32, int(counts.sum()))
            joined = pc.binary_join(_lists(names.take(pa.array(row)), counts), b"")
            good &= pc.equal(joined, want).to_numpy(zero_copy_only=False)
            flat.append((row, counts))
        return [(row[np.repeat(good, counts)], np.where(good, counts, 0)) for row, counts in flat], good


@functools.cache
def tokens(first: str, second: str) -> Tokens:
    """One for each worker process."""
    return Tokens(first, second)


def _lists(values: pa.Array | np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    cuts = np.insert(np.cumsum(sizes), 0, 0).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(cuts), values if isinstance(values, pa.Array) else pa.array(values))


def _ends(ids: np.ndarray, parent: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Where each token ends in its unit: a cumulative sum that starts anew with each unit."""
    upto = np.cumsum(lengths[ids])
    first = np.flatnonzero(np.diff(parent, prepend=-1))
    before = upto[first] - lengths[ids[first]]
    return upto - np.repeat(before, np.diff(first, append=len(ids)))


def aligned(known: Tokens, units: list[str]) -> pa.Table:
    """``n_a, n_b, n_groups, n_links, groups, pairs, good`` of each unit; ``pairs`` are its links."""
    m = len(units)
    sides, good = known.both(units)
    tables = []
    for k, (ids, counts) in enumerate(sides):
        parent = np.repeat(np.arange(m), counts)
        tables.append(pa.table({"unit": parent, "end": _ends(ids, parent, known.lengths[k]), "ab"[k]: ids}))
    links = tables[0].join(tables[1], ["unit", "end"], join_type="full outer", use_threads=False).sort_by([("unit", "ascending"), ("end", "ascending")])
    parent = links.column("unit").to_numpy()
    own = [pc.is_valid(links.column(c)).to_numpy() for c in "ab"]
    shared = own[0] & own[1]
    # Each token reaches up to its end, and the last ends of a unit are the same.
    a, b = (pc.fill_null_backward(links.column(c).combine_chunks()).to_numpy(zero_copy_only=False).astype(np.int64) for c in "ab")
    n_groups = np.bincount(parent[shared], minlength=m)
    group = np.cumsum(shared) - shared
    # The ids of each group, which count up with the tokens, with commas between them.
    texts = [
        pc.binary_join(_lists(known.decimals[k].take(pa.array(ids[there])), np.bincount(group[there], minlength=int(shared.sum()))), ",")
        for k, (ids, there) in enumerate(zip((a, b), own, strict=True))]
    groups = pc.binary_join(_lists(pc.binary_join_element_wise(*texts, "|"), n_groups), ";")
    n_links = np.bincount(parent, minlength=m)
    columns = [sides[0][1], sides[1][1], n_groups, n_links, groups, _lists(a * known.width + b, n_links), good]
    return pa.table(columns, [*COUNTS, "groups", "pairs", "good"])


class Texts(NamedTuple):
    """What a run of texts takes from its units."""

    counts: list[np.ndarray]
    groups: pa.Array
    links: pa.ListArray
    pairs: pa.Table


def texts_of(known: Tokens, texts: list[str]) -> Texts:
    """Counts, groups as text and links of each text; the pairs of all links with their counts."""
    split = [UNIT.findall(" " + t) if t else [] for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    places = pa.array(chain.from_iterable(split), pa.string()).dictionary_encode()
    del split
    names = places.dictionary
    units = pa.concat_tables([aligned(known, names.slice(at, TOGETHER).to_pylist()) for at in range(0, max(len(names), 1), TOGETHER)]).combine_chunks()
    order, parent = places.indices.to_numpy(), np.repeat(np.arange(len(texts)), sizes)
    good = units.column("good").to_numpy()
    whole = np.bincount(parent[~good[order]], minlength=len(texts)) == 0
    order, sizes = order[whole[parent]], np.where(whole, sizes, 0)
    ends = np.insert(np.cumsum(sizes), 0, 0)

    def total(name: str) -> np.ndarray:
        upto = np.insert(np.cumsum(units.column(name).to_numpy()[order]), 0, 0)
        return upto[ends[1:]] - upto[ends[:-1]]

    counts = [total(name) for name in COUNTS]
    one = lambda name: units.column(name).chunk(0) if units.num_rows else pa.array([], units.schema.field(name).type)
    groups = pc.binary_join(_lists(one("groups").take(pa.array(order)), sizes), ";")
    links = _lists(one("pairs").take(pa.array(order)).flatten(), counts[3])
    used = np.bincount(order, minlength=units.num_rows)
    pairs = pa.table({"pair": one("pairs").flatten(), "n": np.repeat(used, units.column("n_links").to_numpy())})
    return Texts(counts, groups, links, _counted([pairs]))


MARKED = "n_a long, n_b long, n_groups long, n_links long, groups string, links array<{link}>, pairs array<long>, counts array<long>, at long"


def _counted(tables: list[pa.Table]) -> pa.Table:
    """``pair, n`` of tables with such columns, each pair once."""
    return pa.concat_tables(tables).group_by("pair", use_threads=False).aggregate([("n", "sum")]).select(["pair", "n_sum"]).rename_columns(["pair", "n"])


def marked(docs: DataFrame, first: str, second: str, id_col: str, text_col: str, hashed: bool) -> DataFrame:
    """A row for each text with its links, and rows without ``at`` that hold pairs and their counts."""
    link = pa.int32() if len(tokens(first, second).bytes[0]) * tokens(first, second).width < 1 << 31 else pa.int64()
    schema = MARKED.format(link="int" if link == pa.int32() else "long")
    inputs = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    kind = inputs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *(c.split()[0] for c in MARKED.split(", "))]

    def counts(table: pa.Table, kind: pa.DataType) -> pa.RecordBatch:
        nothing = [pa.nulls(1, pa.int64())] * len(COUNTS)
        pairs, n = (_lists(table.column(c).to_numpy(), [table.num_rows]) for c in ("pair", "n"))
        return pa.RecordBatch.from_arrays(
            [pa.nulls(1, kind), *nothing, pa.nulls(1, pa.string()), pa.nulls(1, pa.list_(link)), pairs, n, pa.nulls(1, pa.int64())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tokens(first, second)
        at = TaskContext.get().partitionId() << 40
        held: list[pa.Table] = []
        for batch in batches:
            for part in slices(batch, LETTERS):
                m = part.num_rows
                found = texts_of(known, part.column("text").to_pylist())
                held = [_counted([*held, found.pairs])]
                groups = found.groups
                if hashed:
                    groups = pa.array([g and hashlib.sha256(g.encode()).hexdigest() for g in groups.to_pylist()], pa.string())
                nothing = pa.nulls(m, pa.list_(pa.int64()))
                rows = pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *map(pa.array, found.counts), groups, found.links.cast(pa.list_(link)), nothing, nothing, pa.array(at + np.arange(m))], names)
                # Spark gets small batches: a few hundred thousand links, or one longer text.
                cut = np.flatnonzero(np.diff(np.cumsum(found.counts[3]) // HANDED, prepend=0)).tolist()
                for start, end in pairwise([0, *(c for c in cut if 0 < c < m), m]):
                    yield rows.slice(start, end - start)
                at += m
                if held[0].num_rows > PAIRS:
                    yield counts(held.pop(), part.column("doc_id").type)
            if batch.num_rows:
                kind = batch.column("doc_id").type
        if held:
            yield counts(held.pop(), kind)

    return small_batches(inputs).mapInArrow(run, f"doc_id {kind}, {schema}")


def pair_counts(rows: DataFrame, width: int) -> DataFrame:
    """``pair, n, best``: how often each pair is linked, and whether no pair of the same second id is more often."""
    each = rows.filter(F.col("at").isNull()).select(F.explode(F.arrays_zip("pairs", "counts")).alias("p"))
    counts = land(each.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.counts").alias("n")), "pair-sums")
    second = F.pmod("pair", F.lit(width))
    most = counts.groupBy(second.alias("second")).agg(F.max("n").alias("most"))
    return land(counts.withColumn("second", second).join(most, "second").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pair-counts")


def scored(rows: DataFrame, counts: DataFrame, top: int) -> DataFrame:
    """The rows of the texts with ``n_best, count_sum`` over their frequent links, and the other links in ``rare``."""
    frequent = most_frequent(counts, "n", top).toArrow().sort_by("pair")
    shared = rows.sparkSession.sparkContext.broadcast(
        (frequent.column("pair").to_numpy(), frequent.column("n").to_numpy(), frequent.column("best").to_numpy().astype(np.int64)))
    passed = ["doc_id", *COUNTS, "groups", "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = shared.value
        for batch in batches:
            column = batch.column("links")
            ends = np.insert(np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)), 0, 0)
            links = column.flatten().dictionary_encode()
            own = links.dictionary.to_numpy(zero_copy_only=False).astype(np.int64)
            place = np.minimum(np.searchsorted(pairs, own), max(len(pairs) - 1, 0))
            known = pairs[place] == own if len(pairs) else np.zeros(len(own), bool)
            order = links.indices.to_numpy()
            sums = []
            for value in (best, n):
                each = np.where(known, value[place], 0) if len(pairs) else np.zeros(len(own), np.int64)
                upto = np.insert(np.cumsum(each[order]), 0, 0)
                sums.append(pa.array(upto[ends[1:]] - upto[ends[:-1]]))
            rest = ~known[order]
            cuts = np.insert(np.cumsum(rest), 0, 0)[ends].astype(np.int32)
            rare = pa.ListArray.from_arrays(pa.array(cuts), pa.array(own[order[rest]]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in passed), *sums, rare], [*passed, "n_best", "count_sum", "rare"])

    texts = rows.filter(F.col("at").isNotNull()).select(*passed, "links")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.select(*passed).schema)
    return small_batches(texts).mapInArrow(run, f"{schema}, n_best long, count_sum long, rare array<long>")


def align(
    docs: DataFrame, first: str, second: str, id_col: str = "doc_id", text_col: str = "text", top: int = TOP, hashed: bool = False,
) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups`` of each row.

    ``groups`` is ``a1,a2|b1;a3|b2,b3``, the ids of both sides of each group; with ``hashed`` its SHA-256, or nothing for no tokens.
    ``n_best`` counts the links whose pair is the most frequent one of its second id, and ``count_sum``
    adds up the counts of the links' pairs.
    """
    rows = land(marked(docs, first, second, id_col, text_col, hashed), "links", **STORED)
    counts = pair_counts(rows, tokens(first, second).width)
    found = land(scored(rows, counts, top), "scored")
    rare = found.filter(F.size("rare") > 0).select("at", F.explode("rare").alias("pair")).groupBy("at", "pair").agg(F.count(F.lit(1)).alias("k"))
    more = rare.join(counts, "pair").groupBy("at").agg(
        F.sum(F.when(F.col("best"), F.col("k")).otherwise(0)).alias("more_best"), F.sum(F.col("k") * F.col("n")).alias("more_sum"))
    zero = F.lit(0)
    return found.join(more, "at", "left").select(
        "doc_id", *COUNTS, (F.col("n_best") + F.coalesce("more_best", zero)).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", zero)).alias("count_sum"), "groups")

"""Byte-pair encoding and decoding with a pair occurrence index.

A vocabulary file of the ``tokenizers`` library gives ids, ranks of merges and
special tokens.  Words not met before in a partition are laid out as one sequence of
symbols.  An index maps each pair that has a rank to all its positions.  The
active ranks are applied in ascending order from a heap; a merge at a position
replaces the pairs on its left and right, and only their lists are updated.  The
merged words are kept for the next rows, up to ``KEEP_WORDS``.

Defined results.  A null text is the empty text and has no ids; texts of white
space only have none either.  Texts of any length are encoded whole.  Repeated
rows repeat their result, null identifiers are kept, an empty table gives an empty
result, other columns are ignored.  Ids that the vocabulary lacks decode to
nothing.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillflow.llm.tables import small_batches, text_of

KEEP_WORDS = 250_000
# The splitting pattern of the vocabulary file, for lower-cased text;
# white space by its Unicode property.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
ANY_WORD = regex.compile(rf"{CONTRACTIONS}|\p{{L}}+|\p{{N}}|[^\p{{White_Space}}\p{{L}}\p{{N}}]+")
ASCII_WORD = re.compile(rf"{CONTRACTIONS}|[a-z]+|[0-9]|[^ \t-\ra-z0-9]+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where printable, else the next free one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


class Places(dict):
    """The number of each word; a word not met before gets the next one."""

    def __init__(self, known: Iterable[tuple[str, int]]):
        super().__init__(known)
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.fresh.append(word)
        return number


class Vocabulary:
    """Ids, merges and special tokens of a vocabulary file, and the words merged so far."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        kinds = {n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])}
        if model["type"] != "BPE" or model["byte_fallback"] or model["ignore_merges"] or kinds != {"NFC", "Replace", "Lowercase"}:
            raise ValueError(f"{path}: only byte-level BPE on lower-cased words is known")
        ids, end = model["vocab"], model["end_of_word_suffix"]
        letters = byte_letters()
        self.inner = [ids[c] for c in letters]
        self.final = [ids[c + end] for c in letters]
        self.rank: dict[int, int] = {}
        self.parts: list[tuple[int, int, int]] = []
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.rank[ids[a] << 32 | ids[b]] = rank
            self.parts.append((ids[a], ids[b], ids[a + b]))
        made = {new: rank for rank, (_, _, new) in enumerate(self.parts)}
        if any(max(made.get(a, -1), made.get(b, -1)) >= rank for rank, (a, b, _) in enumerate(self.parts)):
            raise ValueError(f"{path}: a merge comes before its parts, so ranks cannot be applied one after the other")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.names = np.array([""] * (max(*ids.values(), *self.special.values()) + 1), object)
        for name, i in (ids | self.special).items():
            self.names[i] = name
        self.gaps = bool((self.names == "").any())
        self.forget()

    def forget(self) -> None:
        """Drop the merged words; special tokens stay."""
        self.place = Places((name, k) for k, name in enumerate(self.special))
        self.tokens = array("i", self.special.values())
        self.ends = array("q", range(len(self.special) + 1))

    def words(self, text: str) -> list[str]:
        """Words and special tokens of a text, in order."""
        out: list[str] = []
        for piece in self.cut.split(text) if "<|" in text else [text]:
            if piece in self.special:
                out.append(piece)
            elif piece.isascii():
                out += ASCII_WORD.findall(piece.lower())
            else:
                # Sigma is lower-cased letter by letter, without its form at word ends.
                out += ANY_WORD.findall(unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower())
        return out

    def learn(self) -> None:
        """Merge the words that were new and keep their ids."""
        for ids in self.merged(self.place.fresh):
            self.tokens.extend(ids)
            self.ends.append(len(self.tokens))
        self.place.fresh.clear()

    def merged(self, words: list[str]) -> Iterator[list[int]]:
        """The ids of each word, by the pair occurrence index over all of them."""
        rank, parts = self.rank, self.parts
        symbol: list[int] = []
        bounds = [0]
        for word in words:
            data = word.encode()
            symbol += [self.inner[b] for b in data[:-1]]
            symbol.append(self.final[data[-1]])
            bounds.append(len(symbol))
        size = len(symbol)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        for start in bounds[:-1]:
            before[start] = -1
        for end in bounds[1:]:
            after[end - 1] = -1
        index: dict[int, list[int]] = {}
        for at in range(size):
            if (to := after[at]) >= 0 and (r := rank.get(symbol[at] << 32 | symbol[to])) is not None:
                index.setdefault(r, []).append(at)
        active = list(index)
        heapq.heapify(active)
        while active:
            now = heapq.heappop(active)
            one, two, new = parts[now]
            for at in sorted(index.pop(now)):
                # Positions whose pair has gone meanwhile are passed over.
                if symbol[at] != one or (to := after[at]) < 0 or symbol[to] != two:
                    continue
                symbol[at], symbol[to] = new, -1
                right = after[at] = after[to]
                if right >= 0:
                    before[right] = at
                    if (r := rank.get(new << 32 | symbol[right])) is not None:
                        if r not in index:
                            index[r] = []
                            heapq.heappush(active, r)
                        index[r].append(at)
                if (back := before[at]) >= 0 and (r := rank.get(symbol[back] << 32 | new)) is not None:
                    if r not in index:
                        index[r] = []
                        heapq.heappush(active, r)
                    index[r].append(back)
        for start, end in pairwise(bounds):
            yield [s for s in symbol[start:end] if s >= 0]

    def spell(self, ids: np.ndarray) -> str:
        """The names of ids with one space between them; ids without a name are passed over."""
        if len(ids) and (self.gaps or ids.min() < 0 or ids.max() >= len(self.names)):
            ids = ids[(ids >= 0) & (ids < len(self.names))]
            ids = ids[self.names[ids] != ""]
        return " ".join(self.names[ids].tolist())

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's ids end, with a leading 0."""
        split = [self.words(t) for t in texts]
        if len(self.ends) > KEEP_WORDS:
            self.forget()
        counts = np.fromiter(map(len, split), np.int64, len(split))
        order = np.fromiter(map(self.place.__getitem__, chain.from_iterable(split)), np.int64, counts.sum())
        self.learn()
        ends = np.frombuffer(self.ends, np.int64)
        starts = ends[order]
        sizes = ends[order + 1] - starts
        upto = np.insert(np.cumsum(sizes), 0, 0)
        ids = np.frombuffer(self.tokens, np.int32)[np.repeat(starts - upto[:-1], sizes) + np.arange(upto[-1])]
        return ids, upto[np.insert(np.cumsum(counts), 0, 0)]


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    """One for each worker process."""
    return Vocabulary(path)


def encode(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", rows: int = 256, spelled: bool = False,
) -> DataFrame:
    """``doc_id, ids`` of each row, and with ``spelled`` what the ids decode to, ``text``.

    Texts are encoded ``rows`` at a time, whole.  Worker processes outlive their
    tasks, so the merged words are dropped at the end of a partition.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                ids, ends = known.encode(part.column("text").to_pylist())
                lists = pa.LargeListArray.from_arrays(ends, ids) if ends[-1] >= 1 << 31 else pa.ListArray.from_arrays(ends.astype(np.int32), ids)
                columns = {"doc_id": part.column("doc_id"), "ids": lists}
                if spelled:
                    columns["text"] = pa.array([known.spell(ids[a:b]) for a, b in pairwise(ends)], pa.string())
                yield pa.RecordBatch.from_arrays([*columns.values()], [*columns])
        known.forget()

    inputs = small_batches(docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")))
    return inputs.mapInArrow(
        run, f"doc_id {inputs.schema['doc_id'].dataType.simpleString()}, ids array<int>" + ", text string" * spelled)


def decode(encoded: DataFrame, path: str, rows: int = 256) -> DataFrame:
    """``doc_id, ids, text``: the names of the ids with one space between them, special tokens too."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                texts = [known.spell(ids.values.to_numpy() if ids.is_valid else np.zeros(0, np.int32)) for ids in part.column("ids")]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, "text"])

    return small_batches(encoded.select("doc_id", "ids")).mapInArrow(
        run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, ids array<int>, text string")

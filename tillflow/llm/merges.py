"""Byte-level BPE encoding and decoding by replaying the merges over the words of the corpus.

A rank file gives the bytes of every token; a token's rank is its id.  A pattern cuts
texts into words, and merges stay inside a word.  The words of the whole corpus are
counted by grouped sums.  Over the most frequent ones, ``top`` at most, the merges are
replayed as a whole: an inverted index maps each rank to all positions of pairs that make
it, the ranks are applied in ascending order, and only the neighbours that a merge
touches enter the index anew.  The dictionary that comes out has ``top`` words of
``LONGEST`` letters at most, a bound that does not grow with the data, so it is
broadcast.  Words outside it are replayed in the same way, in the task that meets them;
texts wait there as numbers until many new words can be replayed together.

Ranks in ascending order are what a word alone would get, unless a merge makes a pair of
a lower rank than its own.  A word in which that happens is merged once more by
itself, lowest pair first.

Defined results.  A null text is the empty text and has no ids.  Texts of any length are
encoded whole.  Repeated rows repeat their result, null identifiers are kept, an
empty table gives an empty result, other columns are ignored.  Ids that the file
lacks decode to nothing.
"""

from __future__ import annotations

import base64
import functools
import heapq
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain, islice, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillflow.llm.tables import land, most_frequent, small_batches, text_of

# Words of the dictionary, and their greatest length.
TOP, LONGEST = 200_000, 64
# Letters of the texts that are in work at a time; a longer text is in work alone.
LETTERS = 2_000_000
# Words replayed together, and words kept in a task beside the dictionary.
TOGETHER, KEPT = 100_000, 250_000
# Texts of so many words wait in a task, as numbers, for the replay of their new words.
WAITING = 4_000_000


@functools.cache
def splitter(pattern: str) -> tuple[regex.Pattern, re.Pattern | None]:
    """The pattern for any text, white space by its Unicode property, and the same for ASCII texts."""
    plain = pattern.replace(r"[^\s\p{L}\p{N}]", r"[^ \t-\rA-Za-z0-9]")
    for name, letters in ((r"\p{L}", "[A-Za-z]"), (r"\p{N}", "[0-9]"), (r"\s", r"[ \t-\r]"), (r"\S", r"[^ \t-\r]")):
        plain = plain.replace(name, letters)
    whole = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
    return whole, None if r"\p" in plain else re.compile(plain)


def split_words(texts: list[str], pattern: str) -> list[list[str]]:
    """The words of each text."""
    whole, plain = splitter(pattern)
    return [(plain if plain and t.isascii() else whole).findall(t) for t in texts]


def slices(batch: pa.RecordBatch, letters: int = LETTERS) -> Iterator[pa.RecordBatch]:
    """The batch in runs of texts that are no longer together than so many letters, a longer text alone."""
    sizes = pc.utf8_length(batch.column("text")).to_numpy(zero_copy_only=False)
    start = held = 0
    for at, size in enumerate(sizes.tolist()):
        if held and held + size > letters:
            yield batch.slice(start, at - start)
            start, held = at, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


class Ranks:
    """The tokens of a rank file."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            pairs = (line.split() for line in file if line.strip())
            self.rank = {base64.b64decode(token): int(number) for token, number in pairs}
        self.names = [b""] * (max(self.rank.values()) + 1)
        for token, number in self.rank.items():
            self.names[number] = token
        missing = [b for b in range(256) if bytes([b]) not in self.rank]
        if missing:
            raise ValueError(f"{path}: no token for the bytes {missing}")
        self.single = [self.rank[bytes([b])] for b in range(256)]
        self.spelling = pa.array(self.names, pa.binary())
        self.whole = pa.array([t.decode() for t in self.rank if _is_text(t)], pa.string())
        # Every two tokens that make a third: the numbers of both as one key, and the rank.
        self.pair = {
            one << 32 | two: number for token, number in self.rank.items() for cut in range(1, len(token))
            if (one := self.rank.get(token[:cut])) is not None and (two := self.rank.get(token[cut:])) is not None}
        # The same for two bytes, -1 where they make none.
        self.of_bytes = np.array([self.rank.get(bytes([a, b]), -1) for a in range(256) for b in range(256)], np.int32).reshape(256, 256)

    def lowest_first(self, word: bytes) -> list[int]:
        """The ids of one word, always merging the pair of the lowest rank, of equal ones the first."""
        names, rank = self.names, self.rank
        symbol: list[int] = [self.single[b] for b in word]
        after, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
        after[-1] = -1
        heap: list[tuple[int, int, int, int]] = []

        def offer(at: int) -> None:
            if at >= 0 and (to := after[at]) >= 0 and (r := rank.get(names[symbol[at]] + names[symbol[to]])) is not None:
                heapq.heappush(heap, (r, at, symbol[at], symbol[to]))

        for at in range(len(word) - 1):
            offer(at)
        while heap:
            r, at, one, two = heapq.heappop(heap)
            if symbol[at] != one or (to := after[at]) < 0 or symbol[to] != two:
                continue
            symbol[at], symbol[to] = r, -1
            after[at] = after[to]
            if after[at] >= 0:
                before[after[at]] = at
            offer(at)
            offer(before[at])
        return [s for s in symbol if s >= 0]

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word, none of them empty: every merge, in the order of ranks, at all its positions."""
        data = np.frombuffer(b"".join(words), np.uint8)
        bounds = np.insert(np.cumsum(np.fromiter(map(len, words), np.int64, len(words))), 0, 0)
        symbol = np.array(self.single, np.int32)[data]
        after, before = np.arange(1, len(data) + 1, dtype=np.int32), np.arange(-1, len(data) - 1, dtype=np.int32)
        after[bounds[1:] - 1] = before[bounds[:-1]] = -1
        # The rank that each position makes with the next one, -1 without; by it positions whose pair has gone meanwhile are passed over.
        makes = np.full(len(data), -1, np.int32)
        makes[:-1] = self.of_bytes[data[:-1], data[1:]]
        makes[after < 0] = -1
        places = np.flatnonzero(makes >= 0)
        places = places[np.argsort(makes[places], kind="stable")]
        active, starts = (x.tolist() for x in np.unique(makes[places], return_index=True))
        index = {r: places[a:b].tolist() for r, (a, b) in zip(active, pairwise([*starts, len(places)]), strict=True)}
        odd: list[int] = []

        def enter(positions: np.ndarray, keys: np.ndarray, now: int) -> np.ndarray:
            """The ranks of pairs at positions; those of a rank enter the index."""
            found = [pair(k, -1) for k in keys.tolist()]
            for r, at in zip(found, positions.tolist(), strict=True):
                if r >= 0:
                    if r < now:
                        odd.append(at)
                    if r in index:
                        index[r].append(at)
                    else:
                        index[r] = [at]
                        heapq.heappush(active, r)
            return np.array(found, np.int32)

        pair = self.pair.get
        while active:
            now = heapq.heappop(active)
            at = np.array(sorted(index.pop(now)), np.int64)
            at = at[makes[at] == now]
            to = after[at]
            # Where a pair begins with the end of the one before it, every other pair of the run is merged.
            joined = to[:-1] == at[1:]
            if joined.any():
                count = np.arange(len(at))
                first = np.maximum.accumulate(np.where(np.insert(joined, 0, False), 0, count))
                at, to = at[(count - first) % 2 == 0], to[(count - first) % 2 == 0]
            right = after[to]
            makes[to] = symbol[to] = -1
            has = right >= 0
            inner, right = at[has], right[has]
            after[at] = -1
            after[inner] = right
            before[right] = inner
            # With the symbol on the right as it still is: merges go from left to right.
            makes[at] = -1
            makes[inner] = enter(inner, symbol[right] | np.int64(now << 32), now)
            symbol[at] = now
            back = before[at]
            back = back[back >= 0]
            makes[back] = enter(back, symbol[back].astype(np.int64) << 32 | now, now)
        left = symbol >= 0
        upto = np.insert(np.cumsum(left), 0, 0)[bounds].tolist()
        ids = symbol[left].tolist()
        again = {*(np.searchsorted(bounds, odd, "right") - 1).tolist()}
        return [self.lowest_first(word) if k in again else ids[a:b] for k, (word, (a, b)) in enumerate(zip(words, pairwise(upto), strict=True))]


def _is_text(token: bytes) -> bool:
    try:
        token.decode()
    except UnicodeDecodeError:
        return False
    return True


@functools.cache
def ranks(path: str) -> Ranks:
    """One for each worker process."""
    return Ranks(path)


def corpus_words(texts: DataFrame, path: str, pattern: str) -> DataFrame:
    """``word, n``: how often the corpus has each word that is no token itself."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = ranks(path).whole
        for batch in batches:
            for part in slices(batch):
                split = split_words(part.column("text").to_pylist(), pattern)
                counts = pa.array(chain.from_iterable(split), pa.string()).value_counts()
                counts = counts.filter(pc.invert(pc.is_in(counts.field("values"), whole)))
                yield pa.RecordBatch.from_arrays([counts.field("values"), counts.field("counts")], ["word", "n"])

    return small_batches(texts).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, path: str, top: int) -> pa.Table:
    """``word, ids`` of the most frequent words, ``top`` at most, of at most ``LONGEST`` letters."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = ranks(path)
        words = chain.from_iterable(batch.column("word").to_pylist() for batch in batches)
        while part := list(islice(words, TOGETHER)):
            ids = known.replay([w.encode() for w in part])
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array(ids, pa.list_(pa.int32()))], ["word", "ids"])

    chosen = most_frequent(counts.filter(F.char_length("word") <= LONGEST), "n", top).select("word")
    return land(chosen.repartition("word").mapInArrow(run, "word string, ids array<int>"), "dictionary").toArrow()


class Places(dict):
    """The number of each word; a word not met before gets the next one."""

    def __init__(self, known: Iterable[tuple[str, int]]):
        super().__init__(known)
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.fresh.append(word)
        return number


class Task:
    """Encodes texts of one partition, with the tokens, the dictionary and the other words met so far."""

    def __init__(self, path: str, pattern: str, frequent: pa.Table | None = None):
        self.ranks, self.pattern = ranks(path), pattern
        whole = self.ranks.whole.to_pylist()
        lists = [] if frequent is None else frequent.column("ids").chunks
        self.known = [*whole, *([] if frequent is None else frequent.column("word").to_pylist())]
        self.known_ids = np.concatenate([np.array([self.ranks.rank[w.encode()] for w in whole], np.int32), *(c.flatten().to_numpy() for c in lists)])
        sizes = np.concatenate([np.ones(len(whole), np.int64), *(pc.list_value_length(c).to_numpy() for c in lists)])
        self.known_ends = np.insert(np.cumsum(sizes), 0, 0)
        self.forget()

    def forget(self) -> None:
        """Drop the other words met; tokens and dictionary stay."""
        self.place = Places(zip(self.known, range(len(self.known)), strict=True))
        self.tokens, self.ends = array("i", self.known_ids.tobytes()), array("q", self.known_ends.tobytes())

    def learn(self) -> None:
        """Replay the words that were new and keep their ids."""
        fresh = self.place.fresh
        for at in range(0, len(fresh), TOGETHER):
            for ids in self.ranks.replay([w.encode() for w in fresh[at:at + TOGETHER]]):
                self.tokens.extend(ids)
                self.ends.append(len(self.tokens))
        fresh.clear()

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the words of all texts in a row, and how many each text has."""
        split = split_words(texts, self.pattern)
        counts = np.fromiter(map(len, split), np.int64, len(split))
        return np.fromiter(map(self.place.__getitem__, chain.from_iterable(split)), np.int32, counts.sum()), counts

    def ids(self, order: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's ids end, with a leading 0."""
        ends = np.frombuffer(self.ends, np.int64)
        starts = ends[order]
        each = ends[order + 1] - starts
        upto = np.insert(np.cumsum(each), 0, 0)
        ids = np.frombuffer(self.tokens, np.int32)[np.repeat(starts - upto[:-1], each) + np.arange(upto[-1])]
        return ids, upto[np.insert(np.cumsum(counts), 0, 0)]

    def encode(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        """Identifiers, ids and ends of slices of batches; new words of several slices are replayed together."""
        waiting: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        for part in chain(chain.from_iterable(map(slices, batches)), [None]):
            if part is not None:
                # A copy of the identifiers, which does not keep the texts of the batch in memory.
                doc_id = part.column("doc_id").take(pa.array(np.arange(part.num_rows)))
                waiting.append((doc_id, *self.numbers(part.column("text").to_pylist())))
                if len(self.place.fresh) < TOGETHER and sum(len(order) for _, order, _ in waiting) < WAITING:
                    continue
            self.learn()
            for doc_id, order, counts in waiting:
                yield doc_id, *self.ids(order, counts)
            waiting.clear()
            if len(self.place) - len(self.known) > KEPT:
                self.forget()

    def spell(self, ids: np.ndarray) -> bytes:
        names = self.ranks.names
        return b"".join([names[i] for i in ids.tolist() if 0 <= i < len(names)])


def encode(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", top: int = TOP, files: bool = False,
) -> DataFrame:
    """``doc_id, ids`` of each row.

    With ``files`` the rows are what token files hold, ``doc_id, n_tokens, packed, decoded``: the
    ids as little-endian unsigned 32-bit integers, and the bytes that they decode to.
    """
    inputs = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    known = frequent_words(land(corpus_words(inputs.select("text"), path, pattern), "word-counts"), path, top)
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = Task(path, pattern, shared.value)
        for doc_id, ids, ends in task.encode(batches):
            columns = {"doc_id": doc_id}
            if files:
                columns["n_tokens"] = pa.array(np.diff(ends))
                data = ids.astype("<u4").tobytes()
                columns["packed"] = pa.array([data[4 * a:4 * b] for a, b in pairwise(ends.tolist())], pa.binary())
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), task.ranks.spelling.take(pa.array(ids)))
                columns["decoded"] = pc.binary_join(lists, b"")
            else:
                columns["ids"] = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*columns.values()], [*columns])

    kind = inputs.schema["doc_id"].dataType.simpleString()
    rest = "n_tokens long, packed binary, decoded binary" if files else "ids array<int>"
    return small_batches(inputs).mapInArrow(run, f"doc_id {kind}, {rest}")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids, decoded``: the bytes of the ids in a row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = Task(path, "")
        for batch in batches:
            spelled = [task.spell(np.array(ids or [], np.int64)) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spelled, pa.binary())], [*batch.schema.names, "decoded"])

    return small_batches(encoded.select("doc_id", "ids")).mapInArrow(
        run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded binary")

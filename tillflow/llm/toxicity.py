"""Toxic spans by a linear-chain conditional random field, and scores of documents.

Tokens are labelled from the documents' labels: in toxic documents of the training
rows, words that go with toxic documents far more often than with others.  The field
has two states and learns transitions, a start, a weight for each class of words (by
how strongly they go with toxic documents) and one for capitals.  Tokens come in
stretches of up to ``STRETCH``.  The forward-backward marginals give the offending
offsets; the largest marginal and the number of offending tokens give a document's
score by a logistic function.

The field is fitted on the driver, to bounded samples: ``train_docs`` labelled
documents (those with the smallest hash), ``max_words`` words and
``train_stretches`` stretches.  Scoring covers every token of every document.
Only the text is an input of a score.

Defined results.  A null text is empty; a text without words gets the score of one
without offending words.  Rows whose remainder is 2 are never learned from.  Null
identifiers are scored and not held out.  With several labels for an identifier the
largest counts.  Without labels of both classes every score is the share of toxic
ones, or 0.  Repeated rows get equal results; an empty table an empty one.  Other
columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillflow.llm.tables import text_of

WORD = re.compile(r"[^\W_]+")
STRETCH = 64
# Word classes: none, then by log odds in steps of one.
CLASSES = 8
LEAST_ODDS, MARKED_ODDS, LEAST_DOCS = 1.5, 3.0, 5
OFFENDING = 0.5


def held_out(id_col: str) -> Column:
    """Rows never learned from: those whose remainder is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass
class Field:
    """A fitted model; ``words`` has the class of each word that has one."""

    words: dict[str, int]
    weight: np.ndarray  # of a word class in the toxic state
    capitals: float
    step: np.ndarray  # 2 x 2, from row to column
    start: np.ndarray
    logistic: np.ndarray  # constant, largest marginal, offending tokens


def lattice(kind: np.ndarray, caps: np.ndarray, size: np.ndarray, field: Field) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of the toxic state, expected steps, and log partition sums of padded stretches."""
    n, width = kind.shape
    emit = np.zeros((width, n, 2))
    emit[:, :, 1] = (field.weight[kind] + field.capitals * caps).T
    alive = np.arange(width)[:, None] < size[None, :]
    step = np.exp(field.step)
    ahead = np.zeros((width, n, 2))
    scale = np.zeros((width, n))
    now = np.exp(field.start) * np.exp(emit[0])
    for t in range(width):
        if t:
            now = np.where(alive[t][:, None], (ahead[t - 1] @ step) * np.exp(emit[t]), ahead[t - 1])
        total = now.sum(1)
        scale[t] = np.where(alive[t], total, 1.0)
        ahead[t] = now / np.where(alive[t], total, 1.0)[:, None]
    back = np.ones((width, n, 2))
    for t in range(width - 2, -1, -1):
        more = ((back[t + 1] * np.exp(emit[t + 1])) @ step.T) / scale[t + 1][:, None]
        back[t] = np.where(alive[t + 1][:, None], more, 1.0)
    both = ahead * back
    marginal = np.where(alive, both[:, :, 1] / np.maximum(both.sum(2), 1e-300), 0.0)
    steps = np.zeros((2, 2))
    for t in range(1, width):
        pair = ahead[t - 1][:, :, None] * step * (back[t] * np.exp(emit[t]))[:, None, :] / scale[t][:, None, None]
        steps += pair[alive[t]].sum(0)
    return marginal.T, steps, np.log(np.maximum(scale, 1e-300)).sum(0)


def padded(stretches: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    out = np.zeros((len(stretches), STRETCH), np.int64)
    size = np.array([len(s) for s in stretches])
    for row, s in zip(out, stretches, strict=True):
        row[:len(s)] = s
    return out, size


def fit_field(words: dict[str, int], kinds: list[np.ndarray], caps: list[np.ndarray], marks: list[np.ndarray], steps: int = 200) -> Field:
    """Maximum likelihood with a small quadratic penalty, by Adam."""
    field = Field(words, np.zeros(CLASSES + 1), 0.0, np.zeros((2, 2)), np.zeros(2), np.zeros(3))
    if not kinds:
        return field
    kind, size = padded(kinds)
    (cap, _), (mark, _) = padded(caps), padded(marks)
    alive = np.arange(STRETCH)[None, :] < size[:, None]
    both = alive[:, 1:]
    seen_steps = np.zeros((2, 2))
    np.add.at(seen_steps, (mark[:, :-1][both], mark[:, 1:][both]), 1)
    seen_start = np.bincount(mark[:, 0], minlength=2).astype(float)
    seen_weight = np.bincount(kind[alive], weights=mark[alive], minlength=CLASSES + 1)
    seen_caps = float((mark * cap)[alive].sum())
    x = np.zeros(CLASSES + 8)
    m, v = np.zeros_like(x), np.zeros_like(x)
    for i in range(1, steps + 1):
        field.weight, field.capitals, field.step, field.start = x[:CLASSES + 1], x[CLASSES + 1], x[CLASSES + 2:CLASSES + 6].reshape(2, 2), x[CLASSES + 6:]
        p, expected, _ = lattice(kind, cap, size, field)
        first = np.array([(1 - p[:, 0]).sum(), p[:, 0].sum()])
        grad = np.concatenate([
            seen_weight - np.bincount(kind[alive], weights=p[alive], minlength=CLASSES + 1), [seen_caps - float((p * cap)[alive].sum())],
            (seen_steps - expected).ravel(), seen_start - first]) / len(kinds) - 1e-3 * x
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        x = x + 0.1 * (m / (1 - 0.9 ** i)) / (np.sqrt(v / (1 - 0.999 ** i)) + 1e-8)
    return Field(words, x[:CLASSES + 1], float(x[CLASSES + 1]), x[CLASSES + 2:CLASSES + 6].reshape(2, 2), x[CLASSES + 6:], np.zeros(3))


def stretches_of(text: str, words: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Word classes, capitals, and offsets of a text's tokens; None if no word has a class."""
    get = words.get
    if not any(map(get, WORD.findall(text.lower()))):
        return None
    found = [(get(m[0].lower(), 0), m[0].isupper() and len(m[0]) > 1, m.start(), m.end()) for m in WORD.finditer(text)]
    table = np.array(found, np.int64).reshape(-1, 4)
    return table[:, 0], table[:, 1], table[:, 2:]


def judged(texts: list[str], field: Field) -> list[tuple[float, int, list[tuple[int, int]]]]:
    """The largest marginal, the number of offending tokens and the offending spans of each text."""
    plain = lattice(np.zeros((1, STRETCH), np.int64), np.zeros((1, STRETCH), np.int64), np.array([STRETCH]), field)[0].max()
    kinds, caps, places = [], [], []
    out: list[tuple[float, int, list[tuple[int, int]]]] = [(float(plain), 0, [])] * len(texts)
    offsets = {}
    for i, text in enumerate(texts):
        if (tokens := stretches_of(text, field.words)) is None:
            continue
        kind, cap, offsets[i] = tokens
        for at in range(0, len(kind), STRETCH):
            if kind[at:at + STRETCH].any():
                kinds.append(kind[at:at + STRETCH])
                caps.append(cap[at:at + STRETCH])
                places.append((i, at))
    peak, bad = Counter(), {}
    for lo in range(0, len(kinds), 4096):
        (kind, size), (cap, _) = padded(kinds[lo:lo + 4096]), padded(caps[lo:lo + 4096])
        marginal = lattice(kind, cap, size, field)[0]
        for (i, at), p, n in zip(places[lo:lo + 4096], marginal, size, strict=True):
            peak[i] = max(peak[i], float(p[:n].max()))
            bad.setdefault(i, []).extend((at + np.flatnonzero(p[:n] >= OFFENDING)).tolist())
    for i, places_ in offsets.items():
        spans: list[tuple[int, int]] = []
        last = -2
        for t in bad.get(i, []):
            a, b = places_[t].tolist()
            if t == last + 1:
                spans[-1] = (spans[-1][0], b)
            else:
                spans.append((a, b))
            last = t
        out[i] = (max(peak[i], float(plain)), len(bad.get(i, [])), spans)
    return out


def sample(docs: DataFrame, labels: DataFrame, id_col: str, label_id: str, label_col: str, text_col: str, train_docs: int) -> DataFrame:
    """``text, toxic`` of at most ``train_docs`` labelled documents; their list alone is broadcast."""
    usable = labels.filter(~held_out(label_id)).filter(F.col(label_id).isNotNull() & F.col(label_col).isNotNull())
    chosen = usable.groupBy(F.col(label_id).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic")).orderBy(
        F.xxhash64("_id"), "_id").limit(train_docs)
    return docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("text")).join(F.broadcast(chosen), "_id").select("text", "toxic")


def word_odds(rows: DataFrame, max_words: int) -> tuple[dict[str, float], int, int]:
    """Log odds of words that go with toxic documents, and the numbers of toxic and other documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                counts[toxic > 0].update({"", *WORD.findall(text.lower())})
            words = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in counts)], ["word", "clean", "toxic"])

    sums = rows.mapInArrow(run, "word string, clean long, toxic long").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    # The empty word stands for all documents.
    best = sums.filter((F.col("word") == "") | (F.col("toxic") >= LEAST_DOCS)).orderBy(F.col("word") != "", (F.col("toxic") / (F.col("clean") + 1)).desc(), "word")
    top = best.limit(max_words + 1).collect()
    clean, toxic = next(((r["clean"], r["toxic"]) for r in top if r["word"] == ""), (0, 0))
    odds = {r["word"]: math.log((r["toxic"] + 0.5) / (r["clean"] + 0.5) * (clean + 1) / (toxic + 1)) for r in top if r["word"]}
    return {w: o for w, o in odds.items() if o >= LEAST_ODDS}, toxic, clean


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "toxic",
    train_docs: int = 20_000, max_words: int = 20_000, train_stretches: int = 4_000,
) -> Field:
    """Fit a field and the score's logistic function to bounded samples of the training rows."""
    rows = sample(docs, labels, id_col, label_id, label_col, text_col, train_docs)
    odds, toxic, clean = word_odds(rows, max_words)
    words = {w: 1 + min(int(o - LEAST_ODDS), CLASSES - 1) for w, o in odds.items()}
    marked = {w for w, o in odds.items() if o >= MARKED_ODDS}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                if (tokens := stretches_of(text, words)) is None:
                    continue
                kind, cap, at = tokens
                mark = [label > 0 and text[a:b].lower() in marked for a, b in at.tolist()]
                for t in range(0, len(kind), STRETCH):
                    if kind[t:t + STRETCH].any():
                        out.append([kind[t:t + STRETCH].tolist(), cap[t:t + STRETCH].tolist(), list(map(int, mark[t:t + STRETCH]))])
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.list_(pa.int32())) for k in range(3)], ["kind", "caps", "mark"])

    lists = rows.mapInArrow(cut, "kind array<int>, caps array<int>, mark array<int>").orderBy(F.xxhash64("kind", "caps", "mark")).limit(train_stretches).collect()
    field = fit_field(words, *([np.array(r[k]) for r in lists] for k in range(3)))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = judged(batch.column("text").to_pylist(), field)
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.int64()), batch.column("toxic")], ["peak", "n", "toxic"])

    # At most ``train_docs`` rows of three numbers.
    seen = rows.mapInArrow(look, "peak double, n long, toxic int").toArrow()
    field.logistic = fit_logistic(*(seen.column(c).to_numpy() for c in ("peak", "n", "toxic")))
    return field


def fit_logistic(peak: np.ndarray, n: np.ndarray, toxic: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Constant, weight of the largest marginal, weight of the offending tokens; by Newton's steps."""
    x = np.column_stack([np.ones(len(peak)), peak, np.log1p(n)])
    y = toxic > 0
    if not len(y) or y.all() or not y.any():
        return np.array([math.log((y.sum() + 1e-9) / (len(y) - y.sum() + 1e-9)) if len(y) else -50.0, 0.0, 0.0]).clip(-50, 50)
    w = np.zeros(3)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(x @ w).clip(-30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-6, 1e-2, 1e-2])
        w = w + np.linalg.solve(hessian, x.T @ (y - p) - np.array([0, 1e-2, 1e-2]) * w)
    return w


def scores(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", rows: int = 512) -> DataFrame:
    """``doc_id, score, spans`` of each row, spans as start and end in code points."""
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                found = judged(part.column("text").to_pylist(), field)
                z = np.array([field.logistic @ (1.0, peak, math.log1p(n)) for peak, n, _ in found])
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array(1 / (1 + np.exp(-z.clip(-700, 700)))),
                    pa.array([[{"start": a, "end": b} for a, b in s] for _, _, s in found], spans)], ["doc_id", "score", "spans"])

    inputs = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    return inputs.mapInArrow(run, f"doc_id {inputs.schema['doc_id'].dataType.simpleString()}, score double, spans array<struct<start:int, end:int>>")

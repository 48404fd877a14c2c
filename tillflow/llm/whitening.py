"""Whitening of embeddings: principal directions scaled to unit variance.

Entries become whole numbers, ``floor(scale * entry)``, and the distinct vectors are the fit
list.  Sums per dimension are grouped sums.  Each task reduces its centred rows,
block by block, to one triangular factor by QR; factors are reduced further, sixteen
at a time, until one is left, which has as many rows as the vectors have entries.
``bidiagonal`` finds its singular values and directions.  The covariance itself is never
formed, so small variances keep their digits.

Defined results.  Rows are dropped whose vector is null, empty, holds null or non-finite
entries or entries beyond 2^31 when scaled, or has another length than most vectors
have (of two lengths that are as frequent, the longer one counts).  Repeated rows repeat
their result and count once in the fit; null identifiers are kept; other columns
are ignored.  A component without variance (fewer distinct vectors than components,
constant entries) has null for ``whitened``, and no part in ``identity_error``, which is null if
no component has variance.  ``explained`` is null if no entry varies.  Tied components have
any orthogonal directions of their space.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillflow.llm.bidiagonal import directions
from tillflow.llm.tables import empty, land

SCALE = 256
# Factors that one task reduces to one.
FAN = 16
# Variances below this part of the largest one are rounding.
LEAST = 1e-24


def whole_numbers(rows: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """``vec_id, x`` of the rows that count."""
    vector = F.col(vector_col)
    usable = F.coalesce(F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double") * scale) < F.lit(2.0 ** 31 - 1))), F.lit(False))
    found = land(rows.filter(usable & (F.size(vector) > 0)).select(
        F.col(id_col).alias("vec_id"), F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("int")).alias("x")), "whole-numbers")
    length = found.groupBy(F.size("x").alias("d")).count().orderBy(F.col("count").desc(), F.col("d").desc()).first()
    return found.filter(F.size("x") == (length.d if length else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def sums(fit: DataFrame) -> tuple[int, np.ndarray]:
    """The number of vectors, and the sum of each entry."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("x")).astype(np.int64).sum(axis=0)
                total = x if total is None else total + x
                n += batch.num_rows
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array([-1, *range(len(total))], pa.int32()), pa.array([n, *total.tolist()], pa.int64())], ["at", "s"])

    found = {r["at"]: r["s"] for r in fit.mapInArrow(run, "at int, s long").groupBy("at").agg(F.sum("s").alias("s")).collect()}
    n = found.pop(-1, 0)
    return n, np.array([found[k] for k in range(len(found))], np.int64)


def _packed(number: int, factor: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([factor.ravel()], pa.list_(pa.float64()))], ["number", "factor"])


def factor(fit: DataFrame, n: int, total: np.ndarray) -> np.ndarray:
    """The triangular factor of the centred vectors."""
    d, centre = len(total), total / n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, d))
        for batch in batches:
            r = np.linalg.qr(np.vstack([r, _matrix(batch.column("x")) - centre]), mode="r")
        if len(r):
            yield _packed(TaskContext.get().partitionId(), r)

    def merge(table: pa.Table) -> pa.Table:
        r = np.linalg.qr(np.vstack([np.array(x).reshape(-1, d) for x in table.column("factor").to_pylist()]), mode="r")
        return pa.Table.from_batches([_packed(table.column("number")[0].as_py() // FAN, r)])

    factors = land(fit.mapInArrow(run, "number long, factor array<double>"), "factors")
    while factors.count() > 1:
        factors = land(factors.groupBy(F.floor(F.col("number") / FAN)).applyInArrow(merge, "number long, factor array<double>"), "factors")
    r = np.array(factors.first().factor).reshape(-1, d)
    return np.vstack([r, np.zeros((max(0, d - len(r)), d))])


def whitened(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", count: int = 4, scale: int = SCALE) -> DataFrame:
    """One row per usable row and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    ``deviation`` is the squared distance from the mean times the square of ``n``, an exact decimal.
    """
    spark = rows.sparkSession
    vectors = whole_numbers(rows, id_col, vector_col, scale)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double"
    fit = land(vectors.select("x").distinct(), "fit")
    n, total = sums(fit)
    if not n:
        return empty(spark, schema + ", identity_error double")
    values, parts = directions(factor(fit, n, total), count)
    values, parts = values / n, parts * np.sign(parts[np.arange(len(parts)), np.abs(parts).argmax(axis=1)])[:, None]
    k, trace, centre = len(parts), values.sum(), total / n
    real = values[:k] > LEAST * values[0]
    turn = np.where(real, 1 / np.sqrt(np.where(real, values[:k], 1)), np.nan)[:, None] * parts
    explained = (values[:k] / trace if trace > 0 else np.full(k, np.nan)).tolist()

    def project(batch: pa.RecordBatch) -> np.ndarray:
        return (_matrix(batch.column("x")) - centre) @ turn.T

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = np.zeros((k + 1, k))
        for batch in batches:
            w = project(batch)
            m += np.vstack([w.sum(axis=0), w.T @ w])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(m.size), pa.int32()), pa.array(m.ravel())], ["at", "s"])

    m = np.zeros((k + 1) * k)
    for row in fit.mapInArrow(moments, "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).collect():
        m[row["at"]] = row["s"] / n
    mean, square = m[:k], m[k:].reshape(k, k)
    off = np.abs(square - np.outer(mean, mean) - np.eye(k))[np.ix_(real, real)]
    error = float(off.max()) if real.any() else None

    length = int(sum(s * s for s in total.tolist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x")).astype(np.int64)
            own, cross = (x * x).sum(axis=1, dtype=np.int64).tolist(), (x @ total).tolist()
            deviation = [n * n * a - 2 * n * b + length for a, b in zip(own, cross, strict=True)]
            w, m = project(batch), batch.num_rows
            each = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, n)), pa.array(deviation, pa.decimal128(38, 0)).take(pa.array(each)),
                pa.array(w.ravel(), from_pandas=True), pa.array(np.tile(explained, m), pa.float64(), from_pandas=True),
            ], ["vec_id", "component", "n", "deviation", "whitened", "explained"])

    return vectors.mapInArrow(run, schema).withColumn("identity_error", F.lit(error).cast("double"))

import math

import numpy as np
import pytest

from tillflow.llm import bidiagonal, whitening

DDL = "vec_id long, embedding array<float>, n string, x string, component string, whitened string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "n", "x", "c", "w") for i, v in rows], DDL)


def plain(rows, k=4):
    """By the covariance matrix and its eigenvectors."""
    kept = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in kept}), float)
    n, centre = len(fit), fit.mean(axis=0)
    cov = (fit - centre).T @ (fit - centre) / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    sums = [int(s) for s in fit.sum(axis=0)]
    return {
        (i, c + 1): (n, sum((n * a - s) ** 2 for a, s in zip(x, sums)), (np.array(x) - centre) @ u[:, c] / math.sqrt(e[c]), e[c] / np.trace(cov))
        for i, x in kept for c in range(min(k, len(e)))}


def held(got, want):
    assert len(got) == len(want) and {(r.vec_id, r.component) for r in got} == {*want}
    side = {}
    for r in got:
        n, deviation, w, explained = want[r.vec_id, r.component]
        assert (r.n, int(r.deviation)) == (n, deviation) and r.explained == pytest.approx(explained, rel=1e-9) and r.identity_error < 1e-9
        if abs(w) > 1e-3:
            side.setdefault(r.component, set()).add(np.sign(w * r.whitened))
        assert abs(r.whitened) == pytest.approx(abs(w), rel=1e-7, abs=1e-7)
    assert all(len(s) == 1 for s in side.values())


def test_whole_table_like_the_covariance(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").repartition(5)
    held(whitening.whitened(rows).collect(), plain([(r.vec_id, r.embedding) for r in rows.collect()]))


def test_odd_rows(spark):
    rng = np.random.default_rng(0)
    good = [(i, rng.normal(size=5).tolist()) for i in range(60)]
    same = [(100 + i, good[0][1]) for i in range(400)]
    odd = [(1000, None), (1001, []), (1002, [1.0, None, 1.0, 1.0, 1.0]), (1003, [math.nan] * 5), (1004, [math.inf] + [0.0] * 4), (1005, [1e30] + [0.0] * 4), (1006, [1.0, 2.0])]
    twice = [(0, good[0][1]), (None, good[1][1]), (2000, [-0.0] * 5)]
    rows = table(spark, good + same + odd + twice).repartition(7)
    got = whitening.whitened(rows, count=3).collect()
    want = plain([(i, [float(np.float32(c)) for c in v]) for i, v in [*good, *same, *twice[1:]]], 3)
    copies = [r for r in got if r.vec_id == 0]
    assert len(copies) == 6 and len({tuple(r) for r in copies}) == 3
    held([r for r in got if r.vec_id != 0] + copies[:1] + [next(r for r in copies if r.component == c) for c in (1, 2, 3) if c != copies[0].component], want)


@pytest.mark.parametrize(("vectors", "real"), [([[1.0, 2.0, 3.0]] * 4, 0), ([[1.0, 0.0, 2.0], [2.0, 0.0, 4.0], [1.0, 0.0, 2.0]], 1), ([[0.5], [1.5], [0.25]], 1)])
def test_components_without_variance(spark, vectors, real):
    got = whitening.whitened(table(spark, list(enumerate(vectors)))).collect()
    k = min(4, len(vectors[0]))
    assert len(got) == len(vectors) * k
    assert {r.component for r in got if r.whitened is not None} == {*range(1, real + 1)}
    assert all((r.identity_error is None) == (real == 0) and (r.explained is None) == (real == 0) for r in got)


def test_empty_table(spark):
    assert whitening.whitened(table(spark, [])).collect() == [] and whitening.whitened(table(spark, [(1, None)])).count() == 0


def test_many_factors_are_reduced_in_turn(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").repartition(9)
    fit = whitening.whole_numbers(rows, "vec_id", "embedding").select("x").distinct().repartition(9)
    n, total = whitening.sums(fit)
    x = np.array([r.x for r in fit.collect()], float)
    r = whitening.factor(fit, n, total)
    assert np.allclose(r.T @ r, (x - x.mean(axis=0)).T @ (x - x.mean(axis=0)))


@pytest.mark.parametrize("seed", range(3))
def test_solver_like_a_dense_one(seed):
    rng = np.random.default_rng(seed)
    turned = np.linalg.qr(rng.normal(size=(20, 20)))[0]
    for matrix in (
        rng.normal(size=(50, 12)), rng.normal(size=(50, 30)) * np.geomspace(1, 1e-7, 30), np.hstack([rng.normal(size=(40, 4))] * 2),
        turned * np.array([3.0] * 3 + [2.0] * 2 + [0.5] * 15) @ turned.T, np.kron(np.eye(4), np.ones((2, 1))), rng.normal(size=(4, 9)), np.zeros((3, 3)), np.ones((2, 1)),
    ):
        n = matrix.shape[1]
        r = np.linalg.qr(matrix, mode="r")
        r = np.vstack([r, np.zeros((n - len(r), n))])
        values, rows = bidiagonal.directions(r, n)
        sizes = np.linalg.svd(r, compute_uv=False)
        top = max(sizes[0], 1e-300)
        # Small singular values keep their digits.
        real = sizes > 1e-12 * top
        assert np.allclose(np.sqrt(values[real]), sizes[real], rtol=1e-9, atol=0)
        assert np.abs(rows @ rows.T - np.eye(n)).max() < 1e-10
        assert np.abs(matrix.T @ matrix @ rows.T - rows.T * values).max() <= 1e-12 * top ** 2 + 1e-300

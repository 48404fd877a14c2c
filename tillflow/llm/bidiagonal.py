"""Singular values and right singular vectors of a small triangular factor.

Householder reflections make the factor bidiagonal.  The differential quotient
difference algorithm with shifts (dqds) finds all singular values, the small ones as
accurately as the large ones.  Each direction comes from a twisted factorisation of
the shifted matrix: the quotient differences from the top and from the bottom
meet where the remainder is smallest.
"""

from __future__ import annotations

import numpy as np

# Neighbouring squares closer than this, as a part of themselves, share a space of directions.
CLOSE = 1e-5
EPS = np.finfo(float).eps


def bidiagonalise(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, upper diagonal, and the reflections from the right, for a square matrix."""
    a = np.array(matrix, float)
    n = len(a)
    right = []

    def reflection(x: np.ndarray) -> np.ndarray:
        v = x.copy()
        v[0] += np.copysign(np.linalg.norm(x), x[0])
        size = np.linalg.norm(v)
        return v / size if size > 0 else v

    for k in range(n):
        v = reflection(a[k:, k])
        a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        if k < n - 1:
            w = reflection(a[k, k + 1:])
            a[k:, k + 1:] -= 2 * np.outer(a[k:, k + 1:] @ w, w)
            right.append(w)
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def _sweep(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[tuple[np.ndarray, np.ndarray] | None, float]:
    """One transform of the quotients and differences, and a better shift.

    None if the shift is beyond the smallest value.  If only the last quotient says so, it
    also says by how much.
    """
    n = len(q)
    out, off = np.empty(n), np.empty(n - 1)
    d = q[0] - shift
    for i in range(n - 1):
        if d < 0:
            return None, 0.0
        out[i] = d + e[i]
        ratio = q[i + 1] / out[i]
        off[i] = e[i] * ratio
        d = d * ratio - shift
    out[-1] = d
    return (None, shift + d) if d < 0 else ((out, off), shift)


def dqds(diagonal: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """The squares of the singular values of a bidiagonal matrix, largest first."""
    size = max(np.abs(diagonal).max(initial=0), np.abs(upper).max(initial=0))
    if size == 0:
        return np.zeros(len(diagonal))
    # Zeros become values far below rounding, so that every quotient is positive.
    q = np.maximum(np.abs(diagonal / size), 1e-30) ** 2
    e = np.maximum(np.abs(upper / size), 1e-34) ** 2
    found: list[float] = []
    blocks = [(q, e, 0.0)]
    while blocks:
        q, e, total = blocks.pop()
        if len(q) == 1:
            found.append(total + q[0])
            continue
        cuts = np.flatnonzero(e <= EPS * EPS * (q[1:] + total))
        if len(cuts):
            k = int(cuts[-1]) + 1
            blocks += [(q[:k], e[:k - 1], total), (q[k:], e[k:], total)]
            continue
        if q[0] < q[-1]:
            q, e = q[::-1].copy(), e[::-1].copy()
        # The smaller value of the last two rows is a good guess of the smallest one.
        a, b, c = q[-2] + (e[-2] if len(e) > 1 else 0.0), q[-1] + e[-1], q[-2] * e[-1]
        shift = max(0.0, (a * b - c) / ((a + b) / 2 + np.hypot((a - b) / 2, np.sqrt(c))))
        for less in (1.0, 0.75, 0.25, 0.01, 0.0):
            step, better = _sweep(q, e, shift * less)
            if step is None and better > 0:
                shift, less = better * (1 - 4 * EPS), 1.0
                step, _ = _sweep(q, e, shift)
            if step is not None:
                q, e = step
                total += shift * less
                break
        blocks.append((np.maximum(q, 1e-300), np.maximum(e, 1e-300), total))
    return np.sort(np.array(found))[::-1] * size * size


def twisted(diagonal: np.ndarray, upper: np.ndarray, value: float) -> np.ndarray:
    """A unit vector of the square of a bidiagonal matrix for the given value."""
    n = len(diagonal)
    tiny = EPS * EPS * max(value, EPS)
    diag, off = diagonal ** 2, diagonal[:-1] * upper
    diag[1:] += upper ** 2
    # From the top with lower factors, from the bottom with upper ones.
    down, up = np.empty(n), np.empty(n)
    down[0] = diag[0] - value
    for i in range(n - 1):
        down[i] = down[i] if abs(down[i]) > tiny else tiny
        down[i + 1] = diag[i + 1] - value - off[i] * (off[i] / down[i])
    up[-1] = diag[-1] - value
    for i in range(n - 2, -1, -1):
        up[i + 1] = up[i + 1] if abs(up[i + 1]) > tiny else tiny
        up[i] = diag[i] - value - off[i] * (off[i] / up[i + 1])
    at = int(np.argmin(np.abs(down + up - (diag - value))))
    z = np.zeros(n)
    z[at] = 1.0
    for i in range(at - 1, -1, -1):
        z[i] = -z[i + 1] * off[i] / down[i]
    for i in range(at + 1, n):
        z[i] = -z[i - 1] * off[i - 1] / up[i]
    return z / np.linalg.norm(z)


def directions(factor: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """All squares of the singular values, largest first, and the right vectors of the first ``count`` as rows.

    Values that are equal or nearly so share a space; their vectors are made
    orthogonal to each other, and turned to fit the values.
    """
    n = len(factor)
    size = np.abs(factor).max(initial=0)
    if size == 0:
        return np.zeros(n), np.eye(n)[:count]
    diagonal, upper, right = bidiagonalise(factor / size)
    values = dqds(diagonal, upper)
    square = np.diag(diagonal ** 2)
    square[range(1, n), range(1, n)] += upper ** 2
    square[range(n - 1), range(1, n)] = square[range(1, n), range(n - 1)] = diagonal[:-1] * upper
    rows, at = np.zeros((min(count, n), n)), 0
    while at < len(rows):
        end = at + 1
        while end < n and values[end - 1] - values[end] <= max(CLOSE * values[at], 4 * EPS * values[0]):
            end += 1
        if end - at == 1:
            block = twisted(diagonal, upper, values[at])[:, None]
        else:
            block = np.random.default_rng(0).standard_normal((n, end - at))
            block[:, 0] = twisted(diagonal, upper, values[at])
            shifted = square - (values[at:end].mean() + max(CLOSE * 1e-3 * values[at], 3.3 * EPS * values[0])) * np.eye(n)
            for _ in range(4):
                block = np.linalg.qr(np.linalg.solve(shifted, block))[0]
            block = block @ np.linalg.eigh(block.T @ square @ block)[1][:, ::-1]
        rows[at:end] = block.T[:len(rows) - at]
        at = end
    # Back from the bidiagonal matrix to the factor, last reflection first.
    for k in range(n - 2, -1, -1):
        w = right[k]
        rows[:, k + 1:] -= 2 * np.outer(rows[:, k + 1:] @ w, w)
    return values * size * size, rows

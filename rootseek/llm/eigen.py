"""Eigenvectors of a symmetric matrix: float32 start, refinement by matrix products.

Method: mixed-precision iterative refinement after Ogita and Aishima. The start
is a float32 eigendecomposition. Each step forms the residuals ``I - X'X`` and
``X'AX`` in higher precision and corrects all vectors at once by matrix
products; it converges quadratically while eigenvalues are apart. Vectors whose
eigenvalues lie within the error bound of each other form a cluster; there the
step only restores orthogonality, and a sub-solve follows: the cluster's small
matrix, shifted by its mean eigenvalue so that its own spread decides the
accuracy, is solved in double precision and turns the cluster's vectors.

Higher precision means extended doubles whose products are sums of exact
double-precision products of slices, so the work stays in BLAS.
"""

from __future__ import annotations

import math

import numpy as np

#: Slices of a factor: about 20 bits each.
SLICES = 4
STEPS = 20
#: Gaps, relative to the largest entry, below which rounding would spoil a correction: always a sub-solve.
CLOSE = 1e-10
LONG = np.longdouble


def _slices(a: np.ndarray, axis: int, bits: int) -> list[np.ndarray]:
    """``a`` as a sum of double matrices with few bits each, relative to the largest of a row or column."""
    out, rest = [], a.astype(LONG)
    for _ in range(SLICES):
        top = np.abs(rest).max(axis=axis, keepdims=True, initial=0).astype(np.float64)
        unit = np.exp2(np.where(top > 0, np.ceil(np.log2(np.where(top > 0, top, 1))), 0) - bits)
        part = np.rint((rest / unit).astype(np.float64)) * unit
        out.append(part)
        rest = rest - part
    return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The matrix product in extended precision: every product of slices is exact in double precision."""
    bits = (53 - max(1, math.ceil(math.log2(max(a.shape[1], 2))))) // 2 - 1
    left, right = _slices(a, 1, bits), _slices(b, 0, bits)
    total = np.zeros((a.shape[0], b.shape[1]), LONG)
    for level in range(SLICES - 1, -1, -1):  # small terms first
        for i in range(level + 1):
            total += left[i] @ right[level - i]
    return total


def _clusters(values: np.ndarray, bound: float) -> list[tuple[int, int]]:
    """Stretches [a, b) of two or more falling values with gaps within ``bound``."""
    cuts = np.flatnonzero(np.abs(np.diff(values.astype(np.float64))) > bound) + 1
    edges = [0, *cuts.tolist(), len(values)]
    return [(a, b) for a, b in zip(edges, edges[1:]) if b - a > 1]


def _step(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """One refinement: (new vectors, eigenvalues, size of the correction, error bound of close eigenvalues)."""
    r = np.eye(len(a), dtype=LONG) - product(x.T, x)
    s = product(x.T, product(a, x))
    # exactly symmetric, or close eigenvalues would turn rounding into loss of orthogonality
    r, s = (r + r.T) / 2, (s + s.T) / 2
    values = np.diag(s) / (1 - np.diag(r))
    off = s - np.diag(values)
    np.fill_diagonal(off, 0)
    norm = lambda m: float(np.sqrt((m.astype(np.float64) ** 2).sum()))
    bound = max(CLOSE, 2 * (norm(off) + norm(np.diag(values)) * norm(r)))
    gap = values[None, :] - values[:, None]
    apart = np.abs(gap) > bound
    e = np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1), r / 2)
    np.fill_diagonal(e, np.diag(r) / 2)
    return x + product(x, e), values, norm(e), bound


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(falling eigenvalues, unit eigenvectors as columns) of a symmetric matrix, in extended precision.

    An empty matrix has none; a matrix of zeros has the unit vectors.
    """
    a = a.astype(LONG)
    size = np.abs(a).max(initial=0)
    if not size > 0:
        return np.zeros(len(a), LONG), np.eye(len(a), dtype=LONG)
    a = a / size
    start = np.linalg.eigh(a.astype(np.float32))[1][:, ::-1]
    x, solved = start.astype(LONG), 0
    for _ in range(STEPS):
        x, values, change, bound = _step(a, x)
        order = np.argsort(-values, kind="stable")
        x, values = x[:, order], values[order]
        if change > 1e-6:
            continue  # sub-solves need nearly orthogonal clusters
        groups = _clusters(values, bound)
        if solved < 3 and groups:
            solved += 1
            for lo, hi in groups:
                part = x[:, lo:hi]
                middle = values[lo:hi].mean()
                small = product(part.T, product(a, part) - middle * part)
                turn = np.linalg.eigh(((small + small.T) / 2).astype(np.float64))[1][:, ::-1]
                x[:, lo:hi] = product(part, turn)
            continue
        if change < 1e-17:
            break
    values = np.diag(product(x.T, product(a, x))) / np.diag(product(x.T, x))
    order = np.argsort(-values, kind="stable")
    x = x[:, order]
    return values[order] * size, x / np.sqrt((x * x).sum(axis=0))

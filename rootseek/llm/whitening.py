"""Whitening of quantised vectors by refined eigenvectors of their exact covariance.

Method: every vector becomes whole numbers ``x = floor(scale * c) + SHIFT``. The
distinct vectors of one length are its fit list. One pass adds up the fit list,
a second one the products of the vectors after the rounded mean is taken off;
both sums are exact whole numbers, so they depend on no order or partitioning.
``n`` squared times the covariance follows as a matrix of whole numbers, which a
task per length solves: float32 eigenvectors, refined in higher precision with
sub-solves for clusters (see ``eigen``). A third pass projects the fit list and
measures how far its covariance is from the identity; the last one
projects all rows. Only the model, at most ``COMPONENTS`` vectors for each
length, is broadcast.

Defined cases: rows whose vector is null or holds null or non-finite entries go,
a null id stays; repeated rows are returned as often and fitted once; vectors of
another length are fitted on their own, an empty vector has no component;
``x`` stays within ``LIMIT`` (products of longer numbers are added up in parts, so
they are exact too); a deviation beyond a long saturates; a component without
variance is 0 for every row and left out of the identity error; ties of
eigenvalues may turn within their own space; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootseek.llm.common import arrow_rows, durable, per_partition, ship
from rootseek.llm.eigen import LONG, eigen

SCALE, SHIFT = 64.0, 1_000_000
COMPONENTS = 16
#: Largest absolute x.
LIMIT = 2**62 - 1
#: Largest number whose products a batch adds up exactly in double precision.
PLAIN = 1 << 20
#: Vectors handled at once.
ROWS = 1024
#: Parts of a longer sum, of 32 bits each, and digits of a longer number, of 16 bits.
PARTS, DIGITS = 6, 4
#: Partial sums that one task adds up.
FAN_IN = 256


# ---- rows and whole numbers ----


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values with NaN for null, offsets, whether the list is given and finite) of an array column."""
    column = column.cast(pa.list_(pa.float64()))
    values = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(column.offsets.to_numpy())
    given = column.is_valid().to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(np.where(given, sizes, 0))])
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    return values, ends, given & (bad[ends[1:]] == bad[ends[:-1]])


def whole(values: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * c) + SHIFT, within ``LIMIT``."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values * scale)
    far = np.abs(scaled) >= 2.0**61
    x = np.where(far, 0, scaled).astype(np.int64) + SHIFT
    for i in np.flatnonzero(far):
        v = scaled.flat[i]
        x.flat[i] = max(-LIMIT, min(LIMIT, (int(v) if np.isfinite(v) else int(np.sign(v)) * LIMIT) + SHIFT))
    return x


def by_length(ids: pa.Array | None, column: pa.Array, scale: float) -> Iterator[tuple[int, pa.Array | None, np.ndarray]]:
    """(length, ids, x) of a batch's valid vectors."""
    values, ends, good = _lists(column)
    sizes = np.diff(ends)
    for dim in np.unique(sizes[good & (sizes > 0)]).tolist():
        rows = np.flatnonzero(good & (sizes == dim))
        x = whole(values[ends[rows][:, None] + np.arange(dim)], scale)
        yield dim, None if ids is None else ids.take(pa.array(rows)), x


def _coded(scale: float):
    """Vectors as bytes: one code for each x vector, in 4 bytes an entry where they fit."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, _, x in by_length(None, batch.column(0), scale):
                short = (np.abs(x) < 2**31).all(axis=1)
                codes = [(r.astype("<i4") if s else r.astype("<i8")).tobytes() for r, s in zip(x, short)]
                yield arrow_rows({"dim": (np.full(len(x), dim), pa.int32()), "code": (codes, pa.binary())})

    return work


def _decoded(dims: pa.Array, codes: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(length, x) of a batch of codes, at most ``ROWS`` at once."""
    dims = dims.to_numpy(zero_copy_only=False)
    values = codes.to_pylist()
    width = np.array([len(v) for v in values], np.int64)
    for dim in np.unique(dims).tolist():
        for size, kind in ((4, "<i4"), (8, "<i8")):
            rows = np.flatnonzero((dims == dim) & (width == size * dim))
            for at in range(0, len(rows), ROWS):
                joined = b"".join([values[i] for i in rows[at : at + ROWS]])
                yield dim, np.frombuffer(joined, kind).astype(np.int64).reshape(-1, dim)


# ---- exact sums ----


def _parts(total: np.ndarray) -> np.ndarray:
    """Python integers as ``PARTS`` int64 of 32 bits each, the last one signed."""
    out = np.zeros((PARTS, *total.shape), np.int64)
    for i in range(PARTS - 1):
        out[i] = (total & 0xFFFFFFFF).astype(np.int64)
        total = total >> 32
    out[-1] = total.astype(np.int64)
    return out


def _joined(parts: np.ndarray) -> np.ndarray:
    """Python integers from added-up parts."""
    return sum((p.astype(object) << (32 * i) for i, p in enumerate(parts)), np.zeros(parts.shape[1:], object))


def _gram(y: np.ndarray) -> np.ndarray:
    """Exact sums of products of the columns of at most ``ROWS`` rows, as Python integers."""
    if np.abs(y).max(initial=0) < PLAIN:
        f = y.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    digits = []
    for _ in range(DIGITS - 1):
        digits.append((y & 0xFFFF).astype(np.float64))
        y = y >> 16
    digits.append(y.astype(np.float64))
    total = np.zeros((y.shape[1],) * 2, object)
    for i, a in enumerate(digits):
        for j, b in enumerate(digits):
            total += (a.T @ b).astype(np.int64).astype(object) << (16 * (i + j))
    return total


def _partial(sums: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """(dim, line, cells): the lines of exact matrices, one for each length."""
    for dim, total in sums.items():
        parts = _parts(total.reshape(-1, dim))
        lines = [np.ascontiguousarray(parts[:, i]).astype("<i8").tobytes() for i in range(parts.shape[1])]
        yield arrow_rows({"dim": (np.full(len(lines), dim), pa.int32()), "line": (np.arange(len(lines)), pa.int32()), "cells": (lines, pa.binary())})


PARTIAL = "dim int, line int, cells binary"


def _add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    # parts carry over here, so any number of levels can follow
    added = _parts(_joined(sum(np.frombuffer(c, "<i8").reshape(PARTS, -1) for c in table["cells"].to_pylist())))
    return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "line": pa.array([key[1].as_py()], pa.int32()), "cells": pa.array([added.astype("<i8").tobytes()])})


def added(partial: DataFrame) -> DataFrame:
    """One row for each (dim, line), through groups of at most about ``FAN_IN`` partial sums."""
    near = partial.withColumn("part", F.floor(F.spark_partition_id() / FAN_IN)).groupBy("dim", "line", "part").applyInArrow(_add, PARTIAL)
    return near.groupBy("dim", "line").applyInArrow(_add, PARTIAL)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number and sums of the vectors: lines 0 (count, in the first cell) and 1."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for dim, x in _decoded(batch.column(0), batch.column(1)):
            total = sums.setdefault(dim, np.zeros((2, dim), object))
            total[0, 0] += len(x)
            total[1] += ((x >> 32).sum(0).astype(object) << 32) + (x & 0xFFFFFFFF).sum(0).astype(object)
    yield from _partial(sums)


def _moments(middle: dict[int, np.ndarray]):
    """Sums of products of the vectors less the rounded mean."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, x in _decoded(batch.column(0), batch.column(1)):
                sums[dim] = sums.get(dim, 0) + _gram(x - middle[dim])
        yield from _partial(sums)

    return work


# ---- the model ----


def _solve(model: dict[int, tuple[int, list[int], list[int]]], components: int):
    """Eigenvectors of one length from the lines of its moments."""

    def work(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        n, rest = model[dim][0], np.array(model[dim][2], object)
        order = np.argsort(table["line"].to_numpy())
        lines = [np.frombuffer(c, "<i8").reshape(PARTS, dim) for c in table["cells"].to_pylist()]
        # sums of products about the rounded mean, times n, less those of what the rounding left: n * n * covariance
        exact = n * np.array([_joined(lines[i]) for i in order]) - rest[:, None] * rest[None, :]
        high = exact.astype(np.float64)
        low = (exact - np.array([[int(v) for v in r] for r in high], object).reshape(high.shape)).astype(np.float64)
        values, vectors = eigen(high.astype(LONG) + low.astype(LONG))
        trace = LONG(float(sum(exact.diagonal())))
        values, vectors = values[:components], vectors[:, :components]
        # below this an eigenvalue is rounding of zero
        some = values > max(float(values.max(initial=0)), 0.0) * dim * 1e-18
        root = np.sqrt(np.where(some, values, 1)) / n
        weights = np.where(some, vectors / root, 0)
        share = np.where(some, values / trace if trace > 0 else 0, 0)
        return pa.table({
            "dim": pa.array([dim], pa.int32()), "weights": pa.array([weights.T.astype("<f8").tobytes()]),
            "explained": pa.array([share.astype(np.float64).tolist()], pa.list_(pa.float64())), "some": pa.array([some.tolist()], pa.list_(pa.bool_())),
        })

    return work


class Model:
    """What one length needs to whiten a row: count, rounded mean, rest of the mean, weights, shares."""

    def __init__(self, n: int, middle: list[int], rest: list[int], weights: np.ndarray, explained: list[float], some: list[bool]):
        self.n, self.middle, self.rest = n, np.array(middle, np.int64), rest
        self.weights, self.explained, self.some = weights, np.array(explained), np.array(some)
        # the mean of the projections: exact rest of the mean, of less than one half in each dimension
        self.left = np.array([float(LONG(r) / LONG(n)) for r in rest])
        self.identity_error = 0.0

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Components of whole vectors, rows by components."""
        return ((x - self.middle).astype(np.float64) - self.left) @ self.weights.T

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """Sum over dimensions of (n * x - S) ** 2: exact, at most the largest long."""
        y, rest = x - self.middle, np.array(self.rest, object)
        most = self.n * int(np.abs(y).max(initial=0)) + max((abs(int(r)) for r in rest), default=0)
        if most * most * x.shape[1] < 2**63:
            return ((y * self.n - rest.astype(np.int64)) ** 2).sum(1)
        off = y.astype(object) * self.n - rest
        return np.minimum((off * off).sum(1), 2**63 - 1).astype(np.int64)


def _products(models: dict[int, Model]):
    """Number, sums and sums of products of the fit list's components, for each length and task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, x in _decoded(batch.column(0), batch.column(1)):
                w = models[dim].whiten(x)
                total = sums.setdefault(dim, np.zeros((1 + w.shape[1], w.shape[1])))
                total[0] += w.sum(0)
                total[1:] += w.T @ w
        dims = list(sums)
        yield arrow_rows({"dim": (dims, pa.int32()), "cells": ([sums[d].ravel().tolist() for d in dims], pa.list_(pa.float64()))})

    return work


def fit(rows: DataFrame, vec_col: str = "embedding", scale: float = SCALE, components: int = COMPONENTS) -> dict[int, Model]:
    """A model for each vector length of the table."""
    ship(rows.sparkSession)
    codes = per_partition(rows.select(F.col(vec_col).cast("array<double>").alias("vec")), _coded(scale), "dim int, code binary")
    distinct = durable(codes.distinct(), "fit-list")
    totals = {}
    for r in added(per_partition(distinct, _sums, PARTIAL)).collect():  # two rows for each length
        totals.setdefault(r.dim, {})[r.line] = _joined(np.frombuffer(bytes(r.cells), "<i8").reshape(PARTS, -1))
    about = {}
    for dim, lines in totals.items():
        n, s = int(lines[0][0]), [int(v) for v in lines[1]]
        middle = [(2 * v + n) // (2 * n) for v in s]
        about[dim] = (n, middle, [v - n * m for v, m in zip(s, middle)])
    middles = {dim: np.array(m, np.int64) for dim, (_, m, _) in about.items()}
    moments = added(per_partition(distinct, _moments(middles), PARTIAL))
    solved = moments.groupBy("dim").applyInArrow(_solve(about, components), "dim int, weights binary, explained array<double>, some array<boolean>")
    models = {r.dim: Model(*about[r.dim], np.frombuffer(bytes(r.weights), "<f8").reshape(-1, r.dim), r.explained, r.some) for r in solved.collect()}
    # cells are few: (1 + components) * components for each length
    cells = per_partition(distinct, _products(models), "dim int, cells array<double>").select("dim", F.posexplode("cells").alias("at", "v"))
    found: dict[int, dict[int, float]] = {}
    for r in cells.groupBy("dim", "at").agg(F.sum("v").alias("v")).collect():
        found.setdefault(r.dim, {})[r["at"]] = r.v
    for dim, m in models.items():
        k = len(m.some)
        total = np.array([found[dim][i] for i in range(k * (k + 1))]).reshape(k + 1, k)
        mean = total[0] / m.n
        off = total[1:] / m.n - np.outer(mean, mean) - np.eye(k)
        m.identity_error = float(np.abs(off[np.ix_(m.some, m.some)]).max(initial=0))
    return models


def transform(rows: DataFrame, models: dict[int, Model], id_col: str = "vec_id", vec_col: str = "embedding", scale: float = SCALE) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of every valid row and component."""
    spark = rows.sparkSession
    known = spark.sparkContext.broadcast(models)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, ids, x in by_length(batch.column(0), batch.column(1), scale):
                m = known.value.get(dim)
                if m is None:
                    continue  # not a length of the fitted table
                w = m.whiten(x)
                k = w.shape[1]
                again = np.repeat(np.arange(len(x)), k)
                yield arrow_rows({
                    "id": (ids.take(pa.array(again)), None), "component": (np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
                    "n": (np.full(len(again), m.n), pa.int64()), "deviation": (m.deviation(x)[again], pa.int64()),
                    "whitened": (w.ravel(), pa.float64()), "explained": (np.tile(m.explained, len(x)), pa.float64()),
                    "identity_error": (np.full(len(again), m.identity_error), pa.float64()),
                })

    narrow = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    schema = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return per_partition(narrow, work, schema).withColumnRenamed("id", id_col)


def whiten(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = SCALE, components: int = COMPONENTS) -> DataFrame:
    """All rows whitened by a model fitted on their own distinct vectors."""
    return transform(rows, fit(rows, vec_col, scale, components), id_col, vec_col, scale)

"""Whitening against exact fractions and double-precision eigenvectors."""

from fractions import Fraction

import numpy as np
import pytest

from rootseek.llm import whitening
from rootseek.llm.eigen import LONG, eigen, product

SCHEMA = "vec_id long, embedding array<double>, id string, vec int, dim int, n long"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, 2, 3) for i, v in rows], SCHEMA).repartition(3)


def exact(vectors):
    """(n, S, n * n * covariance) of distinct whole vectors, in Python's integers."""
    fit = sorted({tuple(v) for v in vectors})
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    cov = [[sum((n * v[i] - s[i]) * (n * v[j] - s[j]) for v in fit) for j in range(len(s))] for i in range(len(s))]
    return n, s, cov  # cov is n ** 3 times the covariance


def check(spark, rows, dim, places=1e-9):
    got = whitening.whiten(frame(spark, rows)).collect()
    fine = [(i, v) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and len(v) == dim]
    x = {i: [min(max(int(np.floor(Fraction(c) * 64)) + 10**6, -whitening.LIMIT), whitening.LIMIT) for c in v] for i, v in fine}
    n, s, cov = exact(x.values())
    k = min(16, dim)
    mine = [r for r in got if r.vec_id in x]
    assert sorted((r.vec_id, r.component) for r in mine) == sorted((i, c) for i, _ in fine for c in range(1, k + 1))
    for r in mine:
        want = sum((n * a - b) ** 2 for a, b in zip(x[r.vec_id], s))
        assert r.n == n and r.deviation == min(want, 2**63 - 1) and r.identity_error <= 1e-4
    v = np.array([[float(Fraction(c, n**3)) for c in row] for row in cov])
    e, w = np.linalg.eigh(v)
    e, w = e[::-1], w[:, ::-1]
    for r in mine[:200]:
        c = r.component - 1
        assert abs(r.explained - e[c] / e.sum()) <= 1e-9
        y = np.array([float(Fraction(a) - Fraction(b, n)) for a, b in zip(x[r.vec_id], s)])
        want = y @ w[:, c] / np.sqrt(e[c])
        assert abs(abs(r.whitened) - abs(want)) <= places * max(1, abs(want))
    return got


def test_whitening_equals_exact_covariance(spark):
    rng = np.random.default_rng(3)
    x = (rng.standard_normal((300, 24)) @ np.diag(np.linspace(0.2, 2, 24)) + rng.standard_normal(24)).tolist()
    rows = list(enumerate(x)) + [(1000 + i, x[0]) for i in range(150)]  # a third are copies
    rows += [(5000, None), (5001, [None] * 24), (5002, [float("nan")] * 24), (5003, [float("-inf")] + [0.0] * 23), (5004, [])]
    got = check(spark, rows, 24)
    for c in range(1, 17):  # one sign for all rows: copies are equal
        assert len({r.whitened for r in got if r.component == c and (r.vec_id == 0 or 1000 <= r.vec_id < 1150)}) == 1


def test_lengths_are_fitted_apart_and_null_ids_stay(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(5).tolist()) for i in range(40)] + [(100 + i, rng.standard_normal(3).tolist()) for i in range(30)]
    got = check(spark, rows, 5)
    assert {r.n for r in got if r.vec_id >= 100} == {30} and max(r.component for r in got if r.vec_id >= 100) == 3
    assert whitening.whiten(frame(spark, [(None, [1.0, 2.0]), (1, [2.0, 5.0]), (2, [4.0, 4.0])])).where("vec_id IS NULL").count() == 2


def test_far_numbers(spark):
    """Products past 64 bits, entries past a long, in one table with small ones."""
    rng = np.random.default_rng(5)
    rows = [(i, (rng.standard_normal(4) * 10.0 ** rng.integers(-3, 12)).tolist()) for i in range(60)]
    check(spark, rows, 4, places=1e-6)
    got = whitening.whiten(frame(spark, [(1, [1e308, 1.0]), (2, [-1e308, 2.0]), (3, [5e16, 3.0])])).collect()
    assert len(got) == 6 and {r.deviation for r in got} == {2**63 - 1} and all(np.isfinite(r.whitened) for r in got)


def test_no_variance_and_empty(spark):
    got = whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert len(got) == 4 and {(r.n, r.whitened, r.explained, r.identity_error, r.deviation) for r in got} == {(1, 0.0, 0.0, 0.0, 0)}
    flat = whitening.whiten(frame(spark, [(i, [float(i), 7.0]) for i in range(9)])).collect()
    assert all(r.whitened == 0 for r in flat if r.component == 2) and all(r.identity_error < 1e-12 for r in flat)
    assert whitening.whiten(frame(spark, [(1, None)])).collect() == []


@pytest.mark.parametrize("gap", [0.0, 1e-12, 1e-8, 1e-3])
def test_clustered_eigenvalues(gap):
    q = np.linalg.qr(np.random.default_rng(6).standard_normal((40, 40)))[0].astype(LONG)
    for _ in range(3):
        q = q + product(q, (np.eye(40) - product(q.T, q)) / 2)
    d = np.sort(np.r_[1 + gap * np.arange(15), np.linspace(2, 9, 25)])[::-1].astype(LONG)
    a = product(q * d, q.T)
    e, x = eigen((a + a.T) / 2)
    assert np.abs(e - d).max() < 1e-16 and np.abs(product(x.T, x) - np.eye(40)).max() < 1e-16
    met = np.abs(product(x.T, q))
    assert np.abs(met[:25, :25] - np.eye(25)).max() < 1e-15
    if gap:
        assert np.abs(met - np.eye(40)).max() < 1e-18 / gap + 1e-15
    half = np.linalg.eigh(a.astype(np.float64))[1][:, ::-1]
    if gap == 1e-12:  # plain double precision loses what refinement keeps
        assert np.abs(np.abs(half.T @ q.astype(float)) - np.eye(40)).max() > 1e-5


def test_sums_in_parts():
    y = np.array([[2**61, -(2**61)], [-(2**62), 3], [5, -7]])
    want = [[sum(int(r[i]) * int(r[j]) for r in y) for j in range(2)] for i in range(2)]
    assert whitening._gram(y).tolist() == want
    assert whitening._joined(whitening._parts(np.array(want, object))).tolist() == want

"""Vector searches against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rootseek.llm import neighbours, topk, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, id string, vec int, dim int, shard int, lane int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "x", 2, 3, 4, 5) for i, v in rows], SCHEMA).repartition(3)


def made(n=700, dim=20, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim)).astype(np.float32)
    x[50:90] = x[0]  # ties
    rows = list(enumerate(x.tolist()))
    bad = [(12000, None), (12020, [1.0, None]), (12040, [float("nan")] * dim), (12060, [float("inf")] * dim), (None, x[3].tolist()), (12080, [0.0] * dim), (12100, [1.0, 2.0, 3.0]), (12120, [3.0, 2.0, 1.0]), (100, x[100].tolist())]
    return rows + bad


def usable(rows):
    return [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]


def ranked(rows, step, k, score):
    out = []
    for i, q in rows:
        if i % step == 0:
            best = sorted((-score(q, v), j) for j, v in rows if j != i and len(v) == len(q))[:k]
            out += [(i, j, -s) for s, j in best]
    return out


@pytest.mark.parametrize("shard", [8192, 64])
def test_top_k_equals_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(vectors, "SHARD_ROWS", shard)
    monkeypatch.setattr(vectors, "LANE_QUERIES", max(10, shard // 8))
    rows = made()
    got = topk.top_k(frame(spark, rows), F.col("id") % 20 == 0, 20).collect()
    score = lambda q, v: int((np.floor(64 * q) * np.floor(64 * v)).sum())
    unique = {(i, tuple(v)): v for i, v in usable(rows)}
    want = ranked([(i, v) for (i, _), v in unique.items()], 20, 20, score)
    twice = 100  # an id that comes twice: its rows compete for the ranks of one query
    for q in {r.query_id for r in got} - {twice}:
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == list(range(1, len(mine) + 1))
        assert [m[2] for m in mine][:5] == [w[2] for w in want if w[0] == q][:5]


def test_top_k_on_plain_rows(spark):
    rows = [r for r in made() if r[0] is not None][:700]
    got = topk.top_k(frame(spark, rows), F.col("id") % 20 == 0, 20).collect()
    want = ranked(usable(rows), 20, 20, lambda q, v: int((np.floor(64 * q) * np.floor(64 * v)).sum()))
    assert sorted((r.query_id, r.vec_id, r.score) for r in got) == sorted(want)


def test_branch_and_bound_prunes_nothing_that_counts():
    rng = np.random.default_rng(3)
    for dim in (1, 5, 16, 40):
        rows = rng.integers(-200, 200, (5000, dim)).astype(float)
        ids = rng.permutation(5000)
        owner, found, score = topk.search(ids[:30], rows[:30], ids, rows, 7)
        for q in range(30):
            exact = rows @ rows[q]
            best = sorted((-s, i) for s, i in zip(exact, ids) if i != ids[q])[:7]
            assert [(-s, i) for s, i in zip(score[owner == q], found[owner == q])] == best


def test_large_components_are_exact(spark):
    rows = [(0, [3e9, 1.0]), (1, [3e9, 2.0]), (2, [-3e9, 5.0]), (3, [1e30, 0.0])]
    got = topk.top_k(frame(spark, rows), F.col("id") == 0, 5).orderBy("rank").collect()
    ints = {i: [int(np.floor(64 * float(np.float32(x)))) for x in v] for i, v in rows}
    want = sorted((-min(2**63 - 1, max(-(2**63), sum(a * b for a, b in zip(ints[0], ints[j])))), j) for j in (1, 2, 3))
    assert [(r.vec_id, r.score) for r in got] == [(j, -s) for s, j in want]


def test_nearest_neighbours_recall(spark):
    rows = made(n=3000, dim=32)
    got = neighbours.nearest(frame(spark, rows), F.col("id") % 50 == 0, 5, shard_rows=1000, lane_queries=20).collect()
    good = [(i, v) for i, v in usable(rows) if np.abs(v).max() > 0]
    cosine = lambda q, v: float((q * v).sum() / (np.sqrt((q * q).sum()) * np.sqrt((v * v).sum())))
    want = ranked([r for r in good if r[0] != 100], 50, 5, cosine)
    byq = {q: [w for w in want if w[0] == q] for q in {w[0] for w in want}}
    hits = total = 0
    for q, best in byq.items():
        mine = sorted((r.rank, r.score, r.vec_id) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == list(range(1, len(mine) + 1)) and len(mine) == len(best)
        hits += sum(m[1] >= best[-1][2] - 1e-12 for m in mine)
        total += len(best)
        for _, s, j in mine:
            assert any(abs(s - cosine(dict(good)[q], v)) < 1e-12 for i, v in good if i == j)
    assert hits / total >= 0.9
    assert {r.query_id for r in got} >= {12100} and 12080 not in {r.query_id for r in got}


def test_no_vectors(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert topk.top_k(none, F.col("id") % 20 == 0, 20).count() == 0
    assert neighbours.nearest(none, F.col("id") % 50 == 0, 5).count() == 0


def test_top_k_of_doubles_beyond_all_bounds(spark):
    """Finite doubles that overflow when scaled take part; scores saturate."""
    from fractions import Fraction
    from math import floor

    rows = [(0, [1e308, 1.0]), (1, [1e-308, 2.0]), (2, [-1e308, 3.0]), (3, [1e10, 1e10]), (20, [0.5, -0.25])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, F.col("id") % 20 == 0, 20).collect())
    whole = {i: [floor(Fraction(x) * 64) for x in v] for i, v in rows}
    want = []
    for q in (0, 20):
        scored = sorted((-sum(a * b for a, b in zip(whole[q], whole[i])), i) for i in whole if i != q)
        want += [(q, n, i, max(-(2**63), min(2**63 - 1, -s))) for n, (s, i) in enumerate(scored, 1)]
    assert [g[:1] + g[2:] for g in sorted(got, key=lambda g: (g[0], g[2]))] == [w[:1] + w[2:] for w in sorted(want, key=lambda w: (w[0], w[2]))]

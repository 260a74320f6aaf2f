"""Exact top-k by inner product of quantised vectors: columnar branch and bound.

Method: a cell (see ``vectors``) lays its rows out by dimension. Inner products
accumulate over blocks of dimensions; after each block a row stays a candidate
of a query only while the partial score plus the product of the remaining
norms (Cauchy-Schwarz) can still reach the query's k-th best score. Once few
pairs are left they are compacted and the later blocks touch only them.

Defined cases: vectors that are null, hold null or non-finite components, or
have no id take no part; vectors meet only vectors of the same length; ties go
to the smaller id, then repeated rows count once each; a query's own id is no
candidate; scores beyond a long saturate.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rootseek.llm import vectors

#: Dimensions per block, rows scored at once, queries scored at once.
DIMS, ROWS, QUERIES = 16, 2048, 512
#: Share of a block's pairs below which they are compacted.
SPARSE = 0.1
EXACT = 2.0**53


def _best(ids: np.ndarray, scores: np.ndarray, owner: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (score, then smaller id) of each owner."""
    order = np.lexsort((ids, -scores, owner))
    ids, scores, owner = ids[order], scores[order], owner[order]
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    rank = np.arange(len(owner)) - np.repeat(first, np.diff(np.append(first, len(owner))))
    keep = rank < k
    return ids[keep], scores[keep], owner[keep]


def search(query_ids: np.ndarray, queries: np.ndarray, row_ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, id, score) of each query's k best rows. Whole numbers in double precision."""
    n, dim = rows.shape
    order = np.argsort(row_ids, kind="stable")
    row_ids, rows = row_ids[order], rows[order]
    by_mass = np.argsort(-(rows**2).sum(0), kind="stable")  # heavy dimensions first: bounds fall sooner
    columns, queries = np.ascontiguousarray(rows[:, by_mass].T), np.ascontiguousarray(queries[:, by_mass])
    starts = list(range(0, dim, DIMS))
    left = lambda x, axis: [np.sqrt((x.take(range(s, dim), axis) ** 2).sum(axis)) for s in starts[1:]] + [np.zeros(x.shape[1 - axis])]
    row_rest, query_rest = left(columns, 0), left(queries, 1)
    out = []
    for q0 in range(0, len(queries), QUERIES):
        q, qid = queries[q0 : q0 + QUERIES], query_ids[q0 : q0 + QUERIES]
        top = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
        floor = np.full(len(q), -np.inf)
        for r0 in range(0, n, ROWS):
            ids, block = row_ids[r0 : r0 + ROWS], columns[:, r0 : r0 + ROWS]
            score, pairs = np.zeros((len(q), len(ids))), None
            for b, s in enumerate(starts):
                rest_r, rest_q = row_rest[b][r0 : r0 + ROWS], query_rest[b][q0 : q0 + QUERIES]
                if pairs is None:
                    score += q[:, s : s + DIMS] @ block[s : s + DIMS]
                    if not np.isfinite(floor).any():
                        continue
                    alive = score >= (floor - 0.5)[:, None] - rest_q[:, None] * rest_r[None, :] * (1 + 1e-9)
                    if np.count_nonzero(alive) <= SPARSE * alive.size or b == len(starts) - 1:
                        pairs = np.nonzero(alive)
                        score = score[pairs]
                else:
                    qi, ri = pairs
                    score = score + np.einsum("ij,ji->i", q[qi, s : s + DIMS], block[s : s + DIMS, ri])
                    alive = score >= floor[qi] - 0.5 - rest_q[qi] * rest_r[ri] * (1 + 1e-9)
                    pairs, score = (qi[alive], ri[alive]), score[alive]
            if pairs is None:
                pairs = np.nonzero(np.ones(score.shape, bool))
                score = score.reshape(len(q), -1)[pairs]
            qi, ri = pairs
            other = ids[ri] != qid[qi]
            top = _best(np.concatenate([top[0], ids[ri[other]]]), np.concatenate([top[1], score[other]]), np.concatenate([top[2], qi[other]]), k)
            held = np.bincount(top[2], minlength=len(q))
            last = np.cumsum(held) - 1
            floor = np.where(held == k, top[1][np.maximum(last, 0)] if len(top[1]) else -np.inf, -np.inf)
        out.append((top[2] + q0, top[0], top[1]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def _whole(m: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) as Python's integers, where the product may leave a double's range."""
    return np.array([[math.floor(Fraction(v) * Fraction(scale)) for v in x] for x in m.tolist()], object).reshape(m.shape)


def _search_large(query_ids, q, row_ids, r, k):
    """As ``search``, over Python's integers, where products may exceed double precision."""
    found = []
    for i, x in enumerate(q):
        scored = sorted((-int(s), int(j)) for s, j in zip(r @ x, row_ids) if j != query_ids[i])[:k]
        found += [(i, j, max(-(2**63), min(2**63 - 1, -s))) for s, j in scored]
    return tuple(np.array(x, np.int64) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3


def top_k(rows: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """(query_id, rank, vec_id, score) of every row that ``is_query`` (a condition on ``id``) selects."""
    base = vectors.valid(rows, id_col, vec_col)
    left, right = vectors.grid(base, base.where(is_query), ["id", "vec"], vectors.SHARD_ROWS, vectors.LANE_QUERIES)

    def cell(key: tuple[pa.Scalar, ...], queries: pa.Table, found: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        given = [vectors.matrix(t["vec"], dim) for t in (queries, found)]
        qid, rid = (t["id"].to_numpy() for t in (queries, found))
        with np.errstate(over="ignore", invalid="ignore"):
            q, r = (np.floor(m * scale) for m in given)
            plain = (np.abs(q).max(initial=0) * np.abs(r).max(initial=0)) * max(dim, 1) < EXACT
        owner, ids, score = (), (), ()
        if len(qid) and len(rid):
            owner, ids, score = search(qid, q, rid, r, k) if plain else _search_large(qid, _whole(given[0], scale), rid, _whole(given[1], scale), k)
        return pa.table({
            "query_id": pa.array(qid[np.asarray(owner, np.int64)], pa.int64()), "vec_id": pa.array(np.asarray(ids, np.int64)), "score": pa.array(np.asarray(score, np.int64)),
        })

    keys = ("dim", "shard", "lane")
    part = right.groupBy(*keys).cogroup(left.groupBy(*keys)).applyInArrow(cell, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return part.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

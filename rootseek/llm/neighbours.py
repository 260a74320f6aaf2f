"""Approximate nearest neighbours by collision counting over single projections.

Method: the index of a shard holds, for each of ``PROJECTIONS`` random
directions, the rows' projections in sorted order. A query centres a window on
its own projection in every array; the windows widen from level to level
(virtual rehashing: a level only adds the two new margins), and a row collides
once for every window that holds it. Rows whose collisions reach the threshold
are verified with the true cosine. The search ends at the first level
whose radius covers the k-th best verified distance; the last level covers
everything, so no row is out of reach and no candidate is capped.

Every row is indexed; nothing is fitted on data, only random directions are
drawn (fixed seed). Vectors are scaled to unit length for the projections,
where nearness in cosine and in distance agree.

Defined cases: vectors that are null, zero, or hold null or non-finite
components take no part; only vectors of the same length meet; ties go to the
smaller id; a query's own id is no candidate; repeated rows count once each.
"""

from __future__ import annotations

from math import erf, floor, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rootseek.llm import vectors
from rootseek.llm.common import durable

#: Sorted arrays per shard, and half a window's width at radius 1.
PROJECTIONS, HALF_WIDTH = 64, 1.0
#: Radii of the levels on the unit sphere; beyond the last one all rows are verified.
RADII = (0.25, 0.5, 0.75, 0.9, 1.0, 1.08, 1.16, 1.24, 1.32, 1.4)
#: Standard deviations by which the threshold lies under the collisions expected at the radius.
SLACK = 1.2
SEED = 20_240_601


def directions(dim: int, count: int) -> np.ndarray:
    return np.random.default_rng((SEED, dim)).standard_normal((count, dim))


def threshold(projections: int = PROJECTIONS, half_width: float = HALF_WIDTH, slack: float = SLACK) -> int:
    """Collisions that a row at the level's radius reaches almost surely."""
    p = erf(half_width / sqrt(2))
    return max(1, floor(projections * p - slack * sqrt(projections * p * (1 - p))))


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; very large and very small ones first to a safe range."""
    peak = np.abs(rows).max(axis=1, keepdims=True)
    safe = rows / peak
    return safe / np.sqrt((safe**2).sum(axis=1, keepdims=True))


def cosine(query: np.ndarray, rows: np.ndarray, query_norm: float, row_norms: np.ndarray) -> np.ndarray:
    return (rows @ query) / (query_norm * row_norms)


def build(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, order) of every sorted array."""
    projected = directions(rows.shape[1], PROJECTIONS) @ unit(rows).T
    order = np.argsort(projected, axis=1, kind="stable").astype(np.int32)
    return np.take_along_axis(projected, order, axis=1), order


def search(query_ids, queries, ids, rows, values, order, k: int):
    """(owner, id, score, verified) of each query's k nearest found rows of a shard."""
    n, need = len(ids), threshold()
    with np.errstate(over="ignore"):
        norms, query_norms = np.sqrt((rows**2).sum(1)), np.sqrt((queries**2).sum(1))
    plain = np.isfinite(norms).all() and np.isfinite(query_norms).all() and (norms > 1e-150).all() and (query_norms > 1e-150).all()
    if not plain:  # lengths out of range: the same cosine from scaled vectors
        rows, queries = unit(rows), unit(queries)
        norms, query_norms = np.sqrt((rows**2).sum(1)), np.sqrt((queries**2).sum(1))
    centres = unit(queries) @ directions(rows.shape[1], PROJECTIONS).T
    edges = np.array([0.0, *RADII]) * HALF_WIDTH  # level 0: the empty window at the centre
    lows = np.array([np.searchsorted(v, c[:, None] - edges, "left") for v, c in zip(values, centres.T)])
    highs = np.array([np.searchsorted(v, c[:, None] + edges, "right") for v, c in zip(values, centres.T)])
    highs[:, :, 0] = lows[:, :, 0]
    out = []
    for i, own in enumerate(query_ids):
        count, verified = np.zeros(n, np.int64), np.zeros(n, bool)
        best_ids, best_scores = np.zeros(0, np.int64), np.zeros(0)
        for level, radius in enumerate((*RADII, None), 1):
            if radius is None:
                fresh = np.flatnonzero(~verified)
            else:
                (low, high), (lo, hi) = ([e[:, i, at].tolist() for e in (lows, highs)] for at in (level - 1, level))
                new = [o[a:b] for o, a, b in zip(order, lo, low)] + [o[a:b] for o, a, b in zip(order, high, hi)]
                count += np.bincount(np.concatenate(new), minlength=n)
                fresh = np.flatnonzero((count >= need) & ~verified)
            verified[fresh] = True
            fresh = fresh[ids[fresh] != own]
            if len(fresh):
                score = cosine(queries[i], rows[fresh], query_norms[i], norms[fresh])
                both, found = np.concatenate([best_scores, score]), np.concatenate([best_ids, ids[fresh]])
                top = np.lexsort((found, -both))[:k]
                best_scores, best_ids = both[top], found[top]
            if radius is not None and len(best_ids) == k and 2 - 2 * best_scores[-1] <= radius**2:
                break
        out.append((np.full(len(best_ids), i), best_ids, best_scores, np.full(len(best_ids), int(verified.sum()))))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else ((), (), (), ())


def index(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", shard_rows: int = vectors.SHARD_ROWS) -> DataFrame:
    """One row per shard and vector length: ids, vectors, sorted arrays. Written once."""
    base = vectors.valid(rows, id_col, vec_col).where(F.exists("vec", lambda x: x != 0))
    shards = max(1, -(-base.count() // shard_rows))
    spread = base.withColumn("shard", F.pmod(F.xxhash64("id", "vec"), F.lit(shards)).cast("int"))

    def work(key: tuple[pa.Scalar, ...], found: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        x = vectors.matrix(found["vec"], dim)
        values, order = build(x)
        return pa.table({
            "dim": pa.array([dim], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int32()), "n": pa.array([len(x)], pa.int32()),
            "ids": pa.array([found["id"].to_numpy().astype(np.int64).tobytes()], pa.binary()), "vecs": pa.array([x.tobytes()], pa.binary()),
            "vals": pa.array([values.tobytes()], pa.binary()), "perm": pa.array([order.tobytes()], pa.binary()),
        })

    built = spread.groupBy("dim", "shard").applyInArrow(work, "dim int, shard int, n int, ids binary, vecs binary, vals binary, perm binary")
    return durable(built, "ann-index")


def nearest(
    rows: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vec_col: str = "embedding",
    shard_rows: int = vectors.SHARD_ROWS, lane_queries: int = 512,
) -> DataFrame:
    """(query_id, rank, vec_id, score) of every row that ``is_query`` (a condition on ``id``) selects."""
    shards = index(rows, id_col, vec_col, shard_rows)
    queries = vectors.valid(rows, id_col, vec_col).where(F.exists("vec", lambda x: x != 0)).where(is_query)
    lanes = max(1, -(-queries.count() // lane_queries))
    lane = F.pmod(F.xxhash64("id", "vec"), F.lit(lanes)).cast("int")
    numbers = shards.select("dim", "shard")
    left = queries.withColumn("lane", lane).join(numbers, "dim").select(F.col("dim").alias("q_dim"), F.col("shard").alias("q_shard"), F.col("lane").alias("q_lane"), "id", "vec")
    right = shards.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))

    def cell(key: tuple[pa.Scalar, ...], asked: pa.Table, held: pa.Table) -> pa.Table:
        dim, owner, ids, score, verified = key[0].as_py(), (), (), (), ()
        qid = asked["id"].to_numpy()
        if len(qid) and held.num_rows:
            row = held.slice(0, 1).to_pylist()[0]
            n = row["n"]
            x = np.frombuffer(row["vecs"]).reshape(n, dim)
            values, order = np.frombuffer(row["vals"]).reshape(-1, n), np.frombuffer(row["perm"], np.int32).reshape(-1, n)
            owner, ids, score, verified = search(qid, vectors.matrix(asked["vec"], dim), np.frombuffer(row["ids"], np.int64), x, values, order, k)
        return pa.table({
            "query_id": pa.array(qid[np.asarray(owner, np.int64)], pa.int64()), "vec_id": pa.array(np.asarray(ids, np.int64)),
            "score": pa.array(np.asarray(score, np.float64)), "verified": pa.array(np.asarray(verified, np.int64)),
        })

    keys = ("dim", "shard", "lane")
    part = left.groupBy(*[f"q_{k}" for k in keys]).cogroup(right.groupBy(*keys)).applyInArrow(cell, "query_id long, vec_id long, score double, verified long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return part.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Valid vectors, and the grid on which a query set meets all rows in blocks.

Rows go to shards, queries to lanes; a cell of the grid holds one shard and one
lane, both of bounded size, and is one group of a co-grouped task. The queries
are a stated set, each cell is searched by blocks, and only a cell's best
rows leave it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootseek.llm.common import ceil_div, ship

#: Rows of a shard and queries of a lane, on average.
SHARD_ROWS, LANE_QUERIES = 8192, 16384


def valid(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec array<double>, dim) of rows whose id is given and whose components are all finite."""
    ship(rows.sparkSession)
    vec = F.col(vec_col).cast("array<double>")
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec")).where(
        F.col("id").isNotNull() & F.coalesce(finite, F.lit(False))
    ).withColumn("dim", F.size("vec"))


def grid(rows: DataFrame, queries: DataFrame, columns: list[str], shard_rows: int, lane_queries: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with (dim, shard, lane), every row once per lane and every query once per shard."""
    n_rows, n_queries = rows.count(), queries.count()
    shards, lanes = max(1, ceil_div(n_rows, shard_rows)), max(1, ceil_div(n_queries, lane_queries))
    spread = F.xxhash64("id", "vec")
    left = rows.withColumn("shard", F.pmod(spread, F.lit(shards)).cast("int"))
    right = queries.withColumn("lane", F.pmod(spread, F.lit(lanes)).cast("int"))
    left = left.select("dim", "shard", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), *columns)
    right = right.select("dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "lane", *columns)
    return left, right


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Rows of an array<double> column of one length."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim) if dim else np.zeros((len(lists), 0))

"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootseek.llm.common import durable


def _fingerprint(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31))).alias("s")).first()
    return r.n, r.s


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang a node's larger (or smaller) neighbours on the smallest node among it and them."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).toDF("u", "v")
    if not large:
        both = both.where("v < u")
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))  # folds before the shuffle
    hung = both.join(least, "u")
    if large:
        hung = hung.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        hung = hung.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return hung.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with a link; the component is its smallest node.

    ``edges`` has columns a and b. Every round is written to the shared folder;
    the driver sees a count and a checksum. The number of rounds grows with the
    logarithm of the longest chain.
    """
    now = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = _fingerprint(now)
    while seen[0]:
        now = durable(_star(_star(now, large=True), large=False), "links")
        after = _fingerprint(now)
        if after == seen:
            break
        seen = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component"))
    ).distinct()

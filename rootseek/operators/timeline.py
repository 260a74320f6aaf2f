"""Causal depth of spans and per-node timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..params import DEFAULTS, Params
from ..session import durable


def causal_depths(spans: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Hops from each span to the top of its trace.

    A span without a parent, or whose parent was lost, has depth 0; spans that
    hang on a cycle get ``unreachable_depth``. Pointers to ancestors are
    doubled each round, so a trace of depth d takes log2(d) joins, all traces
    at once. Finished spans leave the working set.
    """
    links = (
        spans.groupBy("span_id")
        .agg(F.max(F.struct("ord", "parent_span_id")).alias("last"))
        .select("span_id", F.col("last.parent_span_id").alias("parent"))
    )
    known = links.select(F.col("span_id").alias("parent"), F.lit(True).alias("present"))
    start = durable(
        links.join(known, "parent", "left").select(
            "span_id", F.when(F.col("present"), F.col("parent")).alias("up"),
            F.when(F.col("present"), 1).otherwise(0).alias("depth"),
        ),
        "depth",
    )
    done = [start.where("up IS NULL").select("span_id", "depth")]
    state = start
    open_spans = state.where("up IS NOT NULL").count()
    while open_spans:
        ahead = state.select(
            F.col("span_id").alias("up"), F.col("up").alias("next_up"), F.col("depth").alias("more")
        )
        # Finished spans stay joinable as targets; only open ones move on.
        stepped = durable(
            state.where("up IS NOT NULL")
            .join(ahead, "up")
            .select("span_id", F.col("next_up").alias("up"), (F.col("depth") + F.col("more")).alias("depth")),
            "depth",
        )
        closed = stepped.where("up IS NULL").select("span_id", "depth")
        done.append(closed)
        still_open = stepped.where("up IS NOT NULL").count()
        if still_open == open_spans:
            break
        open_spans = still_open
        reached = done[0]
        for part in done[1:]:
            reached = reached.union(part)
        state = reached.withColumn("up", F.lit(None).cast("string")).unionByName(
            stepped.where("up IS NOT NULL")
        )
    depths = done[0]
    for part in done[1:]:
        depths = depths.union(part)
    return (
        links.select("span_id")
        .join(depths, "span_id", "left")
        .select("span_id", F.coalesce("depth", F.lit(params.unreachable_depth)).alias("depth"))
    )


def causal_events(spans: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Every span with its depth; see ``in_causal_order``."""
    return spans.select(
        F.col("service_id").alias("node_id"),
        "trace_id",
        "span_id",
        (F.col("otel_status_code") == 2).alias("is_error"),
        F.coalesce(F.col("http_status_code") >= 500, F.lit(False)).alias("is_server_error"),
        F.col("start_time").alias("timestamp"),
        "ord",
    ).join(causal_depths(spans, params), "span_id")


def in_causal_order(events: DataFrame) -> DataFrame:
    """Events with their ``position`` from 1 in order of (depth, start, input order).

    Ranges of the order go to partitions; a position is the row's place in its
    partition plus the sizes of those before, so no task sees all events.
    """
    order = ["depth", "timestamp", "ord"]
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = durable(
        events.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_row", row),
        "causal-order",
    )
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # one row per partition
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(offsets), "_part").withColumn("position", F.col("_row") + F.col("_before") + 1).drop("_part", "_row", "_before")


def node_timelines(events: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Counts, error rate, mean depth and first error of each node."""
    first = F.min(F.when(F.col("is_error"), F.struct("depth", "timestamp", "ord", "span_id")))
    out = (
        events.groupBy("node_id")
        .agg(
            F.count(F.lit(1)).alias("total_span_count"),
            F.count_if("is_error").alias("error_span_count"),
            F.avg("depth").alias("causal_position"),
            first.alias("first"),
        )
        .select(
            "node_id",
            "total_span_count",
            "error_span_count",
            (F.col("error_span_count") / F.col("total_span_count")).alias("error_rate"),
            "causal_position",
            F.col("first.depth").alias("first_error_depth"),
            F.col("first.span_id").alias("first_error_span_id"),
        )
    )
    return out.withColumn(
        "is_likely_origin",
        F.coalesce(
            (F.col("error_rate") >= params.origin_error_rate)
            & (F.col("first_error_depth") <= params.origin_depth),
            F.lit(False),
        ),
    )


def origin_candidates(timelines: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Anomalous nodes with error spans, shallowest first error first."""
    ids = anomalies.select("node_id").distinct()
    return (
        timelines.join(ids, "node_id", "left_semi")
        .where("is_likely_origin OR error_span_count > 0")
        .orderBy(F.asc_nulls_last("first_error_depth"), "node_id")
    )


def trace_totals(spans: DataFrame) -> DataFrame:
    """Number of traces and spans."""
    return spans.agg(
        F.countDistinct("trace_id").alias("trace_count"), F.count(F.lit(1)).alias("span_count")
    )

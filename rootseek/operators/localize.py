"""Candidate nodes of an iteration, and hints about their neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.incidents import Incidents, per_incident
from ..params import ANOMALY_METRICS
from ..sources.records import ORDER

KEY = ["incident_id", "node_id"]
# Why a node is a candidate, most important first.
REASONS = ("metric_anomaly", "change_event", "investigation_hint")


def reason_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(r) for r in REASONS]), rank + 1)


def base_candidates(anomalies: DataFrame, changed: DataFrame, nodes: DataFrame) -> DataFrame:
    """Candidates that need no hint: anomalous series and recent changes.

    ``place`` is the order of inclusion: z-score descending, then node order.
    """
    metric = anomalies.where(F.col("metric_type").isin(*ANOMALY_METRICS)).select(
        *KEY,
        F.struct(F.lit(0).alias("reason"), (-F.col("z_score")).alias("a"), F.col("cur_ord").cast(ORDER).alias("b"), F.lit(0).cast(ORDER).alias("c")).alias("place"),
    )
    own = per_incident(nodes)
    services = nodes.where("node_type = 'service'").select(*own, "node_id", "ord")
    change = changed.join(services, [*own, "node_id"]).select(
        *KEY,
        F.struct(F.lit(1).alias("reason"), F.lit(0.0).alias("a"), F.col("ord").cast(ORDER).alias("b"), F.lit(0).cast(ORDER).alias("c")).alias("place"),
    )
    return metric.unionByName(change).groupBy(*KEY).agg(F.min("place").alias("place"))


def hint_candidates(hints: DataFrame) -> DataFrame:
    """Hinted nodes, placed after all others in the order of their first hint."""
    return hints.groupBy(*KEY).agg(
        F.min(
            F.struct(
                F.lit(2).alias("reason"),
                F.col("suggesting_rank").cast("double").alias("a"),
                F.when(F.col("direction") == "predecessor", 0).otherwise(1).cast(ORDER).alias("b"),
                F.col("edge_ord").cast(ORDER).alias("c"),
            )
        ).alias("place")
    )


def localize(included: DataFrame, nodes: DataFrame, edges: DataFrame, known: DataFrame | None) -> DataFrame:
    """Typed candidates with the origin test; nodes outside the graph drop out.

    A candidate may be the origin when nothing it calls has been investigated
    or is a candidate now.
    """
    merged = included.groupBy(*KEY).agg(F.min("place").alias("place"))
    if known is not None:
        merged = merged.join(known, KEY, "left_anti")
    candidates = merged.join(nodes.select(*per_incident(nodes), "node_id", "node_type"), [*per_incident(nodes), "node_id"])
    involved = candidates.select(*KEY)
    if known is not None:
        involved = involved.unionByName(known.select(*KEY)).distinct()
    own = per_incident(edges)
    busy = (
        edges.select(*own, F.col("source_id").alias("node_id"), "target_id")
        .join(involved.withColumnRenamed("node_id", "target_id"), [*own, "target_id"])
        .select(*KEY)
        .distinct()
        .withColumn("calls_suspect", F.lit(True))
    )
    return candidates.join(busy, KEY, "left").select(
        *KEY,
        "node_type",
        reason_name(F.col("place.reason")).alias("inclusion_reason"),
        F.col("calls_suspect").isNull().alias("is_potential_origin"),
        "place",
    )


def unplaced(included: DataFrame, nodes: DataFrame) -> DataFrame:
    """Candidates that are not in the graph, as reject rows."""
    return included.join(nodes, [*per_incident(nodes), "node_id"], "left_anti").select(
        F.lit("candidates").alias("source"), F.lit("node not in graph").alias("reason"), F.col("node_id").alias("raw")
    )


def neighbour_hints(
    ranked: DataFrame, edges: DataFrame, signals: DataFrame, known: DataFrame, iteration: int
) -> DataFrame:
    """At most one hint per candidate, neighbour and direction.

    ``ranked`` needs ``causal_rank``; neighbours in ``known`` are left out.
    """
    own = per_incident(edges)
    callers = edges.select(
        *own, F.col("target_id").alias("suggesting_node_id"), F.col("source_id").alias("node_id"),
        F.lit("predecessor").alias("direction"), F.col("ord").alias("edge_ord"),
    )
    callees = edges.select(
        *own, F.col("source_id").alias("suggesting_node_id"), F.col("target_id").alias("node_id"),
        F.lit("successor").alias("direction"), F.col("ord").alias("edge_ord"),
    )
    suspects = ranked.select(
        "incident_id", F.col("node_id").alias("suggesting_node_id"), F.col("causal_rank").alias("suggesting_rank")
    )
    own_errors = signals.select(
        "incident_id", F.col("node_id").alias("suggesting_node_id"), F.col("has_errors").alias("suspect_errors")
    )
    pairs = (
        callers.unionByName(callees)
        .where("suggesting_node_id <> node_id")
        .join(suspects, [*own, "suggesting_node_id"])
        .join(known.select(*KEY), KEY, "left_anti")
        .join(signals, KEY)
        .join(own_errors, ["incident_id", "suggesting_node_id"], "left")
    )
    code = F.col("has_503") | F.col("has_429")
    silent = (
        (F.col("direction") == "successor")
        & F.coalesce("suspect_errors", F.lit(False))
        & F.col("has_200")
        & ~F.col("has_errors")
    )
    err, chg, met = F.col("has_errors"), F.col("has_change"), F.col("has_metric")
    signal = (
        F.when(code | F.col("has_timeout"), "error_code_pattern")
        .when(silent, "silent_degradation")
        .when(chg & err, "change_event")
        .when(~met & err, "missing_telemetry")
        .when(chg & met, "sub_threshold_metric")
        .when(err, "span_errors")
    )
    return (
        pairs.withColumn("signal", signal)
        .where("signal IS NOT NULL")
        .select(
            *KEY,
            "signal",
            "direction",
            F.when(F.col("signal").isin("error_code_pattern", "silent_degradation", "change_event"), "strong")
            .otherwise("moderate")
            .alias("hint_strength"),
            _reason().alias("reason"),
            "suggesting_node_id",
            F.lit(iteration).alias("iteration_found"),
            "suggesting_rank",
            "edge_ord",
        )
    )


def _reason() -> Column:
    """Wording of a hint."""
    who, suspect, signal = F.col("node_id"), F.col("suggesting_node_id"), F.col("signal")
    codes = F.array_compact(
        F.array(F.when(F.col("has_429"), F.lit("429")), F.when(F.col("has_503"), F.lit("503")))
    )
    parts = F.array_compact(
        F.array(
            F.when(
                F.size(codes) > 0,
                F.concat(F.lit("status "), F.array_join(codes, "/")),
            ),
            F.when(F.col("has_timeout"), F.lit("failed connections")),
        )
    )
    return (
        F.when(signal == "error_code_pattern", F.concat(who, F.lit(": "), F.array_join(parts, ", ")))
        .when(
            signal == "silent_degradation",
            F.concat(
                suspect, F.lit(" fails although "), who, F.lit(" answers with 200; its answers may be unusable"),
            ),
        )
        .when(
            signal == "change_event",
            F.concat(who, F.lit(": changed, and failing since")),
        )
        .when(
            signal == "missing_telemetry",
            F.concat(
                who,
                F.lit(": failing spans, yet no metric that would show it"),
            ),
        )
        .when(
            signal == "sub_threshold_metric",
            F.concat(
                who,
                F.lit(": changed, and a metric moved without crossing the threshold"),
            ),
        )
        .otherwise(F.concat(who, F.lit(": failing spans")))
    )


def rank_candidates(candidates: DataFrame, scores: DataFrame, inc: Incidents) -> DataFrame:
    """Best ``top_k`` candidates per incident by causal confidence.

    The literal bound lets Spark drop hopeless rows before the shuffle.
    """
    order = W.partitionBy("incident_id").orderBy(F.desc(F.round("causal_confidence", 12)), "place")
    return (
        candidates.join(scores, KEY)
        .join(inc.df.select("incident_id", "top_k"), "incident_id")
        .withColumn("causal_rank", F.row_number().over(order))
        .where(F.col("causal_rank") <= inc.most_wanted)
        .where("causal_rank <= top_k")
        .drop("top_k")
    )

"""Spans inside the incident windows and their per-node summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.incidents import Incidents, in_window
from ..functions.text import contains_any, http_code
from ..params import ANOMALY_METRICS, TIMEOUT_WORDS


def span_window(spans: DataFrame, inc: Incidents) -> DataFrame:
    """Spans that start in ``[start, start + window]``, with the fields evidence needs."""
    a = F.col("attributes")
    return in_window(spans, "start_time", inc, 0, inc.params.window_seconds).select(
        "incident_id",
        F.col("service_id").alias("node_id"),
        "span_id",
        "operation_name",
        "duration_ms",
        (F.col("otel_status_code") == 2).alias("is_error"),
        http_code(a).alias("http_code"),
        F.lower(F.coalesce(a["error.type"], F.lit(""))).alias("error_type"),
        a["peer.service"].alias("peer"),
        F.nullif(a["db.statement"], F.lit("")).alias("statement"),
        (a["db.system"].isNotNull() | a["db.name"].isNotNull()).alias("is_db"),
        F.when(
            F.size("events") > 0,
            F.transform(
                "events",
                lambda e: F.struct(
                    F.nullif(e["attributes"]["exception.type"], F.lit("")).alias("type"),
                    e["attributes"]["exception.message"].alias("message"),
                    e["attributes"]["exception.stacktrace"].alias("stacktrace"),
                ),
            ),
        ).alias("exceptions"),
        a["exception.stacktrace"].alias("stacktrace"),
        "ord",
    )


def span_summary(window: DataFrame, inc: Incidents) -> DataFrame:
    """One row per incident and node: counts and boolean signals."""
    code = F.col("http_code")
    return window.groupBy("incident_id", "node_id").agg(
        F.count(F.lit(1)).alias("spans"),
        F.count_if("is_error").alias("errors"),
        F.count_if("is_db").alias("db_spans"),
        F.coalesce(F.bool_or(code == 503), F.lit(False)).alias("has_503"),
        F.coalesce(F.bool_or(code == 429), F.lit(False)).alias("has_429"),
        F.coalesce(F.bool_or(code == 200), F.lit(False)).alias("has_200"),
        F.bool_or(contains_any(F.col("error_type"), TIMEOUT_WORDS)).alias("has_timeout"),
        F.max(F.when(F.col("is_db"), F.col("duration_ms"))).alias("slowest_db_ms"),
    )


def changed_nodes(changes: DataFrame, commits: DataFrame | None, inc: Incidents) -> DataFrame:
    """(incident, service) pairs with any change in the candidate lookback."""
    events = changes.select(F.col("service_id").alias("node_id"), "timestamp")
    if commits is not None:
        events = events.unionByName(commits.select(F.col("service_id").alias("node_id"), "timestamp"))
    return (
        in_window(events, "timestamp", inc, inc.params.change_lookback_minutes * 60, 0)
        .select("incident_id", "node_id")
        .distinct()
    )


def node_signals(summary: DataFrame, stats: DataFrame, changed: DataFrame) -> DataFrame:
    """What a neighbour scan needs to know about a node, one row each."""
    flags = ["has_errors", "has_503", "has_429", "has_200", "has_timeout", "has_change", "has_metric"]

    def part(df: DataFrame, **known) -> DataFrame:
        return df.select(
            "incident_id", "node_id", *[known.get(f, F.lit(False)).alias(f) for f in flags]
        )

    has_metric = stats.where(F.col("metric_type").isin(*ANOMALY_METRICS) & (F.col("obs_n") > 0))
    rows = (
        part(
            summary,
            has_errors=F.col("errors") > 0,
            has_503=F.col("has_503"),
            has_429=F.col("has_429"),
            has_200=F.col("has_200"),
            has_timeout=F.col("has_timeout"),
        )
        .unionByName(part(changed, has_change=F.lit(True)))
        .unionByName(part(has_metric, has_metric=F.lit(True)))
    )
    return rows.groupBy("incident_id", "node_id").agg(*[F.max(f).alias(f) for f in flags])

"""Evidence of databases, external dependencies and queues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.incidents import Incidents, per_incident
from ..functions.text import contains_any
from ..params import (
    CACHE_SYSTEMS, INTEGRITY_EXCEPTIONS, RELATIONAL_SYSTEMS, TIMEOUT_EXCEPTIONS, TIMEOUT_WORDS,
)
from . import evidence as E
from . import spanfacts as X

KEY = ["incident_id", "node_id"]


def caller_timeouts(window: DataFrame, edges: DataFrame) -> DataFrame:
    """Callers whose spans carry a timeout exception: the most frequent type
    of each, numbered in call order."""
    counts = X.exception_counts(X.exception_events(window))
    best = X.modal_exception(
        counts, contains_any(F.col("exception_type"), TIMEOUT_EXCEPTIONS)
    ).select("incident_id", F.col("node_id").alias("source_id"), F.col("exception_type").alias("timeout_type"))
    in_order = W.partitionBy(*KEY).orderBy("edge_ord")
    return (
        edges.select(*per_incident(edges), "source_id", F.col("target_id").alias("node_id"), F.col("ord").alias("edge_ord"))
        .join(best, [*per_incident(edges), "source_id"])
        .withColumn("place", F.row_number().over(in_order))
        .select(*KEY, F.col("source_id").alias("caller_id"), "timeout_type", "place")
    )


def _integrity_message(events: DataFrame, matches: DataFrame) -> DataFrame:
    """First non-empty message, looking at the first matching event per span."""
    return (
        events.where("is_error")
        .join(matches.select(*KEY, "exception_type"), [*KEY, "exception_type"])
        .groupBy(*KEY, "ord")
        .agg(F.min_by("exception_message", "pos").alias("message"))
        .where("message <> ''")
        .groupBy(*KEY)
        .agg(F.min_by("message", "ord").alias("integrity_message"))
    )


def database_facts(
    candidates: DataFrame, window: DataFrame, summary: DataFrame, stats: DataFrame,
    systems: DataFrame, edges: DataFrame, inc: Incidents,
) -> DataFrame:
    """Everything the database rules look at, one row per candidate."""
    p = inc.params
    lat, err = F.col("metric_type") == "latency_p99", F.col("metric_type") == "error_rate"
    has_base = F.col("sample_count") > 0
    series = (
        stats.groupBy(*KEY)
        .agg(
            F.max(F.when(lat & has_base, F.col("mean"))).alias("lat_base"),
            F.max(F.when(lat & has_base, F.col("std"))).alias("lat_std"),
            F.max(F.when(lat & (F.col("obs_n") > 0), F.col("obs_mean"))).alias("lat_now"),
            F.max(F.when(err & has_base, F.col("mean"))).alias("err_base"),
            F.max(F.when(err & has_base, F.col("std"))).alias("err_std"),
        )
    )
    ids = candidates.select(*KEY).distinct()
    own = window.join(ids, KEY, "left_semi")
    events = X.exception_events(own)
    errors_only = events.where("is_error")
    integrity = X.modal_exception(
        X.exception_counts(errors_only), contains_any(F.col("exception_type"), INTEGRITY_EXCEPTIONS)
    )
    timeouts = caller_timeouts(window, edges).where(F.col("place") <= p.caller_timeout_items)
    firsts = timeouts.groupBy(*KEY).agg(
        *[
            F.max(F.when(F.col("place") == i, F.struct("caller_id", "timeout_type"))).alias(f"timeout_{i}")
            for i in range(1, p.caller_timeout_items + 1)
        ]
    )
    facts = (
        ids.join(summary, KEY, "left")
        .join(series, KEY, "left")
        .join(systems, [*per_incident(systems), "node_id"], "left")
        .join(integrity.select(*KEY, F.col("exception_type").alias("integrity_type")), KEY, "left")
        .join(_integrity_message(events, integrity), KEY, "left")
        .join(X.slowest_statements(own), KEY, "left")
        .join(X.failing_statements(own), KEY, "left")
        .join(firsts, KEY, "left")
    )
    zero = F.lit(0)
    known = F.col("lat_now").isNotNull() & F.col("lat_base").isNotNull()
    spans, errors = F.coalesce("spans", zero), F.coalesce("errors", zero)
    return (
        facts.withColumn("spans", spans)
        .withColumn("errors", errors)
        .withColumn("db_spans", F.coalesce("db_spans", zero))
        .withColumn("system", F.coalesce("db_system", F.lit("")))
        .withColumn("latency_known", known)
        .withColumn("has_latency_baseline", F.col("lat_base").isNotNull())
        .withColumn("latency_z", F.when(known, (F.col("lat_now") - F.col("lat_base")) / F.col("lat_std")).otherwise(0.0))
        .withColumn("latency_ms", F.coalesce("lat_now", F.lit(0.0)))
        .withColumn("latency_base", F.coalesce("lat_base", F.lit(0.0)))
        .withColumn("error_pct", F.when(F.col("spans") > 0, F.col("errors") / F.col("spans") * 100).otherwise(0.0))
        .withColumn("error_base", F.coalesce("err_base", F.lit(0.0)))
        .withColumn("error_z", (F.col("error_pct") - F.col("error_base")) / F.coalesce(F.col("err_std"), F.lit(1.0)))
        .withColumn(
            "family",
            F.when(F.col("system").isin(*RELATIONAL_SYSTEMS), "relational")
            .when(F.col("system").isin(*CACHE_SYSTEMS), "cache")
            .otherwise("generic"),
        )
        .withColumn("slow", F.col("latency_known") & (F.col("latency_z") >= p.db_latency_z))
        .withColumn(
            "failure_type",
            F.when(
                F.col("family") == "relational",
                F.when(F.col("integrity_type").isNotNull(), "db_error")
                .when(F.col("slow") | F.coalesce(F.col("slowest_db_ms") > p.slow_span_ms, F.lit(False)), "db_slow_query")
                .when((F.col("errors") > 0) & F.col("timeout_1").isNotNull(), "db_connection_exhaustion")
                .otherwise("unknown"),
            )
            .when(F.col("family") == "cache", F.when(F.col("slow"), "db_slow_query").when(F.col("errors") > 0, "db_error").otherwise("unknown"))
            .otherwise("unknown"),
        )
    )


def database_evidence(facts: DataFrame, inc: Incidents) -> DataFrame:
    p = inc.params
    c = F.col
    node = c("node_id")
    relational, generic = c("family") == "relational", c("family") == "generic"
    kind = lambda k: relational & (c("failure_type") == k)
    broken, slow, exhausted, unknown = map(kind, ("db_error", "db_slow_query", "db_connection_exhaustion", "unknown"))
    plain = ~relational
    failing = c("errors") > 0
    err = lambda section, when, cap=False: E.error_rate(
        p, section, node, c("error_pct"), c("error_base"), c("error_z"), when, cap
    )
    lat = lambda section, when, cap=False: E.latency_spike(
        p, section, node, c("latency_ms"), c("latency_base"), c("latency_z"), when, cap
    )
    shown = F.when(c("db_spans") > 0, c("db_spans")).otherwise(c("spans"))
    items = [
        E.integrity_error(1, node, c("integrity_type"), F.coalesce("integrity_message", F.lit("")), broken),
        err(2, broken),
        E.statement(3, node, c("system"), c("error_statement"), broken & c("error_statement").isNotNull()),
        lat(1, slow & c("lat_now").isNotNull()),
        E.slow_query(p, 2, node, c("slow_statement"), c("slow_mean_ms"), c("latency_base"), slow & c("slow_statement").isNotNull()),
        err(3, slow & failing),
        E.connection_exhaustion(p, 1, node, c("errors"), shown, exhausted),
        *[
            E.caller_timeout(2, node, c(f"timeout_{i}.caller_id"), c(f"timeout_{i}.timeout_type"), F.lit(i),
                             exhausted & c(f"timeout_{i}").isNotNull())
            for i in range(1, p.caller_timeout_items + 1)
        ],
        err(3, exhausted),
        lat(4, exhausted & c("lat_now").isNotNull() & (c("latency_z") > 0)),
        lat(1, plain & ~generic & c("slow")),
        lat(1, generic & c("slow"), cap=True),
        err(2, plain & ~generic & failing),
        err(2, generic & failing, cap=True),
        E.missing_telemetry(
            9, node, c("spans"), c("has_latency_baseline"), unknown | (plain & ~c("slow") & ~failing)
        ),
    ]
    return E.explode_items(facts, "database", items)


def dependency_facts(
    candidates: DataFrame, window: DataFrame, edges: DataFrame, inc: Incidents
) -> DataFrame:
    """Calls to each external dependency and how many callers they fail for."""
    codes = X.caller_calls(window)
    top = (
        codes.where("http_code BETWEEN 500 AND 599")
        .groupBy(*KEY)
        .agg(F.max(F.struct("calls", (-F.col("first")).alias("early"), "http_code")).alias("b"))
        .select(*KEY, F.col("b.http_code").alias("top_code"), F.col("b.calls").alias("top_calls"))
    )
    totals = codes.groupBy(*KEY).agg(
        F.sum("calls").alias("calls"), F.coalesce(F.bool_or(F.col("http_code") == 429), F.lit(False)).alias("has_429")
    )
    calls = window.where("peer IS NOT NULL")
    timeouts = calls.groupBy("incident_id", F.col("peer").alias("node_id")).agg(
        F.bool_or(contains_any(F.col("error_type"), TIMEOUT_WORDS)).alias("has_timeout")
    )
    affected = (
        calls.where("is_error")
        .select("incident_id", F.col("peer").alias("node_id"), F.col("node_id").alias("caller"))
        .distinct()
        .groupBy(*KEY)
        .agg(F.count(F.lit(1)).alias("affected"))
    )
    callers = edges.groupBy(*per_incident(edges), F.col("target_id").alias("node_id")).agg(F.count(F.lit(1)).alias("callers"))
    zero, no = F.lit(0), F.lit(False)
    return (
        candidates.select(*KEY).distinct()
        .join(totals, KEY, "left")
        .join(top, KEY, "left")
        .join(timeouts, KEY, "left")
        .join(affected, KEY, "left")
        .join(callers, [*per_incident(callers), "node_id"], "left")
        .select(
            *KEY,
            F.coalesce("calls", zero).alias("calls"),
            "top_code",
            "top_calls",
            F.coalesce("has_429", no).alias("has_429"),
            F.coalesce("has_timeout", no).alias("has_timeout"),
            F.coalesce("affected", zero).alias("affected"),
            F.coalesce("callers", zero).alias("callers"),
        )
        .withColumn(
            "failure_type",
            F.when(F.col("top_code").isNotNull(), "upstream_outage")
            .when(F.col("has_429"), "rate_limited")
            .when(F.col("has_timeout"), "timeout")
            .otherwise("external_dep_failure"),
        )
    )


def dependency_evidence(facts: DataFrame, inc: Incidents) -> DataFrame:
    c = F.col
    minutes = inc.params.http_minutes
    return E.explode_items(
        facts,
        "dependency",
        [
            E.http_errors(inc.params, 1, c("node_id"), c("top_code"), c("top_calls"), c("calls"), minutes, c("top_code").isNotNull()),
            E.caller_scope(2, c("node_id"), c("affected"), c("callers")),
            E.missing_telemetry(3, c("node_id"), F.lit(0), F.lit(False), c("calls") == 0),
        ],
    )


def database_findings(facts: DataFrame, evidence: DataFrame, inc: Incidents) -> DataFrame:
    """Domain, failure type and priority of database candidates."""
    p = inc.params
    counts = E.strength_counts(evidence, KEY)
    return facts.select(*KEY, "failure_type").join(counts, KEY, "left").select(
        *KEY,
        F.lit("database").alias("domain"),
        "failure_type",
        F.when(F.col("strong") > 0, p.database_strong).when(F.col("moderate") > 0, p.database_moderate).otherwise(0.0).alias("priority_score"),
    )


def dependency_findings(facts: DataFrame, inc: Incidents) -> DataFrame:
    p = inc.params
    failing = F.col("top_code").isNotNull() | F.col("has_429") | F.col("has_timeout")
    everyone = (F.col("callers") > 0) & (F.col("affected") == F.col("callers"))
    return facts.select(
        *KEY,
        F.lit("dependency").alias("domain"),
        "failure_type",
        F.when(failing & everyone, p.dependency_everyone).when(failing, p.dependency_some).otherwise(0.0).alias("priority_score"),
    )


def queue_findings(candidates: DataFrame) -> DataFrame:
    return candidates.select(
        *KEY, F.lit("queue").alias("domain"), F.lit("queue_error").alias("failure_type"), F.lit(0.0).alias("priority_score")
    )

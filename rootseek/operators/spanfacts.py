"""Aggregates over the spans of an incident window that evidence cites.

"Most frequent, first seen on ties" is always: count per value with its first
position, then one maximum per node. Both steps pre-aggregate before the
shuffle, by hash; nothing sorts or lists a node's spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.folds import first_of

KEY = ["incident_id", "node_id"]


def _best(score: Column, first: list[Column], *payload: Column) -> Column:
    """Largest score, then earliest; a struct so that the maximum is one column."""
    early = [(-c).alias(f"early_{i}") for i, c in enumerate(first)]
    return F.max(F.struct(score.alias("score"), *early, *payload))


def exception_events(window: DataFrame) -> DataFrame:
    """Typed exceptions of the window's spans in span and event order."""
    return (
        window.where("exceptions IS NOT NULL")
        .select(*KEY, "is_error", "ord", F.posexplode("exceptions").alias("pos", "x"))
        .where("x.type IS NOT NULL")
        .select(
            *KEY, "is_error", "ord", "pos",
            F.col("x.type").alias("exception_type"),
            F.coalesce("x.message", F.lit("")).alias("exception_message"),
        )
    )


def exception_counts(events: DataFrame) -> DataFrame:
    """Exceptions of each type with the (span, event) order of the first one."""
    key = [*KEY, "exception_type"]
    counts = events.groupBy(*key).agg(F.count(F.lit(1)).alias("occurrences"))
    return counts.join(first_of(events, key, F.col("ord"), F.struct("ord", "pos"), "first_place"), key)


def first_exception(events: DataFrame) -> DataFrame:
    """First exception of the first error span that has one."""
    place = F.struct("ord", "pos", "exception_type", "exception_message")
    return first_of(events.where("is_error"), KEY, F.col("ord"), place, "f").select(*KEY, "f.exception_type", "f.exception_message")


def modal_exception(counts: DataFrame, keep: Column | None = None) -> DataFrame:
    chosen = counts if keep is None else counts.where(keep)
    return (
        chosen.groupBy(*KEY)
        .agg(_best(F.col("occurrences"), [F.col("first_place.ord"), F.col("first_place.pos")], F.col("exception_type")).alias("b"))
        .select(*KEY, "b.exception_type", F.col("b.score").alias("occurrences"))
    )


def worst_operations(window: DataFrame) -> DataFrame:
    """Operation with the highest error rate among those with an error."""
    per_op = (
        window.groupBy(*KEY, "operation_name")
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if("is_error").alias("errors"),
            F.min(F.when(F.col("is_error"), F.col("ord"))).alias("first_error"),
        )
        .where("errors > 0")
    )
    return (
        per_op.groupBy(*KEY)
        .agg(
            _best(
                F.col("errors") / F.col("total"), [F.col("first_error")], F.col("operation_name"), F.col("errors"), F.col("total")
            ).alias("b")
        )
        .select(*KEY, F.col("b.operation_name").alias("operation"), F.col("b.score").alias("rate"), "b.errors", "b.total")
    )


def slowest_statements(window: DataFrame) -> DataFrame:
    """Statement with the highest mean duration among database spans."""
    return (
        window.where("is_db AND statement IS NOT NULL")
        .groupBy(*KEY, "statement")
        .agg(F.avg("duration_ms").alias("mean_ms"), F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
        .groupBy(*KEY)
        .agg(_best(F.col("mean_ms"), [F.col("first")], F.col("statement"), F.col("n")).alias("b"))
        .select(*KEY, F.col("b.statement").alias("slow_statement"), F.col("b.score").alias("slow_mean_ms"), F.col("b.n").alias("slow_count"))
    )


def failing_statements(window: DataFrame) -> DataFrame:
    """Statement seen on most error spans."""
    return (
        window.where("is_error AND statement IS NOT NULL")
        .groupBy(*KEY, "statement")
        .agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
        .groupBy(*KEY)
        .agg(_best(F.col("n"), [F.col("first")], F.col("statement")).alias("b"))
        .select(*KEY, F.col("b.statement").alias("error_statement"), F.col("b.score").alias("error_statement_count"))
    )


def error_codes(window: DataFrame) -> DataFrame:
    """Most frequent HTTP status among error spans."""
    return (
        window.where("is_error AND http_code IS NOT NULL")
        .groupBy(*KEY, "http_code")
        .agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
        .groupBy(*KEY)
        .agg(_best(F.col("n"), [F.col("first")], F.col("http_code")).alias("b"))
        .select(*KEY, F.col("b.http_code").alias("http_code"))
    )


def error_patterns(window: DataFrame, nodes: DataFrame) -> DataFrame:
    """Short description of how each node fails."""
    events = exception_events(window).where("is_error")
    return (
        nodes.select(*KEY)
        .join(modal_exception(exception_counts(events)), KEY, "left")
        .join(error_codes(window), KEY, "left")
        .select(
            *KEY,
            F.coalesce(
                "exception_type",
                F.concat(F.lit("HTTP "), F.col("http_code").cast("string"), F.lit(" errors")),
                F.lit("elevated error rate"),
            ).alias("error_pattern"),
        )
    )


def caller_calls(window: DataFrame) -> DataFrame:
    """Status codes of the calls that name a peer."""
    return (
        window.where("peer IS NOT NULL")
        .groupBy("incident_id", F.col("peer").alias("node_id"), "http_code")
        .agg(F.count(F.lit(1)).alias("calls"), F.min("ord").alias("first"))
    )

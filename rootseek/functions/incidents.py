"""Joining telemetry to incident windows without cross joins.

Every window is turned into equi-join keys (time buckets) plus an exact
residual predicate, so that Spark can hash, sort-merge or broadcast it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..params import DEFAULTS, Params


DAY = 86400
#: Literal bounds in one filter.
MOST_STRETCHES = 100


@dataclass(frozen=True)
class Incidents:
    """Incidents with the few facts the driver may know: count and time span."""

    df: DataFrame
    count: int
    first_us: int | None
    last_us: int | None
    most_wanted: int  # largest top_k
    params: Params = DEFAULTS
    days: tuple[int, ...] = ()  # days since 1970 on which incidents start

    @classmethod
    def of(cls, df: DataFrame, params: Params = DEFAULTS) -> "Incidents":
        cols = df.select(
            "incident_id",
            "incident_start",
            (F.col("top_k") if "top_k" in df.columns else F.lit(params.top_k)).cast("int").alias("top_k"),
        )
        n, lo, hi, k, days = cols.agg(
            F.count(F.lit(1)),
            F.min(F.unix_micros("incident_start")),
            F.max(F.unix_micros("incident_start")),
            F.max("top_k"),
            F.collect_set(bucket(F.col("incident_start"), DAY)),  # bounded by the calendar
        ).first()
        return cls(cols, n, lo, hi, k or params.top_k, params, tuple(sorted(days)))

    def stretches(self, before_seconds: int, after_seconds: int) -> list[tuple[int, int]]:
        """Stretches of whole days (first, last) that hold all windows, at most ``MOST_STRETCHES``."""
        gap = 1
        while True:
            out: list[tuple[int, int]] = []
            for day in self.days:
                lo, hi = (day * DAY - before_seconds) // DAY, ((day + 1) * DAY + after_seconds) // DAY
                if out and lo <= out[-1][1] + gap:
                    out[-1] = (out[-1][0], max(hi, out[-1][1]))
                else:
                    out.append((lo, hi))
            if len(out) <= MOST_STRETCHES:
                return out
            gap *= 2

    def prune(self, events: DataFrame, ts: str, before_seconds: int, after_seconds: int) -> DataFrame:
        """Events on the days near incidents, as literals that prune day folders, files and row groups."""
        if not self.days:
            return events.where(F.lit(False))
        lo, hi = self.first_us - before_seconds * 1_000_000, self.last_us + after_seconds * 1_000_000
        near, day = F.lit(False), F.lit(False)
        for first, last in self.stretches(before_seconds, after_seconds):
            a, b = max(lo, first * DAY * 1_000_000), min(hi, ((last + 1) * DAY) * 1_000_000 - 1)
            near = near | F.col(ts).between(F.timestamp_micros(F.lit(a)), F.timestamp_micros(F.lit(b)))
            day = day | F.col("day").between(F.date_from_unix_date(F.lit(first)), F.date_from_unix_date(F.lit(last)))
        return events.where(near & day) if "day" in events.columns else events.where(near)

    def windows(self) -> DataFrame:
        end = F.col("incident_start") + F.make_dt_interval(secs=F.lit(self.params.window_seconds))
        return self.df.withColumn("incident_end", end)

    def small(self, keyed: DataFrame, rows_per_incident: int) -> DataFrame:
        """Broadcast the incident side only when its row bound is known to fit."""
        if self.count * rows_per_incident <= self.params.broadcast_rows:
            return F.broadcast(keyed)
        return keyed


def per_incident(table: DataFrame) -> list[str]:
    """``incident_id`` if a graph table has one graph per incident, nothing if all share one."""
    return [c for c in ("incident_id",) if c in table.columns]


def bucket(ts: Column, seconds: int) -> Column:
    return F.floor(F.unix_seconds(ts) / F.lit(seconds)).cast("bigint")


def in_window(
    events: DataFrame,
    ts: str,
    inc: Incidents,
    before_seconds: int = 0,
    after_seconds: int = 0,
    closed: bool = True,
) -> DataFrame:
    """Events inside ``[start - before, start + after]`` of each incident.

    ``closed=False`` leaves the upper end out. Adds ``incident_id`` and
    ``incident_start``. Literal bounds around the incidents are filtered first
    so that the scan prunes day folders, files and row groups.
    """
    if not inc.days:
        none = events.where(F.lit(False))
        return none.withColumn("incident_id", F.lit("")).withColumn("incident_start", F.lit(None).cast("timestamp"))
    lo = F.col("incident_start") - F.make_dt_interval(secs=F.lit(before_seconds))
    hi = F.col("incident_start") + F.make_dt_interval(secs=F.lit(after_seconds))
    width = max(before_seconds + after_seconds, 60)
    keyed = inc.df.select(
        "incident_id",
        "incident_start",
        F.explode(F.sequence(bucket(lo, width), bucket(hi, width))).alias("_bucket"),
    )
    inside = (F.col(ts) >= lo) & ((F.col(ts) <= hi) if closed else (F.col(ts) < hi))
    return (
        inc.prune(events, ts, before_seconds, after_seconds).withColumn("_bucket", bucket(F.col(ts), width))
        .join(inc.small(keyed, 2), "_bucket")
        .where(inside)
        .drop("_bucket")
    )


def edge_ranks(inc: Incidents) -> DataFrame:
    """(edge, rank) of all window edges: start, end, and the instant after the end.

    At most three rows per incident, so numbering them in one task is bounded
    by the incidents, not by the telemetry.
    """
    edges = _window_edges(inc).select(F.explode(F.array("incident_start", "incident_end", "after_end")).alias("edge")).distinct()
    return edges.withColumn("rank", F.row_number().over(W.orderBy("edge")))


def _window_edges(inc: Incidents) -> DataFrame:
    return inc.windows().withColumn("after_end", F.col("incident_end") + F.expr("INTERVAL '0.000001' SECOND"))


def ranked_windows(inc: Incidents, ranks: DataFrame) -> DataFrame:
    """Incidents with the ranks of their three edges."""
    out = _window_edges(inc)
    for edge, name in (("incident_start", "start_rank"), ("incident_end", "end_rank"), ("after_end", "after_rank")):
        out = out.join(ranks.select(F.col("edge").alias(edge), F.col("rank").alias(name)), edge)
    return out.select("incident_id", "incident_start", "start_rank", "end_rank", "after_rank")


def with_segment(rows: DataFrame, ts: str, inc: Incidents, ranks: DataFrame, seconds: int = 86400) -> DataFrame:
    """Add ``seg``, the number of window edges at or before a row.

    Edges are grouped by day, days without edges carry the number before them,
    so a row meets one small list.
    """
    days = ranks.groupBy(bucket(F.col("edge"), seconds).alias("_day")).agg(
        F.sort_array(F.collect_list("edge")).alias("_edges"), (F.min("rank") - 1).alias("_before")
    )
    first, last, total = days.agg(F.min("_day"), F.max("_day"), F.coalesce(F.sum(F.size("_edges")), F.lit(0))).first()
    if first is None:
        return rows.withColumn("seg", F.lit(0).cast("bigint"))
    fits = last - first + 1 + 3 * inc.count <= inc.params.broadcast_rows
    following = F.coalesce(F.lead("_day").over(W.orderBy("_day")) - 1, F.col("_day"))
    filled = days.withColumn("_to", following).withColumn("_at", F.explode(F.sequence("_day", "_to")))
    own = F.col("_at") == F.col("_day")
    filled = filled.select(
        F.col("_at").alias("_day"),
        F.when(own, F.col("_edges")).otherwise(F.array().cast("array<timestamp>")).alias("_edges"),
        (F.col("_before") + F.when(own, 0).otherwise(F.size("_edges"))).alias("_before"),
    )
    day = F.col("_day")
    return (
        rows.withColumn("_day", bucket(F.col(ts), seconds))
        .join(F.broadcast(filled) if fits else filled, "_day", "left")
        .withColumn(
            "seg",
            F.when(day < first, 0).when(day > last, total)
            .otherwise(F.col("_before") + F.size(F.filter("_edges", lambda e: e <= F.col(ts)))).cast("bigint"),
        )
        .drop("_day", "_edges", "_before")
    )


def bucket_cuts(inc: Incidents, seconds: int) -> tuple[DataFrame, DataFrame]:
    """(edge, rank) of the buckets in which incidents start, and the incidents with ``start_rank``, ``cut`` (the bucket)."""
    start = F.timestamp_seconds(bucket(F.col("incident_start"), seconds) * seconds)
    cut = inc.df.select("incident_id", "incident_start", bucket(F.col("incident_start"), seconds).alias("cut"), start.alias("edge"))
    ranks = cut.select("edge").distinct().withColumn("rank", F.row_number().over(W.orderBy("edge")))
    return ranks, cut.join(ranks, "edge").select("incident_id", "incident_start", "cut", F.col("rank").alias("start_rank"))


def as_of_start(stretches: DataFrame, windows: DataFrame, key: tuple[str, ...], last: int) -> DataFrame:
    """Each stretch row with the incidents that see it as the last one before their start.

    ``stretches`` has one row per key and non-empty stretch ``seg``, ``windows``
    the incidents' ``start_rank``; ``last`` bounds the ranks. The result has one
    row per incident and key, however long the past is.
    """
    in_order = W.partitionBy(*key).orderBy("seg")
    until = F.greatest(F.coalesce(F.lead("seg").over(in_order) - 1, F.lit(last).cast("bigint")), F.col("seg"))
    starts = windows.select("incident_id", "incident_start", (F.col("start_rank") - 1).cast("bigint").alias("seg"))
    return stretches.withColumn("_until", until).withColumn("seg", F.explode(F.sequence("seg", "_until"))).drop("_until").join(starts, "seg")

"""Metric series: baselines, deviations, observed impact, coupling.

Samples are folded once into cells (node, metric, time chunk) that never
straddle a window edge of any incident. All per-incident figures are then
sums over cells, so the raw samples are read and shuffled once however many
incidents there are, and a hot series shrinks before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.incidents import Incidents, as_of_start, bucket, bucket_cuts, edge_ranks, per_incident, ranked_windows, with_segment
from ..params import ANOMALY_METRICS

SERIES = ("node_id", "metric_type")


def _cuts(inc: Incidents, chunk_seconds: int) -> DataFrame:
    """Window edges per time chunk, sorted. At most three edges per incident."""
    after_end = F.col("incident_end") + F.expr("INTERVAL '0.000001' SECOND")
    edges = inc.windows().select(
        F.explode(F.array("incident_start", "incident_end", after_end)).alias("edge")
    )
    keyed = (
        edges.groupBy(bucket(F.col("edge"), chunk_seconds).alias("chunk"))
        .agg(F.sort_array(F.collect_set("edge")).alias("edges"))
    )
    return inc.small(keyed, 3)


def with_cells(samples: DataFrame, inc: Incidents, chunk_seconds: int) -> DataFrame:
    """Add ``chunk`` and ``part``: the cell of each sample."""
    return (
        samples.withColumn("chunk", bucket(F.col("timestamp"), chunk_seconds))
        .join(_cuts(inc, chunk_seconds), "chunk", "left")
        .withColumn(
            "part",
            F.coalesce(F.size(F.filter("edges", lambda e: e <= F.col("timestamp"))), F.lit(0)),
        )
        .drop("edges")
    )


def metric_cells(metrics: DataFrame, inc: Incidents, chunk_seconds: int | None = None) -> DataFrame:
    """Per-cell count, mean, variance, extremes and time span."""
    chunk_seconds = chunk_seconds or inc.params.chunk_seconds
    cells = with_cells(
        metrics.select(*SERIES, "value", "timestamp", "ord"), inc, chunk_seconds
    ).groupBy(*SERIES, "chunk", "part")
    return cells.agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.var_pop("value").alias("var"),
        F.min("value").alias("lo"),
        F.max("value").alias("hi"),
        F.min("timestamp").alias("first_ts"),
        F.max("timestamp").alias("last_ts"),
        F.min("ord").alias("first_ord"),
    )


def series_stats(cells: DataFrame, inc: Incidents) -> DataFrame:
    """One row per incident and series: baseline, current and observed figures.

    Baseline columns cover samples before the start (population deviation,
    floored), ``cur_*`` the half-open and ``obs_*`` the closed incident window.
    Variances are merged around the level the series starts at, which keeps
    their digits when the values are large or jump during an incident.
    """
    p = inc.params
    ranks = edge_ranks(inc)
    windows = ranked_windows(inc, ranks)
    pivots = cells.groupBy(*SERIES).agg(F.min_by("mean", F.struct("chunk", "part")).alias("pivot"))
    shift = F.col("mean") - F.col("pivot")
    # Between two edges all incidents see the same samples: one row per series and
    # stretch, and from here on nothing grows with the past.
    stretches = (
        with_segment(cells, "first_ts", inc, ranks)
        .join(pivots, list(SERIES))
        .groupBy(*SERIES, "seg")
        .agg(
            F.max("pivot").alias("pivot"),
            F.sum("n").alias("n"),
            F.sum(F.col("n") * shift).alias("s1"),
            F.sum(F.col("n") * (F.col("var") + shift * shift)).alias("s2"),
            F.min("lo").alias("lo"),
            F.max("hi").alias("hi"),
            F.sum(F.col("n") * F.col("mean")).alias("total"),
            F.min("first_ord").alias("first_ord"),
        )
    )
    key = ["incident_id", "incident_start", *SERIES]
    in_order = W.partitionBy(*SERIES).orderBy("seg")
    running = stretches.select(
        *SERIES, "seg", "pivot",
        F.sum("n").over(in_order).alias("sample_count"), F.sum("s1").over(in_order).alias("s1"), F.sum("s2").over(in_order).alias("s2"),
        F.min("lo").over(in_order).alias("min_value"), F.max("hi").over(in_order).alias("max_value"),
    )
    before = as_of_start(running, windows, SERIES, 3 * inc.count).select(
        *key, "pivot", "sample_count", "s1", "s2", "min_value", "max_value"
    )
    inside = windows.select(
        "incident_id", "incident_start", F.explode(F.sequence("start_rank", F.col("after_rank") - 1)).alias("seg"), "end_rank"
    ).select("incident_id", "incident_start", F.col("seg").cast("bigint").alias("seg"), (F.col("seg") < F.col("end_rank")).alias("open"))
    cur = F.col("open")
    during = (
        stretches.join(inside, "seg")
        .groupBy(*key)
        .agg(
            F.sum(F.when(cur, F.col("n"))).alias("cur_n"),
            F.sum(F.when(cur, F.col("total"))).alias("cur_sum"),
            F.min(F.when(cur, F.col("first_ord"))).alias("cur_ord"),
            F.sum("n").alias("obs_n"),
            F.sum("total").alias("obs_sum"),
        )
    )
    sums = before.join(during, key, "full")
    d1 = F.try_divide("s1", "sample_count")
    var = F.greatest(F.try_divide("s2", "sample_count") - d1 * d1, F.lit(0.0))
    return sums.select(
        "incident_id",
        "incident_start",
        *SERIES,
        F.coalesce("sample_count", F.lit(0)).alias("sample_count"),
        (F.col("pivot") + d1).alias("mean"),
        F.greatest(F.sqrt(var), F.lit(p.std_floor)).alias("std"),
        "min_value",
        "max_value",
        F.coalesce("cur_n", F.lit(0)).alias("cur_n"),
        F.try_divide("cur_sum", "cur_n").alias("cur_mean"),
        "cur_ord",
        F.coalesce("obs_n", F.lit(0)).alias("obs_n"),
        F.try_divide("obs_sum", "obs_n").alias("obs_mean"),
    )


def baselines(stats: DataFrame) -> DataFrame:
    return stats.where("sample_count > 0").select(
        "incident_id", *SERIES, "mean", "std", "sample_count", "min_value", "max_value"
    )


#: Stretches that one row folds in a scan.
SCAN_BLOCK = 64


def affine_scan(maps: DataFrame, key: tuple[str, ...], keep: float, last: int) -> DataFrame:
    """(key, seg, upto, level): the maps ``e -> keep ** n * e + offset`` of a key composed in order of ``seg``.

    Composition is associative, so stretches are composed in blocks of
    ``SCAN_BLOCK``, the blocks' totals likewise, and so on: no list is longer
    than a block, whatever the number of stretches (at most ``last``).
    """
    def after(level: Column, n: Column, offset: Column) -> Column:
        return level * F.pow(F.lit(keep), n) + offset

    def step(done: Column, x: Column) -> Column:
        before = F.element_at(done, -1)
        return F.concat(done, F.array(F.struct(
            x["seg"].alias("seg"), (before["upto"] + x["n"]).alias("upto"), after(before["level"], x["n"], x["offset"]).alias("level"))))

    empty = F.array(F.struct(F.lit(-1).cast("bigint").alias("seg"), F.lit(0).cast("bigint").alias("upto"), F.lit(0.0).alias("level")))
    block = F.floor(F.col("seg") / SCAN_BLOCK).cast("bigint")
    inside = (
        maps.groupBy(*key, block.alias("block"))
        .agg(F.sort_array(F.collect_list(F.struct("seg", F.col("n").cast("bigint").alias("n"), F.col("offset").cast("double").alias("offset")))).alias("maps"))
        .withColumn("done", F.slice(F.aggregate("maps", empty, step), 2, SCAN_BLOCK))
    )
    rows = inside.select(*key, "block", F.explode("done").alias("m")).select(*key, "block", "m.seg", "m.upto", "m.level")
    if last < SCAN_BLOCK:
        return rows.drop("block")
    ends = inside.select(*key, F.col("block").alias("seg"), F.element_at("done", -1)["upto"].alias("n"), F.element_at("done", -1)["level"].alias("offset"))
    totals = affine_scan(ends, key, keep, last // SCAN_BLOCK)
    in_order = W.partitionBy(*key).orderBy("seg")
    before = totals.select(
        *key, F.col("seg").alias("block"), F.lag("upto", 1, 0).over(in_order).alias("_n"), F.lag("level", 1, 0.0).over(in_order).alias("_level")
    )
    return rows.join(before, [*key, "block"]).select(
        *key, "seg", (F.col("_n") + F.col("upto")).alias("upto"), after(F.col("_level"), F.col("upto"), F.col("level")).alias("level")
    )


def ema(metrics: DataFrame, inc: Incidents) -> DataFrame:
    """Exponential moving average of the samples before each incident.

    The recursion is a chain of affine maps. Weights are taken inside a cell
    first, cells are folded between two window edges, and the maps of these
    stretches are composed by a scan, so no task sorts a whole series and
    nothing pairs the past with incidents: one row per incident and series
    reads the average at its start.
    """
    p = inc.params
    keep = 1.0 - p.ema_alpha
    order = W.partitionBy(*SERIES, "chunk", "part").orderBy(F.desc("timestamp"), F.desc("ord"))
    in_cell = (
        with_cells(metrics.select(*SERIES, "value", "timestamp", "ord"), inc, p.chunk_seconds)
        .withColumn("age", F.row_number().over(order) - 1)
        .groupBy(*SERIES, "chunk", "part")
        .agg(
            F.count("value").alias("n"),
            F.sum(F.col("value") * F.lit(p.ema_alpha) * F.pow(F.lit(keep), F.col("age"))).alias("weighted"),
            F.max_by("value", "age").alias("oldest"),
            F.min("timestamp").alias("first_ts"),
        )
    )
    ranks = edge_ranks(inc)
    later = W.partitionBy(*SERIES, "seg").orderBy(F.desc("chunk"), F.desc("part")).rowsBetween(W.unboundedPreceding, -1)
    stretches = (
        with_segment(in_cell, "first_ts", inc, ranks)
        .withColumn("later", F.coalesce(F.sum("n").over(later), F.lit(0)))
        .groupBy(*SERIES, "seg")
        .agg(
            F.sum("n").alias("n"),
            F.sum(F.col("weighted") * F.pow(F.lit(keep), F.col("later"))).alias("offset"),
            F.min_by("oldest", F.struct("chunk", "part")).alias("oldest"),
        )
    )
    seeds = stretches.groupBy(*SERIES).agg(F.min_by("oldest", "seg").alias("seed"))
    levels = affine_scan(stretches, SERIES, keep, 3 * inc.count).join(seeds, list(SERIES))
    at_start = as_of_start(levels, ranked_windows(inc, ranks), SERIES, 3 * inc.count)
    return at_start.select(
        "incident_id", *SERIES, (F.col("level") + F.col("seed") * F.pow(F.lit(keep), F.col("upto"))).alias("ema"), F.col("upto").alias("sample_count")
    )


def current_values(stats: DataFrame) -> DataFrame:
    return stats.where("cur_n > 0").select(
        "incident_id", *SERIES, F.col("cur_mean").alias("current_value"), "cur_n", "cur_ord"
    )


def deviations(stats: DataFrame, inc: Incidents) -> DataFrame:
    """z-scores of the current means against reliable baselines."""
    p = inc.params
    z = (F.col("cur_mean") - F.col("mean")) / F.col("std")
    return (
        stats.where((F.col("cur_n") > 0) & (F.col("sample_count") >= p.min_samples))
        .select(
            "incident_id",
            *SERIES,
            F.col("cur_mean").alias("current_value"),
            F.col("mean").alias("baseline_mean"),
            F.col("std").alias("baseline_std"),
            F.least(F.lit(p.z_cap), F.greatest(F.lit(p.z_floor), z)).alias("z_score"),
            "cur_ord",
        )
        .withColumn("is_anomalous", F.col("z_score") >= p.anomaly_z)
    )


def anomalies(stats: DataFrame, inc: Incidents) -> DataFrame:
    """Anomalous series; order them by z-score descending, first seen first."""
    return deviations(stats, inc).where("is_anomalous").drop("is_anomalous")


def baseline_summary(stats: DataFrame, metric_types: list[str]) -> DataFrame:
    """Baseline means, one column per metric type."""
    return (
        baselines(stats)
        .groupBy("incident_id", "node_id")
        .pivot("metric_type", metric_types)
        .agg(F.max("mean"))
    )


def default_start(metrics: DataFrame, minutes: int = 5) -> DataFrame:
    """Incident start when none is given: five minutes before the last sample."""
    last = F.coalesce(F.max("timestamp"), F.current_timestamp())
    return metrics.agg((last - F.make_dt_interval(mins=F.lit(minutes))).alias("incident_start"))


def observed_impact(stats: DataFrame, inc: Incidents) -> DataFrame:
    """Error rate and latency multiplier per node seen in the closed window."""
    p = inc.params
    err = F.col("metric_type") == "error_rate"
    lat = F.col("metric_type") == "latency_p99"
    base = F.col("baseline_latency")
    return (
        stats.where(F.col("metric_type").isin(*ANOMALY_METRICS))
        .groupBy("incident_id", "node_id")
        .agg(
            F.sum("obs_n").alias("seen"),
            F.max(F.when(err & (F.col("obs_n") > 0), F.col("obs_mean"))).alias("err"),
            F.max(F.when(lat & (F.col("obs_n") > 0), F.col("obs_mean"))).alias("lat"),
            F.max(F.when(err & (F.col("sample_count") > 0), F.col("mean"))).alias("base_err"),
            F.max(F.when(lat & (F.col("sample_count") > 0), F.col("mean"))).alias("baseline_latency"),
        )
        .where("seen > 0")
        .select(
            "incident_id",
            "node_id",
            F.coalesce("err", F.lit(0.0)).alias("error_rate"),
            F.when(base > 0, F.coalesce("lat", base) / base).otherwise(F.lit(1.0)).alias("latency_multiplier"),
            F.coalesce("base_err", F.lit(0.0)).alias("baseline_error_rate"),
            "baseline_latency",
        )
        .withColumn(
            "is_anomalous",
            (
                (F.col("error_rate") > F.col("baseline_error_rate") * p.error_multiplier)
                & (F.col("error_rate") > p.min_error_pct)
            )
            | (base.isNotNull() & (F.col("latency_multiplier") > p.latency_multiplier)),
        )
    )


def unmeasured_weight(inc: Incidents) -> float:
    """Weight of an edge without any pre-incident samples."""
    p = inc.params
    volume = min(1.0, p.volume_default / p.volume_norm)
    return (p.weight_error + p.weight_latency) * p.coupling_fallback + p.weight_volume * volume


def _coupling(cells: DataFrame, links: DataFrame, inc: Incidents) -> DataFrame:
    """Correlation of both ends of each edge over bucket means before each incident.

    Buckets before an incident's own are whole and the same for all: their two-variable
    moments are running sums per edge over the stretches between the buckets in which
    incidents start. Only the bucket that a start cuts is taken per incident.
    Sums are about the first mean of a series, which keeps their digits.
    """
    p = inc.params
    mean = F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    whole = cells.groupBy(*SERIES, "chunk").agg(mean.alias("v"))
    pivots = whole.groupBy(*SERIES).agg(F.min_by("v", "chunk").alias("pivot"))
    whole = whole.join(pivots, list(SERIES)).select(*SERIES, "chunk", (F.col("v") - F.col("pivot")).alias("v"))
    ranks, cuts = bucket_cuts(inc, p.bucket_seconds)
    own = (
        cells.join(inc.small(cuts.select("incident_id", "incident_start", F.col("cut").alias("chunk")), 1), "chunk")
        .where("last_ts < incident_start")
        .groupBy("incident_id", *SERIES)
        .agg(mean.alias("v"))
        .join(pivots, list(SERIES))
        .select("incident_id", *SERIES, (F.col("v") - F.col("pivot")).alias("v"))
    )
    pairs = links.select("source_id", "target_id").distinct()

    def meet(values: DataFrame, by: list[str]) -> DataFrame:
        x = values.select(*by, "metric_type", F.col("node_id").alias("source_id"), F.col("v").alias("x"))
        y = values.select(*by, "metric_type", F.col("node_id").alias("target_id"), F.col("v").alias("y"))
        return pairs.join(x, "source_id").join(y, [*by, "target_id", "metric_type"])

    edge = ("source_id", "target_id", "metric_type")
    x, y = F.col("x"), F.col("y")
    moments = {"buckets": F.lit(1), "sx": x, "sy": y, "sxx": x * x, "syy": y * y, "sxy": x * y}
    at = F.timestamp_seconds(F.col("chunk") * p.bucket_seconds)
    stretches = (
        with_segment(meet(whole, ["chunk"]).withColumn("at", at), "at", inc, ranks)
        .groupBy(*edge, "seg")
        .agg(*[F.sum(c).alias(n) for n, c in moments.items()])
    )
    in_order = W.partitionBy(*edge).orderBy("seg")
    running = stretches.select(*edge, "seg", *[F.sum(n).over(in_order).alias(n) for n in moments])
    before = as_of_start(running, cuts, edge, inc.count).select("incident_id", *edge, *moments)
    sums = (
        before.unionByName(meet(own, ["incident_id"]).select("incident_id", *edge, *[c.alias(n) for n, c in moments.items()]))
        .groupBy("incident_id", *edge)
        .agg(*[F.sum(n).alias(n) for n in moments])
    )
    n = F.col("buckets")

    def spread(square: str, total: str) -> Column:
        return F.greatest(F.col(square) / n - (F.col(total) / n) * (F.col(total) / n), F.lit(0.0))

    cov = F.col("sxy") / n - (F.col("sx") / n) * (F.col("sy") / n)
    product = F.sqrt(spread("sxx", "sx")) * F.sqrt(spread("syy", "sy"))
    r = F.when(product > 0, cov / product)
    return sums.groupBy("incident_id", "source_id", "target_id").agg(
        *[
            F.max(F.when((F.col("metric_type") == m) & (n >= p.coupling_min_points), r)).alias(c)
            for m, c in (("error_rate", "r_err"), ("latency_p99", "r_lat"))
        ]
    )


def edge_weights(metrics: DataFrame, edges: DataFrame, stats: DataFrame, inc: Incidents) -> DataFrame:
    """Propagation weight per incident and edge, from pre-incident samples only.

    ``edges`` may have an ``incident_id``: each incident then has its own. Edges
    whose source has no baseline are left out: they weigh ``unmeasured_weight``.
    """
    p = inc.params
    own = per_incident(edges)
    links = edges.select(*own, "source_id", "target_id", F.col("ord").alias("edge_ord"))
    ends = links.select(F.col("source_id").alias("node_id")).union(
        links.select(F.col("target_id").alias("node_id"))
    ).distinct()
    cells = metric_cells(
        metrics.where(F.col("metric_type").isin(*ANOMALY_METRICS)).join(ends, "node_id", "left_semi"),
        inc,
        p.bucket_seconds,
    )
    coupling = _coupling(cells, links, inc)
    base = baselines(stats).groupBy("incident_id", "node_id").agg(
        F.max(F.when(F.col("metric_type") == "error_rate", F.col("sample_count"))).alias("n_err"),
        F.max(F.when(F.col("metric_type") == "latency_p99", F.col("sample_count"))).alias("n_lat"),
        F.max(F.when(F.col("metric_type") == "request_rate", F.col("mean"))).alias("volume"),
    )
    src = base.select("incident_id", F.col("node_id").alias("source_id"), F.col("n_err").alias("xe"), F.col("n_lat").alias("xl"), "volume")
    tgt = base.select("incident_id", F.col("node_id").alias("target_id"), F.col("n_err").alias("ye"), F.col("n_lat").alias("yl"))

    def coupled(r: str, nx: str, ny: str) -> Column:
        enough = (F.col(nx) >= p.coupling_min_points) & (F.col(ny) >= p.coupling_min_points)
        clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(r)))
        return F.when(enough & F.col(r).isNotNull(), clipped).otherwise(F.lit(p.coupling_fallback))

    return (
        links.join(src, [*own, "source_id"])
        .join(tgt, ["incident_id", "target_id"], "left")
        .join(coupling, ["incident_id", "source_id", "target_id"], "left")
        .select(
            "incident_id",
            "source_id",
            "target_id",
            "edge_ord",
            coupled("r_err", "xe", "ye").alias("error_coupling"),
            coupled("r_lat", "xl", "yl").alias("latency_coupling"),
            F.coalesce("volume", F.lit(p.volume_default)).alias("call_volume"),
        )
        .withColumn(
            "weight",
            F.greatest(F.lit(0.0), F.least(F.lit(1.0),
                p.weight_error * F.col("error_coupling")
                + p.weight_latency * F.col("latency_coupling")
                + p.weight_volume * F.least(F.lit(1.0), F.col("call_volume") / p.volume_norm))),
        )
    )

"""Seconds per headline query, printed as one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores. Each query
runs once to warm up and then counts with the median of three runs, or with one
run when the warm-up took over three seconds.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession

from rootseek.plans import analyze, catalog, views

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
SLOW_SECONDS = 3.0

HEADLINE = [
    "anomalous_nodes", "baseline_stats", "baseline_ema", "edge_weights", "graph_nodes", "graph_edges", "causal_depth",
    "node_timeline", "forward_impact", "counterfactual", "neighbour_hints", "span_signals", "worst_operation",
    "exception_freq", "evidence_database", "evidence_dependency", "evidence_service_config", "diff_lines", "function_changes",
    "stack_frames", "ingest_spans", "ingest_metrics", "ingest_changes",
]


def drain(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def clock(run) -> float:
    start = time.perf_counter()
    run()
    return round(time.perf_counter() - start, 3)


def timed(run) -> float:
    runs = RUNS if clock(run) <= SLOW_SECONDS else 1
    return statistics.median(clock(run) for _ in range(runs))


def pipeline(t: catalog.Telemetry, count: int) -> None:
    """The whole analysis of ``count`` incidents, a minute apart."""
    incidents = t.spark.range(count).selectExpr(
        "concat('inc-', id) AS incident_id",
        f"timestamp_micros(unix_micros(TIMESTAMP '{views.INCIDENT_START}') + id * 60000000) AS incident_start",
        "5 AS top_k",
    )
    result = analyze.analyze(
        incidents, t.spans, t.metrics, t.changes, views.VIEW_PARAMS, t.commits, t.functions, t.config
    )
    drain(result.results)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("rootseek-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    t = catalog.Telemetry.of(spark, SF_DIR)
    seconds: dict[str, float] = {}
    start = time.perf_counter()
    t.facts, t.functions
    seconds["derive_tables"] = round(time.perf_counter() - start, 3)
    for name in HEADLINE:
        seconds[name] = timed(lambda: drain(catalog.QUERIES[name](spark, SF_DIR)))
        print(name, seconds[name], file=sys.stderr, flush=True)
    pipeline(t, 1)  # warm-up
    for count in (1, 10, 100):
        seconds[f"analysis_{count}"] = clock(lambda: pipeline(t, count))
        print("analysis", count, seconds[f"analysis_{count}"], file=sys.stderr, flush=True)
    total = round(sum(v for k, v in seconds.items() if k != "derive_tables"), 3)
    print(json.dumps({"metric": "total_query_time", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(SF_DIR)}))
    spark.stop()


if __name__ == "__main__":
    main()

"""Registered queries over the driver tables, by name."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.incidents import Incidents
from ..operators import (
    assessments, causal, codechange, domains, graph, graphfold, localize as loc, scoring, series, service, spanfacts, spanwindow,
    timeline,
)
from ..session import configure, durable, new_folder
from ..sources import changes as src_changes, commits as src_commits, lake, metrics as src_metrics, records, results, traces
from . import analyze, views


def spread(df: DataFrame) -> DataFrame:
    """A scan in several partitions per core, spread while its rows are still narrow: a table's files may be few.

    Only for scans. Looking at the partitions of a shuffled table would run its shuffle, and again when it is used.
    """
    wanted = 4 * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)


class Telemetry:
    """Views of one data directory and the tables derived from them.

    Derived tables are written once per session and shared by the queries.
    """

    _known: dict[tuple[str, str], "Telemetry"] = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> "Telemetry":
        configure(spark)
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in cls._known:
            cls._known[key] = cls(spark, sf_dir)
        return cls._known[key]

    @cached_property
    def spans(self) -> DataFrame:
        return durable(views.spans(self.spark, self.dir), "lake-spans")

    @cached_property
    def raw_traces(self) -> DataFrame:
        return durable(views.raw_traces(self.spark, self.dir), "lake-raw-traces")

    @cached_property
    def raw_metrics(self) -> DataFrame:
        return durable(views.raw_metrics(spread(self.metrics)), "lake-raw-metrics")

    @cached_property
    def raw_changes(self) -> DataFrame:
        return durable(views.raw_changes(spread(self.changes)), "lake-raw-changes")

    @property
    def raw_replies(self) -> DataFrame:
        return views.raw_replies(spread(views.table(self.spark, self.dir, "orders").select("o_orderkey", "o_custkey")))

    @property
    def metrics(self) -> DataFrame:
        return views.metrics(self.spark, self.dir)

    @property
    def changes(self) -> DataFrame:
        return views.changes(self.spark, self.dir)

    @property
    def commits(self) -> DataFrame:
        return views.commits(self.spark, self.dir)

    @property
    def config(self) -> DataFrame:
        return views.service_config(self.spark, self.dir)

    @cached_property
    def inc(self) -> Incidents:
        return Incidents.of(views.incidents(self.spark), views.VIEW_PARAMS)

    @cached_property
    def several(self) -> Incidents:
        return Incidents.of(views.several(self.spark, views.STARTS), views.VIEW_PARAMS)

    @cached_property
    def several_stats(self) -> DataFrame:
        return durable(series.series_stats(series.metric_cells(self.metrics, self.several), self.several), "several-stats")

    @cached_property
    def incident_graphs(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Graphs of several incidents from stored folds."""
        path = new_folder(self.spark, "folds")
        graphfold.store(graphfold.fold(self.spans), path)
        return graphfold.incident_graphs(graphfold.load(self.spark, path), Incidents.of(views.several(self.spark, views.GRAPH_STARTS), views.GRAPH_PARAMS))

    @property
    def stats(self) -> DataFrame:
        return series.series_stats(series.metric_cells(self.metrics, self.inc), self.inc)

    @cached_property
    def facts(self) -> analyze.Facts:
        return analyze.gather(
            views.incidents(self.spark), self.spans, self.metrics, self.changes, views.VIEW_PARAMS, self.commits, self.config
        )

    @cached_property
    def diffs(self) -> DataFrame:
        return durable(views.commit_diffs(self.spark, self.dir), "lake-diffs")

    @cached_property
    def symbols(self) -> DataFrame:
        return durable(views.symbols(self.diffs), "lake-symbols")

    @cached_property
    def functions(self) -> DataFrame:
        return durable(codechange.function_changes(self.diffs, self.symbols), "lake-functions")

    @cached_property
    def candidates(self) -> DataFrame:
        """Candidates of the first iteration."""
        f = self.facts
        return durable(loc.localize(f.base, f.nodes, f.edges, None), "first-candidates")

    @cached_property
    def scores(self) -> DataFrame:
        f = self.facts
        return durable(causal.causal_scores(self.candidates.select("incident_id", "node_id"), f.edges, f.weights, f.impact, f.inc), "first-scores")

    def of_type(self, node_type: str) -> DataFrame:
        f = self.facts
        return f.nodes.where(F.col("node_type") == node_type).select(F.lit("inc-1").alias("incident_id"), "node_id")

    @cached_property
    def code_facts(self) -> DataFrame:
        f = self.facts
        return durable(
            service.code_facts(self.of_type("service"), f.window, f.changes, f.nodes, f.inc, self.commits, self.functions), "code-facts"
        )

    @cached_property
    def settings(self) -> DataFrame:
        f = self.facts
        return durable(service.setting_changes(self.of_type("service"), f.changes, f.inc), "settings")

    @cached_property
    def analysis(self) -> analyze.Analysis:
        return analyze.conclude(self.facts, self.commits, self.functions)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    """Register a query that maps a ``Telemetry`` to a DataFrame."""
    QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Telemetry.of(spark, sf_dir))
    return fn


def r6(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


# --- metric series -----------------------------------------------------------

@query
def anomalous_nodes(t):
    return series.anomalies(t.stats, t.inc).select(
        "node_id", "metric_type", *r6("current_value", "baseline_mean", "baseline_std", "z_score")
    ).orderBy(F.desc("z_score"), "node_id")


@query
def baseline_stats(t):
    return series.baselines(t.stats).select(
        "node_id", "metric_type", "sample_count", *r6("mean", "std"), "min_value", "max_value"
    )


@query
def baseline_ema(t):
    return series.ema(t.metrics, t.inc).select("node_id", "metric_type", *r6("ema"), "sample_count")


@query
def baseline_ema_starts(t):
    """Several incidents at once."""
    return series.ema(t.metrics, t.several).select("incident_id", "node_id", "metric_type", *r6("ema"), "sample_count")


@query
def baseline_stats_starts(t):
    return series.baselines(t.several_stats).select(
        "incident_id", "node_id", "metric_type", "sample_count", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"), "min_value", "max_value"
    )


@query
def deviations_starts(t):
    return series.deviations(t.several_stats, t.several).select("incident_id", "node_id", "metric_type", *r6("current_value", "z_score"), "is_anomalous")


@query
def edge_weights_starts(t):
    return series.edge_weights(t.metrics, t.facts.edges, t.several_stats, t.several).select(
        "incident_id", "source_id", "target_id", *r6("error_coupling", "latency_coupling", "weight"), F.round("call_volume", 9).alias("call_volume")
    )


@query
def current_mean(t):
    return series.current_values(t.stats).select("node_id", "metric_type", *r6("current_value"), "cur_n")


@query
def deviations(t):
    return series.deviations(t.stats, t.inc).select("node_id", "metric_type", *r6("z_score"), "is_anomalous")


@query
def baseline_summary(t):
    wanted = ["error_rate", "latency_p50", "latency_p99", "request_rate", "saturation"]
    return series.baseline_summary(t.stats, wanted).select("node_id", *r6(*wanted))


@query
def default_start(t):
    return series.default_start(t.metrics).select(F.unix_micros("incident_start").alias("start_us"))


@query
def observed_impact(t):
    return series.observed_impact(t.stats, t.inc).select(
        "node_id", *r6("error_rate", "latency_multiplier", "baseline_error_rate", "baseline_latency"), "is_anomalous"
    )


@query
def edge_weights(t):
    return series.edge_weights(t.metrics, t.facts.edges, t.stats, t.inc).select(
        "source_id", "target_id", *r6("error_coupling", "latency_coupling", "call_volume", "weight")
    )


@query
def fetch_metrics(t):
    return lake.fetch_metrics(t.metrics, "2024-01-10 00:00:00", "2024-01-20 00:00:00", "n3").select(
        "ord", "node_id", "metric_type", "value"
    )


# --- ingest ------------------------------------------------------------------

@query
def ingest_spans(t):
    good, _ = traces.ingest_traces(t.raw_traces, strict=True)
    return good.select(
        "trace_id", "span_id", "parent_span_id", "service_id", "operation_name", "kind",
        F.unix_micros("start_time").alias("start_us"), "duration_ms", "otel_status_code", "http_status_code",
        F.col("attributes")["peer.service"].alias("peer"),
        F.col("resource_attributes")["service.version"].alias("version"),
        F.try_element_at("events", F.lit(1))["attributes"]["exception.type"].alias("exception_type"),
    )


@query
def ingest_metrics(t):
    good, _ = src_metrics.ingest_metrics(t.raw_metrics)
    return good.select(
        "node_id", "node_type", "metric_type", *r6("value"), F.unix_micros("timestamp").alias("ts_us"), "window_seconds", "unit", "ord"
    )


@query
def ingest_metrics_strict(t):
    good, _ = src_metrics.ingest_metrics(t.raw_metrics, strict=True)
    return good.groupBy("node_id", "metric_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")
    )


@query
def ingest_changes(t):
    good, _ = src_changes.ingest_changes(t.raw_changes, strict=True)
    return good.select(
        "kind", "event_id", "service_id", F.unix_micros("timestamp").alias("ts_us"), "version", "change_type", "key",
        "old_value", "new_value", "author", "diff_summary", F.array_join("deploy_scope", ",").alias("scope"),
        F.col("tags")["team"].alias("team"), "ord",
    )


@query
def ingest_rejects(t):
    bad = [
        traces.ingest_traces(t.raw_traces, strict=True)[1],
        src_metrics.ingest_metrics(t.raw_metrics)[1],
        src_changes.ingest_changes(t.raw_changes)[1],
    ]
    return analyze.ev_union(*bad).groupBy("source", "reason").agg(F.count(F.lit(1)).alias("n"))


def _push(t, shape):
    good, _ = src_commits.ingest_push(views.raw_pushes(t.spark, t.dir, shape), shape)
    return good.select(
        "event_id", "service_id", "commit_sha", "repo_url", "branch", "author", "commit_message",
        F.unix_micros("timestamp").alias("ts_us"), "ord",
    )


@query
def ingest_push_github(t):
    return _push(t, "github")


@query
def ingest_push_gitlab(t):
    return _push(t, "gitlab")


@query
def ingest_commits(t):
    good, bad = src_commits.ingest_commits(views.raw_commits(t.spark, t.dir))
    kept = good.select("event_id", "service_id", "commit_sha", "author", "deploy_event_id", F.unix_micros("timestamp").alias("ts_us"), F.lit(None).cast("string").alias("reason"))
    gone = bad.select(*[F.lit(None).cast(k).alias(n) for n, k in kept.dtypes[:-1]], "reason")
    return kept.unionByName(gone)


@query
def scan_files(t):
    """Records written as JSON lines, scanned and ingested again."""
    out = []
    for name, raw, ingest in (
        ("traces", t.raw_traces, traces.ingest_traces), ("metrics", t.raw_metrics, src_metrics.ingest_metrics), ("changes", t.raw_changes, src_changes.ingest_changes)
    ):
        path = new_folder(t.spark, f"scan-{name}")
        records.write_lines(raw, path)
        good, _ = ingest(records.json_lines(t.spark, path), strict=True)
        out.append(good.agg(F.lit(name).alias("source"), F.count(F.lit(1)).alias("good"), F.countDistinct("ord").alias("orders")))
    return analyze.ev_union(*out)


@query
def span_flags(t):
    return (
        traces.span_predicates(t.spans)
        .groupBy("service_id", "service_version", "environment")
        .agg(
            *[F.count_if(c).alias(c) for c in ("is_error", "is_server_error", "is_client_error", "is_root")],
            F.count(F.lit(1)).alias("n"),
        )
    )


@query
def fetch_spans(t):
    return lake.fetch_spans(t.spans, "2024-01-24 06:00:00", "2024-01-24 18:00:00", "n4").select(
        "span_id", F.unix_micros("start_time").alias("start_us")
    )


# --- graph and timeline ------------------------------------------------------

@query
def graph_nodes(t):
    return graph.with_service_config(graph.discover_nodes(t.spans), t.config).select(
        "node_id", "node_type", "db_type", "queue_type", "endpoint", "env", F.array_join("topics", ",").alias("topics"),
        "code_access_enabled", "repo_url", "ord",
    )


@query
def graph_edges(t):
    return graph.discover_edges(t.spans, t.facts.nodes).select("source_id", "target_id", "edge_type", "protocol", "ord")


@query
def incident_graph_nodes(t):
    """Each incident's own nodes, from daily folds."""
    return t.incident_graphs[0].select("incident_id", "node_id", "node_type", "db_type", "queue_type", "endpoint", "env", F.col("ord").cast("long").alias("ord"))


@query
def incident_graph_edges(t):
    return t.incident_graphs[1].select("incident_id", "source_id", "target_id", "edge_type", "protocol", F.col("ord").cast("long").alias("ord"))


@query
def incident_db_systems(t):
    return t.incident_graphs[2]


@query
def known_topology(t):
    nodes, edges = views.known_topology(t.spark, t.dir)
    found, calls = graph.build_graph(t.spans, known_nodes=nodes, known_edges=edges)
    return found.selectExpr("node_id AS id", "node_type AS kind", "CAST(NULL AS STRING) AS target").unionByName(calls.selectExpr("source_id AS id", "edge_type AS kind", "target_id AS target"))


@query
def change_attach(t):
    attached, _ = graph.attach_changes(t.changes, t.facts.nodes)
    return attached.groupBy("service_id", "kind").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.unix_micros("timestamp")).alias("last_us")
    )


@query
def dag_check(t):
    left = graph.cyclic_edges(t.facts.edges)
    return left.agg(F.count(F.lit(1)).alias("cyclic_edges"), (F.count(F.lit(1)) == 0).alias("is_dag"))


@query
def dag_check_incidents(t):
    """Cyclic and acyclic graphs of several incidents, peeled together."""
    calls = views.region_calls(t.spark, t.dir)
    left = graph.cyclic_edges(calls, ("incident_id",)).groupBy("incident_id").agg(F.count(F.lit(1)).alias("n"))
    return calls.select("incident_id").distinct().join(left, "incident_id", "left").select(
        "incident_id", F.coalesce("n", F.lit(0)).alias("cyclic_edges"), F.col("n").isNull().alias("is_dag")
    )


@query
def db_systems(t):
    return graph.db_systems(t.spans)


@query
def causal_depth(t):
    return timeline.causal_depths(t.spans).select("span_id", F.col("depth").cast("int").alias("depth"))


@query
def node_timeline(t):
    return timeline.node_timelines(timeline.causal_events(t.spans)).select(
        "node_id", "total_span_count", "error_span_count", *r6("error_rate", "causal_position"), "first_error_depth",
        "first_error_span_id", "is_likely_origin",
    )


@query
def causal_events(t):
    return timeline.in_causal_order(timeline.causal_events(t.spans)).select("position", "span_id", "node_id", F.col("depth").cast("int").alias("depth"), "is_error", "is_server_error")


@query
def origin_candidates(t):
    lines = timeline.node_timelines(timeline.causal_events(t.spans))
    return timeline.origin_candidates(lines, series.anomalies(t.stats, t.inc)).select(
        "node_id", "first_error_depth", "error_span_count", "is_likely_origin"
    )


@query
def trace_totals(t):
    return timeline.trace_totals(t.spans)


# --- causal model ------------------------------------------------------------

@query
def failure_severity(t):
    return causal.failure_severity(t.candidates, t.facts.impact, t.inc).select("node_id", *r6("severity"))


@query
def forward_impact(t):
    f = t.facts
    severities = causal.failure_severity(t.candidates, f.impact, f.inc)
    return causal.forward_simulation(severities, f.edges, f.weights, f.inc).select(
        "candidate_id", "node_id", "hop", *r6("predicted_error_rate", "predicted_latency_multiplier", "confidence")
    )


@query
def simple_paths(t):
    return causal.simple_paths(t.candidates, t.facts.edges, t.inc).select(
        "candidate_id", "node_id", F.array_join("path", ">").alias("path")
    )


@query
def counterfactual(t):
    f = t.facts
    return causal.counterfactual(t.candidates, f.edges, f.impact, f.inc).select(
        "node_id", *r6("residual_explanation", "counterfactual"), "is_necessary"
    )


@query
def fit_score(t):
    return t.scores.select("node_id", *r6("fit"))


@query
def rank_candidates(t):
    return loc.rank_candidates(t.candidates, t.scores, t.inc).select(
        "node_id", "node_type", "inclusion_reason", *r6("causal_confidence"), "causal_rank"
    )


# --- candidates and hints ----------------------------------------------------

@query
def localize(t):
    f = t.facts
    return loc.localize(f.base, f.nodes, f.edges, None).select(
        "node_id", "node_type", "inclusion_reason", "is_potential_origin"
    )


@query
def span_signals(t):
    return spanwindow.span_summary(spanwindow.span_window(t.spans, t.inc), t.inc).drop("incident_id").select(
        "node_id", "spans", "errors", "db_spans", "has_503", "has_429", "has_200", "has_timeout", *r6("slowest_db_ms")
    )


@query
def neighbour_hints(t):
    f = t.facts
    batch = loc.rank_candidates(t.candidates, t.scores, t.inc)
    return loc.neighbour_hints(batch, f.edges, f.signals, batch, 1).select(
        "node_id", "signal", "direction", "hint_strength", "reason", "suggesting_node_id"
    )


@query
def iterations(t):
    ranked, _, _ = analyze.reason(t.facts)
    return ranked.select("node_id", "iteration", "causal_rank", "inclusion_reason", "is_potential_origin", *r6("causal_confidence"))


# --- evidence ----------------------------------------------------------------

def _shown(evidence):
    return evidence.select("node_id", "signal", "strength", "section", "item", *r6("measure"))


@query
def worst_operation(t):
    return spanfacts.worst_operations(t.facts.window).select("node_id", "operation", *r6("rate"), "errors", "total")


@query
def exception_freq(t):
    return spanfacts.exception_counts(spanfacts.exception_events(t.facts.window).where("is_error")).select(
        "node_id", "exception_type", "occurrences"
    )


@query
def first_exception(t):
    return spanfacts.first_exception(spanfacts.exception_events(t.facts.window)).drop("incident_id")


@query
def slowest_statement(t):
    return spanfacts.slowest_statements(t.facts.window).select("node_id", "slow_statement", *r6("slow_mean_ms"), "slow_count")


@query
def failing_statement(t):
    return spanfacts.failing_statements(t.facts.window).select("node_id", "error_statement", "error_statement_count")


@query
def error_pattern(t):
    return spanfacts.error_patterns(t.facts.window, t.of_type("service")).select("node_id", "error_pattern")


@query
def status_histogram(t):
    return spanfacts.caller_calls(t.facts.window).select("node_id", "http_code", "calls")


@query
def caller_timeouts(t):
    return domains.caller_timeouts(t.facts.window, t.facts.edges).drop("incident_id")


def _database(t):
    f = t.facts
    facts = durable(
        domains.database_facts(t.of_type("database"), f.window, f.summary, f.stats, f.systems, f.edges, f.inc), "db"
    )
    return facts, domains.database_evidence(facts, f.inc)


@query
def evidence_database(t):
    return _shown(_database(t)[1])


@query
def database_findings(t):
    facts, evidence = _database(t)
    return domains.database_findings(facts, evidence, t.inc).drop("incident_id")


@query
def evidence_dependency(t):
    f = t.facts
    return _shown(domains.dependency_evidence(domains.dependency_facts(t.of_type("external_dep"), f.window, f.edges, f.inc), f.inc))


@query
def finding_texts(t):
    f = t.facts
    found = domains.dependency_evidence(domains.dependency_facts(t.of_type("external_dep"), f.window, f.edges, f.inc), f.inc)
    both = found.select("node_id", "signal", "finding").unionByName(_database(t)[1].where("signal = 'db_integrity_error'").select("node_id", "signal", "finding"))
    return both


@query
def dependency_findings(t):
    f = t.facts
    return domains.dependency_findings(
        domains.dependency_facts(t.of_type("external_dep"), f.window, f.edges, f.inc), f.inc
    ).drop("incident_id")


@query
def queue_findings(t):
    return domains.queue_findings(t.of_type("queue")).drop("incident_id")


@query
def latest_deploy(t):
    return service.latest_deploys(t.of_type("service"), t.facts.changes, t.inc).select(
        "node_id", "deploy_id", "version", "diff_summary", *r6("deploy_minutes")
    )


@query
def evidence_service_code(t):
    return _shown(service.code_evidence(t.code_facts, t.inc))


@query
def evidence_service_config(t):
    return _shown(service.config_evidence(t.code_facts, t.settings, t.inc))


@query
def evidence_assessed(t):
    replies = t.raw_replies
    both = service.config_evidence(t.code_facts, t.settings, t.inc, replies)
    return _shown(both.where("signal = 'llm_config_assessment'")).select("node_id", "signal", "strength", "item")


@query
def service_arbitration(t):
    both = service.code_evidence(t.code_facts, t.inc).unionByName(service.config_evidence(t.code_facts, t.settings, t.inc))
    return service.arbitrate(t.code_facts, t.settings, both, t.inc).select(
        "node_id", "domain", "failure_type", "priority_score", "winner", "both_strong"
    )


# --- code --------------------------------------------------------------------

@query
def diff_lines(t):
    return codechange.diff_lines(t.diffs).select("event_id", "kind", "new_line", "old_line", "text", "pos", "hunk")


@query
def function_changes(t):
    return codechange.function_changes(t.diffs, t.symbols).select(
        "event_id", "file_path", "language", "function_name", "change_type", "start_line", "end_line", "old_code", "new_code"
    )


@query
def stack_frames(t):
    f = t.facts
    return codechange.error_frames(f.window, t.of_type("service")).select(
        "node_id", "span_id", "pos", "file_path", "function_name", "line_number", "base"
    )


@query
def stack_match(t):
    return t.code_facts.where("match_type IS NOT NULL").select(
        "node_id", "match_type", "span_id", "frame_line", "commit_event_id", "function_name", "file_path"
    )


# --- assessor ----------------------------------------------------------------

@query
def assessment_parse(t):
    return assessments.parse_replies(t.raw_replies).select(
        "ref_id", "assessment", "reasoning", F.array_join("signals", ",").alias("signals")
    )


@query
def assessment_requests(t):
    patterns = spanfacts.error_patterns(t.facts.window, t.of_type("service"))
    return assessments.assessment_requests(t.code_facts, t.settings, patterns).select("service_id", "kind", "ref_id", "message")


# --- verdict -----------------------------------------------------------------

@query
def score(t):
    return t.analysis.candidates.select(
        "node_id", "domain", "failure_type", "domain_confidence", "evidence_count", "strong_count", "score_rank", "iteration"
    )


@query
def multi_factor(t):
    return scoring.multi_factor(t.analysis.candidates, t.inc).drop("incident_id")


@query
def verdict(t):
    return t.analysis.results.select(
        "incident_id", "verdict", "root_cause_node", "root_cause_domain", "confidence",
        F.array_join("root_cause_ids", ",").alias("root_cause_ids"), "iterations_run", "data_quality", "multi_factor_explanation",
        F.array_join("weak_signals", ",").alias("weak_signals"),
    )


@query
def result_documents(t):
    docs = results.documents(t.analysis, t.spans.count())
    first = F.get("root_causes", F.lit(0))
    return docs.select(
        "incident_id", "has_root_cause", "root_cause_node", F.array_join(F.transform("root_causes", lambda c: c["node_id"]), ",").alias("root_causes"),
        F.size("all_candidates").alias("candidates"), F.size(first["evidence"]).alias("top_evidence"),
        first["causal_confidence"].alias("top_causal"), "span_count",
    )


@query
def result_summaries(t):
    return results.summaries(results.documents(t.analysis, with_evidence=False)).drop("analyzed_at")


@query
def result_lookup(t):
    """Results stored in two rounds and read back by id and as a whole."""
    path = new_folder(t.spark, "store")
    results.store(views.stored_results(t.spark, t.dir, "first"), path)
    results.store(views.stored_results(t.spark, t.dir, "second", "c_custkey % 3 = 0"), path)
    alone = [results.lookup(t.spark, path, i).select(F.concat(F.lit("lookup of "), "incident_id").alias("incident_id"), "narrative") for i in ("12", "000000000012", "7")]
    return analyze.ev_union(results.stored(t.spark, path), *alone)


@query
def result_feedback(t):
    """Analyst feedback, one entry per order; the newest one counts."""
    feedback = views.table(t.spark, t.dir, "orders").selectExpr(
        "CASE WHEN o_orderkey % 4 = 0 THEN 'inc-unknown' ELSE 'inc-1' END AS incident_id", "o_orderstatus = 'F' AS correct",
        "concat('note ', o_orderkey) AS notes", "timestamp_micros(unix_micros(CAST(o_orderdate AS TIMESTAMP)) + o_orderkey) AS submitted_at",
    )
    docs, unknown = results.with_feedback(results.documents(t.analysis, with_evidence=False), feedback)
    known = docs.select("incident_id", F.col("feedback.correct").alias("correct"), F.col("feedback.notes").alias("notes"), F.lit(1).cast("bigint").alias("n"))
    missed = unknown.groupBy(F.col("raw").alias("incident_id")).agg(
        F.lit(None).cast("boolean").alias("correct"), F.lit(None).cast("string").alias("notes"), F.count(F.lit(1)).alias("n")
    )
    return known.unionByName(missed)


@query
def narrative_requests(t):
    return t.analysis.narratives.select(
        "incident_id", F.size(F.split("narrative_prompt", "\n")).alias("narrative_lines"),
        F.substring_index("fix_prompt", "\n", 6).alias("fix_head"),
    )


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole analysis of the example incident: ranked candidates with scores."""
    t = Telemetry.of(spark, sf_dir)
    return t.analysis.candidates.select(
        "incident_id", "score_rank", "node_id", "node_type", "domain", "failure_type", "domain_confidence",
        "causal_confidence", "iteration", "verdict", "is_root_cause",
    )

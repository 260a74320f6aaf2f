"""The whole analysis: from telemetry tables to verdicts, for many incidents at once.

The telemetry is read a fixed number of times and folded to small tables; the
loop of at most three iterations touches only those. The driver learns counts
(is anything left?) and never rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.incidents import Incidents, per_incident
from ..operators import causal, codechange, domains, evidence as ev, graph, graphfold, localize as loc, scoring, series, service
from ..operators import assessments, spanfacts, spanwindow
from ..params import DEFAULTS, Params
from ..session import durable, durable_all, together

KEY = ["incident_id", "node_id"]


@dataclass
class Analysis:
    """Tables an analysis leaves behind."""

    results: DataFrame      # one row per incident
    candidates: DataFrame   # examined candidates with scores and ranks
    evidence: DataFrame     # one row per evidence item
    hints: DataFrame        # one row per neighbour hint
    requests: DataFrame     # open questions for the assessor
    narratives: DataFrame   # texts asking for a narrative and a fix
    rejects: DataFrame      # rows that could not be placed
    nodes: DataFrame
    edges: DataFrame


@dataclass
class Facts:
    """Small tables derived once from the telemetry."""

    inc: Incidents
    calls: DataFrame
    nodes: DataFrame
    edges: DataFrame
    systems: DataFrame
    changes: DataFrame
    stats: DataFrame
    impact: DataFrame
    sick_calls: DataFrame
    weights: DataFrame
    window: DataFrame
    summary: DataFrame
    signals: DataFrame
    base: DataFrame
    anomalies: DataFrame
    rejects: DataFrame


def gather(
    incidents: DataFrame,
    spans: DataFrame,
    metrics: DataFrame,
    changes: DataFrame,
    params: Params = DEFAULTS,
    commits: DataFrame | None = None,
    service_config: DataFrame | None = None,
    known_nodes: DataFrame | None = None,
    known_edges: DataFrame | None = None,
    folds: graphfold.Folds | None = None,
) -> Facts:
    inc = Incidents.of(incidents, params)
    # not written: a table as long as the lake would cost more than reading it again
    calls = graph.call_facts(spans)
    if folds is None:
        nodes = graph.known_or_found_nodes(calls, service_config, known_nodes)
        edges, systems = graph.discover_edges(calls, nodes, known_edges), graph.db_systems(calls)
    else:
        if known_nodes is not None or known_edges is not None:
            raise ValueError("give known nodes and edges to graphfold.fold")
        nodes, edges, systems = graphfold.incident_graphs(folds, inc)
        nodes = durable(nodes if service_config is None else graph.with_service_config(nodes, service_config), "nodes")
        changes = inc.prune(changes, "timestamp", params.change_lookback_minutes * 60, params.window_seconds)
    attached, missed = graph.attach_changes(changes, nodes)
    on_services = None
    if commits is not None:
        services = nodes.where("node_type = 'service'").select(F.col("node_id").alias("service_id"))
        on_services = commits.join(services, "service_id", "left_semi")  # of any incident's graph
    t = durable_all(
        edges=edges,
        stats=series.series_stats(series.metric_cells(metrics, inc), inc),
        window=spanwindow.span_window(spans, inc),
        systems=systems,
        changed=spanwindow.changed_nodes(attached, on_services, inc),
    )
    anomalies = series.anomalies(t["stats"], inc)
    t |= durable_all(
        summary=spanwindow.span_summary(t["window"], inc),
        base=loc.base_candidates(anomalies, t["changed"], nodes),
        impact=series.observed_impact(t["stats"], inc),
        weights=series.edge_weights(metrics, t["edges"], t["stats"], inc),
    )
    t |= durable_all(
        signals=spanwindow.node_signals(t["summary"], t["stats"], t["changed"]),
        sick_calls=causal.sick_calls(t["edges"], t["impact"]),
    )
    return Facts(
        inc=inc,
        calls=calls,
        nodes=nodes,
        edges=t["edges"],
        systems=t["systems"],
        changes=attached,
        stats=t["stats"],
        impact=t["impact"],
        weights=t["weights"],
        window=t["window"],
        summary=t["summary"],
        signals=t["signals"],
        sick_calls=t["sick_calls"],
        base=t["base"],
        anomalies=anomalies,
        rejects=missed.unionByName(loc.unplaced(t["base"], nodes)),
    )


def reason(facts: Facts) -> tuple[DataFrame | None, DataFrame | None, DataFrame | None]:
    """Ranked candidates of all iterations, all hints, and the causal scores.

    Unranked candidates may return in a later iteration; ranked ones are known
    from then on. An incident stops when its last batch gave no new hint.
    """
    inc = facts.inc
    ranked, hints = [], []
    scores = known = pool = None
    for iteration in range(1, inc.params.max_iterations + 1):
        included = facts.base
        if pool is not None:
            open_incidents = pool.select("incident_id").distinct()
            included = included.join(open_incidents, "incident_id", "left_semi").unionByName(loc.hint_candidates(pool))
        candidates = durable(loc.localize(included, facts.nodes, facts.edges, known), "candidates")
        if candidates.isEmpty():
            break
        new = candidates if scores is None else candidates.join(scores, KEY, "left_anti")
        if scores is None or not new.isEmpty():
            fresh = durable(
                causal.causal_scores(
                    new.select(*KEY), facts.edges, facts.weights, facts.impact, inc, facts.sick_calls
                ),
                "scores",
            )
            scores = fresh if scores is None else scores.unionByName(fresh)
        batch = durable(
            loc.rank_candidates(candidates, scores, inc).withColumn("iteration", F.lit(iteration)), "ranked"
        )
        ranked.append(batch)
        ids = batch.select(*KEY)
        known = ids if known is None else known.unionByName(ids)
        pool = durable(loc.neighbour_hints(batch, facts.edges, facts.signals, known, iteration), "hints")
        hints.append(pool)
        if pool.isEmpty():
            break
    if not ranked:
        return None, None, None
    return reduce(DataFrame.unionByName, ranked), reduce(DataFrame.unionByName, hints), scores


def examine(
    facts: Facts,
    ranked: DataFrame,
    commits: DataFrame | None = None,
    functions: DataFrame | None = None,
    replies: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Findings and evidence of every ranked candidate by node type, and the
    questions left open."""
    inc = facts.inc
    of = lambda t: ranked.where(F.col("node_type") == t).select(*KEY)
    svc, dbs, deps = of("service"), of("database"), of("external_dep")

    code, settings, db, dep = together(
        lambda: durable(
            service.code_facts(svc, facts.window, facts.changes, facts.nodes, inc, commits, functions, replies), "code"
        ),
        lambda: durable(service.setting_changes(svc, facts.changes, inc), "settings"),
        lambda: durable(
            domains.database_facts(
                dbs, facts.window, facts.summary, facts.stats, facts.systems, facts.edges, inc
            ),
            "db",
        ),
        lambda: durable(domains.dependency_facts(deps, facts.window, facts.edges, inc), "dep"),
    )
    both = durable(
        ev_union(service.code_evidence(code, inc), service.config_evidence(code, settings, inc, replies)), "service-evidence"
    )
    arbitrated = durable(service.arbitrate(code, settings, both, inc), "arbitrated")
    db_evidence = domains.database_evidence(db, inc)
    dep_evidence = domains.dependency_evidence(dep, inc)

    first = lambda df: df.withColumn("engine_pos", F.lit(0))
    evidence = durable(
        ev_union(service.merge_engines(both, arbitrated), first(db_evidence), first(dep_evidence)), "evidence"
    )
    cols = [*KEY, "domain", "failure_type", "priority_score"]
    findings = ev_union(
        arbitrated.select(*cols),
        domains.database_findings(db, db_evidence, inc).select(*cols),
        domains.dependency_findings(dep, inc).select(*cols),
        domains.queue_findings(of("queue")).select(*cols),
    )
    patterns = spanfacts.error_patterns(facts.window, svc)
    return findings, evidence, assessments.assessment_requests(code, settings, patterns)


def ev_union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def analyze(
    incidents: DataFrame,
    spans: DataFrame,
    metrics: DataFrame,
    changes: DataFrame,
    params: Params = DEFAULTS,
    commits: DataFrame | None = None,
    functions: DataFrame | None = None,
    service_config: DataFrame | None = None,
    replies: DataFrame | None = None,
    known_nodes: DataFrame | None = None,
    known_edges: DataFrame | None = None,
    folds: graphfold.Folds | None = None,
) -> Analysis:
    """Analyse every incident over the shared telemetry tables.

    With stored ``folds`` each incident has the graph of its own days, and spans
    and changes are read near the incidents only; rejects then tell of those
    changes. Without, the incidents share the graph of all spans given.

    A graph with a cycle cannot be ranked: an incident with candidates whose own
    part of the graph has one gets the failure result, the others are unaffected.
    """
    facts = gather(incidents, spans, metrics, changes, params, commits, service_config, known_nodes, known_edges, folds)
    return conclude(facts, commits, functions, replies)


def conclude(
    facts: Facts,
    commits: DataFrame | None = None,
    functions: DataFrame | None = None,
    replies: DataFrame | None = None,
) -> Analysis:
    inc = facts.inc
    # The loop ends on any graph, so it need not wait for the cycle test.
    cyclic, (ranked, hints, _) = together(
        lambda: durable(graph.cyclic_incidents(facts.calls, facts.edges, inc), "cyclic"), lambda: reason(facts)
    )
    if ranked is not None:
        ranked, hints = (t.join(cyclic, "incident_id", "left_anti") for t in (ranked, hints))
    if ranked is None:
        # nothing to examine: keep the tables, but empty
        seed = facts.base.limit(0).join(facts.nodes.select("node_id", "node_type").distinct(), "node_id")
        ranked = seed.select(
            *KEY, "node_type", F.lit("").alias("inclusion_reason"), F.lit(False).alias("is_potential_origin"),
            F.lit(0.0).alias("causal_confidence"), F.lit(0).alias("causal_rank"), F.lit(0).alias("iteration"),
        )
        hints = loc.neighbour_hints(ranked, facts.edges, facts.signals, ranked, 0)
    findings, evidence, requests = examine(facts, ranked, commits, functions, replies)
    examined = ranked.join(findings, KEY)
    scored = durable(scoring.score(examined, evidence, inc), "scored")
    flags = scoring.multi_factor(scored, inc)
    judged = durable(scoring.root_causes(scored, flags, inc), "judged")
    verdict = durable(scoring.verdicts(judged), "verdicts")
    quality = scoring.data_quality(inc, facts.anomalies, series.baselines(facts.stats))
    loops = ranked.groupBy("incident_id").agg(F.max("iteration").alias("loops"))
    has_candidates = facts.base.join(facts.nodes, [*per_incident(facts.nodes), "node_id"], "left_semi").select("incident_id").distinct()
    failed = has_candidates.join(cyclic, "incident_id", "left_semi").withColumn("failed", F.lit(True))
    none = F.array().cast("array<string>")
    bad = F.coalesce("failed", F.lit(False))
    results = (
        inc.df.select("incident_id", "incident_start")
        .join(verdict, "incident_id", "left")
        .join(quality, "incident_id", "left")
        .join(loops, "incident_id", "left")
        .join(failed, "incident_id", "left")
        .join(flags, "incident_id", "left")
        .select(
            "incident_id",
            "incident_start",
            F.coalesce("verdict", F.lit("no_root_cause_found")).alias("verdict"),
            "root_cause_node",
            "root_cause_rank",
            "root_cause_domain",
            F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
            F.coalesce("root_cause_ids", none).alias("root_cause_ids"),
            F.when(bad, "not analysed: the call graph of this incident has a cycle").otherwise("").alias("narrative"),
            F.when(bad, 0).otherwise(F.coalesce("loops", F.lit(1))).alias("iterations_run"),
            F.when(bad, "low").otherwise(F.col("data_quality")).alias("data_quality"),
            "multi_factor_explanation",
            F.coalesce("residual_unexplained", F.lit(0.0)).alias("residual_unexplained"),
            F.coalesce("weak_signals", none).alias("weak_signals"),
            F.current_timestamp().alias("analyzed_at"),
        )
    )
    narratives = assessments.narrative_requests(judged, evidence, verdict)
    return Analysis(
        results=results, candidates=judged, evidence=evidence, hints=hints, requests=requests,
        narratives=narratives, rejects=facts.rejects, nodes=facts.nodes, edges=facts.edges,
    )

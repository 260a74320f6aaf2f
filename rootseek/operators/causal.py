"""Causal ranking: forward simulation along callers and a counterfactual test.

Edges point from caller to callee; a failure spreads from a node to its
callers. State is keyed (incident, candidate, node) and grows by one hop per
round for all incidents and candidates together. Edges may have an
``incident_id``: each incident then has its own graph.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.incidents import Incidents, per_incident
from ..session import durable, together
from ..sources.records import ORDER
from .series import unmeasured_weight

STATE = ("incident_id", "candidate_id", "node_id")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def failure_severity(candidates: DataFrame, impact: DataFrame, inc: Incidents) -> DataFrame:
    """Severity in [0, 1] from the candidate's own observed impact."""
    p = inc.params
    # unobserved nodes carry no signal (least and greatest would skip a NULL)
    raw_err = F.coalesce(F.col("error_rate") / 100, F.lit(0.0))
    raw_lat = F.coalesce((F.col("latency_multiplier") - 1) / p.latency_factor, F.lit(0.0))
    err = F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw_err))
    lat = F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw_lat))
    worst = F.greatest(err, lat)
    return (
        candidates.select("incident_id", "node_id")
        .join(impact.select("incident_id", "node_id", "error_rate", "latency_multiplier"), ["incident_id", "node_id"], "left")
        .select(
            "incident_id",
            "node_id",
            F.when(worst > 0, worst).otherwise(F.lit(p.severity_without_data)).alias("severity"),
        )
    )


def forward_simulation(severities: DataFrame, edges: DataFrame, weights: DataFrame, inc: Incidents) -> DataFrame:
    """Predicted impact of each candidate on itself and all its callers.

    Breadth first; a node counts once, through the shortest path, and among
    equally short ones through the first in call order.
    """
    p = inc.params
    own = per_incident(edges)
    calls = edges.select(*own, "source_id", F.col("target_id").alias("node_id"), F.col("ord").cast(ORDER).alias("ord"))
    w = weights.select("incident_id", "source_id", F.col("target_id").alias("node_id"), "weight")
    front = severities.select(
        "incident_id",
        F.col("node_id").alias("candidate_id"),
        "node_id",
        F.lit(0).alias("hop"),
        F.col("severity").cast("double").alias("severity"),
        F.array().cast(f"array<{ORDER}>").alias("path"),
    )
    levels = [front]
    while True:
        step = (
            levels[-1]
            .join(calls, [*own, "node_id"])
            .join(w, ["incident_id", "source_id", "node_id"], "left")
            .groupBy("incident_id", "candidate_id", F.col("source_id").alias("node_id"))
            .agg(
                F.min(
                    F.struct(
                        F.concat("path", F.array("ord")).alias("path"),
                        (F.col("severity") * F.coalesce("weight", F.lit(unmeasured_weight(inc)))).alias("severity"),
                    )
                ).alias("first"),
                F.min(F.col("hop") + 1).alias("hop"),
            )
            .join(_union([lv.select(*STATE) for lv in levels]), list(STATE), "left_anti")
            .select(*STATE, "hop", "first.severity", "first.path")
        )
        step = durable(step, "front")
        if step.isEmpty():
            break
        levels.append(step)
    hop = F.col("hop")
    return _union(levels).select(
        *STATE,
        "hop",
        (F.col("severity") * 100).alias("predicted_error_rate"),
        (1 + F.col("severity") * p.latency_factor).alias("predicted_latency_multiplier"),
        F.when(hop == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(p.hop_floor), 1 - hop * p.hop_decay)).alias("confidence"),
    )


def simple_paths(seeds: DataFrame, edges: DataFrame, inc: Incidents) -> DataFrame:
    """All cycle-free caller paths of up to ``path_cutoff`` hops from each seed."""
    own = per_incident(edges)
    calls = edges.select(*own, "source_id", F.col("target_id").alias("node_id"))
    level = seeds.select("incident_id", F.col("node_id").alias("candidate_id"), "node_id").withColumn(
        "path", F.array("node_id")
    )
    found = []
    for _ in range(inc.params.path_cutoff):
        level = (
            level.join(calls, [*own, "node_id"])
            .where(~F.array_contains("path", F.col("source_id")))
            .select("incident_id", "candidate_id", F.col("source_id").alias("node_id"), F.concat("path", F.array("source_id")).alias("path"))
        )
        found.append(level)
    return _union(found)


def sick_calls(edges: DataFrame, impact: DataFrame) -> DataFrame:
    """Calls between anomalous nodes, with the number each caller has."""
    sick = impact.where("is_anomalous").select("incident_id", "node_id")
    own = per_incident(edges)
    links = (
        edges.select(*own, "source_id", F.col("target_id").alias("node_id"))
        .join(sick, [*own, "node_id"])
        .join(sick.withColumnRenamed("node_id", "source_id"), ["incident_id", "source_id"], "left_semi")
    )
    needs = links.groupBy("incident_id", "source_id").agg(F.count(F.lit(1)).alias("needed"))
    return links.join(needs, ["incident_id", "source_id"])


def counterfactual(
    candidates: DataFrame, edges: DataFrame, impact: DataFrame, inc: Incidents, links: DataFrame | None = None
) -> DataFrame:
    """How much of the anomaly remains explained once a candidate is removed.

    Grows, per candidate, the set of anomalous nodes that only it explains: a
    node joins when it calls anomalous nodes and all of those are already in
    the set. On a DAG everything else stays reachable from another root, so
    the small unexplained set is tracked and not the large explained one.
    ``links`` is the written ``sick_calls`` table when the caller has it.
    """
    p = inc.params
    sick = impact.where("is_anomalous").select("incident_id", "node_id")
    total = sick.groupBy("incident_id").agg(F.count(F.lit(1)).alias("total"))
    if links is None:
        links = durable(sick_calls(edges, impact), "sick_calls")
    lost = candidates.select("incident_id", F.col("node_id").alias("candidate_id"), "node_id").join(
        sick, ["incident_id", "node_id"], "left_semi"
    )
    sets = [lost.select(*STATE)]
    while not sets[-1].isEmpty():
        now = _union(sets)
        more = (
            now.join(links, ["incident_id", "node_id"])
            .groupBy("incident_id", "candidate_id", F.col("source_id").alias("node_id"))
            .agg(F.count(F.lit(1)).alias("gone"), F.max("needed").alias("needed"))
            .where("gone = needed")
            .join(now, list(STATE), "left_anti")
            .select(*STATE)
        )
        sets.append(durable(more, "lost"))
    unexplained = _union(sets).groupBy("incident_id", F.col("candidate_id").alias("node_id")).agg(
        F.count(F.lit(1)).alias("unexplained")
    )
    explained = F.col("total") - F.coalesce("unexplained", F.lit(0))
    residual = F.when(F.col("total") > 0, explained / F.col("total")).otherwise(F.lit(0.0))
    return (
        candidates.select("incident_id", "node_id")
        .join(total, "incident_id", "left")
        .join(unexplained, ["incident_id", "node_id"], "left")
        .select("incident_id", "node_id", "total", residual.alias("residual"))
        .select(
            "incident_id",
            "node_id",
            F.coalesce(F.col("total") > 0, F.lit(False)).alias("assessable"),
            F.col("residual").alias("residual_explanation"),
            F.when(F.col("total") > 0, 1 - F.col("residual")).otherwise(F.lit(0.0)).alias("counterfactual"),
        )
        .withColumn("is_necessary", F.col("assessable") & (F.col("residual_explanation") < p.necessity))
        .drop("assessable")
    )


def fit_scores(predicted: DataFrame, impact: DataFrame, inc: Incidents) -> DataFrame:
    """1 minus the mean prediction error over the observed nodes.

    Observed nodes without a prediction cost 1 each, so only matches need to
    be joined; the rest follows from the count.
    """
    p = inc.params
    observed = impact.groupBy("incident_id").agg(F.count(F.lit(1)).alias("seen"))

    def off(pred: str, obs: str):
        return F.least(F.lit(1.0), F.abs(F.col(pred) - F.col(obs)) / F.greatest(F.lit(1.0), F.col(obs)))

    error = p.fit_error_weight * off("predicted_error_rate", "error_rate") + p.fit_latency_weight * off(
        "predicted_latency_multiplier", "latency_multiplier"
    )
    matched = (
        predicted.join(impact, ["incident_id", "node_id"])
        .groupBy("incident_id", "candidate_id")
        .agg(F.count(F.lit(1)).alias("hits"), F.sum(F.least(F.lit(1.0), error)).alias("errors"))
    )
    candidates = predicted.where("hop = 0").select("incident_id", "candidate_id")
    mean = (F.col("seen") - F.coalesce("hits", F.lit(0)) + F.coalesce("errors", F.lit(0.0))) / F.col("seen")
    return (
        candidates.join(observed, "incident_id", "left")
        .join(matched, ["incident_id", "candidate_id"], "left")
        .select(
            "incident_id",
            F.col("candidate_id").alias("node_id"),
            F.when(F.col("seen") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - mean)))
            .otherwise(F.lit(p.fit_without_data))
            .alias("fit"),
        )
    )


def causal_scores(
    candidates: DataFrame, edges: DataFrame, weights: DataFrame, impact: DataFrame, inc: Incidents,
    links: DataFrame | None = None,
) -> DataFrame:
    """Fit, counterfactual and causal confidence per (incident, candidate)."""
    p = inc.params
    severities = failure_severity(candidates, impact, inc)
    predicted, cf = together(
        lambda: forward_simulation(severities, edges, weights, inc),
        lambda: counterfactual(candidates, edges, impact, inc, links),
    )
    fit = fit_scores(predicted, impact, inc)
    return fit.join(cf, ["incident_id", "node_id"]).withColumn(
        "causal_confidence",
        F.least(F.lit(1.0), F.greatest(F.lit(0.0),
            p.alpha_fit * F.col("fit") + p.beta_counterfactual * F.col("counterfactual"))),
    )

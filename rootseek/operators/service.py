"""Service candidates: a code engine, a configuration engine, and their arbitration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.incidents import Incidents, in_window
from ..session import durable
from . import evidence as E
from . import spanfacts as X
from .assessments import replies_for
from .codechange import error_frames, match_stack, relevant_commits

KEY = ["incident_id", "node_id"]


def _minutes():
    return (F.unix_micros("incident_start") - F.unix_micros("timestamp")) / 60e6


def latest_deploys(candidates: DataFrame, changes: DataFrame, inc: Incidents) -> DataFrame:
    """Most recent deploy of each candidate in the deploy window."""
    recent = in_window(changes.where("kind = 'deploy'"), "timestamp", inc, inc.params.deploy_lookback_minutes * 60, 0)
    fields = F.struct(
        "timestamp", (-F.col("ord")).alias("early"), "event_id", "version", "diff_summary", _minutes().alias("minutes")
    )
    return (
        recent.withColumnRenamed("service_id", "node_id")
        .join(candidates.select(*KEY).distinct(), KEY, "left_semi")
        .groupBy(*KEY)
        .agg(F.max(fields).alias("d"))
        .select(
            *KEY,
            F.col("d.event_id").alias("deploy_id"),
            F.col("d.version").alias("version"),
            F.col("d.diff_summary").alias("diff_summary"),
            F.col("d.minutes").alias("deploy_minutes"),
        )
    )


def setting_changes(candidates: DataFrame, changes: DataFrame, inc: Incidents) -> DataFrame:
    """Flag and configuration changes in their window.

    ``place`` numbers flags before configurations in input order; only the
    first few are put to the assessor (``asked``). Numbering looks at the
    smallest places of each service alone, not at a sort of all its changes.
    """
    p = inc.params
    recent = (
        in_window(changes.where("kind <> 'deploy'"), "timestamp", inc, p.config_lookback_minutes * 60, 0)
        .withColumnRenamed("service_id", "node_id")
        .join(candidates.select(*KEY).distinct(), KEY, "left_semi")
        .select(*KEY, "kind", "event_id", "key", "old_value", "new_value", _minutes().alias("minutes"), "ord",
                (F.col("kind") != "feature_flag").alias("is_config"))
    )
    # top places per hash slice first, so that a busy service is spread out
    sliced = recent.select(*KEY, "is_config", "ord").withColumn("slice", F.pmod(F.xxhash64("ord"), F.lit(32)))
    in_slice = W.partitionBy(*KEY, "slice").orderBy("is_config", "ord")
    in_node = W.partitionBy(*KEY).orderBy("is_config", "ord")
    first = (
        sliced.withColumn("r", F.row_number().over(in_slice))
        .where(F.col("r") <= p.assessed_changes)
        .withColumn("place", F.row_number().over(in_node))
        .where(F.col("place") <= p.assessed_changes)
        .select(*KEY, "is_config", "ord", "place")
    )
    return (
        recent.join(first, [*KEY, "is_config", "ord"], "left")
        .withColumn("asked", F.col("place").isNotNull())
    )


def code_facts(
    candidates: DataFrame, window: DataFrame, changes: DataFrame, nodes: DataFrame, inc: Incidents,
    commits: DataFrame | None = None, functions: DataFrame | None = None, replies: DataFrame | None = None,
) -> DataFrame:
    """What the code engine knows, one row per service candidate."""
    ids = candidates.select(*KEY).distinct()
    own = window.join(ids, KEY, "left_semi")
    deploys = latest_deploys(ids, changes, inc)
    facts = (
        ids.join(deploys, KEY, "left")
        .join(X.first_exception(X.exception_events(own)), KEY, "left")
        .join(X.worst_operations(own), KEY, "left")
    )
    if commits is not None and functions is not None:
        linked = relevant_commits(ids, commits, deploys, nodes, inc)
        linked = durable(linked, "linked")
        wanted = functions.join(linked.select("event_id").distinct(), "event_id", "left_semi")
        matches = match_stack(
            durable(error_frames(own, linked), "frames"), linked, durable(wanted, "functions"), inc
        )
        facts = facts.join(matches, KEY, "left")
    else:
        for name in ("match_type", "span_id", "commit_event_id", "function_name", "file_path", "old_code", "new_code"):
            facts = facts.withColumn(name, F.lit(None).cast("string"))
        facts = facts.withColumn("frame_line", F.lit(None).cast("int"))

    def answered(df: DataFrame, kind: str, ref: str, prefix: str) -> DataFrame:
        r = replies_for(replies, kind, df).select(
            *KEY, F.col("ref_id").alias(ref), *[F.col(x).alias(f"{prefix}_{x}") for x in ("assessment", "reasoning", "signals")]
        )
        return df.join(r, [*KEY, ref], "left")

    facts = answered(facts, "deploy_exception", "deploy_id", "a")
    facts = answered(facts, "code_match", "commit_event_id", "b")
    judged = (F.col("old_code") != "") & (F.col("new_code") != "")
    return facts.withColumn(
        "a_assessment",
        F.when(
            (F.col("diff_summary") != "") & F.col("exception_type").isNotNull(), F.col("a_assessment")
        ),
    ).withColumn("b_assessment", F.when(judged, F.col("b_assessment"))).withColumn(
        "smoking_gun",
        F.coalesce(
            (F.col("b_assessment") == "likely") & F.col("match_type").isin("exact_line", "function_match"), F.lit(False)
        ),
    )


def code_evidence(facts: DataFrame, inc: Incidents) -> DataFrame:
    p, c = inc.params, F.col
    node = c("node_id")
    return E.explode_items(
        facts,
        "code",
        [
            E.deploy(p, node, c("version"), c("deploy_minutes"), c("deploy_id").isNotNull()),
            E.exception(2, node, c("exception_type"), c("exception_message"), c("exception_type").isNotNull()),
            E.assessment(3, "llm_causal_assessment", c("a_assessment"), c("a_reasoning"), c("a_signals"),
                         "the change does not explain the exception", {}, {}, F.lit(True)),
            E.stack_match(c("function_name"), c("file_path"), c("frame_line"), c("match_type"), c("match_type").isNotNull()),
            E.assessment(5, "llm_case_b_analysis", c("b_assessment"), c("b_reasoning"), c("b_signals"),
                         "the code change does not explain the exception",
                         {"function": c("function_name"), "match_type": c("match_type")},
                         {"function": c("function_name")}, c("smoking_gun")),
            E.operation(6, "degraded_operation", "weak", " of its calls", c("operation"), c("rate"),
                        c("operation").isNotNull()),
            E.no_deploy(p, node, c("deploy_id").isNull()),
        ],
    )


def config_evidence(facts: DataFrame, settings: DataFrame, inc: Incidents, replies: DataFrame | None = None) -> DataFrame:
    """Evidence of the configuration engine: one item per change, plus summaries."""
    p, c = inc.params, F.col
    node = c("node_id")
    answers = replies_for(replies, "setting_change", settings).withColumnRenamed("ref_id", "event_id")
    per_change = E.explode_items(
        settings.join(answers, [*KEY, "event_id"], "left"),
        "config",
        [
            E.setting_change(p, c("kind"), node, c("key"), F.coalesce("old_value", F.lit("None")),
                             F.coalesce("new_value", F.lit("None")), c("minutes"), c("ord")),
            F.when(
                c("asked"),
                E.assessment(3, "llm_config_assessment", c("assessment"), c("reasoning"), c("signals"),
                             "the setting does not explain the errors", {}, {}, F.lit(True), order=c("place")),
            ),
        ],
    )
    any_change = settings.select(*KEY).distinct()
    summary = E.explode_items(
        facts.join(any_change, KEY, "left_semi"),
        "config",
        [
            E.operation(4, "post_change_errors", "moderate", " of its calls since the setting changed", c("operation"), c("rate"),
                        c("operation").isNotNull()),
            E.simultaneous_change(node, F.lit("pending_arbitration"), c("deploy_id").isNotNull()),
        ],
    )
    return per_change.unionByName(summary)


def arbitrate(facts: DataFrame, settings: DataFrame, evidence: DataFrame, inc: Incidents) -> DataFrame:
    """Which engine explains the service, and the resulting priority.

    More strong items win, then more moderate ones, then the code engine. With
    strong items on both sides the code engine names the failure.
    """
    counts = (
        evidence.groupBy(*KEY)
        .agg(
            *[
                F.count_if((F.col("engine") == e) & (F.col("strength") == s)).alias(f"{e}_{s}")
                for e in ("code", "config")
                for s in ("strong", "moderate")
            ]
        )
    )
    kinds = settings.groupBy(*KEY).agg(
        F.bool_or(F.col("kind") == "feature_flag").alias("has_flag"), F.lit(True).alias("has_setting")
    )
    p, c, no = inc.params, F.col, F.lit(False)
    rows = (
        facts.join(counts, KEY, "left").join(kinds, KEY, "left")
        .withColumn("has_flag", F.coalesce("has_flag", no))
        .withColumn("has_setting", F.coalesce("has_setting", no))
        .na.fill(0, ["code_strong", "code_moderate", "config_strong", "config_moderate"])
    )
    config_wins = (c("config_strong") > c("code_strong")) | (
        (c("config_strong") == c("code_strong")) & (c("config_moderate") > c("code_moderate"))
    )
    rows = (
        rows.withColumn("winner", F.when(config_wins, "config").otherwise("code"))
        .withColumn("both_strong", (c("code_strong") > 0) & (c("config_strong") > 0))
        .withColumn("named_by", F.when(c("both_strong"), "code").otherwise(c("winner")))
    )
    by_config = (c("named_by") == "config") & c("has_setting")
    strong = F.when(c("winner") == "code", c("code_strong")).otherwise(c("config_strong"))
    moderate = F.when(c("winner") == "code", c("code_moderate")).otherwise(c("config_moderate"))
    code_failure = (
        F.when(c("smoking_gun") | c("deploy_id").isNotNull(), "code_regression")
        .when(c("exception_type").isNotNull(), "runtime_error")
        .otherwise("application_error")
    )
    return rows.select(
        *KEY,
        F.when(by_config, "configuration").otherwise("application_code").alias("domain"),
        F.when(c("named_by") == "code", code_failure)
        .when(c("has_flag"), "feature_flag_regression")
        .when(c("has_setting"), "config_regression")
        .otherwise("application_error")
        .alias("failure_type"),
        F.when(c("smoking_gun"), p.service_smoking_gun)
        .when(strong >= 1, p.service_strong)
        .when(moderate >= 2, p.service_moderate)
        .otherwise(0.0)
        .alias("priority_score"),
        "winner",
        "both_strong",
        "smoking_gun",
    )


def merge_engines(evidence: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Winner's items before the loser's; resolves the both-strong mark."""
    v = verdicts.select(*KEY, "winner", "both_strong")
    marked = F.map_concat("metadata", F.create_map(F.lit("both_strong"), F.lit("true")))
    return (
        evidence.join(v, KEY)
        .withColumn("engine_pos", (F.col("engine") != F.col("winner")).cast("int"))
        .withColumn(
            "metadata",
            F.when((F.col("signal") == "simultaneous_change") & F.col("both_strong"), marked).otherwise(F.col("metadata")),
        )
        .drop("winner", "both_strong")
    )

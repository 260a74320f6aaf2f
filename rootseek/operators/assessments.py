"""Requests for, and replies from, an outside assessor.

The remote call is not part of the engine: requests go out as a table and
replies come back as a table ``assessments(incident_id, service_id, kind,
ref_id, raw_reply)``. Without replies the analysis runs on signals alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import percent
from ..functions.variants import fields, is_array, is_string, member, once, shown, typed

KEY = ["incident_id", "node_id"]
KINDS = ("deploy_exception", "code_match", "setting_change")
# Answers that count.
ANSWERS = ("likely", "unlikely", "uncertain")

REPLY_FORMAT = (
    'Answer with one JSON object: {"causal_assessment": "likely|unlikely|uncertain", '
    '"reasoning": "one or two sentences", "signals": ["..."]}.'
)
INSTRUCTIONS = {
    "deploy_exception": "Judge whether the deployed change caused the exception. " + REPLY_FORMAT,
    "code_match": "Judge whether the change to this function caused the exception. " + REPLY_FORMAT,
    "setting_change": "Judge whether the setting change caused the errors. " + REPLY_FORMAT,
}


def parse_replies(replies: DataFrame) -> DataFrame:
    """Verdict, reasoning and signals of each reply; unusable ones read as
    uncertain with reasoning 'parse error'."""
    cleaned = F.trim(
        F.regexp_replace(
            F.regexp_replace(
                F.regexp_replace(F.regexp_replace("raw_reply", r"^\s+|\s+$", ""), r"^```json\s*", ""), r"^```\s*", ""
            ),
            r"\s*```$",
            "",
        )
    )
    keys = [c for c in replies.columns if c != "raw_reply"]
    read = once(replies, *keys, m=fields(F.try_parse_json(cleaned)))
    verdict, reasoning, signals = (member("m", n) for n in ("causal_assessment", "reasoning", "signals"))
    usable = F.coalesce(
        is_string(verdict) & verdict["text"].isin(*ANSWERS) & is_string(reasoning) & (reasoning["text"] != ""),
        F.lit(False),
    )
    listed = F.transform(
        F.try_variant_get(F.try_parse_json(signals["text"]), "$", "array<variant>"), lambda x: shown(typed(x))
    )
    return read.select(
        *keys,
        F.when(usable, verdict["text"]).otherwise("uncertain").alias("assessment"),
        F.when(usable, reasoning["text"]).otherwise("parse error").alias("reasoning"),
        F.coalesce(F.when(usable & is_array(signals), listed), F.array().cast("array<string>")).alias("signals"),
    )


def replies_for(replies: DataFrame | None, kind: str, like: DataFrame) -> DataFrame:
    """Parsed replies of one kind keyed (incident, node, ref)."""
    if replies is None:
        return like.sparkSession.createDataFrame(
            [], "incident_id string, node_id string, ref_id string, assessment string, reasoning string, signals array<string>"
        )
    return parse_replies(replies.where(F.col("kind") == kind)).select(
        "incident_id", F.col("service_id").alias("node_id"), "ref_id", "assessment", "reasoning", "signals"
    )


def _lines(*pairs: tuple[str, Column]) -> Column:
    return F.concat_ws("\n", *[F.concat(F.lit(f"{k}: "), F.coalesce(v.cast("string"), F.lit(""))) for k, v in pairs])


def _request(kind: str, ref: Column, message: Column) -> list[Column]:
    return [
        "incident_id",
        F.col("node_id").alias("service_id"),
        F.lit(kind).alias("kind"),
        ref.alias("ref_id"),
        F.lit(INSTRUCTIONS[kind]).alias("instructions"),
        message.alias("message"),
    ]


def assessment_requests(code_facts: DataFrame, settings: DataFrame, patterns: DataFrame) -> DataFrame:
    """One row per question the service engines would ask."""
    c = F.col
    deploy = code_facts.where("diff_summary IS NOT NULL AND diff_summary <> '' AND exception_type IS NOT NULL").select(
        *_request(
            "deploy_exception", c("deploy_id"),
            _lines(("Deploy diff summary", c("diff_summary")), ("Service", c("node_id")), ("Deploy version", c("version")),
                   ("Exception type", c("exception_type")), ("Exception message", c("exception_message"))),
        )
    )
    code = code_facts.where("match_type IS NOT NULL AND old_code <> '' AND new_code <> ''").select(
        *_request(
            "code_match", c("commit_event_id"),
            F.concat_ws(
                "\n",
                _lines(("Service", c("node_id")), ("Function", c("function_name")), ("File", c("file_path")),
                       ("Match type", c("match_type"))),
                F.lit(""), F.lit("OLD CODE:"), c("old_code"), F.lit(""), F.lit("NEW CODE:"), c("new_code"), F.lit(""),
                _lines(("Exception type", c("exception_type")), ("Exception at line", c("frame_line")),
                       ("Exception message", c("exception_message"))),
            ),
        )
    )
    flag = c("kind") == "feature_flag"
    setting = (
        settings.where("asked")
        .join(patterns, KEY)
        .select(
            *_request(
                "setting_change", c("event_id"),
                F.concat_ws(
                    "\n",
                    F.when(flag, "Change type: feature_flag").otherwise("Change type: config"),
                    F.concat(F.when(flag, "Flag key: ").otherwise("Config key: "), c("key")),
                    _lines(("Old value", c("old_value")), ("New value", c("new_value")), ("Error pattern", c("error_pattern"))),
                ),
            )
        )
    )
    return deploy.unionByName(code).unionByName(setting)


def _top_cause(scored: DataFrame, verdicts: DataFrame) -> DataFrame:
    leaders = verdicts.where("root_cause_node IS NOT NULL").select(
        "incident_id", "verdict", F.col("root_cause_node").alias("node_id"), F.col("root_cause_rank").alias("score_rank")
    )
    return scored.drop("verdict").join(leaders, ["incident_id", "node_id", "score_rank"])


def narrative_requests(scored: DataFrame, evidence: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Texts asking for a narrative and for a fix, for each incident with a cause.

    The narrative shows all evidence of the leading cause; the fix shows the
    strong items, or the first four when none is strong.
    """
    place = W.partitionBy("incident_id").orderBy("engine_pos", "section", "item")
    lead = _top_cause(scored, verdicts)
    has_strong = F.max(F.when(F.col("strength") == "strong", 1).otherwise(0)).over(W.partitionBy("incident_id"))
    shown = (
        evidence.join(lead.select("incident_id", "node_id"), KEY)
        .withColumn("n", F.row_number().over(place))
        .withColumn("any_strong", has_strong)
        .withColumn("for_fix", F.when(F.col("any_strong") == 1, F.col("strength") == "strong").otherwise(F.col("n") <= 4))
        .withColumn("fix_n", F.sum(F.col("for_fix").cast("int")).over(place))
    )
    listing = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(c)), lambda x: x["line"]), "\n")
    full = F.struct(
        "n",
        F.concat(F.col("n").cast("string"), F.lit(". "), "signal", F.lit(": "), "finding", F.lit(" ("), "strength", F.lit(")")).alias("line"),
    )
    short = F.when(
        F.col("for_fix"),
        F.struct(
            F.col("fix_n").alias("n"),
            F.concat(F.col("fix_n").cast("string"), F.lit(". ["), F.upper("strength"), F.lit("] "), "signal", F.lit(": "), "finding").alias("line"),
        ),
    )
    texts = shown.groupBy("incident_id").agg(listing(full).alias("all_lines"), listing(short).alias("fix_lines"))
    c = F.col
    sure = percent(c("domain_confidence"))
    return lead.join(texts, "incident_id", "left").select(
        "incident_id",
        F.concat_ws(
            "\n",
            F.lit("Summarise this root cause analysis of a production incident."),
            _lines(("Incident ID", c("incident_id")), ("Verdict", c("verdict")),
                   ("Root cause", F.concat("node_id", F.lit(" ("), "node_type", F.lit(")"))),
                   ("Domain", c("domain")), ("Confidence", sure)),
            F.lit("Evidence:"), c("all_lines"), F.lit(""),
            F.lit("Explain in 3-5 plain sentences what failed, why, and the likely impact, with the confidence. "
                  "Use only what is stated above."),
        ).alias("narrative_prompt"),
        F.concat_ws(
            "\n",
            F.lit("Recommend a fix for this production incident."),
            _lines(("Incident ID", c("incident_id")),
                   ("Root cause", F.concat("node_id", F.lit(" ("), "node_type", F.lit(")"))),
                   ("Domain", c("domain")), ("Failure type", c("failure_type")), ("Confidence", sure)),
            F.lit("Key evidence:"), c("fix_lines"), F.lit(""),
            F.lit("Give 2-4 plain, specific sentences. Use only what is stated above."),
        ).alias("fix_prompt"),
    )

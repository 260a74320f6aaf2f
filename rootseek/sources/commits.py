"""Commit metadata, directly or from push payloads of two code hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.variants import fields, member, once
from .records import first_reason, split, tagged

COLUMNS = [
    "event_id", "service_id", "commit_sha", "repo_url", "branch", "author", "commit_message", "deploy_event_id",
    "timestamp", "ord",
]
# Accepted timestamp forms (numeric offset or Z, fraction only with Z).
STAMP = r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}((\.\d{1,6})?Z|[+-]\d{2}:?\d{2})$"


def commit_timestamp(text: Column) -> Column:
    with_colon = F.regexp_replace(text, r"([+-]\d{2})(\d{2})$", "$1:$2")
    return F.when(text.rlike(STAMP), with_colon.try_cast("timestamp"))


def _check(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with raw text fields to commits and rejects."""
    required = ("event_id", "commit_sha", "stamp", "repo_url", "branch")
    checked = rows.withColumn("timestamp", commit_timestamp(F.col("stamp"))).withColumn(
        "reason",
        first_reason(
            *[(F.col(c) != "", f"missing {c}") for c in required],
            (F.col("timestamp").isNotNull(), "bad timestamp"),
        ),
    )
    return split(tagged(checked, COLUMNS, "commits"), COLUMNS)


def ingest_commits(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Metadata records ``(raw, service_id, ord)``."""
    get = lambda n: member("m", n)["text"]
    rows = once(records, "raw", "service_id", "ord", m=fields(F.try_parse_json("raw"))).select(
        "raw", "service_id", "ord",
        *[get(n).alias(n) for n in ("event_id", "commit_sha", "repo_url", "branch", "author", "commit_message", "deploy_event_id")],
        get("timestamp").alias("stamp"),
    )
    return _check(rows)


def ingest_push(records: DataFrame, shape: str) -> tuple[DataFrame, DataFrame]:
    """Push payloads ``(raw, service_id, ord)``.

    ``shape`` is 'github' (``after``/``head_commit``/``pusher``) or 'gitlab'
    (``checkout_sha``/``commits``/``user_email``); the first commit listed
    gives message and time in the latter.
    """
    v = F.col("v")
    path = lambda p: F.try_variant_get(v, p, "string")
    if shape == "github":
        sha = F.coalesce(F.nullif(path("$.after"), F.lit("")), path("$.head_commit.id"))
        url, author, head = "$.repository.html_url", "$.pusher.email", "$.head_commit"
    elif shape == "gitlab":
        sha = path("$.checkout_sha")
        url, author, head = "$.project.web_url", "$.user_email", "$.commits[0]"
    else:
        raise ValueError(f"unknown payload shape {shape!r}")
    rows = (
        once(records, "raw", "service_id", "ord", v=F.try_parse_json("raw"))
        .withColumn("commit_sha", sha)
        .select(
            "raw", "service_id", "ord", "commit_sha",
            F.concat(F.lit(f"{shape}-"), F.substring("commit_sha", 1, 12)).alias("event_id"),
            F.replace(path("$.ref"), F.lit("refs/heads/"), F.lit("")).alias("branch"),
            path(url).alias("repo_url"),
            path(author).alias("author"),
            path(f"{head}.message").alias("commit_message"),
            path(f"{head}.timestamp").alias("stamp"),
            F.lit(None).cast("string").alias("deploy_event_id"),
        )
    )
    return _check(rows)

"""Change records (deploy, configuration, feature flag) and their inverse."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.variants import (
    fields, is_array, is_null, is_object, is_string, once, picked, shown, truthy, typed, typed_member, utc_timestamp,
)
from ..params import CHANGE_KINDS
from .records import first_reason, split, tagged

COLUMNS = [
    "kind", "event_id", "service_id", "timestamp", "version", "change_type", "key", "old_value", "new_value", "author",
    "diff_summary", "deploy_scope", "tags", "ord",
]
# Fields each kind must fill.
REQUIRED = {
    "deploy": ("event_id", "service_id", "timestamp", "version"),
    "config_change": ("event_id", "service_id", "timestamp", "change_type", "key"),
    "feature_flag": ("event_id", "service_id", "timestamp", "flag_key"),
}
# All members that are read.
MEMBERS = sorted({n for names in REQUIRED.values() for n in names} | {
    "event_type", "old_value", "new_value", "author", "diff_summary", "deploy_scope", "tags",
})


def tagged_changes(records: DataFrame, strict: bool = False) -> DataFrame:
    """Changes and rejects from records ``(raw, ord)``, one wide table.

    ``strict`` (file ingestion) also wants the three identifying fields to be
    non-empty text.
    """
    read = once(records, "raw", "ord", o=picked(F.try_parse_json("raw"), MEMBERS))
    members = {f"f_{n}": typed_member("o", n) for n in MEMBERS}
    parsed = once(read, "raw", "ord", is_record=F.col("o").isNotNull(), **members)
    f = lambda name: F.col(f"f_{name}")
    names = sorted({n for required in REQUIRED.values() for n in required})
    checked = once(
        parsed,
        "raw",
        "ord",
        "is_record",
        *members,
        kind=F.when(is_string(f("event_type")), f("event_type")["text"]),
        empty=F.array_compact(F.array(*[F.when(~truthy(f(n)), F.lit(n)) for n in names])),
        textual=F.lit(True) if not strict else is_string(f("event_id")) & is_string(f("service_id")) & is_string(f("timestamp")),
    )
    kind = F.col("kind")
    is_deploy, is_flag = kind == "deploy", kind == "feature_flag"
    needed = F.create_map(
        *[x for k, ns in REQUIRED.items() for x in (F.lit(k), F.array(*[F.lit(n) for n in ns]))]
    )
    missing = F.get(
        F.filter(F.try_element_at(needed, kind), lambda n: F.array_contains("empty", n)), F.lit(0)
    )
    scope = f("deploy_scope")
    listed = F.transform(
        F.try_variant_get(F.try_parse_json(scope["text"]), "$", "array<variant>"), lambda x: shown(typed(x))
    )
    tags = F.transform_values(fields(F.try_parse_json(f("tags")["text"])), lambda k, x: shown(x))
    optional = lambda name: F.when(truthy(f(name)), shown(f(name)))
    read = once(
        checked,
        "raw",
        "ord",
        "kind",
        event_id=shown(f("event_id")),
        service_id=shown(f("service_id")),
        timestamp=utc_timestamp(f("timestamp")),
        version=F.when(is_deploy, shown(f("version"))),
        change_type=F.when(kind == "config_change", shown(f("change_type"))),
        key=F.when(is_flag, shown(f("flag_key"))).when(~is_deploy, shown(f("key"))),
        old_value=F.when(~is_deploy, shown(f("old_value"))),
        new_value=F.when(~is_deploy, shown(f("new_value"))),
        author=optional("author"),
        diff_summary=F.when(is_deploy, optional("diff_summary")),
        deploy_scope=F.when(is_deploy & is_null(scope), F.array(shown(f("service_id")))).when(is_deploy, listed),
        tags=F.coalesce(F.when(is_object(f("tags")), tags), F.create_map().cast("map<string,string>")),
        reason=F.coalesce(
            first_reason(
                (F.col("is_record"), "not an object"),
                (truthy(f("event_type")), "missing event_type"),
                (kind.isin(*CHANGE_KINDS), "unknown event_type"),
                (F.col("textual"), "identifying field is not text"),
            ),
            F.when(missing.isNotNull(), F.concat(F.lit("missing "), missing)),
            F.when(is_deploy & ~is_null(scope) & ~is_array(scope), "deploy_scope must be a list"),
        ),
    )
    bad_time = F.when(F.col("timestamp").isNull(), "bad timestamp")
    return tagged(read.withColumn("reason", F.coalesce("reason", bad_time)), COLUMNS, "changes")


def ingest_changes(records: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Changes and rejects from records ``(raw, ord)``."""
    return split(tagged_changes(records, strict), COLUMNS)


def to_records(changes: DataFrame) -> DataFrame:
    """Raw records of changes: the inverse of ingestion."""
    stamp = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    kind = F.col("kind")
    only = lambda k, c: F.when(kind == k, c)
    empty = F.lit("")
    row = F.struct(
        kind.alias("event_type"), "event_id", "service_id", stamp.alias("timestamp"),
        F.coalesce("author", empty).alias("author"), "tags", "version",
        only("deploy", F.coalesce("diff_summary", empty)).alias("diff_summary"), "deploy_scope", "change_type",
        only("config_change", F.col("key")).alias("key"), only("feature_flag", F.col("key")).alias("flag_key"),
        "old_value", "new_value",
    )
    return changes.select(F.to_json(row).alias("raw"), "ord")

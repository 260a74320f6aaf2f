"""The dependency graph as stored daily folds, merged for each incident.

A node or edge keeps its earliest mention, a minimum of structs. Minima merge, so
a day's spans are folded once, stored in the day's folder, and the graph of an
incident is the merge of the folds of its own days: its window and
``Params.graph_lookback_days`` before its start. No analysis reads the spans
of the past again.

A parent link is resolved when its day is folded, among the spans of that
day and of ``REACH_DAYS`` days around it; a parent farther away gives no call.
Graphs are merged once per distinct stretch of days, however many incidents share it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.incidents import Incidents
from ..session import durable, exists, together
from ..sources.records import ORDER
from . import graph

REACH_DAYS = 1
#: Added to the order of seeds, which come before any mention.
SEED_ORDER = -(10**30)

#: Columns of the stored folds.
STORED = {
    "nodes": f"node_id string, first struct<ord: {ORDER}, node_type: string, db_type: string, db_version: string, queue_type: string, endpoint: string, env: string, topics: array<string>>",
    "edges": f"source_id string, target_id string, first struct<ord: {ORDER}, edge_type: string, protocol: string>",
    "systems": f"node_id string, first struct<ord: {ORDER}, db_system: string>",
}


@dataclass
class Folds:
    """Daily folds: (day, key, first). A row without key only marks its day as folded."""

    nodes: DataFrame
    edges: DataFrame
    systems: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {"nodes": self.nodes, "edges": self.edges, "systems": self.systems}


def _on_days(spans: DataFrame, days: tuple[str, str] | None, reach: int = 0) -> DataFrame:
    """Spans of the days and ``reach`` days around them; literal bounds prune folders, files and row groups."""
    if days is None:
        return spans
    lo, hi = F.date_sub(F.to_date(F.lit(days[0])), reach), F.date_add(F.to_date(F.lit(days[1])), reach)
    inside = (F.col("start_time") >= lo.cast("timestamp")) & (F.col("start_time") < F.date_add(hi, 1).cast("timestamp"))
    return spans.where(inside & F.col("day").between(lo, hi) if "day" in spans.columns else inside)


def _first(*fields: tuple[str, Column | str]) -> Column:
    return F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in fields]).alias("first")


def _ordered(folded: DataFrame) -> DataFrame:
    """Folds with the order of the first mention wide enough for any source of order numbers."""
    fields = [f.name for f in folded.schema["first"].dataType.fields]
    return folded.withColumn("first", F.struct(F.col("first.ord").cast(ORDER).alias("ord"), *[F.col(f"first.{f}").alias(f) for f in fields if f != "ord"]))


def fold(
    spans: DataFrame, days: tuple[str, str] | None = None, match_trace: bool = False,
    known_nodes: DataFrame | None = None, known_edges: DataFrame | None = None,
) -> Folds:
    """Folds of the spans of the days from first to last (all days if not given).

    Known nodes and edges are put into every folded day, ahead of its mentions.
    """
    day = F.to_date("start_time").alias("day")
    facts = graph.call_facts(_on_days(spans, days, REACH_DAYS))
    own = _on_days(facts, days)
    nodes = graph.node_mentions(own, day)
    edges = graph.stated_edges(own, day).unionByName(_near_calls(facts, own.withColumn("day", day), match_trace))
    systems = own.where("db_system <> ''").select(
        day, F.col("service_id").alias("node_id"), _first(("ord", "ord"), ("db_system", F.lower("db_system")))
    )
    folded = [
        _ordered(graph.earliest(m, "day", *key))
        for m, key in ((nodes, ["node_id"]), (edges, ["source_id", "target_id"]), (systems, ["node_id"]))
    ]
    marked = own.select(day).distinct() if days is None else spans.sparkSession.sql(
        f"SELECT explode(sequence(DATE '{days[0]}', DATE '{days[1]}')) AS day"
    )
    if known_nodes is not None:
        folded[0] = folded[0].unionByName(_seeds(known_nodes, marked, ["node_id"], folded[0])).groupBy("day", "node_id").agg(F.min("first").alias("first"))
    if known_edges is not None:
        folded[1] = folded[1].unionByName(_seeds(known_edges, marked, ["source_id", "target_id"], folded[1])).groupBy("day", "source_id", "target_id").agg(F.min("first").alias("first"))
    return Folds(*[f.unionByName(marked, allowMissingColumns=True) for f in folded])


def _near_calls(facts: DataFrame, children: DataFrame, match_trace: bool) -> DataFrame:
    """Calls by parent links, the parent at most ``REACH_DAYS`` days from the child.

    A span id that occurs on several days resolves to the last occurrence within reach.
    """
    trace = ["trace_id"] if match_trace else []
    # ids are hardly ever repeated, so nothing is gained by sorting them before the shuffle too
    ids = facts.select(
        *trace, F.col("span_id").alias("parent_span_id"), F.to_date("start_time").alias("parent_day"), "ord", F.col("service_id").alias("source_id")
    ).repartition(*trace, "parent_span_id")
    parents = ids.groupBy(*trace, "parent_span_id", "parent_day").agg(F.max(F.struct("ord", "source_id")).alias("p"))
    folded = graph.folded_children(children, "day", *trace)
    return (
        folded.join(parents, [*trace, "parent_span_id"])
        .where(F.abs(F.datediff("day", "parent_day")) <= REACH_DAYS)
        .groupBy("day", *trace, "parent_span_id", "target_id")
        .agg(F.max("p").alias("p"), F.min("first").alias("first"))
        .select("day", F.col("p.source_id").alias("source_id"), "target_id", "first")
        .where("source_id <> target_id")
    )


def _seeds(known: DataFrame, days: DataFrame, key: list[str], like: DataFrame) -> DataFrame:
    """Known rows for each folded day, in the form of the folds."""
    calendar = [r.day for r in days.distinct().collect()]  # bounded by the calendar
    fields = like.schema["first"].dataType.fields
    order = F.col("ord").cast(ORDER) if "ord" in known.columns else F.lit(0).cast(ORDER)
    first = F.struct(
        (order + F.lit(str(SEED_ORDER)).cast(ORDER)).cast(ORDER).alias("ord"),
        *[(F.col(f.name) if f.name in known.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields if f.name != "ord"],
    )
    if not calendar:
        return like.limit(0)
    return known.select(F.explode(F.array(*[F.lit(d) for d in calendar])).alias("day"), *key, first.alias("first"))


def store(folds: Folds, path: str) -> None:
    """Write the folds by day; a day that is folded again replaces what was stored for it."""
    spark = folds.nodes.sparkSession

    def write(name: str, table: DataFrame) -> None:
        # one task per day and slice: folds are small, yet a day with very many edges is no single file
        rows = table.repartition("day", F.pmod(F.hash(*[c for c in table.columns if c not in ("day", "first")]), F.lit(8)))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{path}/{name}")

    together(*[lambda n=n, t=t: write(n, t) for n, t in folds.tables().items()])


def load(spark: SparkSession, path: str) -> Folds:
    """Stored folds. ``day`` names folders, so a merge lists and reads only the days it needs."""
    if not exists(spark, f"{path}/nodes"):
        raise FileNotFoundError(f"{path}: no folds are stored here")
    return Folds(*[spark.read.schema(f"{columns}, day date").parquet(f"{path}/{name}") for name, columns in STORED.items()])


def incident_graphs(folds: Folds, inc: Incidents) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, systems), each with ``incident_id``: the graph of every incident from its own days."""
    p = inc.params
    own = inc.windows().select(
        "incident_id", F.date_sub(F.to_date("incident_start"), p.graph_lookback_days).alias("lo"), F.to_date("incident_end").alias("hi")
    )
    own = own.withColumn("stretch", F.concat_ws("/", "lo", "hi"))
    wanted = own.select("stretch", F.explode(F.sequence("lo", "hi")).alias("day")).distinct()
    wanted = inc.small(wanted, p.graph_lookback_days + 2 + p.window_seconds // 86400)
    literal = F.lit(False)
    for first, last in inc.stretches(p.graph_lookback_days * 86400, p.window_seconds):
        literal = literal | F.col("day").between(F.date_from_unix_date(F.lit(first)), F.date_from_unix_date(F.lit(last)))

    def merged(table: DataFrame) -> DataFrame:
        return table.where(literal).join(wanted, "day")

    nodes = durable(graph.first_nodes(merged(folds.nodes.where("node_id IS NOT NULL")), "stretch"), "stretch-nodes")
    edges = graph.first_edges(merged(folds.edges.where("source_id IS NOT NULL")), nodes, "stretch")
    systems = graph.earliest(merged(folds.systems.where("node_id IS NOT NULL")), "stretch", "node_id").select(
        "stretch", "node_id", "first.db_system"
    )
    incidents = inc.small(own.select("incident_id", "stretch"), 1)
    nodes, edges, systems = (incidents.join(t, "stretch").drop("stretch") for t in (nodes, edges, systems))
    return nodes, edges, systems

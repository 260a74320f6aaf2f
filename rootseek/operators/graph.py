"""Typed service dependency graph from spans.

"First discovery wins" is a minimum over (input order, fields) and not a
window. Mentions that differ in their order alone are folded first, by hash, so a
node or edge seen in most spans costs one row per map task and no span is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.incidents import Incidents, in_window, per_incident
from ..params import WRITE_OPERATIONS
from ..session import durable


def _attr(key: str) -> Column:
    return F.col("attributes")[key]


def _has(*keys: str) -> Column:
    found = F.lit(False)
    for key in keys:
        found = found | _attr(key).isNotNull()
    return found


def _filled(key: str) -> Column:
    return F.nullif(_attr(key), F.lit(""))


def call_facts(spans: DataFrame) -> DataFrame:
    """The narrow columns the graph needs, read from the attribute maps once.

    A span may name the dependency it calls (``target_id``, ``target_type``)
    and, by slightly different fields, the other end of an edge (``other_id``).
    All graph operators accept spans or this table; write it when several of
    them run over a large span table.
    """
    kind = F.col("kind")
    client, producer, consumer = kind == "client", kind == "producer", kind == "consumer"
    db = _has("db.system", "db.name", "db.namespace")
    queue = _has("messaging.system", "messaging.destination", "messaging.destination.name")
    target_type = (
        F.when(client & db, "database")
        .when(client & queue, "queue")
        .when(client & _has("peer.service"), "external_dep")
        .when(producer, "queue")
    )
    database_id = F.coalesce(_filled("db.name"), _filled("db.namespace"), F.concat("service_id", F.lit("-db")))
    queue_id = F.coalesce(
        _filled("messaging.destination"), _filled("messaging.destination.name"), F.lit("unknown-queue")
    )
    channel = F.coalesce(_attr("messaging.destination"), F.lit("unknown-queue"))
    callee = F.coalesce(_attr("db.name"), _attr("messaging.destination"), _attr("peer.service"))
    writes = F.upper(F.coalesce(_attr("db.operation"), F.lit(""))).isin(*WRITE_OPERATIONS)
    return spans.select(
        "trace_id",
        "span_id",
        "parent_span_id",
        "service_id",
        "kind",
        "start_time",
        "ord",
        target_type.alias("target_type"),
        F.when(target_type == "database", database_id)
        .when(target_type == "queue", queue_id)
        .when(target_type == "external_dep", _attr("peer.service"))
        .alias("target_id"),
        F.when(producer | consumer, channel).when(client, F.nullif(callee, F.lit(""))).alias("other_id"),
        F.when(producer, "publishes_to")
        .when(consumer, "subscribes_to")
        .when(_has("db.system") & writes, "writes_to")
        .when(_has("db.system"), "reads_from")
        .otherwise("calls")
        .alias("edge_type"),
        F.coalesce(_attr("http.scheme"), _attr("rpc.system"), F.lit("unknown")).alias("protocol"),
        _attr("db.system").alias("db_system"),
        _attr("db.version").alias("db_version"),
        _attr("messaging.system").alias("queue_system"),
        _filled("messaging.destination").alias("topic"),
        F.coalesce(_filled("server.address"), _filled("net.peer.name")).alias("address"),
        F.nullif(F.col("resource_attributes")["deployment.environment"], F.lit("")).alias("environment"),
    )


def _facts(spans: DataFrame) -> DataFrame:
    return spans if "other_id" in spans.columns else call_facts(spans)


def node_mentions(spans: DataFrame, *by: Column) -> DataFrame:
    """(by, node_id, first): every mention of a node, as a struct whose minimum is the earliest."""
    kind = F.col("m.node_type")
    when = lambda t, c: F.when(kind == t, c)
    own = F.col("target_id") == F.col("service_id")
    emitter = F.struct(
        F.lit(0).alias("sub"),
        F.col("service_id").alias("node_id"),
        F.when(own, F.col("target_type")).otherwise("service").alias("node_type"),
    )
    target = F.struct(
        F.lit(1).alias("sub"),
        F.col("target_id").alias("node_id"),
        F.col("target_type").alias("node_type"),
    )
    return (
        _facts(spans)
        .withColumn(
            "m",
            F.explode(
                F.when(F.col("target_id").isNotNull() & ~own, F.array(emitter, target)).otherwise(F.array(emitter))
            ),
        )
        .select(
            *by,
            F.col("m.node_id").alias("node_id"),
            F.struct(
                (F.col("ord") * 2 + F.col("m.sub")).alias("ord"),
                kind.alias("node_type"),
                when("database", F.coalesce("db_system", F.lit("unknown"))).alias("db_type"),
                when("database", F.col("db_version")).alias("db_version"),
                when("queue", F.coalesce("queue_system", F.lit("unknown"))).alias("queue_type"),
                when("external_dep", F.col("address")).alias("endpoint"),
                when("service", F.col("environment")).alias("env"),
                when("queue", F.array_compact(F.array("topic"))).alias("topics"),
            ).alias("first"),
        )
    )


def earliest(mentions: DataFrame, *key: str) -> DataFrame:
    """(key, first): the least ``first`` of each key, a struct that begins with ``ord``.

    A minimum of structs sorts its input. So mentions that differ in ``ord`` alone are
    folded before, by a minimum of numbers, which needs a hash table only.
    """
    names = [n for n in mentions.schema["first"].dataType.names if n != "ord"]
    alike = mentions.select(*key, F.col("first.ord").alias("_ord"), *[F.col(f"first.{n}").alias(f"_{n}") for n in names])
    folded = alike.groupBy(*key, *[f"_{n}" for n in names]).agg(F.min("_ord").alias("_ord"))
    first = F.struct(*[F.col(f"_{n}").alias(n) for n in ("ord", *names)])
    return folded.groupBy(*key).agg(F.min(first).alias("first"))


def first_nodes(mentions: DataFrame, *by: str) -> DataFrame:
    """One row per node; the earliest mention decides type and attributes."""
    return earliest(mentions, *by, "node_id").select(
        *by,
        "node_id",
        "first.node_type",
        "first.db_type",
        "first.db_version",
        "first.queue_type",
        "first.endpoint",
        "first.env",
        "first.topics",
        F.lit(False).alias("code_access_enabled"),
        F.lit(None).cast("string").alias("repo_url"),
        "first.ord",
    )


def discover_nodes(spans: DataFrame, known_nodes: DataFrame | None = None) -> DataFrame:
    """One row per node; the earliest mention decides type and attributes."""
    found = first_nodes(node_mentions(spans))
    if known_nodes is None:
        return found
    new = found.join(known_nodes, "node_id", "left_anti")
    return known_nodes.unionByName(new, allowMissingColumns=True)


def stated_edges(spans: DataFrame, *by: Column) -> DataFrame:
    """(by, source_id, target_id, first): edges that a span states by itself, before any existence check."""
    consumer = F.col("kind") == "consumer"
    return (
        spans.where("other_id IS NOT NULL AND other_id <> service_id")
        .select(
            *by,
            F.when(consumer, F.col("other_id")).otherwise(F.col("service_id")).alias("source_id"),
            F.when(consumer, F.col("service_id")).otherwise(F.col("other_id")).alias("target_id"),
            F.struct((F.col("ord") * 2).alias("ord"), "edge_type", "protocol").alias("first"),
        )
    )


def parent_calls(spans: DataFrame, match_trace: bool = False) -> DataFrame:
    """Calls between services implied by parent links.

    Children are folded to one row per parent and service before the join, so
    a parent with very many children does not overload one task. A span id
    that occurs twice resolves to its last occurrence.
    """
    trace = ["trace_id"] if match_trace else []
    spans = _facts(spans)
    # ids are hardly ever repeated, so nothing is gained by sorting them before the shuffle too
    ids = spans.select(*trace, F.col("span_id").alias("parent_span_id"), "service_id", "ord").repartition(*trace, "parent_span_id")
    parents = ids.groupBy(*trace, "parent_span_id").agg(F.max_by("service_id", "ord").alias("source_id"))
    children = folded_children(spans, *trace)
    return (
        children.join(parents, [*trace, "parent_span_id"])
        .where("source_id <> target_id")
        .select("source_id", "target_id", "first")
    )


def folded_children(spans: DataFrame, *by: str) -> DataFrame:
    """(by, parent_span_id, target_id, first): one row per parent, service and protocol, folded by hash."""
    return (
        spans.where("parent_span_id IS NOT NULL")
        .groupBy(*by, "parent_span_id", F.col("service_id").alias("target_id"), "protocol")
        .agg(F.min("ord").alias("_ord"))
        .select(
            *by, "parent_span_id", "target_id",
            F.struct((F.col("_ord") * 2 + 1).alias("ord"), F.lit("calls").alias("edge_type"), "protocol").alias("first"),
        )
    )


def first_edges(mentions: DataFrame, nodes: DataFrame, *by: str) -> DataFrame:
    """One row per (source, target) whose ends both are nodes; first mention wins."""
    ids = nodes.select(*by, "node_id")
    return (
        earliest(mentions, *by, "source_id", "target_id")
        .select(*by, "source_id", "target_id", "first.edge_type", "first.protocol", "first.ord")
        .join(ids.withColumnRenamed("node_id", "source_id"), [*by, "source_id"], "left_semi")
        .join(ids.withColumnRenamed("node_id", "target_id"), [*by, "target_id"], "left_semi")
        .select(*by, "source_id", "target_id", "edge_type", "protocol", "ord")
    )


def discover_edges(
    spans: DataFrame,
    nodes: DataFrame,
    known_edges: DataFrame | None = None,
    match_trace: bool = False,
) -> DataFrame:
    """One row per (source, target) between known nodes; first mention wins."""
    spans = _facts(spans)
    found = first_edges(stated_edges(spans).unionByName(parent_calls(spans, match_trace)), nodes)
    if known_edges is None:
        return found
    new = found.join(known_edges, ["source_id", "target_id"], "left_anti")
    return known_edges.unionByName(new, allowMissingColumns=True)


def with_service_config(nodes: DataFrame, service_config: DataFrame) -> DataFrame:
    """Copy code access and repository onto matching service nodes."""
    cfg = service_config.select(
        "node_id",
        F.col("code_access_enabled").alias("_access"),
        F.col("repo_url").alias("_repo"),
        F.lit(True).alias("_known"),
    )
    apply = F.col("_known") & (F.col("node_type") == "service")
    return (
        nodes.join(cfg, "node_id", "left")
        .withColumn(
            "code_access_enabled",
            F.when(apply, F.col("_access")).otherwise(F.col("code_access_enabled")),
        )
        .withColumn("repo_url", F.when(apply, F.col("_repo")).otherwise(F.col("repo_url")))
        .drop("_access", "_repo", "_known")
    )


def attach_changes(changes: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Changes on known services, and the misses with a reason."""
    types = nodes.select(F.col("node_id").alias("service_id"), "node_type")
    if per_incident(nodes):  # a service of any incident's graph; each incident looks at its own nodes later
        types = types.groupBy("service_id").agg(F.max_by("node_type", F.col("node_type") == "service").alias("node_type"))
    typed = changes.join(types, "service_id", "left")
    attached = typed.where("node_type = 'service'").drop("node_type")
    missed = typed.where("node_type IS NULL OR node_type <> 'service'").select(
        F.lit("changes").alias("source"),
        F.when(F.col("node_type").isNull(), "node not in graph")
        .otherwise(F.concat(F.lit("node is "), "node_type"))
        .alias("reason"),
        F.col("event_id").alias("raw"),
    )
    return attached, missed


def db_systems(spans: DataFrame) -> DataFrame:
    """First non-empty db.system a node's own spans carry, lower-cased."""
    value = F.col("db_system")
    return (
        _facts(spans).where("db_system <> ''")
        .groupBy(F.col("service_id").alias("node_id"), F.lower(value).alias("_system"))
        .agg(F.min("ord").alias("_ord"))
        .groupBy("node_id")
        .agg(F.min_by("_system", "_ord").alias("db_system"))
    )


def known_or_found_nodes(
    spans: DataFrame, service_config: DataFrame | None = None, known_nodes: DataFrame | None = None
) -> DataFrame:
    """The written node table."""
    nodes = discover_nodes(spans, known_nodes)
    if service_config is not None:
        nodes = with_service_config(nodes, service_config)
    return durable(nodes, "nodes")


def build_graph(
    spans: DataFrame,
    service_config: DataFrame | None = None,
    known_nodes: DataFrame | None = None,
    known_edges: DataFrame | None = None,
    match_trace: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges; a known topology, when given, wins over discovery."""
    nodes = known_or_found_nodes(spans, service_config, known_nodes)
    edges = durable(discover_edges(spans, nodes, known_edges, match_trace), "edges")
    return nodes, edges


def cyclic_edges(edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Edges left after peeling off nodes without callers; empty for a DAG.

    Each round removes every node that has no incoming edge, so the number of
    rounds is the depth of the graph. ``by``: columns that tell graphs apart;
    all of them are peeled together.
    """
    left = edges.select(*by, "source_id", "target_id")
    size = left.count()
    while size:
        called = left.select(*by, F.col("target_id").alias("source_id")).distinct()
        left = durable(left.join(called, [*by, "source_id"], "left_semi"), "peel")
        remaining = left.count()
        if remaining == size:
            break
        size = remaining
    return left


def has_cycle(edges: DataFrame) -> bool:
    return not cyclic_edges(edges).isEmpty()


def cyclic_incidents(spans: DataFrame, edges: DataFrame, inc: Incidents) -> DataFrame:
    """Incidents whose own graph has a cycle.

    That is the graph of the incident where ``edges`` has one for each, else
    the shared graph, cut to the nodes the incident's window mentions. Spans are read only if the shared graph has a cycle at all, and then only
    those of the windows.
    """
    if per_incident(edges):
        return cyclic_edges(edges, ("incident_id",)).select("incident_id").distinct()
    left = cyclic_edges(edges)
    if left.isEmpty():
        return inc.df.select("incident_id").limit(0)
    seen = (
        in_window(_facts(spans), "start_time", inc, 0, inc.params.window_seconds)
        .select("incident_id", F.explode(F.array("service_id", "target_id", "other_id")).alias("node_id"))
        .where("node_id IS NOT NULL")
        .distinct()
    )
    callers, callees = (seen.withColumnRenamed("node_id", c) for c in ("source_id", "target_id"))
    own = left.join(callers, "source_id").join(callees, ["incident_id", "target_id"])
    return cyclic_edges(own, ("incident_id",)).select("incident_id").distinct()

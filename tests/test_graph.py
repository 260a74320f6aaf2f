from datetime import timedelta

from build import START, Lake, rows
from rootseek.operators import graph, timeline


def test_nodes_by_attributes_and_first_mention(spark):
    lake = Lake()
    lake.span("shop", kind="client", attrs={"db.system": "postgresql"}, resource={"deployment.environment": "prod"})
    lake.span("shop", kind="client", attrs={"db.namespace": "ledger", "db.version": "15"})
    lake.span("shop", kind="client", attrs={"messaging.destination.name": "jobs", "messaging.system": "kafka"})
    lake.span("shop", kind="client", attrs={"peer.service": "stripe", "net.peer.name": "api.example"})
    lake.span("shop", kind="producer", attrs={})
    lake.span("worker", kind="consumer", attrs={"messaging.destination": "late"})
    lake.span("cache", kind="client", attrs={"db.name": "cache", "db.system": "redis"})
    lake.span("cache")
    lake.span("ledger")
    nodes = graph.discover_nodes(lake.tables(spark)["spans"])
    found = {r.node_id: r for r in nodes.collect()}
    assert {k: v.node_type for k, v in found.items()} == {
        "shop": "service", "shop-db": "database", "ledger": "database", "jobs": "queue", "stripe": "external_dep",
        "unknown-queue": "queue", "worker": "service", "cache": "database"}
    assert (found["shop"].env, found["shop-db"].db_type, found["ledger"].db_type, found["ledger"].db_version) == ("prod", "postgresql", "unknown", "15")
    assert (found["jobs"].queue_type, found["jobs"].topics, found["stripe"].endpoint) == ("kafka", [], "api.example")
    assert [r.node_id for r in nodes.orderBy("ord").collect()][:3] == ["shop", "shop-db", "ledger"]


def test_edges_need_both_ends_and_first_mention_wins(spark):
    lake = Lake()
    lake.span("shop", kind="client", attrs={"db.system": "mysql", "db.name": "orders", "db.operation": "insert"})
    lake.span("shop", kind="client", attrs={"db.system": "mysql", "db.name": "orders"})
    lake.span("shop", kind="client", attrs={"db.system": "mysql"})                       # synthetic node, no edge
    lake.span("shop", kind="client", attrs={"db.namespace": "ledger"})                   # node, no edge
    lake.span("shop", kind="producer", attrs={"messaging.destination": "jobs", "rpc.system": "amqp"})
    lake.span("worker", kind="consumer", attrs={"messaging.destination": "jobs"})
    lake.span("orphan", kind="consumer", attrs={"messaging.destination": "nowhere"})      # no such node
    lake.span("front", span_id="p")
    lake.span("shop", parent="p", attrs={"http.scheme": "https"})
    lake.span("front", parent="p")
    lake.span("x", parent="lost")
    t = lake.tables(spark)
    nodes = graph.discover_nodes(t["spans"])
    edges = graph.discover_edges(t["spans"], nodes)
    assert rows(edges, "source_id", "target_id", "edge_type", "protocol") == [
        ("front", "shop", "calls", "https"), ("jobs", "worker", "subscribes_to", "unknown"),
        ("shop", "jobs", "publishes_to", "amqp"), ("shop", "orders", "writes_to", "unknown")]


def test_known_topology_wins(spark):
    lake = Lake()
    lake.span("a", span_id="p")
    lake.span("b", parent="p")
    spans = lake.tables(spark)["spans"]
    known_nodes = spark.createDataFrame([("b", "queue", -1)], "node_id string, node_type string, ord bigint")
    known_edges = spark.createDataFrame([("a", "b", "depends_on", "x", -1)], "source_id string, target_id string, edge_type string, protocol string, ord bigint")
    nodes, edges = graph.build_graph(spans, known_nodes=known_nodes, known_edges=known_edges)
    assert rows(nodes, "node_id", "node_type") == [("a", "service"), ("b", "queue")]
    assert rows(edges, "edge_type") == [("depends_on",)]


def test_parent_ids_may_be_matched_per_trace(spark):
    lake = Lake()
    lake.span("a", span_id="p", trace="t1")
    lake.span("b", span_id="p", trace="t2")
    lake.span("c", parent="p", trace="t1")
    spans = lake.tables(spark)["spans"]
    assert rows(graph.parent_calls(spans), "source_id") == [("b",)]
    assert rows(graph.parent_calls(spans, match_trace=True), "source_id") == [("a",)]


def test_changes_attach_to_services_only(spark):
    lake = Lake()
    lake.span("svc", kind="client", attrs={"db.name": "db"})
    for service in ("svc", "db", "ghost"):
        lake.change("deploy", service, 5)
    t = lake.tables(spark)
    attached, missed = graph.attach_changes(t["changes"], graph.discover_nodes(t["spans"]))
    assert rows(attached, "service_id") == [("svc",)]
    assert rows(missed, "reason") == [("node is database",), ("node not in graph",)]


def test_cycles_are_found(spark):
    edge = "source_id string, target_id string"
    dag = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c")], edge)
    assert not graph.has_cycle(dag)
    looped = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("c", "d")], edge)
    assert {("b", "c"), ("c", "b")} <= set(rows(graph.cyclic_edges(looped), "source_id", "target_id"))


def test_causal_depth(spark):
    lake = Lake()
    for i in range(9):
        lake.span("n", span_id=f"c{i}", parent=f"c{i - 1}" if i else None)
    lake.span("n", span_id="lost", parent="gone")
    lake.span("n", span_id="x", parent="y")
    lake.span("n", span_id="y", parent="x")
    lake.span("n", span_id="z", parent="y")
    depths = dict(rows(timeline.causal_depths(lake.tables(spark)["spans"]), "span_id", "depth"))
    assert depths == {**{f"c{i}": i for i in range(9)}, "lost": 0, "x": 999, "y": 999, "z": 999}


def test_timelines(spark):
    lake = Lake()
    lake.span("root", span_id="r")
    late = lake.span("svc", parent="r", error=True, start=START + timedelta(seconds=9))
    early = lake.span("svc", parent="r", error=True, start=START + timedelta(seconds=3))
    lake.span("svc", parent="r")
    lake.span("deep", parent=late)
    t = lake.tables(spark)
    lines = timeline.node_timelines(timeline.causal_events(t["spans"]))
    got = {r.node_id: r for r in lines.collect()}
    assert (got["svc"].first_error_span_id, got["svc"].first_error_depth, got["svc"].error_span_count, got["svc"].is_likely_origin) == (early, 1, 2, True)
    assert got["deep"].causal_position == 2.0 and not got["root"].is_likely_origin
    sick = spark.createDataFrame([("svc",), ("root",)], "node_id string")
    assert [r.node_id for r in timeline.origin_candidates(lines, sick).collect()] == ["svc"]
    assert timeline.trace_totals(t["spans"]).first().span_count == 5

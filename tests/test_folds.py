"""Daily graph folds, graphs per incident, and tables stored by day."""

import glob
import os
import shutil
from datetime import timedelta

import pytest
from build import START, Lake, rows
from rootseek import schemas
from rootseek.functions.incidents import Incidents, in_window
from rootseek.operators import graph, graphfold
from rootseek.params import Params
from rootseek.plans.analyze import analyze
from rootseek.sources import lake as stored

DAY = timedelta(days=1)
NODE = ("node_id", "node_type", "db_type", "queue_type", "endpoint", "env")
EDGE = ("source_id", "target_id", "edge_type", "protocol")


def week():
    """Three days of calls; types, protocols and links differ from day to day."""
    lake = Lake()
    for d in (-2, -1, 0):
        at = START + d * DAY
        root = lake.span("web", at, trace=f"t{d}", attrs={"http.scheme": "http" if d else "https"}, resource={"deployment.environment": f"e{d}"})
        lake.span("shop", at, parent=root, trace=f"t{d}")
        if d == -2:
            lake.span("shop", at, kind="client", attrs={"db.name": "old", "db.system": "MySQL"})
            lake.span("old-job", at, parent=root)
        if d == -1:
            lake.span("shop", at, kind="producer", attrs={"messaging.destination": "q"})
            lake.span("worker", at, kind="consumer", attrs={"messaging.destination": "q"})
        if d == 0:
            lake.span("shop", at, kind="client", attrs={"db.name": "new", "db.system": "Redis", "db.operation": "insert"})
            lake.span("worker", at, kind="client", attrs={"peer.service": "pay", "server.address": "x"})
    # over midnight: the parent is on the day before
    late = lake.span("cron", START.replace(hour=23, minute=59) - DAY)
    lake.span("night", START.replace(hour=0, minute=1), parent=late)
    # beyond reach: two days
    far = lake.span("far-parent", START - 2 * DAY)
    lake.span("far-child", START, parent=far)
    return lake


def graphs(spark, folds, lake, **params):
    inc = Incidents.of(lake.tables(spark)["incidents"], Params(**params))
    nodes, edges, systems = graphfold.incident_graphs(folds, inc)
    return nodes, edges, systems


def test_graph_of_all_days_equals_direct_discovery(spark):
    lake = week()
    lake.incident("i")
    spans = lake.tables(spark)["spans"]
    nodes, edges, systems = graphs(spark, graphfold.fold(spans), lake)
    plain = graph.discover_nodes(spans)
    assert rows(nodes, *NODE) == rows(plain, *NODE)
    direct = rows(graph.discover_edges(spans, plain), *EDGE)
    assert ("far-parent", "far-child", "calls", "unknown") in direct and ("cron", "night", "calls", "unknown") in direct
    assert rows(edges, *EDGE) == [e for e in direct if e[0] != "far-parent"]
    assert rows(systems, "node_id", "db_system") == rows(graph.db_systems(spans), "node_id", "db_system")


def test_each_incident_has_the_graph_of_its_days(spark):
    lake = week()
    for i, d in enumerate((-2, -1, 0, 0)):
        lake.incident(f"i{i}", START + d * DAY)
    spans = lake.tables(spark)["spans"]
    nodes, edges, _ = graphs(spark, graphfold.fold(spans), lake, graph_lookback_days=0)
    got = {}
    for r in edges.collect():
        got.setdefault(r.incident_id, set()).add((r.source_id, r.target_id))
    assert got["i0"] == {("web", "shop"), ("web", "old-job"), ("shop", "old")}
    assert got["i1"] == {("web", "shop"), ("shop", "q"), ("q", "worker")}
    # one end of the call over midnight is not among the day's nodes
    assert got["i2"] == got["i3"] == {("web", "shop"), ("shop", "new"), ("worker", "pay")}
    assert {(r.incident_id, r.env) for r in nodes.where("node_id = 'web'").collect()} == {("i0", "e-2"), ("i1", "e-1"), ("i2", "e0"), ("i3", "e0")}
    _, edges, _ = graphs(spark, graphfold.fold(spans), lake, graph_lookback_days=1)
    assert {(r.source_id, r.target_id) for r in edges.where("incident_id = 'i2'").collect()} == got["i1"] | got["i2"] | {("cron", "night")}
    assert {r.protocol for r in edges.where("incident_id = 'i2' AND source_id = 'shop' AND target_id = 'new'").collect()} == {"unknown"}


def test_folding_by_day_and_again(spark, tmp_path):
    """Days folded one by one, in any order and twice, are the fold of all; a day that lost its spans is emptied."""
    lake = week()
    lake.incident("i")
    spans = lake.tables(spark)["spans"]
    path = str(tmp_path / "folds")
    names = [str((START + d * DAY).date()) for d in (0, -2, -1, -2)]
    for day in names:
        graphfold.store(graphfold.fold(spans, (day, day)), path)
    a, b = (graphfold.incident_graphs(f, Incidents.of(lake.tables(spark)["incidents"])) for f in (graphfold.load(spark, path), graphfold.fold(spans)))
    assert rows(a[0], *NODE, "ord") == rows(b[0], *NODE, "ord") and rows(a[1], *EDGE, "ord") == rows(b[1], *EDGE, "ord")
    graphfold.store(graphfold.fold(spans.limit(0), (names[0], names[0])), path)
    left = graphfold.incident_graphs(graphfold.load(spark, path), Incidents.of(lake.tables(spark)["incidents"]))[1]
    assert ("shop", "new") not in rows(left, "source_id", "target_id") and ("shop", "q") in rows(left, "source_id", "target_id")
    with pytest.raises(FileNotFoundError):
        graphfold.load(spark, str(tmp_path / "nothing"))


def test_known_topology_wins_in_folds(spark):
    lake = week()
    lake.incident("i")
    spans = lake.tables(spark)["spans"]
    nodes = spark.createDataFrame([("shop", "queue"), ("only-known", "service")], "node_id string, node_type string")
    edges = spark.createDataFrame([("web", "shop", "depends_on", "known")], "source_id string, target_id string, edge_type string, protocol string")
    found, calls, _ = graphs(spark, graphfold.fold(spans, known_nodes=nodes, known_edges=edges), lake)
    types = dict(rows(found, "node_id", "node_type"))
    assert types["shop"] == "queue" and types["only-known"] == "service" and types["web"] == "service"
    assert ("web", "shop", "depends_on", "known") in rows(calls, *EDGE)
    with pytest.raises(ValueError, match="known"):
        t = lake.tables(spark)
        analyze(t["incidents"], spans, t["metrics"], t["changes"], known_nodes=nodes, folds=graphfold.fold(spans))


def sick(lake, start, name, cause, dependent):
    """An incident in which ``cause`` fails after a deploy and ``dependent`` calls it."""
    lake.incident(name, start)
    for i in range(3):
        at = start + timedelta(seconds=20 + i)
        root = lake.span(dependent, at, error=True, trace=f"{name}-{i}", http=500)
        lake.span(cause, at, error=True, parent=root, trace=f"{name}-{i}", http=500, exceptions=[("ValueError", "m", None)])
    lake.series(cause, start, error=1.0, error_now=60.0)
    lake.series(dependent, start, error=1.0, error_now=40.0)
    lake.change("deploy", cause, 5, start)


def outcome(a):
    return (
        rows(a.results, "incident_id", "verdict", "root_cause_node", "confidence", "iterations_run"),
        rows(a.candidates, "incident_id", "node_id", "inclusion_reason", "causal_rank", "is_potential_origin"),
        rows(a.evidence, "incident_id", "node_id", "signal", "strength"), rows(a.hints, "incident_id", "node_id", "signal", "direction"),
    )


def test_analysis_reads_folds_and_its_window_only(spark, tmp_path):
    """With the spans of all other days gone, and garbage in their place, the analysis is the same."""
    lake = Lake()
    year = START - timedelta(days=365)
    sick(lake, START, "now", "db-proxy", "shop")
    sick(lake, year, "then", "shop", "db-proxy")  # calls the other way round: together they would be a cycle
    for d in range(1, 5):
        lake.span("other", START - d * DAY)
        root = lake.span("shop", START - d * DAY, trace=f"x{d}")
        lake.span("cart", START - d * DAY, parent=root, trace=f"x{d}")
    t = lake.tables(spark)
    spans_at, folds_at = str(tmp_path / "spans"), str(tmp_path / "folds")
    stored.store_by_day(t["spans"], "start_time", spans_at)
    graphfold.store(graphfold.fold(stored.read_by_day(spark, spans_at)), folds_at)
    apart = [analyze(t["incidents"].where(f"incident_id = '{i}'"), t["spans"].where(f"start_time {op} '2023-07-01'"), t["metrics"], t["changes"]) for i, op in (("now", ">"), ("then", "<"))]
    want = [sorted(x, key=repr) for x in map(lambda p: p[0] + p[1], zip(*map(outcome, apart)))]

    def run():
        return outcome(analyze(t["incidents"], stored.read_by_day(spark, spans_at, schemas.SPANS), t["metrics"], t["changes"], folds=graphfold.load(spark, folds_at)))

    first = run()
    assert [sorted(x, key=repr) for x in first] == want
    assert {r[:3] for r in first[0]} == {("now", "top_hypotheses", "db-proxy"), ("then", "top_hypotheses", "shop")}
    for folder in glob.glob(f"{spans_at}/day=*"):
        if not folder.endswith((str(START.date()), str(year.date()))):
            for file in glob.glob(f"{folder}/*.parquet"):
                os.remove(file)
            with open(f"{folder}/part-0.parquet", "wb") as bad:
                bad.write(b"not parquet")
    for name in ("nodes", "edges", "systems"):  # nor are folds of other times read
        spare = f"{folds_at}/{name}/day=2020-01-01"
        os.makedirs(spare)
        with open(f"{spare}/part-0.parquet", "wb") as bad:
            bad.write(b"not parquet")
    assert run() == first
    # shared by all incidents, the two graphs make a cycle
    shared = analyze(t["incidents"], t["spans"], t["metrics"], t["changes"])
    assert rows(shared.results, "incident_id", "iterations_run") == [("now", 0), ("then", 0)]


def test_two_far_incidents_read_two_days(spark, tmp_path):
    lake = Lake()
    starts = [START, START - timedelta(days=365)]
    for i, s in enumerate(starts):
        lake.incident(f"i{i}", s)
    for d in range(0, 400, 5):
        lake.metric("a", "error_rate", d, START - d * DAY)
    t = lake.tables(spark)
    path = str(tmp_path / "metrics")
    stored.store_by_day(t["metrics"], "timestamp", path)
    inc = Incidents.of(t["incidents"])
    assert [b - a for a, b in inc.stretches(0, 300)] == [1, 1]
    for folder in glob.glob(f"{path}/day=*"):
        if not folder.endswith(tuple(str(s.date()) for s in starts)):
            shutil.copy(__file__, f"{folder}/part-0.parquet")
            os.remove(glob.glob(f"{folder}/part-*-*.parquet")[0])
    got = in_window(stored.read_by_day(spark, path, schemas.METRICS), "timestamp", inc, 0, 300)
    assert rows(got, "incident_id", "value") == [("i0", 0.0), ("i1", 365.0)]
    assert stored.fetch_metrics(stored.read_by_day(spark, path, schemas.METRICS), "2024-01-01 00:00:00", "2024-01-01 13:00:00").count() == 1


def test_bounds_stay_few(spark):
    lake = Lake()
    for i in range(300):
        lake.incident(f"i{i}", START + timedelta(days=3 * i))
    inc = Incidents.of(lake.tables(spark)["incidents"])
    found = inc.stretches(0, 300)
    assert len(found) <= 100 and all(any(a <= d <= b for a, b in found) for d in inc.days)


def test_storing_a_day_again_replaces_it(spark, tmp_path):
    lake = Lake()
    lake.metric("a", "error_rate", 1, START)
    lake.metric("a", "error_rate", 2, START - DAY)
    path = str(tmp_path / "metrics")
    metrics = lake.tables(spark)["metrics"]
    stored.store_by_day(metrics, "timestamp", path)
    stored.store_by_day(metrics.where("value = 1").selectExpr("* except (value)", "CAST(7 AS DOUBLE) AS value"), "timestamp", path)
    assert rows(stored.read_by_day(spark, path), "value") == [(2.0,), (7.0,)]

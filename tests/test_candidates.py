from datetime import timedelta

from build import START, Lake, rows
from rootseek.functions.incidents import Incidents
from rootseek.operators import localize as loc, spanwindow
from rootseek.operators import series

EDGE = "source_id string, target_id string, ord bigint"


def signals_of(spark, lake, changes_on=()):
    t = lake.tables(spark)
    inc = Incidents.of(t["incidents"])
    stats = series.series_stats(series.metric_cells(t["metrics"], inc), inc)
    summary = spanwindow.span_summary(spanwindow.span_window(t["spans"], inc), inc)
    return spanwindow.node_signals(summary, stats, spanwindow.changed_nodes(t["changes"], t["commits"], inc))


def hints_of(spark, lake, edges, suspect="cand", known=("cand",)):
    ranked = spark.createDataFrame([("i", suspect, 1)], "incident_id string, node_id string, causal_rank int")
    seen = spark.createDataFrame([("i", k) for k in known], "incident_id string, node_id string")
    links = spark.createDataFrame([(*e, n) for n, e in enumerate(edges)], EDGE)
    got = loc.neighbour_hints(ranked, links, signals_of(spark, lake), seen, 1)
    return {(r.node_id, r.direction): (r.signal, r.hint_strength, r.reason) for r in got.collect()}


def test_each_hint_signal(spark):
    lake = Lake()
    lake.incident("i")
    late = START + timedelta(seconds=301)
    lake.span("cand", error=True)
    lake.span("e503", attrs={"http.status_code": "503"})
    lake.span("e429", attrs={"http.status_code": "", "http.response.status_code": "429"})
    lake.span("both", attrs={"http.status_code": "429"})
    lake.span("both", attrs={"http.status_code": "503"})
    lake.span("slow", error=True, attrs={"error.type": "ReadTimeoutError"})
    lake.span("nofall", attrs={"http.status_code": "bad", "http.response.status_code": "503"})
    lake.span("silent", attrs={"http.status_code": "200"})
    lake.span("caller200", attrs={"http.status_code": "200"})
    lake.span("changed", error=True)
    lake.change("deploy", "changed", 10)
    lake.span("old", error=True)
    lake.change("deploy", "old", 90)
    lake.span("plain", error=True)
    lake.metric("plain", "error_rate", 1.0, START)
    lake.change("feature_flag", "moving", 60)
    lake.metric("moving", "latency_p99", 1.0, START + timedelta(seconds=300))
    lake.span("outside", error=True, start=late)
    lake.span("quiet")
    succ = ["e503", "e429", "both", "slow", "nofall", "silent", "changed", "old", "plain", "moving", "outside", "quiet"]
    got = hints_of(spark, lake, [("cand", s) for s in succ] + [("caller200", "cand"), ("changed", "cand"), ("cand", "cand")])
    kinds = {k: v[:2] for k, v in got.items()}
    assert kinds == {
        ("e503", "successor"): ("error_code_pattern", "strong"), ("e429", "successor"): ("error_code_pattern", "strong"),
        ("both", "successor"): ("error_code_pattern", "strong"), ("slow", "successor"): ("error_code_pattern", "strong"),
        ("silent", "successor"): ("silent_degradation", "strong"), ("changed", "successor"): ("change_event", "strong"),
        ("changed", "predecessor"): ("change_event", "strong"), ("old", "successor"): ("missing_telemetry", "moderate"),
        ("plain", "successor"): ("span_errors", "moderate"), ("moving", "successor"): ("sub_threshold_metric", "moderate")}
    assert got["both", "successor"][2] == "both: status 429/503"
    assert got["slow", "successor"][2] == "slow: failed connections"


def test_known_neighbours_give_no_hint(spark):
    lake = Lake()
    lake.incident("i")
    lake.span("cand", error=True)
    lake.span("seen", error=True)
    assert hints_of(spark, lake, [("cand", "seen")], known=("cand", "seen")) == {}


def test_candidates_their_reason_and_origin(spark):
    nodes = spark.createDataFrame(
        [("a", "service", 1), ("b", "service", 2), ("c", "database", 3), ("h", "queue", 4), ("k", "service", 5)],
        "node_id string, node_type string, ord bigint")
    anomalies = spark.createDataFrame(
        [("i", "c", "latency_p99", 5.0, 9), ("i", "a", "error_rate", 20.0, 8), ("i", "a", "latency_p99", 4.0, 7), ("i", "ghost", "error_rate", 9.0, 1),
         ("i", "b", "saturation", 9.0, 2)],
        "incident_id string, node_id string, metric_type string, z_score double, cur_ord bigint")
    changed = spark.createDataFrame([("i", "a"), ("i", "b"), ("i", "c"), ("i", "k")], "incident_id string, node_id string")
    base = loc.base_candidates(anomalies, changed, nodes)
    hints = spark.createDataFrame(
        [("i", "h", 2, "successor", 5), ("i", "b", 1, "predecessor", 1)],
        "incident_id string, node_id string, suggesting_rank int, direction string, edge_ord bigint")
    edges = spark.createDataFrame([("a", "b", 1), ("b", "h", 2), ("h", "k", 3)], EDGE)
    known = spark.createDataFrame([("i", "k")], "incident_id string, node_id string")
    got = loc.localize(base.unionByName(loc.hint_candidates(hints)), nodes, edges, known).orderBy("place").collect()
    assert [(r.node_id, r.inclusion_reason, r.is_potential_origin) for r in got] == [
        ("a", "metric_anomaly", False), ("c", "metric_anomaly", True), ("b", "change_event", False), ("h", "investigation_hint", False)]
    assert rows(loc.unplaced(base, nodes), "raw") == [("ghost",)]


def test_ranking_breaks_ties_by_inclusion(spark):
    nodes = spark.createDataFrame([(n, "service", i) for i, n in enumerate("abcd")], "node_id string, node_type string, ord bigint")
    changed = spark.createDataFrame([("i", n) for n in "dcba"], "incident_id string, node_id string")
    empty = spark.createDataFrame([], "incident_id string, node_id string, metric_type string, z_score double, cur_ord bigint")
    edges = spark.createDataFrame([], EDGE)
    cands = loc.localize(loc.base_candidates(empty, changed, nodes), nodes, edges, None)
    scores = spark.createDataFrame([("i", "a", 0.1), ("i", "b", 0.5), ("i", "c", 0.5), ("i", "d", 0.5)], "incident_id string, node_id string, causal_confidence double")
    inc = Incidents.of(spark.createDataFrame([("i", START, 3)], "incident_id string, incident_start timestamp, top_k int"))
    assert rows(loc.rank_candidates(cands, scores, inc), "causal_rank", "node_id") == [(1, "b"), (2, "c"), (3, "d")]

import json

import pytest

from build import rows
from rootseek.operators import graph
from rootseek.sources import changes, commits, lake, metrics, records, traces
from rootseek.streaming.ingest import ingest_stream, store_stream


def raw(spark, items):
    texts = [(x if isinstance(x, str) else json.dumps(x), i) for i, x in enumerate(items)]
    return spark.createDataFrame(texts, "raw string, ord bigint")


def metric(**kw):
    base = dict(node_id="checkout", node_type="service", metric_type="error_rate", value=1.5,
                timestamp="2024-01-01T10:00:00Z", window_seconds=60, unit="percent")
    base.update(kw)
    return {k: v for k, v in base.items() if v != "DROP"}


def test_metrics_keep_good_rows_and_name_the_fault(spark):
    bad = {
        "non-numeric value": metric(value="NaN"), "unknown metric_type": metric(metric_type="gpu_utilization"),
        "invalid node_id": metric(node_id=""), "negative value": metric(value=-0.01),
        "bad timestamp": metric(timestamp="2024-01-01 10:00:00"), "window_seconds must be positive": metric(window_seconds=0),
        "missing window_seconds": metric(window_seconds="DROP"), "unknown node_type": metric(node_type="vm_instance"),
        "not an object": [1], "invalid unit": metric(unit=5), "non-finite value": metric(value="1e999"),
    }
    extra = [metric(value=True), metric(window_seconds=True), metric(window_seconds="60.7"), "{truncated", metric(timestamp=5), 7]
    good, rejects = metrics.ingest_metrics(
        raw(spark, [metric(), *bad.values(), *extra, metric(node_id="billing-queue", node_type="queue", value=15400.0)])
    )
    assert rows(good, "node_id", "value") == [("billing-queue", 15400.0), ("checkout", 1.5)]
    assert set(bad) <= {r["reason"] for r in rejects.collect()}
    assert rejects.count() == len(bad) + len(extra)


def test_metric_values_given_as_text_and_fractions(spark):
    items = [metric(value="842.5"), metric(value=" 7 "), metric(value="1d"), metric(window_seconds=60.7), metric(window_seconds="60"),
             metric(timestamp="2024-01-01T10:00:00.123456Z"), metric(value=60.0), metric(window_seconds=60.0)]
    good, _ = metrics.ingest_metrics(raw(spark, items))
    assert rows(good, "ord", "value", "window_seconds") == [
        (0, 842.5, 60), (1, 7.0, 60), (3, 1.5, 60), (4, 1.5, 60), (5, 1.5, 60), (6, 60.0, 60), (7, 1.5, 60)]
    strict, _ = metrics.ingest_metrics(raw(spark, items), strict=True)
    assert [r[0] for r in rows(strict, "ord")] == [5, 6]


def kv(key, **value):
    return {"key": key, "value": value}


def span(span_id, start=1704103200000000000, end=1704103205200000000, **kw):
    base = dict(traceId="t1", spanId=span_id, parentSpanId="", name="POST /checkout", kind=2, startTimeUnixNano=str(start),
                endTimeUnixNano=str(end), attributes=[kv("http.status_code", intValue="504")], status={"code": 2}, events=[])
    base.update(kw)
    return {k: v for k, v in base.items() if v != "DROP"}


def trace(*spans, resource=None):
    return {"resourceSpans": [{"resource": {"attributes": resource if resource is not None else [kv("service.name", stringValue="checkout")]},
                               "scopeSpans": [{"spans": list(spans)}]}]}


def test_spans_are_normalised(spark):
    record = trace(
        span("root", attributes=[kv("http.status_code", stringValue="x"), kv("http.response.status_code", intValue=504), kv("b", boolValue=True),
                                 kv("d", doubleValue=0.5), kv("k", stringValue="1"), kv("k", stringValue="2"), kv("", stringValue="x"), kv("z")],
             events=[{"name": "exception", "timeUnixNano": "5", "attributes": [kv("exception.type", stringValue="ConnectionPoolTimeout")]}]),
        span("child", parentSpanId="root", kind=99, status="DROP", name="DROP", attributes=[]),
        resource=[kv("service.name", stringValue=""), kv("service.instance.id", stringValue="inst-1"), kv("service.version", stringValue="2.4.1")],
    )
    good, bad = traces.ingest_traces(raw(spark, [record]), strict=True)
    root, child = good.orderBy("ord").collect()
    assert bad.count() == 0
    assert (root.service_id, root.kind, root.http_status_code, root.duration_ms, root.parent_span_id) == ("inst-1", "server", 504, 5200.0, None)
    assert root.attributes == {"http.status_code": "x", "http.response.status_code": "504", "b": "true", "d": "0.5", "k": "2"}
    assert root.events[0].attributes == {"exception.type": "ConnectionPoolTimeout"}
    assert (child.parent_span_id, child.kind, child.otel_status_code, child.operation_name) == ("root", "internal", 0, "unknown")
    flags = {r.span_id: r for r in traces.span_predicates(good).collect()}
    assert flags["root"].is_error and flags["root"].is_server_error and flags["root"].is_root and flags["root"].service_version == "2.4.1"
    assert not flags["child"].is_root and not flags["child"].is_client_error


def test_nanoseconds_are_cut_to_microseconds(spark):
    good, _ = traces.ingest_traces(raw(spark, [trace(span("a", start=1706181191000000999, end=1706181191000001999))]))
    r = good.selectExpr("unix_micros(start_time) AS a", "unix_micros(end_time) AS b", "duration_ms").first()
    assert (r.a, r.b, r.duration_ms) == (1706181191000000, 1706181191000001, 0.001)


def test_bad_spans_and_traces_are_rejected(spark):
    bad_spans = [span(""), span("b", traceId=""), span("c", startTimeUnixNano="DROP"), span("d", endTimeUnixNano="soon"),
                 span("e", end=1704103199000000000), span("f", attributes=[kv("n", intValue="x")]), 7, span("g", attributes=[5])]
    shapes = [{"status": "x"}, {"resourceSpans": []}, {"resourceSpans": [{"resource": {}}]}, {"resourceSpans": [{"scopeSpans": [{}]}]}, 5, "{"]
    keep = trace(span("ok", kind=5), resource=[])
    records = [trace(*bad_spans, span("kept", kind=99)), keep, *shapes]
    good, bad = traces.ingest_traces(raw(spark, records), strict=True)
    assert rows(good, "span_id", "service_id", "kind") == [("kept", "checkout", "internal"), ("ok", "unknown-service", "consumer")]
    assert sorted(r.reason for r in bad.collect()) == sorted([
        "empty spanId", "empty traceId", "missing timestamp", "unparseable timestamp", "end before start", "bad attribute", "not an object",
        "bad attribute", "missing resourceSpans", "resourceSpans must be a non-empty list", "resourceSpans entry without scopeSpans",
        "scopeSpans entry without spans", "not an object", "malformed JSON"])
    mixed = {"resourceSpans": [{"resource": {}}, trace(span("late"))["resourceSpans"][0]]}
    assert [r.span_id for r in traces.ingest_traces(raw(spark, [mixed]))[0].collect()] == ["late"]
    spoiled = trace(span("x"), resource=[kv("n", intValue="abc")])
    assert traces.ingest_traces(raw(spark, [spoiled]))[0].count() == 0


def test_records_and_spans_are_read_in_one_walk(spark):
    plan = traces.tagged_traces(raw(spark, [trace(span("a"))]), strict=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "$.traceId" not in plan and "$.events" not in plan  # no walk for each field
    assert plan.count("StructField(traceId") <= 1 and plan.count("parse_json") + plan.count("parseJson") <= 1


def test_lists_of_odd_types_are_told_apart(spark):
    of = lambda spans: {"resourceSpans": [{"scopeSpans": [{"spans": spans}]}]}
    records = [of(None), of(5), {"resourceSpans": [7]}, {"resourceSpans": [{"scopeSpans": [7]}]}, {"resourceSpans": [{"scopeSpans": 5}]}, of([None]),
               {"resourceSpans": [{"resource": 5, "scopeSpans": [{"spans": [span("kept", kind="3", status={"code": "2"}, attributes={}, events=7)]}]}]}]
    good, bad = traces.ingest_traces(raw(spark, records), strict=True)
    assert rows(good, "span_id", "kind", "otel_status_code", "attributes", "events") == [("kept", "client", 2, {}, [])]
    assert sorted(r.reason for r in bad.collect()) == [
        "not an object", "resourceSpans entry without scopeSpans", "resourceSpans entry without scopeSpans", "scopeSpans entry without spans"]


DEPLOY = dict(event_type="deploy", event_id="deploy-aaaa1111", service_id="pay", timestamp="2024-01-01T10:00:00Z", version="2.4.1",
              author="", tags={"n": 5, "b": True, "x": None})
CONFIG = dict(event_type="config_change", event_id="cfg-1", service_id="pay", timestamp="2024-01-01T10:00:00Z", change_type="update",
              key="DB_POOL_MAX_CONNECTIONS", old_value=60, new_value=40)
FLAG = dict(event_type="feature_flag", event_id="ff-1", service_id="pay", timestamp="2024-01-01T10:00:00Z", flag_key="new-payment-retry-path",
            old_value=False, new_value=True)


def test_changes_are_normalised(spark):
    good, bad = changes.ingest_changes(raw(spark, [DEPLOY, CONFIG, FLAG, {**FLAG, "old_value": None, "new_value": "on", "tags": 5}]), strict=True)
    d, c, f, g = good.orderBy("ord").collect()
    assert bad.count() == 0
    assert (d.version, d.deploy_scope, d.author, d.tags) == ("2.4.1", ["pay"], None, {"n": "5", "b": "True", "x": "None"})
    assert (c.key, c.old_value, c.new_value, c.deploy_scope) == ("DB_POOL_MAX_CONNECTIONS", "60", "40", None)
    assert (f.key, f.old_value, f.new_value) == ("new-payment-retry-path", "False", "True")
    assert (g.old_value, g.new_value, g.tags) == ("None", "on", {})


def test_bad_changes_are_rejected(spark):
    bad = [{**DEPLOY, "service_id": ""}, {k: v for k, v in DEPLOY.items() if k != "version"}, {**DEPLOY, "timestamp": "yesterday"},
           {**DEPLOY, "deploy_scope": "all"}, {**DEPLOY, "event_type": "rollback"}, {k: v for k, v in CONFIG.items() if k != "key"},
           {k: v for k, v in DEPLOY.items() if k != "event_type"}, "text", {**FLAG, "event_id": 0}]
    good, rejects = changes.ingest_changes(raw(spark, [DEPLOY, *bad]))
    assert [r.event_id for r in good.collect()] == ["deploy-aaaa1111"]
    assert sorted(r.reason for r in rejects.collect()) == sorted([
        "missing service_id", "missing version", "bad timestamp", "deploy_scope must be a list", "unknown event_type", "missing key",
        "missing event_type", "not an object", "missing event_id"])
    numbered = {**DEPLOY, "event_id": 7}
    assert changes.ingest_changes(raw(spark, [numbered]))[0].first().event_id == "7"
    assert changes.ingest_changes(raw(spark, [numbered]), strict=True)[0].count() == 0


def test_change_members_are_read_in_one_walk(spark):
    plan = changes.tagged_changes(raw(spark, [DEPLOY]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("transform_values(") <= 2  # of the tags, written out twice; the record itself makes no map
    odd = [{**CONFIG, "old_value": 0.0, "new_value": [1, None]}, {**DEPLOY, "deploy_scope": [True, None, 5], "version": 2.50}, None, [], {**FLAG, "other": {"a": 1}}]
    good, bad = changes.ingest_changes(raw(spark, odd))
    assert rows(good, "ord", "version", "old_value", "new_value", "deploy_scope") == [
        (0, None, "0", "[1,null]", None), (1, "2.5", None, None, ["True", "None", "5"]), (4, None, "False", "True", None)]
    assert [r.reason for r in bad.collect()] == ["not an object"] * 2


def test_change_records_round_trip(spark):
    good, _ = changes.ingest_changes(raw(spark, [{**DEPLOY, "diff_summary": "d"}, CONFIG, FLAG]))
    again, bad = changes.ingest_changes(changes.to_records(good))
    assert bad.count() == 0
    assert again.orderBy("ord").collect() == good.orderBy("ord").collect()


def test_commits_and_push_payloads(spark):
    meta = dict(event_id="e", commit_sha="s", timestamp="2024-01-01T10:00:00+0200", repo_url="u", branch="b")
    items = [(json.dumps(m), "svc", i) for i, m in enumerate([meta, {**meta, "timestamp": "now"}, {**meta, "branch": ""}, {**meta, "timestamp": "2024-01-01T10:00:00.5Z"}])]
    good, bad = commits.ingest_commits(spark.createDataFrame(items, "raw string, service_id string, ord bigint"))
    assert [r.t for r in good.orderBy("ord").selectExpr("CAST(timestamp AS STRING) AS t").collect()] == ["2024-01-01 08:00:00", "2024-01-01 10:00:00.5"]
    assert sorted(r.reason for r in bad.collect()) == ["bad timestamp", "missing branch"]
    github = {"ref": "refs/heads/fix/a", "after": "", "head_commit": {"id": "0123456789abcdef", "message": "m", "timestamp": "2024-01-01T10:00:00Z"},
              "repository": {"html_url": "h"}}
    one = commits.ingest_push(spark.createDataFrame([(json.dumps(github), "svc", 0), ("{}", "svc", 1)], "raw string, service_id string, ord bigint"), "github")
    r = one[0].first()
    assert (r.event_id, r.branch, r.author, one[1].count()) == ("github-0123456789ab", "fix/a", None, 1)
    with pytest.raises(ValueError):
        commits.ingest_push(one[0], "other")


def test_files_hold_one_record_or_many(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([metric(), metric(node_id="b")]))
    (tmp_path / "b.json").write_text(json.dumps(metric(node_id="c")))
    (tmp_path / "c.json").write_text('{"node_id": "trunc')
    (tmp_path / "d.json").write_text("42")
    (tmp_path / "e.json").write_text("[]")
    good, bad = metrics.ingest_metrics(records.json_files(spark, str(tmp_path)), strict=True)
    assert [r[0] for r in rows(good, "node_id")] == ["b", "c", "checkout"]
    assert bad.count() == 0


def test_bounded_fetch_is_half_open_and_pushed_down(spark, tmp_path):
    good, _ = metrics.ingest_metrics(raw(spark, [metric(timestamp=f"2024-01-01T10:0{i}:00Z", node_id=f"n{i % 2}") for i in range(5)]))
    good.write.parquet(str(tmp_path / "m"))
    got = lake.fetch_metrics(spark.read.parquet(str(tmp_path / "m")), "2024-01-01 10:01:00", "2024-01-01 10:03:00")
    assert [r[0] for r in rows(got, "ord")] == [1, 2]
    assert "PushedFilters: [IsNotNull(timestamp), GreaterThanOrEqual(timestamp" in got._jdf.queryExecution().toString()
    assert [r[0] for r in rows(lake.fetch_metrics(good, "2024-01-01 10:00:00", "2024-01-01 10:03:00", "n0"), "ord")] == [0, 2]


def test_a_stream_of_files_uses_the_same_rules(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.txt").write_text("\n".join([json.dumps(metric()), json.dumps(metric(value=-1)), "{"]))
    q = ingest_stream(spark, str(tmp_path / "in"), metrics.ingest_metrics, str(tmp_path / "good"), str(tmp_path / "bad"), "metrics")
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "good")).count() == 1
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 2


def test_orders_of_late_partitions_and_batches_stay_apart(spark):
    late = (1_000_000 << 33) + 5  # the sixth row of partition 1,000,000
    record = json.dumps(trace(span("a"), span("b")))
    rows_in = [(record, late), (record, late + 1)]
    good, _ = traces.ingest_traces(spark.createDataFrame(rows_in, "raw string, ord bigint"))
    orders = [r.ord for r in good.orderBy("ord").collect()]
    assert len(set(orders)) == 4 and orders == sorted(orders)
    nodes, _ = graph.build_graph(good)
    assert nodes.count() >= 1
    row = spark.range(1).select(records.record_order(3).alias("later"), records.record_order(2).alias("sooner")).first()
    assert row.later > row.sooner + (1 << 62)


def test_paths_without_files_have_no_records(spark, tmp_path):
    for read in (records.json_lines, records.json_files):
        assert read(spark, str(tmp_path / "none*.json")).count() == 0


def test_good_rows_and_rejects_come_from_one_pass(spark, tmp_path):
    """The stored table holds what the two sides of an ingest hold; its plan reads the records once."""
    one = {"traceId": "t", "spanId": "s", "startTimeUnixNano": "1000000", "endTimeUnixNano": "3000000"}
    given_traces = [
        {"resourceSpans": [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "a"}}]}, "scopeSpans": [{"spans": [one, {**one, "spanId": ""}, 7]}]},
                           {"scopeSpans": [{"spans": [{**one, "spanId": "u"}]}, {"spans": []}]}]},
        {"other": 1}, [1], {"resourceSpans": []},
        {"resourceSpans": [{"resource": {"attributes": [{"key": "k", "value": {"intValue": "x"}}]}, "scopeSpans": [{"spans": [one]}]}]},
    ]
    sample = {"node_id": "n", "node_type": "service", "metric_type": "error_rate", "value": 1, "timestamp": "2024-01-01T00:00:00Z", "window_seconds": 60, "unit": "u"}
    change = {"event_type": "deploy", "event_id": "e", "service_id": "s", "timestamp": "2024-01-01T00:00:00Z", "version": "1"}
    cases = {
        "traces": (traces.tagged_traces, traces.ingest_traces, traces.COLUMNS, [json.dumps(x) for x in given_traces] + ["{", None], {True: (2, 8), False: (2, 6)}),
        "metrics": (metrics.tagged_metrics, metrics.ingest_metrics, metrics.COLUMNS, [json.dumps(x) for x in (sample, {**sample, "value": -1}, {**sample, "unit": 3}, 5)], {True: (1, 3), False: (1, 3)}),
        "changes": (changes.tagged_changes, changes.ingest_changes, changes.COLUMNS, [json.dumps(x) for x in (change, {**change, "version": ""}, {"event_type": "x"})], {True: (1, 2), False: (1, 2)}),
    }
    for name, (tag, ingest, columns, raw, counts) in cases.items():
        given = spark.createDataFrame([(r, i) for i, r in enumerate(raw)], "raw string, ord long")
        for strict, (n_good, n_bad) in counts.items():
            path = str(tmp_path / f"{name}-{strict}")
            table = tag(given, strict)
            plan = table._jdf.queryExecution().optimizedPlan().toString()
            assert plan.count("LogicalRDD") == 1 and "Union" not in plan
            assert records.store(table, path) == {"good": n_good, "rejected": n_bad}
            good, bad = records.stored(spark, path, columns)
            for side, same in zip((good, bad), ingest(given, strict)):
                text = lambda df: sorted(str(r.asDict(True)) for r in df.collect())
                assert side.columns == same.columns and text(side) == text(same)
    assert records.store(cases["metrics"][0](given.limit(0)), str(tmp_path / "none")) == {"good": 0, "rejected": 0}


def test_stream_into_one_table(spark, tmp_path):
    lines = ['{"node_id": "n", "node_type": "service", "metric_type": "error_rate", "value": 2, "timestamp": "2024-01-01T00:00:00Z", "window_seconds": 60, "unit": "u"}', "broken"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(lines))
    for _ in range(2):  # a second run finds nothing new
        q = store_stream(spark, str(tmp_path / "in"), metrics.tagged_metrics, str(tmp_path / "out"), "metrics")
        q.awaitTermination()
    good, bad = records.stored(spark, str(tmp_path / "out"), metrics.COLUMNS)
    assert [(r.node_id, r.value) for r in good.collect()] == [("n", 2.0)] and [(r.source, r.raw) for r in bad.collect()] == [("metrics", "broken")]

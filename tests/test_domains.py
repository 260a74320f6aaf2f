from build import START, Lake, rows
from rootseek.functions.incidents import Incidents
from rootseek.operators import domains, graph, series, service, spanwindow

DB = {"db.system": "postgresql", "db.statement": "SELECT 1"}


def prepare(spark, lake):
    t = lake.tables(spark)
    inc = Incidents.of(t["incidents"])
    window = spanwindow.span_window(t["spans"], inc)
    return t, inc, window, spanwindow.span_summary(window, inc), series.series_stats(series.metric_cells(t["metrics"], inc), inc)


def ids(spark, *names):
    return spark.createDataFrame([("i", n) for n in names], "incident_id string, node_id string")


def edges_of(spark, *pairs):
    return spark.createDataFrame([(*p, i) for i, p in enumerate(pairs)], "source_id string, target_id string, ord bigint")


def test_database_rules(spark):
    lake = Lake()
    lake.incident("i")
    # integrity error; the message is the first non-empty one
    lake.span("broken", error=True, attrs={**DB, "db.statement": "INSERT a"}, exceptions=[("Timeout", "t", None), ("UniqueViolation", "", None)])
    lake.span("broken", error=True, attrs={**DB, "db.statement": "INSERT a"}, exceptions=[("UniqueViolation", "dup key", None)])
    lake.span("broken", attrs={**DB, "db.statement": "SELECT slow"}, ms=900)
    # slow: latency spike and a slow statement
    lake.series("slow", START, error=1.0, latency=10.0, factor=12.0)
    lake.span("slow", attrs={**DB, "db.statement": "SELECT big"}, ms=400)
    lake.span("slow", error=True, attrs={**DB, "db.statement": "SELECT small"}, ms=20)
    # slow by one long span alone, no metrics
    lake.span("longspan", attrs=DB, ms=150)
    # exhausted connections: errors here, timeouts at callers
    lake.span("full", error=True, attrs=DB)
    lake.span("full", attrs=DB)
    for caller, kind in (("c1", "ReadTimeout"), ("c2", "PoolExhausted"), ("c3", "ConnectionPoolTimeout"), ("c4", "ValueError")):
        lake.span(caller, exceptions=[(kind, "m", None), ("ValueError", "", None), ("ValueError", "", None)])
    # errors without caller timeouts
    lake.span("unsure", error=True, attrs=DB)
    # cache and unknown systems
    lake.span("cache", error=True, attrs={"db.system": "Redis"})
    lake.series("cache", START, latency=10.0, factor=4.0, error=1.0)
    lake.span("cache2", error=True, attrs={"db.system": "memcached"})
    lake.span("odd", error=True, attrs={"db.system": "postgres"})
    lake.series("odd", START, latency=10.0, factor=9.0, error=1.0)
    t, inc, window, summary, stats = prepare(spark, lake)
    names = ("broken", "slow", "longspan", "full", "unsure", "cache", "cache2", "odd", "ghost")
    edges = edges_of(spark, ("c4", "full"), ("c2", "full"), ("c1", "full"), ("c3", "full"), ("c1", "slow"))
    facts = domains.database_facts(ids(spark, *names), window, summary, stats, graph.db_systems(t["spans"]), edges, inc)
    evidence = domains.database_evidence(facts, inc)
    kinds = {r.node_id: (r.failure_type, r.priority_score) for r in domains.database_findings(facts, evidence, inc).collect()}
    assert kinds == {
        "broken": ("db_error", 0.15), "slow": ("db_slow_query", 0.15), "longspan": ("db_slow_query", 0.05),
        "full": ("db_connection_exhaustion", 0.15), "unsure": ("unknown", 0.05), "cache": ("db_slow_query", 0.15), "cache2": ("db_error", 0.15),
        "odd": ("unknown", 0.05), "ghost": ("unknown", 0.05)}
    shown = {}
    for r in evidence.orderBy("node_id", "section", "item").collect():
        shown.setdefault(r.node_id, []).append((r.signal, r.strength))
    assert shown["broken"] == [("db_integrity_error", "strong"), ("error_rate_spike", "strong"), ("db_statement", "weak")]
    assert shown["slow"] == [("latency_spike", "strong"), ("slow_query", "strong"), ("error_rate_spike", "strong")]
    assert shown["longspan"] == [("slow_query", "moderate")]
    assert shown["full"] == [("connection_exhaustion", "strong"), ("caller_timeout", "moderate"), ("caller_timeout", "moderate"), ("error_rate_spike", "strong")]
    assert shown["unsure"] == [("missing_telemetry", "moderate")]
    assert shown["cache"] == [("latency_spike", "strong"), ("error_rate_spike", "strong")]
    assert shown["cache2"] == [("error_rate_spike", "strong")]
    assert shown["odd"] == [("latency_spike", "moderate"), ("error_rate_spike", "moderate")]
    assert shown["ghost"] == [("missing_telemetry", "moderate")]
    items = {(r.node_id, r.signal, r["item"]): r for r in evidence.collect()}
    assert items["broken", "db_integrity_error", 0].metadata["exception_message"] == "dup key"
    assert items["full", "caller_timeout", 1].metadata["caller_node_id"] == "c2" and items["full", "caller_timeout", 2].metadata["caller_node_id"] == "c1"
    assert items["ghost", "missing_telemetry", 0].finding == "little is recorded of ghost: 0 spans and no metrics"
    assert items["cache2", "error_rate_spike", 0].metadata["z_score"] == "100.0"


def test_dependency_rules(spark):
    lake = Lake()
    lake.incident("i")
    for svc in ("a", "b"):
        lake.span(svc, error=True, attrs={"peer.service": "down", "http.status_code": "503"})
    lake.span("a", attrs={"peer.service": "down", "http.status_code": "500"})
    lake.span("a", attrs={"peer.service": "limited", "http.status_code": "429"})
    lake.span("a", error=True, attrs={"peer.service": "lagging", "error.type": "CONNECTION_RESET"})
    lake.span("b", attrs={"peer.service": "fine", "http.status_code": "200"})
    t, inc, window, *_ = prepare(spark, lake)
    edges = edges_of(spark, ("a", "down"), ("b", "down"), ("a", "limited"), ("a", "lagging"), ("b", "lagging"), ("b", "fine"))
    facts = domains.dependency_facts(ids(spark, "down", "limited", "lagging", "fine", "unseen"), window, edges, inc)
    assert rows(domains.dependency_findings(facts, inc), "node_id", "failure_type", "priority_score") == [
        ("down", "upstream_outage", 0.15), ("fine", "external_dep_failure", 0.0), ("lagging", "timeout", 0.05), ("limited", "rate_limited", 0.05),
        ("unseen", "external_dep_failure", 0.0)]
    evidence = domains.dependency_evidence(facts, inc)
    assert rows(evidence, "node_id", "signal", "strength") == [
        ("down", "all_callers_affected", "strong"), ("down", "http_error_pattern", "strong"), ("fine", "all_callers_affected", "moderate"),
        ("lagging", "all_callers_affected", "moderate"), ("limited", "all_callers_affected", "moderate"), ("unseen", "all_callers_affected", "weak"),
        ("unseen", "missing_telemetry", "moderate")]
    http = evidence.where("signal = 'http_error_pattern'").first()
    assert http.finding == "2 of 3 calls to down came back as 503 within 5 min"


STACK = 'File "src/risk.py", line 47, in evaluate'
LIKELY = '{"causal_assessment": "likely", "reasoning": "removed the null check", "signals": ["s1", "s2"]}'
UNLIKELY = '{"causal_assessment": "unlikely", "reasoning": "unrelated"}'


def examine(spark, lake, *names):
    """Findings and ordered evidence of service candidates."""
    t, inc, window, *_ = prepare(spark, lake)
    nodes = graph.with_service_config(graph.discover_nodes(t["spans"]), t["config"])
    cands = ids(spark, *names)
    facts = service.code_facts(cands, window, t["changes"], nodes, inc, t["commits"], t["functions"], t["replies"])
    settings = service.setting_changes(cands, t["changes"], inc)
    both = service.code_evidence(facts, inc).unionByName(service.config_evidence(facts, settings, inc, t["replies"]))
    verdicts = service.arbitrate(facts, settings, both, inc)
    merged = service.merge_engines(both, verdicts)
    found = {r.node_id: r for r in verdicts.collect()}
    shown = {}
    for r in merged.orderBy("node_id", "engine_pos", "section", "item").collect():
        shown.setdefault(r.node_id, []).append(r)
    return found, shown


def test_service_rules(spark):
    lake = Lake()
    lake.incident("i")
    fn = [("src/risk.py", "evaluate", 45, "old", "new")]

    def code(name, minutes=10, event=None, **kw):
        lake.access(name, kw.get("access", True))
        lake.span(name, error=True, op="eval", exceptions=[("NPE", "null", kw.get("stack", STACK))])
        lake.change("deploy", name, 10, event_id=f"d-{name}", diff="removed null check")
        lake.commit(name, minutes, event or f"cc-{name}", deploy=kw.get("deploy"), functions=fn)
        lake.reply("i", name, "code_match", event or f"cc-{name}", kw.get("reply", LIKELY))

    lake.span("deployed")
    lake.change("deploy", "deployed", 20)
    lake.change("deploy", "deployed", 10, version="v2")
    lake.change("deploy", "deployed", 40)
    lake.span("thrower", error=True, exceptions=[(None, "x", None), ("KeyError", "k" * 200, None)])
    lake.span("flagged", error=True)
    lake.change("feature_flag", "flagged", 3, key="retry")
    lake.span("mixed")
    lake.change("deploy", "mixed", 10)
    lake.change("feature_flag", "mixed", 3)
    lake.change("config_change", "mixed", 12)
    lake.span("quiet")
    lake.change("config_change", "quiet", 16)
    lake.span("tuned")
    lake.change("config_change", "tuned", 10)
    code("gun")
    code("nolikely", reply=UNLIKELY)
    code("filematch", stack='File "src/risk.py", line 900, in other')
    code("noaccess", access=False)
    code("early", minutes=31)
    code("otherdeploy", deploy="d-else")
    code("samedeploy", deploy="d-samedeploy", reply="unusable")
    lake.reply("i", "samedeploy", "deploy_exception", "d-samedeploy", UNLIKELY)
    lake.span("asked")
    for i in range(5):
        lake.change("config_change" if i < 2 else "feature_flag", "asked", 14, event_id=f"q{i}")
        lake.reply("i", "asked", "setting_change", f"q{i}", LIKELY if i % 2 else UNLIKELY)
    names = ["deployed", "thrower", "flagged", "mixed", "quiet", "tuned", "gun", "nolikely", "filematch", "noaccess", "early", "otherdeploy",
             "samedeploy", "asked"]
    found, shown = examine(spark, lake, *names)
    signals = {k: [(r.signal, r.strength) for r in v] for k, v in shown.items()}
    of = lambda n: (found[n].domain, found[n].failure_type, found[n].priority_score)

    assert of("deployed") == ("application_code", "code_regression", 0.2)
    assert signals["deployed"] == [("deploy_in_window", "strong")]
    assert shown["deployed"][0].finding == "version v2 went live on deployed, 10 min ahead of the incident"
    assert of("thrower") == ("application_code", "runtime_error", 0.0)
    assert signals["thrower"] == [("exception_in_spans", "moderate"), ("degraded_operation", "weak"), ("no_deploy_in_window", "weak")]
    assert shown["thrower"][0].finding == "KeyError raised in thrower: " + "k" * 120
    assert shown["thrower"][1].finding == "op fails in 100% of its calls"
    assert of("flagged") == ("configuration", "feature_flag_regression", 0.2)
    assert signals["flagged"] == [("feature_flag_change", "strong"), ("post_change_errors", "moderate"), ("degraded_operation", "weak"), ("no_deploy_in_window", "weak")]
    assert shown["flagged"][0].finding == "flag retry of flagged: False -> True, 3 min ahead of the incident"
    assert of("mixed") == ("application_code", "code_regression", 0.2) and found["mixed"].both_strong
    assert signals["mixed"] == [("feature_flag_change", "strong"), ("config_change", "moderate"), ("simultaneous_change", "moderate"), ("deploy_in_window", "strong")]
    assert shown["mixed"][2].metadata["both_strong"] == "true"
    assert of("quiet") == ("application_code", "application_error", 0.0)
    assert signals["quiet"] == [("no_deploy_in_window", "weak")]
    assert of("tuned") == ("configuration", "config_regression", 0.0)
    assert of("gun") == ("application_code", "code_regression", 0.95) and found["gun"].smoking_gun
    assert [s for s, _ in signals["gun"]] == ["deploy_in_window", "exception_in_spans", "stacktrace_match", "llm_case_b_analysis", "degraded_operation"]
    assert shown["gun"][2].finding == "a stack trace leads to evaluate, src/risk.py line 47 [exact_line]"
    assert shown["gun"][3].metadata == {"assessment": "likely", "function": "evaluate", "match_type": "exact_line", "signals": "s1, s2"}
    assert ("llm_case_b_analysis", "weak") in signals["nolikely"] and not found["nolikely"].smoking_gun
    assert ("stacktrace_match", "weak") in signals["filematch"] and not found["filematch"].smoking_gun
    assert "llm_case_b_analysis" not in dict(signals["filematch"])
    for n in ("noaccess", "early", "otherdeploy"):
        assert "stacktrace_match" not in dict(signals[n])
    assert ("stacktrace_match", "strong") in signals["samedeploy"] and ("llm_causal_assessment", "weak") in signals["samedeploy"]
    assert [s for s in signals["asked"] if s[0] == "llm_config_assessment"] == [
        ("llm_config_assessment", "weak"), ("llm_config_assessment", "strong"), ("llm_config_assessment", "weak")]

"""End to end: four incident scenarios and some edge cases in shared tables."""

from datetime import timedelta

import pytest

from build import START, Lake, rows
from rootseek.operators import graph
from rootseek.plans.analyze import analyze
from rootseek.sources import results

LIKELY = '{"causal_assessment": "likely", "reasoning": "the null check was removed", "signals": ["s"]}'
DAY = timedelta(days=1)


def bad_deploy(lake, start, p):
    """checkout -> payment -> fraud; a deploy of fraud throws."""
    for i, svc in enumerate(("checkout", "payment", "fraud")):
        lake.series(p + svc, start, error=1.0, latency=100.0, rate=50.0, factor=8.5, error_now=85.0)
    a = lake.span(p + "checkout", start + timedelta(seconds=5), error=True)
    b = lake.span(p + "payment", start + timedelta(seconds=6), error=True, parent=a)
    lake.span(p + "fraud", start + timedelta(seconds=7), error=True, parent=b,
              exceptions=[("NullPointerException", "user", "at com.acme.Risk.evaluate(Risk.java:46)")])
    lake.change("deploy", p + "fraud", 10, start, event_id=p + "dep", diff="removed null check")
    lake.commit(p + "fraud", 10, p + "cc", start, functions=[("src/Risk.java", "evaluate", 45, "o", "n")])
    lake.access(p + "fraud")


def slow_database(lake, start, p):
    for svc in ("checkout", "payment", "pg"):
        lake.series(p + svc, start, error=1.0, latency=100.0, factor=12.0, error_now=70.0)
    a = lake.span(p + "checkout", start + timedelta(seconds=5), error=True)
    b = lake.span(p + "payment", start + timedelta(seconds=6), error=True, parent=a)
    lake.span(p + "pg", start + timedelta(seconds=7), error=True, parent=b, kind="client", ms=1200,
              attrs={"db.system": "postgresql", "db.name": p + "pg", "db.statement": "SELECT * FROM t"})


def external_outage(lake, start, p):
    for svc in ("checkout", "payment", "stripe"):
        lake.series(p + svc, start, error=1.0, latency=100.0, factor=6.0, error_now=90.0)
    a = lake.span(p + "checkout", start + timedelta(seconds=5), error=True)
    lake.span(p + "payment", start + timedelta(seconds=6), error=True, parent=a, kind="client",
              attrs={"peer.service": p + "stripe", "http.status_code": "503"})


def flag_flip(lake, start, p):
    for svc in ("checkout", "payment", "fraud"):
        lake.series(p + svc, start, error=1.0, latency=100.0, factor=4.0, error_now=75.0)
    a = lake.span(p + "checkout", start + timedelta(seconds=5), error=True)
    b = lake.span(p + "payment", start + timedelta(seconds=6), error=True, parent=a)
    lake.span(p + "fraud", start + timedelta(seconds=7), error=True, parent=b, exceptions=[("RuleError", "x", None)])
    lake.change("feature_flag", p + "fraud", 3, start)


def two_causes(lake, start, p):
    for svc in ("api", "pg"):
        lake.series(p + svc, start, error=1.0, latency=100.0, factor=9.0, error_now=80.0)
    a = lake.span(p + "api", start + timedelta(seconds=5), error=True, exceptions=[("Err", "x", None)])
    lake.span(p + "pg", start + timedelta(seconds=7), error=True, parent=a, kind="client", ms=900,
              attrs={"db.system": "mysql", "db.name": p + "pg", "db.statement": "SELECT 1"})
    lake.change("deploy", p + "api", 5, start)
    lake.change("config_change", p + "api", 4, start)


def hinted(lake, start, p):
    """Only the caller is anomalous; the silent callee is found by a hint."""
    lake.series(p + "front", start, error=1.0, latency=100.0, factor=9.0, error_now=80.0)
    a = lake.span(p + "front", start + timedelta(seconds=5), error=True)
    lake.span(p + "back", start + timedelta(seconds=6), parent=a, attrs={"http.status_code": "200"})


SCENARIOS = [bad_deploy, slow_database, external_outage, flag_flip, two_causes, hinted]


def fill(which):
    lake = Lake()
    for i, build in enumerate(SCENARIOS):
        start = START + i * DAY
        build(lake, start, f"{build.__name__}-")
        if build in which:
            lake.incident(build.__name__, start)
    if "calm" in which:
        lake.incident("calm", START + 30 * DAY)
    lake.reply("bad_deploy", "bad_deploy-fraud", "code_match", "bad_deploy-cc", LIKELY)
    lake.reply("bad_deploy", "bad_deploy-fraud", "deploy_exception", "bad_deploy-dep", LIKELY)
    return lake


def run(spark, lake):
    t = lake.tables(spark)
    return analyze(t["incidents"], t["spans"], t["metrics"], t["changes"], commits=t["commits"], functions=t["functions"],
                   service_config=t["config"], replies=t["replies"])


@pytest.fixture(scope="module")
def analysis(spark):
    return run(spark, fill([*SCENARIOS, "calm"]))


def test_verdicts(analysis):
    got = {r.incident_id: r for r in analysis.results.collect()}
    short = {k: (r.verdict, r.root_cause_node, r.root_cause_domain, r.confidence) for k, r in got.items()}
    assert short["bad_deploy"] == ("root_cause_found", "bad_deploy-fraud", "application_code", 0.95)
    assert short["slow_database"] == ("root_cause_found", "slow_database-pg", "database", 0.95)
    assert short["external_outage"] == ("root_cause_found", "external_outage-stripe", "dependency", 0.70)
    assert short["flag_flip"] == ("root_cause_found", "flag_flip-fraud", "configuration", 0.75)
    assert short["two_causes"][0] == "multi_factor" and len(got["two_causes"].root_cause_ids) == 2
    assert got["two_causes"].residual_unexplained == 0.5
    assert got["two_causes"].multi_factor_explanation.startswith("two causes: ")
    assert short["calm"] == ("no_root_cause_found", None, None, 0.0)
    assert (got["calm"].iterations_run, got["calm"].data_quality, got["calm"].narrative) == (1, "low", "")
    assert got["bad_deploy"].data_quality == "high"
    assert got["hinted"].iterations_run == 2 and short["hinted"][0] == "top_hypotheses"


def test_candidates_and_invariants(analysis):
    by = {}
    for r in analysis.candidates.collect():
        by.setdefault(r.incident_id, []).append(r)
        assert 0 <= r.causal_confidence <= 1 and 0 <= r.domain_confidence <= 0.95 and 0 <= r.fit <= 1
    for rows_ in by.values():
        assert sorted(r.score_rank for r in rows_) == list(range(1, len(rows_) + 1))
    hinted_rows = {r.node_id: r for r in by["hinted"]}
    assert hinted_rows["hinted-back"].inclusion_reason == "investigation_hint" and hinted_rows["hinted-back"].iteration == 2
    pay = [r for r in by["bad_deploy"] if r.node_id == "bad_deploy-fraud"][0]
    assert pay.is_potential_origin and pay.failure_type == "code_regression"
    keys = rows(analysis.hints, "incident_id", "suggesting_node_id", "node_id", "direction")
    assert len(keys) == len(set(keys))


def test_narratives_and_requests(analysis):
    text = {r.incident_id: r for r in analysis.narratives.collect()}
    assert "Root cause: flag_flip-fraud (service)" in text["flag_flip"].narrative_prompt
    assert "1. feature_flag_change: flag " in text["flag_flip"].narrative_prompt
    assert "1. [STRONG] feature_flag_change" in text["flag_flip"].fix_prompt and "2. " not in text["flag_flip"].fix_prompt
    assert "Confidence: 75%" in text["flag_flip"].fix_prompt and "calm" not in text
    asked = {(r.service_id, r.kind): r.message for r in analysis.requests.collect()}
    assert "OLD CODE:\no\n" in asked["bad_deploy-fraud", "code_match"]
    assert "Error pattern: RuleError" in asked["flag_flip-fraud", "setting_change"]


def test_many_incidents_equal_single_runs(spark, analysis):
    cols = ["incident_id", "node_id", "score_rank", "iteration", "domain", "failure_type", "domain_confidence"]
    together = [r for r in rows(analysis.candidates, *cols)]
    for one in (bad_deploy, hinted):
        alone = run(spark, fill([one]))
        assert rows(alone.candidates, *cols) == [r for r in together if r[0] == one.__name__]


def test_results_are_stored_found_and_updated(spark, analysis, tmp_path):
    path = str(tmp_path / "results")
    docs = results.documents(analysis, 12)
    results.store(docs, path)
    one = results.lookup(spark, path, "flag_flip").first()
    assert (one.root_cause_node, one.span_count, one.has_root_cause) == ("flag_flip-fraud", 12, True)
    assert [c.rank for c in one.root_causes] == list(range(1, min(3, len(one.all_candidates)) + 1))
    assert one.all_candidates[0].evidence[0].signal == "feature_flag_change"
    assert results.lookup(spark, path, "nope").count() == 0
    from pyspark.sql import functions as F

    results.store(docs.where("incident_id = 'calm'").withColumn("narrative", F.lit("again")), path)
    assert results.lookup(spark, path, "calm").first().narrative == "again"
    assert spark.read.parquet(path).count() == docs.count()
    short = {r.incident_id: r for r in results.summaries(docs).collect()}
    assert (short["flag_flip"].top_candidate, short["calm"].top_candidate) == ("flag_flip-fraud", None)
    notes = spark.createDataFrame(
        [("calm", True, "first", START), ("calm", False, "last", START + DAY), ("nope", True, "x", START)],
        "incident_id string, correct boolean, notes string, submitted_at timestamp")
    rated, unknown = results.with_feedback(docs, notes)
    assert rated.where("incident_id = 'calm'").first().feedback.notes == "last"
    assert rows(unknown, "raw") == [("nope",)]


def test_a_cycle_fails_only_the_incident_that_sees_it(spark):
    lake = Lake()
    hinted(lake, START, "")
    hinted(lake, START + 3 * DAY, "later-")
    lake.span("x", span_id="xa")
    lake.span("y", span_id="yb", parent="xa")
    lake.span("x", parent="yb")
    lake.incident("busy", START)
    lake.incident("later", START + 3 * DAY)
    lake.incident("calm", START + 9 * DAY)
    t = lake.tables(spark)
    assert graph.has_cycle(graph.build_graph(t["spans"])[1])
    got = {r.incident_id: r for r in analyze(t["incidents"], t["spans"], t["metrics"], t["changes"]).results.collect()}
    assert (got["busy"].verdict, got["busy"].narrative, got["busy"].iterations_run, got["busy"].data_quality) == (
        "no_root_cause_found", "not analysed: the call graph of this incident has a cycle", 0, "low")
    assert got["later"].narrative == "" and got["later"].iterations_run > 0
    assert (got["calm"].narrative, got["calm"].iterations_run) == ("", 1)


def test_stored_ids_come_back_as_they_were(spark, tmp_path):
    path = str(tmp_path / "store")
    ids = ["0012", "12", "2024-01-01", "a/b"]
    results.store(spark.createDataFrame([(i, i) for i in ids], "incident_id string, narrative string"), path)
    for i in ids:
        assert [tuple(r) for r in results.lookup(spark, path, i).collect()] == [(i, i)]
    results.store(spark.createDataFrame([("12", "new")], "incident_id string, narrative string"), path)
    assert sorted(map(tuple, results.stored(spark, path).collect())) == [("0012", "0012"), ("12", "new"), ("2024-01-01", "2024-01-01"), ("a/b", "a/b")]

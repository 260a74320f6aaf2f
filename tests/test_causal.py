import random

from build import rows
from rootseek.functions.incidents import Incidents
from rootseek.operators import causal
from rootseek.params import Params

P = Params()


def graph_of(rng, n):
    """Random DAG: edges (caller, callee) in call order."""
    pairs = [(f"n{i}", f"n{j}") for i in range(n) for j in range(i + 1, n) if rng.random() < 0.35]
    rng.shuffle(pairs)
    return pairs


def forward(cand, edges, weights, severity):
    """Breadth-first walk over callers, first visit wins."""
    seen, queue = {cand: (0, severity)}, [cand]
    for node in queue:
        for caller, callee in edges:
            if callee == node and caller not in seen:
                seen[caller] = (seen[node][0] + 1, seen[node][1] * weights[caller, callee])
                queue.append(caller)
    return seen


def residual(cand, edges, sick):
    if not sick:
        return 0.0
    roots = {s for s in sick if not any(a == s and b in sick for a, b in edges)}
    reached = set(roots - {cand})
    grown = True
    while grown:
        more = {a for a, b in edges if b in reached and a in sick and a != cand} - reached
        reached |= more
        grown = bool(more)
    return len(reached) / len(sick)


def test_against_brute_force_on_random_graphs(spark):
    rng = random.Random(11)
    inc_rows, edge_rows, weight_rows, impact_rows, cand_rows, want = [], [], [], [], [], {}
    # one shared graph made of separate parts, one incident per part
    order = 0
    for g in range(6):
        name = f"i{g}"
        inc_rows.append((name,))
        nodes = [f"g{g}n{k}" for k in range(8)]
        edges = [(f"g{g}{a}", f"g{g}{b}") for a, b in graph_of(rng, 8)]
        weights = {e: round(rng.random(), 3) for e in edges}
        for e in edges:
            order += 1
            edge_rows.append((*e, order))
            weight_rows.append((name, *e, weights[e]))
        impact = {n: (rng.choice([0.0, 50.0, 90.0]), rng.choice([1.0, 3.0, 8.0])) for n in nodes if rng.random() < 0.8}
        sick = {n for n, (e, m) in impact.items() if rng.random() < 0.7}
        for n, (e, m) in impact.items():
            impact_rows.append((name, n, e, m, n in sick))
        for n in nodes:
            cand_rows.append((name, n))
            e, m = impact.get(n, (0.0, 1.0))
            s = max(min(1, e / 100), min(1, (m - 1) / 5)) or 0.5
            walk = forward(n, edges, weights, s)
            off = []
            for o, (oe, om) in impact.items():
                if o not in walk:
                    off.append(1.0)
                else:
                    sv = walk[o][1]
                    off.append(min(1, 0.7 * min(1, abs(sv * 100 - oe) / max(1, oe)) + 0.3 * min(1, abs(1 + 5 * sv - om) / max(1, om))))
            fit = 1 - sum(off) / len(off) if off else 0.5
            left = residual(n, edges, sick)
            cf = 1 - left if sick else 0.0
            want[name, n] = (walk, fit, left, cf)
    inc = Incidents.of(spark.createDataFrame([(n, None) for (n,) in inc_rows], "incident_id string, incident_start timestamp"))
    edges = spark.createDataFrame(edge_rows, "source_id string, target_id string, ord bigint")
    weights = spark.createDataFrame(weight_rows, "incident_id string, source_id string, target_id string, weight double")
    impact = spark.createDataFrame(impact_rows, "incident_id string, node_id string, error_rate double, latency_multiplier double, is_anomalous boolean")
    cands = spark.createDataFrame(cand_rows, "incident_id string, node_id string")
    severities = causal.failure_severity(cands, impact, inc)
    got = {}
    for r in causal.forward_simulation(severities, edges, weights, inc).collect():
        got.setdefault((r.incident_id, r.candidate_id), {})[r.node_id] = (r.hop, r.predicted_error_rate / 100)
    scores = {(r.incident_id, r.node_id): r for r in causal.causal_scores(cands, edges, weights, impact, inc).collect()}
    for key, (walk, fit, left, cf) in want.items():
        assert set(got[key]) == set(walk)
        for n, (hop, s) in walk.items():
            assert got[key][n][0] == hop and abs(got[key][n][1] - s) < 1e-9
        r = scores[key]
        assert abs(r.fit - fit) < 1e-9 and abs(r.residual_explanation - left) < 1e-9 and abs(r.counterfactual - cf) < 1e-9
        assert 0 <= r.causal_confidence <= 1 and abs(r.causal_confidence - (0.6 * fit + 0.4 * cf)) < 1e-9


def test_paths_stop_at_the_cutoff(spark):
    chain = [(f"n{i}", f"n{i + 1}", i) for i in range(8)]
    edges = spark.createDataFrame(chain, "source_id string, target_id string, ord bigint")
    inc = Incidents.of(spark.createDataFrame([("i", None)], "incident_id string, incident_start timestamp"), P)
    seeds = spark.createDataFrame([("i", "n8")], "incident_id string, node_id string")
    paths = rows(causal.simple_paths(seeds, edges, inc), "path")
    assert max(len(p[0]) for p in paths) == P.path_cutoff + 1 and len(paths) == 5


def test_nothing_observed_is_neutral(spark):
    inc = Incidents.of(spark.createDataFrame([("i", None)], "incident_id string, incident_start timestamp"))
    edges = spark.createDataFrame([("a", "b", 1)], "source_id string, target_id string, ord bigint")
    weights = spark.createDataFrame([], "incident_id string, source_id string, target_id string, weight double")
    impact = spark.createDataFrame([], "incident_id string, node_id string, error_rate double, latency_multiplier double, is_anomalous boolean")
    cands = spark.createDataFrame([("i", "b")], "incident_id string, node_id string")
    r = causal.causal_scores(cands, edges, weights, impact, inc).first()
    assert (r.fit, r.counterfactual, r.residual_explanation, r.is_necessary) == (0.5, 0.0, 0.0, False)
    walk = causal.forward_simulation(causal.failure_severity(cands, impact, inc), edges, weights, inc)
    assert rows(walk, "node_id", "hop", "predicted_error_rate", "confidence") == [("a", 1, 0.5 * 0.402 * 100, 0.85), ("b", 0, 50.0, 1.0)]

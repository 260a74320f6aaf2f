import random
from datetime import timedelta

from build import START, Lake, rows
from rootseek import schemas
from rootseek.functions.incidents import Incidents
from rootseek.operators import series
from rootseek.params import Params

WINDOW = 300


def brute(samples, start):
    """Baseline, current and observed means of one series, straight from the definitions."""
    pre = [v for t, v in sorted(samples, key=lambda s: s[0]) if t < start]
    cur = [v for t, v in samples if start <= t < start + timedelta(seconds=WINDOW)]
    obs = [v for t, v in samples if start <= t <= start + timedelta(seconds=WINDOW)]
    mean = sum(pre) / len(pre) if pre else None
    std = max((sum((v - mean) ** 2 for v in pre) / len(pre)) ** 0.5, 0.01) if pre else None
    smooth = None
    for v in pre:
        smooth = v if smooth is None else 0.3 * v + 0.7 * smooth
    avg = lambda xs: sum(xs) / len(xs) if xs else None
    return len(pre), mean, std, smooth, avg(cur), avg(obs)


def near(a, b):
    return (a is None) == (b is None) and (a is None or abs(a - b) < 1e-6 * max(1.0, abs(b)))


def test_all_incidents_match_the_definitions(spark):
    rng = random.Random(5)
    lake = Lake()
    starts = [START, START + timedelta(minutes=7), START + timedelta(minutes=7, seconds=30), START + timedelta(hours=3)]
    for i, s in enumerate(starts):
        lake.incident(f"i{i}", s)
    for node in ("a", "b"):
        for kind in ("error_rate", "latency_p99"):
            for _ in range(150):
                lake.metric(node, kind, 1e6 + rng.random(), START + timedelta(seconds=rng.randrange(-4000, 14000)))
            for s in starts:  # exactly on the window edges
                lake.metric(node, kind, 3.0, s)
                lake.metric(node, kind, 5.0, s + timedelta(seconds=WINDOW))
    t = lake.tables(spark)
    inc = Incidents.of(t["incidents"], Params(chunk_seconds=600))
    stats = {(r.incident_id, r.node_id, r.metric_type): r for r in series.series_stats(series.metric_cells(t["metrics"], inc), inc).collect()}
    smooth = {(r.incident_id, r.node_id, r.metric_type): r.ema for r in series.ema(t["metrics"], inc).collect()}
    data = {}
    for node, _, kind, v, at, *_ in lake.rows["metrics"]:
        data.setdefault((node, kind), []).append((at, v))
    for i, s in enumerate(starts):
        for (node, kind), samples in data.items():
            n, mean, std, ema, cur, obs = brute(samples, s)
            r = stats[f"i{i}", node, kind]
            assert r.sample_count == n
            assert near(r.mean, mean) and near(r.std, std) and near(r.cur_mean, cur) and near(r.obs_mean, obs)
            assert near(smooth.get((f"i{i}", node, kind)), ema)


def test_constant_series_keeps_the_floor(spark):
    lake = Lake()
    lake.incident("i")
    for m in range(1, 50):
        lake.metric("a", "error_rate", 123456.7, START - timedelta(minutes=m * 17))
    t = lake.tables(spark)
    inc = Incidents.of(t["incidents"])
    r = series.baselines(series.series_stats(series.metric_cells(t["metrics"], inc), inc)).first()
    assert (r.std, r.sample_count, r.min_value, r.max_value) == (0.01, 49, 123456.7, 123456.7)


def test_few_samples_are_not_reliable_and_z_is_clamped(spark):
    lake = Lake()
    lake.incident("i")
    lake.series("calm", START, error=1.0)
    lake.series("wild", START, error=1.0, error_now=1000.0)
    lake.metric("new", "error_rate", 1.0, START - timedelta(minutes=1))
    lake.metric("new", "error_rate", 90.0, START)
    t = lake.tables(spark)
    inc = Incidents.of(t["incidents"])
    stats = series.series_stats(series.metric_cells(t["metrics"], inc), inc)
    assert rows(series.anomalies(stats, inc), "node_id", "z_score") == [("wild", 20.0)]
    assert rows(series.deviations(stats, inc), "node_id") == [("calm",), ("wild",)]


def test_observed_impact_without_baseline(spark):
    lake = Lake()
    lake.incident("i")
    lake.metric("a", "latency_p99", 900.0, START + timedelta(seconds=300))
    lake.metric("b", "request_rate", 5.0, START)
    lake.series("c", START, latency=100.0, factor=2.5)
    t = lake.tables(spark)
    inc = Incidents.of(t["incidents"])
    got = series.observed_impact(series.series_stats(series.metric_cells(t["metrics"], inc), inc), inc)
    r = {x.node_id: x for x in got.collect()}
    assert set(r) == {"a", "c"}
    assert (r["a"].latency_multiplier, r["a"].error_rate, r["a"].is_anomalous) == (1.0, 0.0, False)
    assert r["c"].is_anomalous and abs(r["c"].latency_multiplier - 2.4977) < 1e-3


def test_edge_weights_use_earlier_samples_only(spark):
    lake = Lake()
    lake.incident("i")
    lake.series("a", START, error=1.0, rate=2000.0)
    lake.series("b", START, error=5.0)
    lake.series("c", START, latency=9.0)
    edges = spark.createDataFrame([("a", "b", 1), ("b", "a", 2), ("a", "c", 3), ("z", "a", 4)], "source_id string, target_id string, ord bigint")

    def weights():
        t = lake.tables(spark)
        inc = Incidents.of(t["incidents"])
        stats = series.series_stats(series.metric_cells(t["metrics"], inc), inc)
        return {(r.source_id, r.target_id): round(r.weight, 6) for r in series.edge_weights(t["metrics"], edges, stats, inc).collect()}

    before = weights()
    # perfectly coupled errors, no latency data, full volume
    assert before == {("a", "b"): 0.8, ("b", "a"): 0.602, ("a", "c"): 0.6}
    for k in range(10):
        lake.metric("b", "error_rate", 500.0 * k, START + timedelta(seconds=30 * k))
    assert weights() == before
    t = lake.tables(spark)
    inc = Incidents.of(t["incidents"])
    assert abs(series.unmeasured_weight(inc) - 0.402) < 1e-12


def test_constant_series_fall_back_to_half(spark):
    lake = Lake()
    lake.incident("i")
    for m in range(1, 6):
        for node in ("a", "b"):
            lake.metric(node, "error_rate", 2.0, START - timedelta(minutes=m))
    edges = spark.createDataFrame([("a", "b", 1)], "source_id string, target_id string, ord bigint")
    t = lake.tables(spark)
    inc = Incidents.of(t["incidents"])
    stats = series.series_stats(series.metric_cells(t["metrics"], inc), inc)
    assert series.edge_weights(t["metrics"], edges, stats, inc).first().error_coupling == 0.5


def test_default_start_and_summary(spark):
    lake = Lake()
    lake.incident("i")
    lake.series("a", START, error=1.0)
    t = lake.tables(spark)
    got = series.default_start(t["metrics"]).selectExpr("CAST(incident_start AS STRING) AS s").first().s
    assert got == "2024-01-01 11:56:00"
    inc = Incidents.of(t["incidents"])
    r = series.baseline_summary(series.series_stats(series.metric_cells(t["metrics"], inc), inc), ["error_rate", "latency_p99"]).first()
    assert abs(r.error_rate - 1.09) < 1e-9 and r.latency_p99 is None


def test_large_incident_lists_are_not_broadcast(spark):
    lake = Lake()
    for i in range(20):
        lake.incident(f"i{i}", START + timedelta(minutes=i))
    lake.series("a", START, error=1.0)
    t = lake.tables(spark)
    small = Incidents.of(t["incidents"], Params(broadcast_rows=10))
    stats = series.series_stats(series.metric_cells(t["metrics"], small), small)
    plain = Incidents.of(t["incidents"])
    same = series.series_stats(series.metric_cells(t["metrics"], plain), plain)
    cols = ["incident_id", "node_id", "sample_count", "cur_n", "obs_n"]
    assert rows(stats, *cols) == rows(same, *cols)
    assert "ResolvedHint" not in stats._jdf.queryExecution().analyzed().toString()


def test_many_incidents_cost_rows_per_series_not_per_cell(spark):
    start = START
    samples = [("n", "service", "error_rate", float(i % 7), start - timedelta(hours=i), 60, "u", i) for i in range(400)]
    metrics = spark.createDataFrame(samples, schemas.METRICS)
    rows_in = [(f"i{k}", start - timedelta(hours=3 * k, minutes=k % 5), 5) for k in range(50)]
    inc = Incidents.of(spark.createDataFrame(rows_in, schemas.INCIDENTS))
    got = {r.incident_id: r for r in series.series_stats(series.metric_cells(metrics, inc), inc).collect()}
    assert len(got) == 50
    for name, at, _ in rows_in:
        old = [v for _, _, _, v, ts, *_ in samples if ts < at]
        now = [v for _, _, _, v, ts, *_ in samples if at <= ts < at + timedelta(seconds=300)]
        mean = sum(old) / len(old)
        r = got[name]
        assert (r.sample_count, r.min_value, r.max_value, r.cur_n) == (len(old), min(old), max(old), len(now))
        assert abs(r.mean - mean) < 1e-9 and abs(r.std - max(0.01, (sum((v - mean) ** 2 for v in old) / len(old)) ** 0.5)) < 1e-9


def coupling_by_definition(samples, start, seconds=60):
    """Pearson correlation of bucket means before a start; None below three common buckets or without spread."""
    def means(points):
        buckets = {}
        for at, v in points:
            if at < start:
                buckets.setdefault(int(at.timestamp()) // seconds, []).append(v)
        return {b: sum(v) / len(v) for b, v in buckets.items()}

    x, y = (means(s) for s in samples)
    both = sorted(set(x) & set(y))
    if len(both) < 3:
        return None
    xs, ys = [x[b] for b in both], [y[b] for b in both]
    mx, my = sum(xs) / len(xs), sum(ys) / len(ys)
    cov = sum((a - mx) * (b - my) for a, b in zip(xs, ys))
    spread = (sum((a - mx) ** 2 for a in xs) * sum((b - my) ** 2 for b in ys)) ** 0.5
    return cov / spread if spread > 0 else None


def test_coupling_of_many_starts_matches_the_definition(spark):
    rng = random.Random(8)
    lake = Lake()
    base = START + timedelta(seconds=7)
    starts = [base, base, START + timedelta(minutes=3), base + timedelta(minutes=3), base + timedelta(minutes=11), base - timedelta(days=2), base + timedelta(hours=30)]
    for i, s in enumerate(starts):
        lake.incident(f"i{i}", s)
    for _ in range(400):
        at = START + timedelta(seconds=rng.randrange(-1200, 1200))
        for node in "abc":
            if rng.random() < 0.7:
                lake.metric(node, "error_rate", 1e5 + (at.timestamp() % 600) / 60 * (2 if node != "c" else -1) + rng.random(), at + timedelta(seconds=rng.randrange(3)))
    t = lake.tables(spark)
    inc = Incidents.of(t["incidents"])
    edges = spark.createDataFrame([("a", "b", 1), ("a", "c", 2)], "source_id string, target_id string, ord bigint")
    stats = series.series_stats(series.metric_cells(t["metrics"], inc), inc)
    got = {(r.incident_id, r.target_id): r.error_coupling for r in series.edge_weights(t["metrics"], edges, stats, inc).collect()}
    data = {}
    for node, _, _, v, at, *_ in lake.rows["metrics"]:
        data.setdefault(node, []).append((at, v))
    want = {}
    for i, s in enumerate(starts):
        for target in "bc":
            if any(at < s for at, _ in data["a"]):
                r = coupling_by_definition((data["a"], data[target]), s)
                enough = sum(at < s for at, _ in data[target]) >= 3
                want[f"i{i}", target] = 0.5 if r is None or not enough else max(0.0, min(1.0, r))
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-7 for k in want)
    assert 0.5 < got["i0", "b"] < 1 and got["i0", "c"] == 0
    # each incident its own edges
    own = spark.createDataFrame([("i0", "a", "b", 1), ("i3", "a", "c", 2)], "incident_id string, source_id string, target_id string, ord bigint")
    mine = {(r.incident_id, r.target_id): r.error_coupling for r in series.edge_weights(t["metrics"], own, stats, inc).collect()}
    assert mine == {k: got[k] for k in (("i0", "b"), ("i3", "c"))}


def test_scan_of_many_stretches(spark, monkeypatch):
    """Blocks of blocks give the plain recursion, for any block size."""
    rng = random.Random(3)
    data = {(k,): sorted((seg, rng.randrange(1, 5), rng.random()) for seg in rng.sample(range(1000), 300)) for k in "ab"}
    maps = spark.createDataFrame([(k, *m) for (k,), ms in data.items() for m in ms], "k string, seg bigint, n bigint, offset double")
    for size in (64, 7, 2000):
        monkeypatch.setattr(series, "SCAN_BLOCK", size)
        got = {(r.k, r.seg): (r.upto, r.level) for r in series.affine_scan(maps, ("k",), 0.7, 1000).collect()}
        assert len(got) == 600
        for (k,), ms in data.items():
            level = upto = 0
            for seg, n, offset in ms:
                level, upto = level * 0.7**n + offset, upto + n
                assert got[k, seg][0] == upto and abs(got[k, seg][1] - level) < 1e-9


def test_the_past_is_not_paired_with_incidents(spark):
    """No join of the plans yields more rows than there are cells or incidents times series."""
    samples = [(n, "service", "error_rate", float(i % 7), START - timedelta(hours=i), 60, "u", i) for i in range(600) for n in "ab"]
    metrics = spark.createDataFrame(samples, schemas.METRICS).repartition(4)
    inc = Incidents.of(spark.createDataFrame([(f"i{k}", START - timedelta(minutes=k), 5) for k in range(60)], schemas.INCIDENTS))
    edges = spark.createDataFrame([("a", "b", 1)], "source_id string, target_id string, ord bigint")
    stats = series.series_stats(series.metric_cells(metrics, inc), inc)
    for df in (series.ema(metrics, inc), series.edge_weights(metrics, edges, stats, inc)):
        df.collect()
        assert most_join_rows(df) <= 2500, most_join_rows(df)  # pairing would give 36,000 and more


def most_join_rows(df):
    """Rows of the join with the most output rows in the executed plan."""
    found, open_ = [0], [df._jdf.queryExecution().executedPlan()]
    while open_:
        plan = open_.pop()
        name = plan.nodeName()
        if name == "AdaptiveSparkPlan":
            open_.append(plan.executedPlan())
        elif "QueryStage" in name:
            open_.append(plan.plan())
        elif name == "ReusedExchange":
            open_.append(plan.child())
        if "Join" in name and plan.metrics().contains("numOutputRows"):
            found.append(plan.metrics().apply("numOutputRows").value())
        children = plan.children()
        open_ += [children.apply(i) for i in range(children.size())]
    return max(found)

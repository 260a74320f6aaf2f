"""Work that must not grow faster than the tables: exchanges, sorts and files of the shared steps."""

import os

import pytest
from build import Lake
from pyspark.sql import functions as F

from rootseek.functions.folds import first_of
from rootseek.functions.text import frames_of
from rootseek.operators import codechange, graph, spanfacts
from rootseek.plans import catalog, views
from rootseek.sources import records

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def plan_of(df) -> str:
    """The physical plan, without the rest of an explanation."""
    return df._jdf.queryExecution().sparkPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


def count_of(df, node: str) -> int:
    return sum(line.strip(" +-:*()0123456789").startswith(node) for line in df._jdf.queryExecution().executedPlan().toString().splitlines())


@needs_tables
def test_raw_traces_shuffle_narrow_lines_once(spark):
    raw = views.raw_traces(spark, SF)
    assert count_of(raw, "Exchange") == 1 and count_of(raw, "Sort ") == 1
    orders = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey").distinct().count()
    assert raw.count() == raw.select("ord").distinct().count() == orders


@needs_tables
def test_replies_are_parsed_in_several_tasks_a_core(spark):
    replies = catalog.Telemetry.of(spark, SF).raw_replies
    assert replies.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    assert replies.count() == replies.select("ref_id").distinct().count() == orders.count()


def test_written_lines_are_compressed_and_come_back(spark, tmp_path):
    path = str(tmp_path / "lines")
    rows = spark.range(0, 120_000, 1, 1).select(F.concat(F.lit('{"name":"a record like the others","id":'), "id", F.lit("}")).alias("raw"), F.col("id").alias("ord"))
    records.write_lines(rows, path)
    files = [f for f in os.listdir(path) if f.startswith("part-")]
    assert len(files) == 3  # bounded, since one task reads a file
    assert sum(os.path.getsize(os.path.join(path, f)) for f in files) * 5 < rows.agg(F.sum(F.length("raw"))).first()[0]
    back = records.json_lines(spark, path)
    assert back.select("ord").distinct().count() == 120_000
    assert back.select("raw").exceptAll(rows.select("raw")).isEmpty()


def deepest_aggregates(df) -> list[str]:
    """The aggregate next to each scan."""
    found, out = None, []
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        node = line.strip(" +-:*()0123456789")
        if "Aggregate" in node.split("(")[0]:
            found = node.split("(")[0]
        if "Scan" in node.split("(")[0] and found:
            out.append(found)
            found = None
    return out


def test_graph_folds_spans_by_hash(spark, tmp_path):
    lake = Lake()
    for i in range(3):
        lake.span("a", attrs={"peer.service": "b", "db.system": "X"}, kind="client", parent=None if i == 0 else "s0")
    path = str(tmp_path / "spans")
    lake.tables(spark)["spans"].write.parquet(path)
    facts = graph.call_facts(spark.read.parquet(path))
    day = F.to_date("start_time").alias("day")
    for folded in (
        graph.discover_nodes(facts), graph.db_systems(facts), graph.folded_children(facts),
        graph.earliest(graph.stated_edges(facts, day), "day", "source_id", "target_id"),
        graph.earliest(graph.node_mentions(facts, day), "day", "node_id"),
    ):
        assert deepest_aggregates(folded) == ["HashAggregate"]


def test_earliest_mention_wins_whatever_is_alike(spark):
    rows = [("k", (5, "b", None)), ("k", (2, "c", ["t"])), ("k", (2, "c", None)), ("k", (9, "a", ["t"])), ("l", (7, None, None))]
    mentions = spark.createDataFrame(rows, "key string, first struct<ord: bigint, x: string, topics: array<string>>")
    got = {r.key: tuple(r["first"]) for r in graph.earliest(mentions, "key").collect()}
    want = {r.key: tuple(r["first"]) for r in mentions.groupBy("key").agg(F.min("first").alias("first")).collect()}
    assert got == want == {"k": (2, "c", None), "l": (7, None, None)}


def test_first_of_equals_the_least_struct(spark, tmp_path):
    rows = [("a", None, 3, "x"), ("a", None, 1, "z"), ("a", None, 1, "y"), ("a", 7, 2, None), (None, 7, 5, "q"), ("b", 1, None, "r")]
    path = str(tmp_path / "rows")
    spark.createDataFrame(rows, "k string, l int, ord bigint, v string").write.parquet(path)
    table = spark.read.parquet(path)
    pick = F.struct("ord", "v")
    seen = lambda df: sorted(map(str, df.collect()))
    numbered = table.where("ord IS NOT NULL")
    first = first_of(numbered, ["k", "l"], F.col("ord"), pick, "p")
    assert seen(first) == seen(numbered.groupBy("k", "l").agg(F.min(pick).alias("p")))
    assert seen(first_of(table, ["k"], F.col("ord"), pick, "p", last=True)) == seen(table.groupBy("k").agg(F.max(pick).alias("p")))


def test_evidence_folds_spans_by_hash(spark, tmp_path):
    lake = Lake()
    lake.span("a", error=True, exceptions=[("T", "m", None), ("U", "n", None)])
    lake.tables(spark)["spans"].write.parquet(str(tmp_path / "spans"))
    window = spark.read.parquet(str(tmp_path / "spans")).selectExpr(
        "'i' AS incident_id", "service_id AS node_id", "true AS is_error", "ord",
        "transform(events, e -> struct(e.attributes['exception.type'] AS type, e.attributes['exception.message'] AS message)) AS exceptions",
    )
    events = spanfacts.exception_events(window)
    for folded in (spanfacts.first_exception(events), spanfacts.exception_counts(events)):
        # the first aggregate above each scan, of the rows that are compared as a whole there are few
        assert "HashAggregate" in deepest_aggregates(folded)
    assert spanfacts.first_exception(events).first().exception_type == "T"
    assert {(r.exception_type, tuple(r.first_place)) for r in spanfacts.exception_counts(events).collect()} == {("T", (0, 0)), ("U", (0, 1))}


def test_diffs_meet_their_symbols_as_text(spark):
    files = spark.createDataFrame([("e", "f.py", "modified", "@@ -1 +1 @@\n-a\n+b", 1)], "event_id string, file_path string, change_type string, raw_diff string, ord bigint")
    symbols = spark.createDataFrame([("e", "f.py", "new", "g", 1, 2, 0)], "event_id string, file_path string, side string, function_name string, start_line int, end_line int, ord bigint")
    changed = codechange.function_changes(files, symbols)
    exchanged = [line for line in changed._jdf.queryExecution().executedPlan().toString().splitlines() if "Generate" in line]
    joined = changed._jdf.queryExecution().executedPlan().toString()
    assert exchanged and "Generate" not in joined[joined.index("Join"):]
    assert [(r.function_name, r.new_code) for r in changed.collect()] == [("g", "b\n")]


def test_methods_too_long_for_the_jvm_are_not_used(spark):
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000  # the JVM's own limit


def test_frames_of_a_format_whose_words_are_missing_are_not_looked_for(spark):
    traces = ['  File "/srv/a.py", line 3, in f', "Boom\n\tat com.acme.Svc.g(B.java:7)", "Error\n    at /srv/c.js:1:2", "File line at ( :", ""]
    rows = spark.createDataFrame([(i, [t]) for i, t in enumerate(traces)], "i int, t array<string>")
    found = rows.select("i", frames_of(F.col("t")).alias("f"))
    assert "contains(" in plan_of(found).lower()
    seen = {r.i: [tuple(x) for x in r.f] for r in found.collect()}
    assert seen == {0: [("/srv/a.py", "f", 3)], 1: [("B.java", "g", 7)], 2: [("/srv/c.js", "<anonymous>", 1)], 3: [], 4: []}

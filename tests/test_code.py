from build import Lake, rows
from rootseek.functions.incidents import Incidents
from rootseek.operators import assessments, codechange
from pyspark.sql import functions as F

FILES = "event_id string, file_path string, change_type string, old_path string, raw_diff string, ord bigint"
SYMBOLS = "event_id string, file_path string, side string, function_name string, start_line int, end_line int, ord bigint"

DIFF = """--- a/pay.py
+++ b/pay.py
@@ -1,4 +1,5 @@
 def keep():
-    old()
+    new()
+    more()

 tail
@@ bad header @@
+ignored
@@ -40 +41 @@
-gone
\\ No newline at end of file
"""


def lines_of(spark, *files):
    return codechange.diff_lines(spark.createDataFrame(list(files), FILES))


def test_diff_lines_are_numbered_on_both_sides(spark):
    got = lines_of(spark, ("e", "src/pay.py", "modified", None, DIFF, 0)).orderBy("pos").collect()
    assert [(r.kind, r.old_line, r.new_line, r.text) for r in got] == [
        (" ", 1, 1, "def keep():"), ("-", 2, 2, "    old()"), ("+", None, 2, "    new()"), ("+", None, 3, "    more()"),
        (" ", 3, 4, ""), (" ", 4, 5, "tail"), ("-", 40, 41, "gone"), (" ", 41, 41, "\\ No newline at end of file")]


def test_only_known_languages_and_changed_files_are_read(spark):
    got = lines_of(
        spark, ("e", "a.txt", "modified", None, "@@ -1 +1 @@\n+x", 0), ("e", "b.py", "deleted", None, "@@ -1 +1 @@\n-x", 1),
        ("e", "c.PY", "modified", None, "@@ -1 +1 @@\n+x", 2), ("e", "d.tsx", "added", None, "@@ -0,0 +1,2 @@\r\n+x\r\n+y", 3),
        ("e", "dir.py/e", "modified", None, "@@ -1 +1 @@\n+x", 4), ("e", "f.go", "modified", None, "", 5))
    assert rows(got, "file_path", "text") == [("d.tsx", "x"), ("d.tsx", "y")]
    files = spark.createDataFrame([("e", "x.rs", "renamed", "y.rs", "d", 0), ("e", "noext", "modified", None, "d", 1)], FILES)
    assert rows(codechange.file_changes(files), "file_path", "language") == [("noext", "unknown"), ("x.rs", "rust")]


def test_functions_are_modified_added_and_deleted(spark):
    files = spark.createDataFrame([("e", "src/pay.py", "modified", None, DIFF, 3)], FILES)
    syms = [("new", "keep", 1, 3, 0), ("new", "fresh", 3, 4, 1), ("new", "calm", 4, 9, 2), ("old", "keep", 1, 2, 0), ("old", "dead", 38, 42, 1),
            ("old", "calm", 3, 6, 2)]
    symbols = spark.createDataFrame([("e", "src/pay.py", *s) for s in syms], SYMBOLS)
    got = {r.function_name: r for r in codechange.function_changes(files, symbols).collect()}
    assert {k: v.change_type for k, v in got.items()} == {"keep": "modified", "fresh": "added", "dead": "deleted"}
    assert (got["keep"].old_code, got["keep"].new_code) == ("def keep():\n    old()", "def keep():\n    new()\n    more()")
    assert (got["fresh"].old_code, got["fresh"].new_code) == (None, "    more()\n")
    assert (got["dead"].old_code, got["dead"].new_code, got["dead"].start_line) == ("\n\ngone\n\\ No newline at end of file\n", None, 38)
    assert got["dead"].ord > got["keep"].ord


def test_long_diffs_fold_in_blocks(spark, monkeypatch):
    """Hunks over block borders, repeated symbols and line numbers: as counted one by one."""
    import random

    rng = random.Random(4)
    body, want, pos = [], [], 0
    for hunk in range(1, 6):
        old, new = rng.randrange(1, 50), rng.randrange(1, 50)
        body.append(f"@@ -{old},9 +{new},9 @@ fn" if hunk != 3 else "@@ unreadable")
        for i in range(rng.randrange(0, 400)):
            mark = rng.choice("+- \\")
            body.append(f"{mark}line {hunk} {i}")
            if hunk != 3:
                kind = mark if mark in "+-" else " "
                want.append((len(body) - 1, hunk, kind, new, None if kind == "+" else old, f"line {hunk} {i}" if mark != "\\" else body[-1]))
                old, new = old + (kind != "+"), new + (kind != "-")
    diff = "\n".join(body)
    files = spark.createDataFrame([("e", "a.py", "modified", None, diff, 0), ("e", "empty.py", "modified", None, "@@ -1 +1 @@", 1)], FILES)
    plans = []
    for size in (256, 7, 5000):
        monkeypatch.setattr(codechange, "FOLD_BLOCK", size)
        df = codechange.diff_lines(files)
        assert [(r.pos, r.hunk, r.kind, r.new_line, r.old_line, r.text) for r in df.orderBy("pos").collect()] == want
        plans.append(df._jdf.queryExecution().executedPlan().toString())
    assert not any("Exchange" in p or "Window" in p for p in plans)
    symbols = spark.createDataFrame([("e", "a.py", s, "f", a, a + 9, a) for s in ("old", "new") for a in range(1, 600, 10)] * 2, SYMBOLS)
    changes = codechange.function_changes(files, symbols)
    got = sorted((r.start_line, r.change_type, r.new_code) for r in changes.collect())
    text = {n: t for _, _, k, n, _, t in want if k != "-"}
    hit = {n for _, _, k, n, _, _ in want if k != " "}
    assert got == [(a, "modified", "\n".join(text.get(i, "") for i in range(a, a + 10))) for a in range(1, 600, 10) if hit & set(range(a, a + 10))]
    assert changes._jdf.queryExecution().executedPlan().toString().count("Window") == 0


TRACES = {
    'Traceback:\n  File "src/fraud/risk.py", line 47, in evaluate\n': [("src/fraud/risk.py", "evaluate", 47)],
    "NPE\n\tat com.acme.fraud.RiskEvaluator.evaluate(RiskEvaluator.java:42)\n": [("RiskEvaluator.java", "evaluate", 42)],
    "TypeError\n    at Object.handle (/srv/app/index.js:10:15)\n    at Layer.handle [as handle_request] (/srv/lib/layer.js:95:5)\n    at /srv/app/anon.js:23:13\n    at async /srv/app/later.js:7:1\n": [
        ("/srv/app/index.js", "handle", 10), ("/srv/lib/layer.js", "handle", 95), ("/srv/app/anon.js", "<anonymous>", 23),
        ("/srv/app/later.js", "<anonymous>", 7)],
    "no frames here": [],
}


def test_stack_frames_in_three_formats(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TRACES)], "i int, t string")
    got = df.select("i", codechange.frames_of(F.array("t", "t", F.lit(None).cast("string"))).alias("f")).orderBy("i").collect()
    assert [[(f.file_path, f.function_name, f.line_number) for f in r.f] for r in got] == list(TRACES.values())


def match(spark, frames, functions):
    inc = Incidents.of(spark.createDataFrame([("i", None)], "incident_id string, incident_start timestamp"))
    fr = spark.createDataFrame(
        [("i", "svc", f"s{n}", n, 0, p, f, line, p.rsplit("/", 1)[-1]) for n, (p, f, line) in enumerate(frames)],
        "incident_id string, node_id string, span_id string, ord bigint, pos int, file_path string, function_name string, line_number int, base string")
    lake = Lake()
    lake.commit("svc", 5, "e", functions=functions)
    commits = spark.createDataFrame([("i", "svc", "e")], "incident_id string, node_id string, event_id string")
    r = codechange.match_stack(fr, commits, lake.tables(spark)["functions"], inc).first()
    return r and (r.match_type, r.function_name, r.frame_line, r.span_id, r.match_confidence)


def test_best_stack_match_wins(spark):
    fns = [("src/a.py", "f", 45, "o", "n"), ("src/a.py", "g", 100, "o", "n"), ("lib/b.py", "h", 10, "o", "n")]
    assert match(spark, [("/x/a.py", "zzz", 300), ("/x/a.py", "g", 400), ("/x/b.py", "q", 13), ("a.py", "f", 45)], fns) == ("exact_line", "h", 13, "s2", 1.0)
    assert match(spark, [("/x/a.py", "zzz", 300), ("/x/a.py", "g", 400)], fns) == ("function_match", "g", 400, "s1", 0.6)
    assert match(spark, [("/x/a.py", "zzz", 300)], fns) == ("file_match", "f", 300, "s0", 0.3)
    assert match(spark, [("/x/a.py", "f", 49)], fns)[0] == "function_match"
    assert match(spark, [("/x/other.py", "f", 45)], fns) is None


def test_replies(spark):
    texts = [
        '{"causal_assessment": "likely", "reasoning": "because", "signals": ["a", 5, null]}',
        '```json\n{"causal_assessment": "unlikely", "reasoning": "no"}\n```', '```\n{"causal_assessment": "uncertain", "reasoning": "?", "signals": "x"}\n```',
        "I cannot tell", '{"causal_assessment": "sure", "reasoning": "x"}', '{"causal_assessment": "likely", "reasoning": ""}', "[1]", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, raw_reply string")
    got = [(r.assessment, r.reasoning, r.signals) for r in assessments.parse_replies(df).orderBy("i").collect()]
    broken = ("uncertain", "parse error", [])
    assert got == [("likely", "because", ["a", "5", "None"]), ("unlikely", "no", []), ("uncertain", "?", [])] + [broken] * 6

"""Commits: diff lines, changed functions, and stack frames that hit them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.folds import first_of
from ..functions.incidents import Incidents, in_window, per_incident
from ..functions.text import basename, frames_of
from ..functions.variants import once

KEY = ["incident_id", "node_id"]
FILE = ["event_id", "file_path"]
#: Lines that are folded together.
FOLD_BLOCK = 256
HUNK_LINE = "struct<pos:int,hunk:int,kind:string,new_line:int,old_line:int,text:string>"

# File extension to language.
LANGUAGES = {
    ".py": "python", ".java": "java", ".go": "go", ".ts": "typescript", ".tsx": "typescript",
    ".rb": "ruby", ".js": "javascript", ".jsx": "javascript", ".cpp": "cpp", ".c": "c",
    ".cs": "c_sharp", ".rs": "rust",
}
HUNK = r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
# Match kinds, best first, with their confidence.
MATCHES = {"exact_line": 1.0, "function_match": 0.6, "file_match": 0.3}


def language(path: Column) -> Column:
    """Language by the last extension, case-sensitive; NULL when unknown."""
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.try_element_at(table, F.regexp_extract(path, r"\.[^./]*$", 0))


def file_changes(files: DataFrame) -> DataFrame:
    """Files with a non-empty diff and their language."""
    return files.where("raw_diff <> ''").withColumn(
        "language", F.coalesce(language(F.col("file_path")), F.lit("unknown"))
    )


def _block_fold(pieces: Column) -> Column:
    """The hunk lines of one diff: a state machine over its text lines.

    The state is the hunk and the next line number on both sides, without
    numbers outside readable hunks. Lines are folded in blocks, whose lists are
    put together at the end, so no long list is copied for every line.
    """
    def state(pos, hunk, old, new, out) -> Column:
        return F.struct(pos.alias("pos"), hunk.alias("hunk"), old.alias("old"), new.alias("new"), out.alias("out"))

    def step(s: Column, line: Column) -> Column:
        header, mark = line.startswith("@@"), F.substring(line, 1, 1)
        number = lambda g: F.regexp_extract(line, HUNK, g).try_cast("int")
        inside = s["old"].isNotNull() & s["new"].isNotNull()
        found = F.struct(
            s["pos"].alias("pos"), s["hunk"].alias("hunk"), F.when(mark.isin("+", "-"), mark).otherwise(" ").alias("kind"), s["new"].alias("new_line"),
            F.when(mark != "+", s["old"]).alias("old_line"),
            F.when(mark.isin("+", "-", " "), F.substring(line, 2, 2147483647)).otherwise(line).alias("text"),
        )
        return state(
            s["pos"] + 1, s["hunk"] + header.cast("int"),
            F.when(header, number(1)).otherwise(s["old"] + (mark != "+").cast("int")),
            F.when(header, number(3)).otherwise(s["new"] + (mark != "-").cast("int")),
            F.when(~header & inside, F.concat(s["out"], F.array(found))).otherwise(s["out"]),
        )

    no_lines, none = F.array().cast(f"array<{HUNK_LINE}>"), F.lit(None).cast("int")

    def block(s: Column, lines: Column) -> Column:
        done = F.aggregate(lines, state(s["pos"], s["hunk"], s["old"], s["new"], no_lines), step)
        return F.transform(F.array(done), lambda d: state(
            d["pos"], d["hunk"], d["old"], d["new"], F.concat(s["out"], F.array(d["out"]))))[0]

    starts = F.sequence(F.lit(1), F.greatest(F.size(pieces), F.lit(1)), F.lit(FOLD_BLOCK))
    blocks = F.transform(starts, lambda i: F.slice(pieces, i, FOLD_BLOCK))
    first = state(F.lit(0), F.lit(0), none, none, F.array().cast(f"array<array<{HUNK_LINE}>>"))
    return F.aggregate(blocks, first, block, lambda s: F.flatten(s["out"]))


def _parsed(files: DataFrame, *keep: str) -> DataFrame:
    """Readable files with ``lines``, the hunk lines of their diff."""
    pieces = F.split("raw_diff", LINE_BREAK)
    kept = F.col("pieces")
    trimmed = F.when(F.element_at(kept, -1) == "", F.slice(kept, 1, F.size(kept) - 1)).otherwise(kept)
    readable = file_changes(files).where("language <> 'unknown' AND change_type IN ('modified', 'added')")
    cut = once(once(readable, *FILE, "ord", *keep, pieces=pieces), *FILE, "ord", *keep, kept=trimmed)
    return once(cut, *FILE, "ord", *keep, lines=_block_fold(F.col("kept")))


def diff_lines(files: DataFrame) -> DataFrame:
    """Every hunk line of every file diff with its old and new line number.

    ``kind`` is '+', '-' or ' '. A removed line carries the new-file position
    it was removed at. Nothing is shuffled.
    """
    return _parsed(files).select(*FILE, "ord", F.explode("lines").alias("l")).select(
        *FILE, "ord", "l.pos", "l.hunk", "l.kind", "l.new_line", "l.old_line", "l.text"
    )


def function_changes(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Functions a diff modified, added or deleted, with their code.

    ``symbols`` gives the function ranges of both file versions: event_id,
    file_path, side ('old' or 'new'), function_name, start_line, end_line, ord.
    A file's symbols are folded to one row and meet its diff in one equi join;
    all else happens within the row. The diffs meet them as text, since their lines
    take several times the room.
    """
    symbol = F.struct("side", "function_name", "start_line", "end_line", "ord")
    folded = symbols.groupBy(*FILE).agg(F.sort_array(F.collect_set(symbol)).alias("symbols"))
    both = _parsed(files.join(folded, FILE), "language", "symbols")
    side = lambda name: F.filter("symbols", lambda s: s["side"] == name)
    of = lambda keep: F.filter("lines", keep)
    sides = once(
        both, *FILE, "ord", "language",
        new_side=side("new"), old_side=side("old"),
        changed=F.transform(of(lambda x: x["kind"] != " "), lambda x: x["new_line"]),
        removed=F.transform(of(lambda x: x["kind"] == "-"), lambda x: x["old_line"]),
        # of lines with one number the last one counts
        new_text=F.map_from_entries(F.transform(of(lambda x: x["kind"] != "-"), lambda x: F.struct(x["new_line"], x["text"]))),
        old_text=F.map_from_entries(F.transform(of(lambda x: x["kind"] != "+"), lambda x: F.struct(x["old_line"], x["text"]))),
    )
    contains = lambda lines: lambda s: F.exists(lines, lambda i: i.between(s["start_line"], s["end_line"]))
    found = once(
        sides, *FILE, "ord", "language", "old_side", "new_text", "old_text",
        hit=F.filter("new_side", contains("changed")), gone=F.filter("old_side", contains("removed")),
    )
    none = F.lit(None).cast("int")

    def latest_old(s: Column) -> Column:
        same = F.filter("old_side", lambda o: o["function_name"] == s["function_name"])
        return F.array_max(F.transform(same, lambda o: F.struct(o["ord"].alias("ord"), o["start_line"].alias("start_line"), o["end_line"].alias("end_line"))))

    def change(s: Column, kind: Column, old_from: Column, old_to: Column, new_from: Column, new_to: Column, deleted: int) -> Column:
        return F.struct(
            s["function_name"].alias("function_name"), kind.alias("change_type"), s["start_line"].alias("start_line"), s["end_line"].alias("end_line"),
            old_from.alias("old_from"), old_to.alias("old_to"), new_from.alias("new_from"), new_to.alias("new_to"),
            F.lit(deleted).cast("bigint").alias("deleted"), s["ord"].cast("bigint").alias("symbol_ord"),
        )

    with_old = F.transform("hit", lambda s: F.struct(s.alias("s"), latest_old(s).alias("o")))
    current = F.transform(with_old, lambda x: change(
        x["s"], F.when(x["o"].isNotNull(), "modified").otherwise("added"),
        x["o"]["start_line"], x["o"]["end_line"], x["s"]["start_line"], x["s"]["end_line"], 0))
    lost = F.filter("gone", lambda o: ~F.exists("hit", lambda s: s["function_name"] == o["function_name"]))
    deleted = F.transform(lost, lambda o: change(o, F.lit("deleted"), o["start_line"], o["end_line"], none, none, 1))
    every = found.select(*FILE, "ord", "language", "new_text", "old_text", F.explode(F.concat(current, deleted)).alias("f"))
    return every.select(
        *FILE, "language", "f.function_name", "f.change_type", "f.start_line", "f.end_line",
        _code("old").alias("old_code"), _code("new").alias("new_code"),
        F.array("ord", "f.deleted", "f.symbol_ord").alias("ord"),
    )


def _code(side: str) -> Column:
    """Code of one side; lines outside the diff read as empty."""
    first, last = F.col(f"f.{side}_from"), F.col(f"f.{side}_to")
    rows = F.transform(F.sequence(first, last), lambda i: F.coalesce(F.try_element_at(F.col(f"{side}_text"), i), F.lit("")))
    return F.when(first.isNotNull(), F.array_join(rows, "\n"))


def relevant_commits(
    candidates: DataFrame, commits: DataFrame, deploys: DataFrame, nodes: DataFrame, inc: Incidents
) -> DataFrame:
    """Commits in the deploy window that belong to the candidate's last deploy.

    ``deploys`` is the latest deploy per candidate. A commit without a deploy
    id, or a candidate without a deploy, matches by service and time alone.
    """
    recent = in_window(commits, "timestamp", inc, inc.params.deploy_lookback_minutes * 60, 0)
    open_code = nodes.where("node_type = 'service' AND code_access_enabled").select(*per_incident(nodes), "node_id")
    linked = F.col("deploy_event_id").isNull() | F.col("deploy_id").isNull() | (F.col("deploy_event_id") == F.col("deploy_id"))
    return (
        recent.withColumnRenamed("service_id", "node_id")
        .join(candidates.select(*KEY).distinct(), KEY, "left_semi")
        .join(open_code, [*per_incident(nodes), "node_id"], "left_semi")
        .join(deploys.select(*KEY, "deploy_id"), KEY, "left")
        .where(linked)
        .select(*KEY, "event_id")
    )


def error_frames(window: DataFrame, of: DataFrame) -> DataFrame:
    """Stack frames of error spans of the given (incident, node) pairs."""
    own = F.transform(F.col("exceptions"), lambda x: x["stacktrace"])
    traces = F.concat(F.coalesce(own, F.array().cast("array<string>")), F.array("stacktrace"))
    failing = window.where("is_error AND (exceptions IS NOT NULL OR stacktrace IS NOT NULL)").join(
        of.select(*KEY).distinct(), KEY, "left_semi"
    )
    return (
        once(failing, *KEY, "span_id", "ord", frames=frames_of(traces))
        .select(*KEY, "span_id", "ord", F.posexplode("frames").alias("pos", "f"))
        .select(
            *KEY, "span_id", "ord", "pos", "f.file_path", "f.function_name", "f.line_number",
            basename(F.col("f.file_path")).alias("base"),
        )
    )


def match_stack(frames: DataFrame, commits: DataFrame, functions: DataFrame, inc: Incidents) -> DataFrame:
    """Best frame-to-function match per candidate.

    Only the earliest frame and the first function of each join key can win,
    so both sides are folded to one row per key before an equality join: on
    (file, line) for exact hits, (file, function) and (file) for weaker ones.
    Each side is folded to its finest key once, where the code of a function
    takes part for the first functions only; the coarser keys fold that.
    """
    tol = inc.params.line_tolerance
    changed = commits.join(functions, "event_id").select(
        *KEY, "event_id", "function_name", "file_path", "start_line", "old_code", "new_code",
        F.col("ord").alias("function_ord"), basename(F.col("file_path")).alias("base"),
    )
    target = F.struct("function_ord", "event_id", "function_name", "file_path", "old_code", "new_code")
    spot = F.struct("ord", "pos", "line_number", "span_id")
    listed = isinstance(functions.schema["ord"].dataType, T.ArrayType)
    lead = F.coalesce(F.get("function_ord", F.lit(0)) if listed else F.col("function_ord"), F.lit(-(1 << 63)))
    places = first_of(frames, [*KEY, "base", "function_name", "line_number"], F.col("ord"), spot, "spot")
    targets = first_of(changed, [*KEY, "base", "function_name", "start_line"], lead, target, "target")

    def best(rank: int, keys: list[str], frame_side: DataFrame, function_side: DataFrame) -> DataFrame:
        f = frame_side.groupBy(*KEY, *keys).agg(F.min("spot").alias("spot"))
        g = function_side.groupBy(*KEY, *keys).agg(F.min("target").alias("target"))
        return f.join(g, [*KEY, *keys]).select(*KEY, F.lit(rank).alias("rank"), "spot", "target")

    near = targets.withColumn("at", F.explode(F.sequence(F.col("start_line") - tol, F.col("start_line") + tol)))
    at_line = places.where("line_number IS NOT NULL").withColumn("at", F.col("line_number"))
    hits = (
        best(0, ["base", "at"], at_line, near)
        .unionByName(best(1, ["base", "function_name"], places, targets))
        .unionByName(best(2, ["base"], places, targets))
    )
    kinds = F.array(*[F.lit(k) for k in MATCHES])
    sure = F.array(*[F.lit(v) for v in MATCHES.values()])
    return (
        hits.groupBy(*KEY)
        .agg(F.min(F.struct("rank", "spot", "target")).alias("b"))
        .select(
            *KEY,
            F.element_at(kinds, F.col("b.rank") + 1).alias("match_type"),
            F.element_at(sure, F.col("b.rank") + 1).alias("match_confidence"),
            F.col("b.spot.span_id").alias("span_id"),
            F.col("b.spot.line_number").alias("frame_line"),
            F.col("b.target.event_id").alias("commit_event_id"),
            F.col("b.target.function_name").alias("function_name"),
            F.col("b.target.file_path").alias("file_path"),
            F.col("b.target.old_code").alias("old_code"),
            F.col("b.target.new_code").alias("new_code"),
        )
    )

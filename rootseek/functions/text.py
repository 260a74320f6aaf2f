"""Column helpers for parsing and for the wording of findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The three stack-frame formats (File "f", line n, in g; name (file:line[:col]);
# at file:line:col without parentheses); word and space characters are Unicode's.
PYTHON_FRAME = r'(?U)File\s+"?([^",\n]+)"?,\s+line\s+(\d+),\s+in\s+(\S+)'
NAMED_FRAME = r"(?U)(?:at\s+)?([\w.<>/\[\]$]+)(?:\s+\[as\s+[^\]]+\])?\s*\(([^)]+?):(\d+)(?::\d+)?\)"
ANONYMOUS_FRAME = r"(?mU)^\s*at\s+(?:async\s+)?([^\s()]+?):(\d+):(\d+)\s*$"


def parse_int(raw: Column) -> Column:
    """Whole-number text to INT; anything else is NULL."""
    return F.when(raw.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(raw).try_cast("int"))


def http_code(attributes: Column) -> Column:
    """First non-empty status attribute, then parsed; no fallback on failure."""
    return parse_int(
        F.coalesce(
            F.nullif(attributes["http.status_code"], F.lit("")),
            F.nullif(attributes["http.response.status_code"], F.lit("")),
        )
    )


def basename(path: Column) -> Column:
    return F.regexp_extract(path, "[^/]*$", 0)


def last_part(name: Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1)


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | text.contains(word)
    return found


def whole(x: Column) -> Column:
    """Number without decimals, halves to even."""
    return F.format_string("%.0f", F.bround(x, 0))


def one_decimal(x: Column) -> Column:
    return F.format_string("%.1f", x)


def percent(ratio: Column) -> Column:
    return F.concat(whole(ratio * 100), F.lit("%"))


def text(x: Column) -> Column:
    return x.cast("string")


def stack_frames(trace: Column) -> Column:
    """Frames of one stack trace, format by format, in order of appearance."""

    def rows(pattern: str, file_group: int, line_group: int, name_group: int | None) -> Column:
        groups = lambda g: F.regexp_extract_all(trace, F.lit(pattern), F.lit(g))
        files = groups(file_group)
        names = groups(name_group) if name_group else F.transform(files, lambda f: F.lit("<anonymous>"))
        zipped = F.arrays_zip(files.alias("f"), groups(line_group).alias("l"), names.alias("n"))
        return F.transform(
            zipped,
            lambda z: F.struct(
                z["f"].alias("file_path"),
                z["n"].alias("function_name"),
                z["l"].try_cast("int").alias("line_number"),
            ),
        )

    none = F.array().cast("array<struct<file_path:string,function_name:string,line_number:int>>")
    # a pattern is run once per group, so formats whose fixed words are missing are not tried
    if_any = lambda frames, *words: F.when(reduce(Column.__and__, [trace.contains(w) for w in words]), frames).otherwise(none)
    named = F.transform(
        rows(NAMED_FRAME, 2, 3, 1),
        lambda r: F.struct(
            r["file_path"].alias("file_path"),
            last_part(r["function_name"]).alias("function_name"),
            r["line_number"].alias("line_number"),
        ),
    )
    return F.concat(
        if_any(rows(PYTHON_FRAME, 1, 2, 3), "File", "line"), if_any(named, "(", ":"), if_any(rows(ANONYMOUS_FRAME, 1, 2, None), "at", ":")
    )


def frames_of(traces: Column) -> Column:
    """Distinct frames over several stack traces, in order."""
    filled = F.filter(traces, lambda t: t.isNotNull() & (t != ""))
    return F.array_distinct(F.flatten(F.transform(filled, stack_frames)))

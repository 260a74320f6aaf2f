"""Typed access to raw JSON where the JSON type of a value matters.

A record is parsed once into a map from field name to (type, text); all checks
then look at that map. ``once`` keeps the optimizer from repeating the parse
for every field that is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TIMESTAMP = r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}(\.\d{1,6})?Z$"
NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"
INTEGER = r"^\s*[+-]?\d+\s*$"


def once(df: DataFrame, *keep: str, **columns: Column) -> DataFrame:
    """Select ``keep`` plus computed columns, each evaluated exactly once.

    The columns travel through a one-element explode, which projections above
    it cannot be merged into.
    """
    packed = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select(*keep, F.explode(F.array(packed)).alias("_once")).select(*keep, "_once.*")


def typed(v: Column) -> Column:
    """(type, text) of a variant."""
    return F.struct(
        F.schema_of_variant(v).alias("type"), F.try_variant_get(v, "$", "string").alias("text")
    )


def fields(v: Column) -> Column:
    """Members of a JSON object as name -> (type, text); NULL for other values."""
    return F.transform_values(F.try_variant_get(v, "$", "map<string,variant>"), lambda k, x: typed(x))


def picked(v: Column, names: list[str]) -> Column:
    """The named members of a JSON object as variants, read in one walk; NULL for other values."""
    return F.try_variant_get(v, "$", f"struct<{','.join(f'{n}:variant' for n in names)}>")


def typed_member(o: str, name: str) -> Column:
    """(type, text) of a member made by ``picked``; NULL when absent."""
    return F.when(F.col(o)[name].isNotNull(), typed(F.col(o)[name]))


def member(m: str, name: str) -> Column:
    """A field of a map made by ``fields``; NULL when absent."""
    return F.col(m)[name]


def is_string(f: Column) -> Column:
    return F.coalesce(f["type"] == "STRING", F.lit(False))


def is_null(f: Column) -> Column:
    """Absent, or JSON null."""
    return f.isNull() | F.coalesce(f["type"] == "VOID", F.lit(False))


def is_integer(f: Column) -> Column:
    return F.coalesce(f["type"] == "BIGINT", F.lit(False))


def is_number(f: Column) -> Column:
    t = f["type"]
    return F.coalesce(t.isin("BIGINT", "DOUBLE", "FLOAT") | t.startswith("DECIMAL"), F.lit(False))


def is_object(f: Column) -> Column:
    return F.coalesce(f["type"].startswith("OBJECT"), F.lit(False))


def is_array(f: Column) -> Column:
    return F.coalesce(f["type"].startswith("ARRAY"), F.lit(False))


def shown(f: Column) -> Column:
    """How the value reads as text; null and missing read 'None'."""
    return (
        F.when(is_null(f), "None").when(f["type"] == "BOOLEAN", F.initcap(f["text"])).otherwise(f["text"])
    )


def truthy(f: Column) -> Column:
    """False for absent, null, empty text, false, zero and empty containers."""
    zero = f["text"].rlike(r"^[+-]?0*(\.0*)?([eE][+-]?\d+)?$")
    return ~(
        is_null(f)
        | F.coalesce(f["text"] == "", F.lit(False))
        | ((f["type"] == "BOOLEAN") & (f["text"] == "false"))
        | (is_number(f) & zero)
        | (f["type"].startswith("OBJECT") & (f["text"] == "{}"))
        | (f["type"].startswith("ARRAY") & (f["text"] == "[]"))
    )


def utc_timestamp(f: Column) -> Column:
    """Strict UTC timestamp text, NULL for anything else."""
    return F.when(is_string(f) & f["text"].rlike(TIMESTAMP), f["text"].try_cast("timestamp"))

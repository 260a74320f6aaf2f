"""First and last rows of each key without sorting all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_of(rows: DataFrame, key: list[str], lead: Column, pick: Column, name: str, last: bool = False) -> DataFrame:
    """(key, name): the least (``last``: greatest) ``pick`` of each key, a struct whose first field is ``lead``.

    A minimum of structs sorts its input, and spills. So the least ``lead``, a number or a
    time, is found by hash first, and only rows that have it are compared as a whole.
    ``rows`` are read twice. A null lead counts only if ``last``, as the smallest.
    """
    best = F.max if last else F.min
    led = rows.withColumn("_lead", lead)
    least = led.groupBy(*key).agg(best("_lead").alias("_least")).withColumnsRenamed({k: f"_of_{k}" for k in key})
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in key])
    leading = led.join(least, same & F.col("_lead").eqNullSafe(F.col("_least")), "left_semi")
    return leading.groupBy(*key).agg(best(pick).alias(name))

"""Helpers the operators share: reading, written tables, row numbers, block grids."""

from __future__ import annotations

import ctypes
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rootseek.session import durable

__all__ = ["durable", "read", "ship", "arrow_rows", "per_partition", "partition_offsets", "ceil_div", "kept"]

_shipped: set[str] = set()
#: What this worker keeps from task to task, and which of it the running task has asked for.
_kept: dict[tuple[Callable, str], object] = {}
_asked: set[tuple[Callable, str]] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Have Spark send this package to the workers, wherever the driver found it."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        target = os.path.join(tempfile.mkdtemp(prefix="rootseek-"), "rootseek.zip")  # Spark serves it from the driver
        with zipfile.ZipFile(target, "w") as z:
            for folder, _, names in os.walk(top):
                for name in names:
                    if name.endswith(".py"):
                        z.write(os.path.join(folder, name), os.path.join("rootseek", os.path.relpath(os.path.join(folder, name), top)))
        spark.sparkContext.addPyFile(target)
        # whole texts may be long: small batches keep the workers' memory bounded. Both hold for the session.
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return spark


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ceil_div(a: int, b: int) -> int:
    return -(-a // b)


def arrow_rows(columns: dict[str, tuple[object, pa.DataType]]) -> pa.RecordBatch:
    """A record batch of named (values, type) columns."""
    return pa.RecordBatch.from_arrays(
        [v if isinstance(v, pa.Array) else pa.array(v, type=t) for v, t in columns.values()], names=list(columns)
    )


def kept(make: Callable[[str], object], key: str) -> object:
    """``make(key)``, made once in a worker and kept until a task gives rows without asking for it."""
    name = (make, key)
    _asked.add(name)
    if name not in _kept:
        _kept[name] = make(key)
    return _kept[name]


def _forget() -> None:
    """Drop what only earlier work needed; else idle workers hold it through all that follows."""
    for name in _kept.keys() - _asked:
        del _kept[name]


def _release() -> None:
    """Give memory that a task no longer needs back to the machine; workers live on."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def _tidy(work: Callable) -> Callable:
    def run(batches):
        _asked.clear()
        rows = 0
        try:
            for batch in work(batches):
                rows += batch.num_rows
                yield batch
            if rows:
                _forget()
        finally:
            _release()

    return run


def chain(*works: Callable) -> Callable:
    """Several steps over batches in one worker, each taking what the one before gives."""

    def run(batches):
        for work in works:
            batches = work(batches)
        return batches

    return run


def per_partition(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with this package at hand on the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(_tidy(work), schema)


def partition_offsets(totals: DataFrame, part: str, amount: str) -> DataFrame:
    """(part, before): the amounts of all parts with a smaller number.

    One row per partition of the input comes in, so the ordered sum is small
    whatever the number of rows.
    """
    rows = sorted((r[part], r[amount]) for r in totals.select(part, amount).collect())
    before = np.concatenate([[0], np.cumsum([n for _, n in rows], dtype=np.int64)]).tolist()
    spark = totals.sparkSession
    return F.broadcast(spark.createDataFrame([(int(p), int(b)) for (p, _), b in zip(rows, before)], f"{part} int, before long"))

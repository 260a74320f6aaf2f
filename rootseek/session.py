"""Session settings and durable intermediate tables."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar, copy_context

from pyspark.sql import DataFrame, SparkSession

# Settings the operators rely on. Sizes are left to the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # The JVM never compiles a method beyond this size; Spark then runs the steps one by one, in methods that it does compile.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}

# Lists that take the folders of written tables while a ``written_here`` block of a thread is open.
_open = ContextVar("open_lists", default=())


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for written intermediate tables, named by ``spark.checkpoint.dir``.

    There is no fallback: a folder made up here might be local to one machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named


def durable(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and read it back.

    Cuts the lineage, survives the loss of executors, and gives the planner
    true file sizes for its join choices.
    """
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_folder(spark: SparkSession, label: str) -> str:
    """A folder of its own under the shared one."""
    path = os.path.join(scratch_dir(spark), "rootseek", f"{label}-{uuid.uuid4().hex}")
    for folders in _open.get():
        folders.append(path)
    return path


@contextmanager
def written_here():
    """The folders written inside the block, for ``delete`` once their readers are done."""
    folders: list[str] = []
    token = _open.set((*_open.get(), folders))
    try:
        yield folders
    finally:
        _open.reset(token)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether anything lies under a path or pattern."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target)
    return found is not None and len(found) > 0


def delete(spark: SparkSession, folders: list[str]) -> None:
    """Remove written tables, through the store that holds them."""
    jvm = spark._jvm
    for path in folders:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    folders.clear()


def together(*steps: Callable):
    """Run independent steps at the same time; Spark interleaves their jobs.

    Keeps the executors busy when single steps are too small to fill them.
    """
    with ThreadPoolExecutor(max_workers=len(steps)) as pool:
        return [f.result() for f in [pool.submit(copy_context().run, step) for step in steps]]


def durable_all(**tables: DataFrame) -> dict[str, DataFrame]:
    """``durable`` for several independent tables at once."""
    written = together(*[lambda n=n, d=d: durable(d, n) for n, d in tables.items()])
    return dict(zip(tables, written))

"""Time-bounded reads of telemetry tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import exists


def _bounded(table: DataFrame, column: str, start: str | datetime, end: str | datetime) -> DataFrame:
    """Rows in ``[start, end)``. Literal bounds, so day folders, files and row groups are pruned."""
    lo, hi = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    inside = (F.col(column) >= lo) & (F.col(column) < hi)
    return table.where(inside & F.col("day").between(F.to_date(lo), F.to_date(hi)) if "day" in table.columns else inside)


def fetch_spans(spans: DataFrame, start, end, service_id: str | None = None) -> DataFrame:
    rows = _bounded(spans, "start_time", start, end)
    return rows if service_id is None else rows.where(F.col("service_id") == service_id)


def fetch_metrics(metrics: DataFrame, start, end, node_id: str | None = None) -> DataFrame:
    rows = _bounded(metrics, "timestamp", start, end)
    return rows if node_id is None else rows.where(F.col("node_id") == node_id)


def store_by_day(table: DataFrame, column: str, path: str) -> None:
    """Write a telemetry table in one folder per day of ``column``; days it holds replace stored ones.

    Each day is split over tasks by the rows themselves, so a busy day is no single task.
    """
    spark = table.sparkSession
    dated = table.withColumn("day", F.to_date(column))
    if exists(spark, path):
        dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
    else:
        dated.write.partitionBy("day").parquet(path)


def read_by_day(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A table stored by day. Its ``day`` column lets bounds skip whole folders.

    With ``schema`` (without the day) no file is opened to find out its columns.
    """
    return spark.read.parquet(path) if schema is None else spark.read.schema(f"{schema}, day date").parquet(path)

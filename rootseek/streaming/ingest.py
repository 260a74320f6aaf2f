"""The ingest operators on a stream of new files.

They are column expressions, so the batch functions serve each micro-batch
unchanged; valid rows and rejects go to two append-only tables. Rows keep an
order across micro-batches. The progress of a stream is kept beside its results,
not among tables that may be deleted.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.records import record_order, store

Ingest = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


def ingest_stream(
    spark: SparkSession, source: str, ingest: Ingest, good_path: str, reject_path: str, name: str
) -> StreamingQuery:
    """Ingest every new JSON-lines file under ``source`` until none is left."""

    def write(batch: DataFrame, batch_id: int) -> None:
        records = batch.select(F.col("value").alias("raw"), record_order(batch_id).alias("ord"))
        good, bad = ingest(records)
        # One folder per batch: a batch replayed after a failure replaces its own output.
        good.write.mode("overwrite").parquet(os.path.join(good_path, f"batch={batch_id}"))
        bad.write.mode("overwrite").parquet(os.path.join(reject_path, f"batch={batch_id}"))

    return (
        spark.readStream.text(source)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", os.path.join(good_path + ".progress", name))
        .trigger(availableNow=True)
        .start()
    )


def store_stream(spark: SparkSession, source: str, tagged: Callable[[DataFrame], DataFrame], path: str, name: str) -> StreamingQuery:
    """As ``ingest_stream``, yet into one table of good rows and rejects, each file read and parsed once.

    ``tagged`` is a ``tagged_*`` operator; ``records.stored`` tells the two sides apart.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(F.col("value").alias("raw"), record_order(batch_id).alias("ord"))
        store(tagged(rows), os.path.join(path, f"batch={batch_id}"), overwrite=True)

    return (
        spark.readStream.text(source)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", os.path.join(path + ".progress", name))
        .trigger(availableNow=True)
        .start()
    )

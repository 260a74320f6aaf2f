"""Raw JSON records: one row per record with its text and input order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import exists


# Wide enough for batch, partition, row and position in a record together.
ORDER = "decimal(38,0)"
BATCH_ROWS, RECORD_ITEMS = 1 << 63, 1 << 31


def record_order(batch: int | None = None) -> Column:
    """Position of a row: batch, partition of the read, row.

    It follows the read, in which Spark may take larger files first; give
    records an order of their own where file order matters.
    """
    row = F.monotonically_increasing_id()
    return row if batch is None else (F.lit(batch).cast(ORDER) * F.lit(BATCH_ROWS - 1) + F.lit(batch) + row).cast(ORDER)


def item_order(record: Column, position: Column) -> Column:
    """Order of the items of ordered records. A record has fewer items than an array can hold."""
    return (record.cast(ORDER) * F.lit(RECORD_ITEMS) + position).cast(ORDER)


#: Records in one written file. A compressed file is read by one task.
FILE_RECORDS = 50_000


def write_lines(records: DataFrame, path: str) -> None:
    """Records as compressed JSON lines, for ``json_lines``; in files that one task can read."""
    records.select("raw").write.option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """One record per line; files split freely across tasks unless compressed. A path without files has no records."""
    if not exists(spark, path):
        return spark.createDataFrame([], "raw string, ord long")
    return spark.read.text(path).select(F.col("value").alias("raw"), record_order().alias("ord"))


def json_files(spark: SparkSession, path: str) -> DataFrame:
    """Files holding one object or an array of them.

    Each file is parsed as a whole, so keep single files moderate; files are
    spread over tasks. Unreadable text and other roots give no records, nor
    does a path without files.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], "raw string, ord long")
    missing_ok = spark.read.option("ignoreMissingFiles", "true")
    v = F.try_parse_json("value")
    root = F.schema_of_variant("v")
    items = F.when(root.startswith("ARRAY"), F.try_variant_get("v", "$", "array<variant>")).when(
        root.startswith("OBJECT"), F.array("v")
    )
    return (
        missing_ok.text(path, wholetext=True)
        .select(v.alias("v"), F.monotonically_increasing_id().alias("file"))
        .select("file", F.posexplode(items).alias("pos", "item"))
        .select(F.to_json("item").alias("raw"), record_order().alias("ord"))
    )


def tagged(checked: DataFrame, columns: list[str], source: str) -> DataFrame:
    """Checked rows with their columns, and for rejects ``source``, ``reason`` and the record's text."""
    return checked.select(*columns, F.lit(source).alias("source"), "reason", F.when(F.col("reason").isNotNull(), F.col("raw")).alias("raw"))


def split(rows: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Tagged rows without a ``reason``, and the rest as rejects. Each side reads the records by itself."""
    return rows.where("reason IS NULL").select(*columns), rows.where("reason IS NOT NULL").select("source", "reason", "raw")


def store(rows: DataFrame, path: str, overwrite: bool = False) -> dict[str, int]:
    """Write tagged rows in one pass over the records, and return how many were good and rejected.

    Good rows and rejects lie in folders of one table (see ``stored``); the counts
    are collected while writing.
    """
    seen = Observation("ingest")
    bad = F.col("reason").isNotNull()
    counted = rows.observe(seen, F.count_if(~bad).alias("good"), F.count_if(bad).alias("rejected"))
    counted.withColumn("rejected", bad).write.partitionBy("rejected").mode("overwrite" if overwrite else "append").option(
        "partitionOverwriteMode", "static"
    ).parquet(path)
    return {name: int(n or 0) for name, n in seen.get.items()}


def stored(spark: SparkSession, path: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Good rows and rejects that ``store`` wrote; each side reads its own folder."""
    rows = spark.read.parquet(path)
    good = rows.where("rejected = 'false'").select(*columns)
    return good, rows.where("rejected = 'true'").select("source", "reason", "raw")


def first_reason(*checks: tuple[Column, str]) -> Column:
    """Text of the first check that fails."""
    out = F.lit(None).cast("string")
    for ok, reason in reversed(checks):
        out = F.when(~F.coalesce(ok, F.lit(False)), reason).otherwise(out)
    return out

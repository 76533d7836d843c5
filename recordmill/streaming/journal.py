"""Streaming forms of resumable work: a journal that grows, and upserts that change nothing when repeated."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.records import first_wins, upserted


def read_journal(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Entries of a growing folder of JSON lines; a torn line is let go."""
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").json(path)


def once_each(entries: DataFrame, key: Sequence[str], time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Each key's first entry. With a time column state is dropped after the delay; without one it is kept for good."""
    if time is None:
        return entries.dropDuplicates(list(key))
    return entries.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(key))


def counted(entries: DataFrame, time: str, by: str, window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Entries by window of time and key; late ones up to the delay still count."""
    return entries.withWatermark(time, delay).groupBy(F.window(time, window), by).agg(F.count(F.lit(1)).alias("n"))


def upsert_stream(entries: DataFrame, table: str, key: str, order: Sequence[str], checkpoint: str) -> StreamingQuery:
    """Upsert every batch into a parquet table by key. Versions of the table are written beside each other and named by batch,
    so that a batch that runs again after a failure overwrites its own version only."""

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = first_wins(batch, [key], [F.col(c) for c in order])
        held = current(spark, table, before=number)
        out = new if held is None else upserted(new, held, key)
        out.write.mode("overwrite").parquet(f"{table}/version={number}")

    return entries.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, table: str, before: int | None = None) -> DataFrame | None:
    """The newest version of a table that upsert_stream keeps (below a number)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    versions = [int(s.getPath().getName().partition("=")[2]) for s in fs.listStatus(path) if s.getPath().getName().startswith("version=")]
    versions = [v for v in versions if before is None or v < before]
    return spark.read.parquet(f"{table}/version={max(versions)}") if versions else None

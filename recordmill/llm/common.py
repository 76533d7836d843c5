"""What the operators of this package share: reading columns in Arrow batches, cuts of lineage that survive executors, numbering."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OWN_FOLDER: str | None = None
_SCOPES: list[list[DataFrame]] = []
#: Rows of text handed to a Python worker at once: bounds a worker's memory whatever the partition's size.
TEXT_BATCH_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = TEXT_BATCH_ROWS) -> None:
    """Lower (never raise) the Arrow batch size of the session, so that long texts don't pile up in one batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where that setting is absent, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    global _OWN_FOLDER
    if _OWN_FOLDER is None:
        _OWN_FOLDER = tempfile.mkdtemp(prefix="checkpoint-")
        atexit.register(shutil.rmtree, _OWN_FOLDER, ignore_errors=True)
    return f"file://{_OWN_FOLDER}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows as a table in the shared folder and read it. Unlike an executor's blocks the table
    outlives executors, and it is compressed by column."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    for made in _SCOPES:
        made.append(out)
    return out


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """The tables that cut() writes inside the block."""
    made: list[DataFrame] = []
    _SCOPES.append(made)
    try:
        yield made
    finally:
        _SCOPES[:] = [s for s in _SCOPES if s is not made]


def sweep(tables: list[DataFrame], read_by: DataFrame) -> None:
    """Delete tables that cut() wrote, but those that a frame still reads."""
    files = read_by.inputFiles()
    discard(*[t for t in tables if not any(t._cut_path.rpartition("/")[2] in f for f in files)])
    tables.clear()


def discard(*tables: DataFrame) -> None:
    """Delete tables that cut() wrote, when nothing reads them any more."""
    for df in tables:
        jvm, path = df.sparkSession._jvm, df._cut_path
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of lineages that were cut: it does so once the driver's objects are collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """The column's texts; null counts as empty."""
    return ["" if x is None else x for x in column.to_pylist()]


def map_arrow(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | T.StructType) -> DataFrame:
    """Apply a function of one record batch to every batch; None yields nothing. A worker that waits for its next task holds no
    Arrow memory."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = function(batch)
            if out is not None:
                yield out
            batch = out = None
        pa.default_memory_pool().release_unused()

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def with_columns(batch: pa.RecordBatch, added: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with columns appended; columns of the same names are replaced."""
    names = [n for n in batch.schema.names if n not in added]
    return pa.RecordBatch.from_arrays([batch.column(n) for n in names] + list(added.values()), names=names + list(added))


def extended(schema: T.StructType, added: str) -> T.StructType:
    """The schema with the fields of a DDL text appended; fields of the same names are replaced."""
    fields = T.StructType.fromDDL(added).fields
    names = {f.name for f in fields}
    return T.StructType([f for f in schema.fields if f.name not in names] + fields)


def numbered(df: DataFrame, group: list[str], order: list, name: str, count: str | None = None) -> DataFrame:
    """Add the row's place (from 0) among the rows of its group in the given order, without gathering a group in one task.

    The rows are sorted over the whole table into ranges, kept in a table, numbered inside each range, and shifted by
    the sums of the ranges before. A window by group then only sees one row for each range that the group reaches.
    `order` must end in something that tells rows apart or be content to leave ties in any order.
    """
    return running(df, group, order, F.lit(1).cast("long"), name, count)


def running(df: DataFrame, group: list[str], order: list, value, name: str, total: str | None = None) -> DataFrame:
    """Add the sum of `value` over the rows before this one in its group (see numbered); nulls count as 0."""
    from pyspark.sql import Window as W

    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc_nulls_first() for c in group] + list(order)
    ranged = df.withColumn("_value", F.coalesce(value, F.lit(0)).cast("long")).withColumn("_salt", F.rand(17))
    ranged = cut(ranged.repartitionByRange(parts, *keys, F.col("_salt")).withColumn("_range", F.spark_partition_id()))
    inside = W.partitionBy(*group, "_range").orderBy(*order, "_salt")
    local = ranged.withColumn(name, F.sum("_value").over(inside.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_value"))
    sums = ranged.groupBy(*group, "_range").agg(F.sum("_value").alias("_sum"))
    before = W.partitionBy(*group).orderBy("_range")
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    if total:
        sums = sums.withColumn(total, F.sum("_sum").over(W.partitionBy(*group)))
    renamed = sums.select(*[F.col(c).alias(f"_key_{i}") for i, c in enumerate(group)], F.col("_range").alias("_key_range"), "_before", *([total] if total else []))
    match = F.col("_range") == F.col("_key_range")
    for i, c in enumerate(group):
        match = match & F.col(c).eqNullSafe(F.col(f"_key_{i}"))
    joined = local.join(renamed, match)
    return joined.withColumn(name, F.col(name) + F.col("_before")).drop("_value", "_salt", "_range", "_key_range", "_before", *[f"_key_{i}" for i in range(len(group))])


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start+1, … of each run, one run after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def covered(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """The union of half-open spans as maximal runs in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(starts.tolist(), ends.tolist(), strict=True)):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        elif b > a:
            out.append((a, b))
    return out

"""Reading and writing records and tables: JSON stores, CSV of unknown encoding, graphs, inventories, sinks."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Iterator, Mapping
from functools import reduce
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..kinds import BY_NAME, KINDS

#: Older names of fields.
ALIASES = {"cellSpecId": "cell_spec_id", "serialNumber": "serial_number", "shortId": "short_id", "cellFormat": "cell_format", "distribution": "distributions", "encodingFormat": "encoding_format", "contentUrl": "content_url", "accessUrl": "access_url"}


def read_kind(spark: SparkSession, root: str, kind: str, schema: T.StructType | None = None, strict: bool = False) -> DataFrame:
    """Every record of a kind, one JSON file each, with the scan order (_order: the file's path). strict: unreadable files fail."""
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST" if strict else "PERMISSIVE").option("pathGlobFilter", "*.json")
    df = (reader.schema(schema) if schema is not None else reader).json(f"{root}/{BY_NAME[kind].folder}")
    return canonical(df).withColumn("_order", F.col("_metadata.file_path"))


def read_store(spark: SparkSession, root: str, strict: bool = True) -> dict[str, DataFrame]:
    """All kinds whose folder exists; a file that is no record fails."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return {k.name: read_kind(spark, root, k.name, strict=strict) for k in KINDS if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{k.folder}"))}


def canonical(df: DataFrame, aliases: Mapping[str, str] = ALIASES) -> DataFrame:
    """Old names of top fields renamed; where both are there the new one wins and the old one fills its gaps."""
    for old, new in aliases.items():
        if old in df.columns:
            df = df.withColumn(new, F.coalesce(new, old)).drop(old) if new in df.columns else df.withColumnRenamed(old, new)
    return df


def kind_of(df: DataFrame) -> Column:
    """The first kind, in the registry's order, whose body is there."""
    out = None
    for k in KINDS:
        if k.body in df.columns:
            out = F.when(F.col(k.body).isNotNull(), k.name) if out is None else out.when(F.col(k.body).isNotNull(), k.name)
    return F.lit(None).cast("string") if out is None else out


def polymorphic_name(c: Column, field: str = "name") -> Column:
    """A name given as text or as an object with a name."""
    return F.coalesce(F.get_json_object(c, f"$.{field}"), F.when(~c.startswith("{"), c))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    return spark.read.option("header", True).csv(path)


def read_csv_any_encoding(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """CSV files (quoted line breaks allowed) in UTF-8 with or without a mark, else Windows-1252, else with replacements.

    A file is decoded as a whole before rows are made of it. Missing columns are null.
    """
    import csv
    import io

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                text = None
                for encoding in ("utf-8-sig", "cp1252"):
                    try:
                        text = bytes(content).decode(encoding)
                        break
                    except UnicodeDecodeError:
                        continue
                text = bytes(content).decode("utf-8", "replace") if text is None else text
                found = list(csv.DictReader(io.StringIO(text, newline="")))
                yield pd.DataFrame([[name, i, *[r.get(c) for c in columns]] for i, r in enumerate(found)], columns=["file", "row", *columns])

    schema = T.StructType([T.StructField("file", T.StringType()), T.StructField("row", T.LongType()), *[T.StructField(c, T.StringType()) for c in columns]])
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, schema)


def graph_nodes(spark: SparkSession, path: str) -> DataFrame:
    """Nodes of JSON-LD files with an @graph: file, id, types, node (JSON)."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    nodes = text.select("file", F.explode(F.from_json(F.get_json_object("value", "$['@graph']"), "array<string>")).alias("node"))
    types = F.get_json_object("node", "$['@type']")
    return nodes.select("file", F.get_json_object("node", "$['@id']").alias("id"), F.when(types.startswith("["), F.from_json(types, "array<string>")).otherwise(F.array(types)).alias("types"), "node")


def inventory(spark: SparkSession, path: str, roles: Mapping[str, str]) -> DataFrame:
    """Files below a folder with size, time and role (by ending); contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    role = reduce(lambda acc, kv: acc.when(F.lower("path").endswith(kv[0]), kv[1]), roles.items(), F.when(F.lit(False), "")).otherwise("other")
    return files.withColumn("role", role)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """sha256 and md5 of every file's bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"))


# Sinks

def write_document(path: str, document: object) -> None:
    """One document, written beside its place and moved there when whole."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=target.parent, prefix=f".{target.name}.")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as file:
            json.dump(document, file, ensure_ascii=False, indent=2)
            file.flush()
            os.fsync(file.fileno())
        os.replace(name, target)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise


def save_kind(df: DataFrame, root: str, kind: str, form: str = "parquet", mode: str = "overwrite") -> None:
    """A kind's table; Spark's commit makes the write all or nothing. One table, not one file a record."""
    df.write.mode(mode).format(form).save(f"{root}/{BY_NAME[kind].folder}")


def append_journal(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_lines(df: DataFrame, path: str) -> None:
    """A one-column table of text, such as N-Triples."""
    df.write.mode("overwrite").text(path)


def publish(df: DataFrame, path: str) -> None:
    """Documents (id, kind, document) as text files, in a folder for each kind."""
    df.select("kind", F.col("document").alias("value")).write.mode("overwrite").partitionBy("kind").text(path)

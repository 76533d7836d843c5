"""Measurement series: first and last values, downsampling, profiles, canonical columns."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import unix_of_timestamp

#: Canonical columns of a series.
COLUMNS = (
    "test_time_second", "unix_time_second", "voltage_volt", "current_ampere", "power_watt", "cycle_count", "step_count", "step_index", "charging_capacity_ah", "discharging_capacity_ah",
    "charging_energy_wh", "discharging_energy_wh", "ambient_temperature_celsius", "internal_resistance_ohm",
)


def first_last(df: DataFrame, by: str, value: str, order: Sequence[str]) -> DataFrame:
    """The first and the last known value of each series in its order: two partial aggregates, no sort."""
    key = F.when(F.col(value).isNotNull(), F.struct(*order))
    return df.groupBy(by).agg(F.min_by(value, key).alias("first_value"), F.max_by(value, key).alias("last_value"))


def downsample(df: DataFrame, by: str, order: Sequence[str], most: int) -> DataFrame:
    """Every k-th row of each series from its first on, k = n div most + 1; a series of no more than `most` rows stays whole."""
    inside = W.partitionBy(by)
    place = F.row_number().over(inside.orderBy(*order)) - 1
    rows = F.count(F.lit(1)).over(inside)
    step = F.when(rows > most, F.floor(rows / most) + 1).otherwise(1)
    return df.withColumn("_place", place).withColumn("_step", step).where(F.col("_place") % F.col("_step") == 0).drop("_place", "_step")


def period(df: DataFrame, by: str, time: str) -> DataFrame:
    return df.groupBy(by).agg(F.min(time).alias("first_ts"), F.max(time).alias("last_ts"))


def renamed(df: DataFrame, hints: Mapping[str, str]) -> tuple[DataFrame, list[str]]:
    """Columns renamed by hints, and the hints that name no column."""
    return df.withColumnsRenamed({a: b for a, b in hints.items() if a in df.columns}), [a for a in hints if a not in df.columns]


def lost_columns(source: Sequence[str], result: DataFrame, hints: Mapping[str, str]) -> list[str]:
    """Source columns that the result no longer has."""
    return [c for c in source if c not in result.columns and hints.get(c, c) not in result.columns]


def profile(df: DataFrame, vocabulary: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Measured variables by column: canonical name and unit from the vocabulary or the label itself; the first of a name stays."""
    rows, seen = [], set()
    for c in df.columns:
        label, _, unit = c.partition(" / ")
        name, unit = vocabulary.get(label.strip().lower(), (re.sub("[^a-z0-9]+", "_", label.strip().lower()).strip("_"), unit.strip() or None))
        if name not in seen:
            seen.add(name)
            rows.append((len(rows), name, unit))
    return df.sparkSession.createDataFrame(rows, "pos int, name string, unit string")


def infer_test_kind(columns: Sequence[str], rules: Sequence[tuple[str, Sequence[str]]], default: str = "other") -> str:
    """The kind of the first rule one of whose keywords is part of a column's name."""
    names = [c.lower() for c in columns]
    return next((kind for kind, words in rules if any(w in n for w in words for n in names)), default)


def raw_with_converted(files: DataFrame, path: str = "path", ending: str = ".bdf.parquet") -> DataFrame:
    """Raw files and, where there is one, the converted file beside them."""
    stem: Column = F.regexp_replace(path, r"\.[^./]*$", "")
    raw = files.where(~F.col(path).endswith(ending)).select(F.col(path), stem.alias("_stem"))
    done = files.where(F.col(path).endswith(ending)).select(F.col(path).alias("converted"), F.regexp_replace(path, re.escape(ending) + "$", "").alias("_done"))
    return raw.join(done, F.col("_stem") == F.col("_done"), "left").select(path, "converted")


def as_records(df: DataFrame, by: str, time: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """Series as records: a test for each (id, kind, started_at, ended_at in seconds) and its dataset (id, test_id, n_rows, variables
    that hold a value, in order of names). One aggregation each, without gathering a series."""
    measured = sorted(c for c in df.columns if c not in (by, time))
    test_id = F.concat(F.lit("test/"), F.col(by).cast("string"))
    tests = df.groupBy(by).agg(unix_of_timestamp(F.min(time)).alias("started_at"), unix_of_timestamp(F.max(time)).alias("ended_at")).select(test_id.alias("id"), F.lit(kind).alias("kind"), "started_at", "ended_at")
    held = F.array_compact(F.array(*[F.when(F.count(c) > 0, F.lit(c)) for c in measured]))
    datasets = df.groupBy(by).agg(F.count(F.lit(1)).alias("n_rows"), held.alias("variables")).select(F.concat(F.lit("dataset/"), F.col(by).cast("string")).alias("id"), test_id.alias("test_id"), "n_rows", "variables")
    return tests, datasets

"""Indexes, rollups, collation and completeness."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def kind_index(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows of each kind and in total."""
    parts = [df.select(F.lit(kind).alias("kind")) for kind, df in tables.items()]
    counts = reduce(DataFrame.unionByName, parts).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    return counts.unionByName(counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("total").alias("kind"), "n"))


def counted(stored: Column, items: Column) -> Column:
    """A stored count, else the list's length, else 0."""
    return F.coalesce(stored.cast("long"), F.when(items.isNotNull(), F.size(items)).cast("long"), F.lit(0).cast("long"))


def ordered_list(value: Column, *order: Column) -> Column:
    """An aggregate: values as an array in the given order."""
    key = [c.alias(f"_o{i}") for i, c in enumerate(order)]
    return F.transform(F.array_sort(F.collect_list(F.struct(*key, value.alias("_v")))), lambda x: x["_v"])


def collate(claims: DataFrame, by: str, order: Sequence[Column]) -> DataFrame:
    """parameter -> its claims (all other columns) in order, and their number."""
    others = [c for c in claims.columns if c != by]
    return claims.groupBy(by).agg(ordered_list(F.struct(*others), *order).alias("claims"), F.count(F.lit(1)).alias("n_claims"))


def with_source_citation(claims: DataFrame, claim: str, source: str) -> DataFrame:
    """A claim's own citation goes before its source's."""
    return claims.withColumn(claim, F.coalesce(claim, source)).drop(source)


def completeness(have: DataFrame, group: str, item: str, tiers: Mapping[str, Sequence[str]]) -> DataFrame:
    """group, tier, satisfied, missing (in the tier's order); tiers that require nothing are left out."""
    sets = have.groupBy(group).agg(F.collect_set(item).alias("_have"))
    rows = [F.struct(F.lit(t).alias("tier"), F.array_except(F.array(*map(F.lit, r)), "_have").alias("missing")) for t, r in tiers.items() if r]
    out = sets.select(group, F.explode(F.array(*rows)).alias("_t")).select(group, "_t.tier", "_t.missing")
    return out.withColumn("satisfied", F.size("missing") == 0)


def sided_completeness(have: DataFrame, group: str, scope: str, item: str, tiers: Mapping[str, Mapping[str, Sequence[str]]], sides: Sequence[str] = ("negative", "positive"), sided: Sequence[str] = ("material", "electrode")) -> DataFrame:
    """Completeness of a whole: every sided scope counts for each side, from the side's items or else the plain scope's.

    group, tier, satisfied, missing (map of scope, with side, to items)."""
    sets = have.groupBy(group, scope).agg(F.collect_set(item).alias("_items")).groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct(scope, "_items"))).alias("_have"))
    none = F.array().cast("array<string>")
    rows = []
    for tier, needs in tiers.items():
        entries = []
        for s, required in needs.items():
            for name in [f"{s}_{side}" for side in sides] if s in sided else [s]:
                got = F.coalesce(F.try_element_at("_have", F.lit(name)), F.try_element_at("_have", F.lit(s)), none)
                entries.append(F.struct(F.lit(name).alias("scope"), F.array_except(F.array(*map(F.lit, required)), got).alias("absent")))
        rows.append(F.struct(F.lit(tier).alias("tier"), F.filter(F.array(*entries), lambda e: F.size(e["absent"]) > 0).alias("gaps")))
    out = sets.select(group, F.explode(F.array(*rows)).alias("_t")).select(group, "_t.tier", "_t.gaps")
    return out.select(group, "tier", (F.size("gaps") == 0).alias("satisfied"), F.map_from_entries("gaps").alias("missing"))


def facet_rollup(df: DataFrame, key: str, position: Column, modes: Column, values: Column, flags: Mapping[str, Column], listed: Column | None = None) -> DataFrame:
    """Facets by key, in one aggregation: distinct modes in order of first appearance, distinct sorted values (or of `listed`),
    the window of values, any-flags."""
    return df.groupBy(key).agg(
        F.array_distinct(ordered_list(modes, position, modes)).alias("modes"), F.array_sort(F.collect_set(values if listed is None else listed)).alias("distinct_values"),
        F.min(values).alias("low"), F.max(values).alias("high"), *[F.bool_or(c).alias(n) for n, c in flags.items()],
    )


def status_pivot(df: DataFrame, group: str, status: str, values: Sequence[str]) -> DataFrame:
    return df.groupBy(group).agg(*[F.count_if(F.col(status) == v).alias(v.lower()) for v in values], F.count(F.lit(1)).alias("total"))


def statistics(df: DataFrame, by: str, value: Column, digits: int = 6) -> DataFrame:
    """What a quantity carries of its samples: number, mean and standard deviation (null of a single one)."""
    return df.groupBy(by).agg(F.count(value).alias("n"), F.round(F.avg(value), digits).alias("mean"), F.round(F.stddev_samp(value), digits).alias("std_dev"))


def fan_in(df: DataFrame, foreign: str, id_column: str) -> DataFrame:
    """Ids that refer to each key, sorted."""
    return df.groupBy(foreign).agg(F.array_sort(F.collect_list(id_column)).alias("ids"), F.count(F.lit(1)).alias("n"))


def coverage(df: DataFrame, by: str, start: Column, end: Column) -> DataFrame:
    return df.groupBy(by).agg(F.min(start).alias("covers_from"), F.max(end).alias("covers_to"))


def collisions(df: DataFrame, value: str, key: str) -> DataFrame:
    """Values that several keys share, with the keys."""
    return df.groupBy(value).agg(F.array_sort(F.collect_set(key)).alias("keys")).where(F.size("keys") > 1)


def null_aware_sum(c: Column, digits: int = 4) -> Column:
    """An aggregate: the sum of what is known, null if nothing is."""
    return F.round(F.sum(c), digits)


def conformance(declared: DataFrame, derived: DataFrame, key: str, fields: Sequence[str], tolerance: float = 0.0) -> DataFrame:
    """Fields in which a declared row differs from the derived one (null-safe): key, diverging."""
    a = declared.select(F.col(key).alias("_k"), *[F.col(f).alias(f"_a_{f}") for f in fields])
    b = derived.select(F.col(key), *[F.col(f).alias(f"_b_{f}") for f in fields])
    numbers = {f for f in fields if isinstance(declared.schema[f].dataType, T.NumericType) and isinstance(derived.schema[f].dataType, T.NumericType)}

    def differs(f: str) -> Column:
        same = F.col(f"_a_{f}").eqNullSafe(F.col(f"_b_{f}"))
        return ~(same | F.coalesce(F.abs(F.col(f"_a_{f}") - F.col(f"_b_{f}")) <= tolerance, F.lit(False)) if tolerance > 0 and f in numbers else same)

    return a.join(b, F.col("_k") == F.col(key)).select(key, F.array_compact(F.array(*[F.when(differs(f), F.lit(f)) for f in fields])).alias("diverging")).where(F.size("diverging") > 0)


def outcomes(df: DataFrame, kind: str, failed: Column) -> DataFrame:
    """Rows and failures of each kind and in total."""
    counts = df.groupBy(F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_if(failed).alias("n_failed"))
    return counts.unionByName(counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_failed"), F.lit(0)).alias("n_failed")).select(F.lit("total").alias("kind"), "n", "n_failed"))


def next_step(steps: Sequence[tuple[Column, str]], default: str) -> Column:
    """The name of the first condition that holds."""
    out = F.lit(default)
    for condition, name in reversed(steps):
        out = F.when(condition, name).otherwise(out)
    return out


def recovery(found: Column, wanted: Column) -> Column:
    """How much of what a source holds was recovered: full, partial, none."""
    return F.when(found <= 0, "none").when(found < wanted, "partial").otherwise("full")

"""Importers: rows and documents of other formats as record tables. Flat ones are projections; loops need a function."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identity
from ..functions.scalars import cleaned, converted, finite_number, joined, mapped
from ..kinds import BASE_IRI


def from_rows(df: DataFrame, row_id: Column, maker: Column, model: Column, materials: Mapping[str, Column], capacity: Column, cycles: Column) -> dict[str, DataFrame]:
    """Records of a spreadsheet row: material specs (once each), a cell spec, a cell, and a test where cycles are known.

    The same row gives the same ids each time, so importing twice changes nothing.
    """
    uid = lambda role: identity.bytewise_uid(row_id.cast("string"), F.lit(role))
    iri = lambda space, role: F.concat(F.lit(f"{BASE_IRI}/{space}/"), uid(role))
    named = df.select(F.explode(F.array_compact(F.array(*[F.when(cleaned(c).isNotNull(), F.struct(F.lit(role).alias("role"), cleaned(c).alias("name"))) for role, c in materials.items()]))).alias("_m")).select("_m.*").distinct()
    specs = named.withColumn("id", F.concat(F.lit(f"{BASE_IRI}/spec/"), identity.bytewise_uid(F.col("role"), F.lower("name"))))
    cell_specs = df.select(
        iri("spec", "cell-spec").alias("id"), F.coalesce(cleaned(maker), F.lit("unknown")).alias("manufacturer"), cleaned(model).alias("model"),
        joined(*[cleaned(c) for c in materials.values()], default="unknown").alias("chemistry"), finite_number(capacity).alias("nominal_capacity"),
    )
    cells = df.select(iri("cell", "cell").alias("id"), iri("spec", "cell-spec").alias("cell_spec_id"))
    tests = df.where(finite_number(cycles).isNotNull()).select(iri("test", "test").alias("id"), iri("cell", "cell").alias("cell_id"), F.lit("cycling").alias("kind"), finite_number(cycles).alias("cycles"))
    return {"material-spec": specs, "cell-spec": cell_specs, "cell": cells, "test": tests}


def from_flags(df: DataFrame, identifier: Column, flags: Column, kinds: Mapping[str, str], active: Column) -> DataFrame:
    """A test for every measurement flag (map<string, boolean>) that is set, of active entries: source, flag, kind, id."""
    rows = df.where(active).select(identifier.alias("source"), F.explode(flags).alias("flag", "is_set")).where("is_set")
    return rows.select("source", "flag", F.coalesce(mapped(F.col("flag"), kinds), F.lit("other")).alias("kind"), identity.bytewise_uid("source", "flag").alias("uid"))


def claims_from_blocks(df: DataFrame, identifier: Column, block: Column, values: Column, fields: Mapping[str, str], units: Mapping[str, str], factors: Mapping[str, float]) -> DataFrame:
    """Parameter claims of a block of numbers (map<string, double>): known fields by `block.field`, in canonical units."""
    rows = df.select(identifier.alias("source"), block.alias("block"), F.explode(values).alias("field", "value"))
    key = F.concat_ws(".", "block", "field")
    return rows.select("source", F.coalesce(mapped(key, fields), key).alias("parameter"), converted(F.col("value"), mapped(key, units), factors).alias("value"), mapped(key, fields).isNotNull().alias("known"))


def embedded(df: DataFrame, identifier: Column, holders: Mapping[str, Column]) -> DataFrame:
    """Materials and components that sit inside a record: id, holder, name."""
    made = F.array_compact(F.array(*[F.when(c.isNotNull(), F.struct(F.lit(h).alias("holder"), c.cast("string").alias("name"))) for h, c in holders.items()]))
    return df.select(identifier.alias("id"), F.explode(made).alias("_h")).select("id", "_h.*")


def folded(df: DataFrame, program: str = "program", position: str = "position", mode: str = "mode", target: str = "target", count: str = "count") -> DataFrame:
    """A flat program with backward jumps as nested groups: program, path (such as 2.0), mode, repeats of the groups around it.

    A jump row (mode `loop`) goes back to the step at `target` and runs it and what follows `count` times in all. Programs are
    short, but nested: one function call for each.
    """

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        steps: list = []  # (position or None, mode or list)
        for row in frame.sort_values(position).itertuples(index=False):
            if getattr(row, mode) != "loop":
                steps.append((getattr(row, position), getattr(row, mode)))
                continue
            goal = getattr(row, target)
            first = next((i for i, s in enumerate(steps) if _start(s) >= goal), len(steps))
            steps[first:] = [(None, (int(getattr(row, count)), steps[first:]))] if first < len(steps) else []
        out: list[tuple] = []
        _flatten(steps, [], [], out)
        return pd.DataFrame([(frame[program].iloc[0], *r) for r in out], columns=["program", "path", "mode", "repeats"])

    kind = df.schema[program].dataType.simpleString()
    return df.groupBy(program).applyInPandas(fold, f"program {kind}, path string, mode string, repeats array<int>")


def _start(step) -> int:
    return step[0] if step[0] is not None else _start(step[1][1][0])


def _flatten(steps: list, path: list[int], repeats: list[int], out: list[tuple]) -> None:
    for i, (place, what) in enumerate(steps):
        if place is None:
            _flatten(what[1], [*path, i], [*repeats, what[0]], out)
        else:
            out.append((".".join(map(str, [*path, i])), what, repeats))


def quantities(df: DataFrame, identifier: str, document: str) -> DataFrame:
    """Every (value, unit) pair anywhere in a JSON document: id, path, value, unit. Recursive documents, in batches."""
    import json

    def walk(node, path: str, out: list) -> None:
        if isinstance(node, dict):
            if isinstance(node.get("value"), int | float) and not isinstance(node["value"], bool):
                out.append((path, float(node["value"]), node.get("unit")))
            for k, v in node.items():
                walk(v, f"{path}.{k}" if path else k, out)
        elif isinstance(node, list):
            for i, v in enumerate(node):
                walk(v, f"{path}[{i}]", out)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows: list[tuple] = []
            for key, text in zip(frame[identifier], frame[document], strict=True):
                found: list[tuple] = []
                try:
                    walk(json.loads(text), "", found)
                except (TypeError, ValueError):
                    continue
                rows += [(key, *f) for f in found]
            yield pd.DataFrame(rows, columns=["id", "path", "value", "unit"])

    kind = df.schema[identifier].dataType.simpleString()
    return df.select(identifier, document).mapInPandas(run, f"id {kind}, path string, value double, unit string")


def grouped_files(df: DataFrame, name: str, patterns: Sequence[str]) -> DataFrame:
    """Files by cell: the first pattern that matches all names and tells at least two groups apart; none: no rows.

    name, cell (the number without leading zeros). One aggregate looks at all patterns at once.
    """
    number = lambda p: F.nullif(F.regexp_extract(F.col(name), p, 1), F.lit("")).try_cast("long")
    seen = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(number(p)).alias(f"n{i}") for i, p in enumerate(patterns)], *[F.countDistinct(number(p)).alias(f"d{i}") for i, p in enumerate(patterns)]).first()
    for i, p in enumerate(patterns):
        if seen["n"] and seen[f"n{i}"] == seen["n"] and seen[f"d{i}"] > 1:
            return df.select(name, number(p).alias("cell"))
    return df.select(name, F.lit(None).cast("long").alias("cell")).limit(0)

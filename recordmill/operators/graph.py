"""Records as graphs: triples, nodes, merges, and text forms."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RDF_TYPE = "rdf:type"


def triples(df: DataFrame, subject: Column, type_: str, properties: Mapping[str, Column], links: Mapping[str, Column] | None = None) -> DataFrame:
    """(s, p, o, is_iri) of every record: its type, properties and links; nulls make no triple."""
    made = [F.struct(F.lit(RDF_TYPE).alias("p"), F.lit(type_).alias("o"), F.lit(True).alias("is_iri"))]
    made += [F.when(c.isNotNull(), F.struct(F.lit(p).alias("p"), c.cast("string").alias("o"), F.lit(False).alias("is_iri"))) for p, c in properties.items()]
    made += [F.when(c.isNotNull(), F.struct(F.lit(p).alias("p"), c.cast("string").alias("o"), F.lit(True).alias("is_iri"))) for p, c in (links or {}).items()]
    return df.select(subject.alias("s"), F.explode(F.array_compact(F.array(*made))).alias("_t")).select("s", "_t.*")


def merged(*graphs: DataFrame) -> DataFrame:
    """Nodes by id (s), a later graph's property replacing an earlier one's."""
    both = None
    for rank, g in enumerate(graphs):
        part = g.withColumn("_rank", F.lit(rank))
        both = part if both is None else both.unionByName(part)
    latest = both.groupBy("s", "p").agg(F.max("_rank").alias("_latest"))
    return both.join(latest, ["s", "p"]).where("_rank = _latest").drop("_rank", "_latest").distinct()


def n_triples(graph: DataFrame) -> DataFrame:
    """Lines of N-Triples; (s, p) and linked objects are full addresses by now."""
    literal = F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(F.regexp_replace("o", r"\\", r"\\\\"), '"', r'\\"'), "\n", r"\\n"), F.lit('"'))
    o = F.when(F.col("is_iri"), F.concat(F.lit("<"), "o", F.lit(">"))).otherwise(literal)
    return graph.select(F.concat(F.lit("<"), "s", F.lit("> <"), "p", F.lit("> "), o, F.lit(" .")).alias("value"))


def json_ld(df: DataFrame, identifier: Column, types: Column, fields: Mapping[str, Column], context: str) -> DataFrame:
    """One document for each record."""
    parts = [F.lit(context).alias("@context"), identifier.alias("@id"), types.alias("@type"), *[c.alias(n) for n, c in fields.items()]]
    return df.select(identifier.alias("id"), F.to_json(F.struct(*parts)).alias("document"))


def stacked_types(*maps: tuple[Column, Mapping[str, str]]) -> Column:
    """Classes of a record by its fields, those that are known, in order and once each."""
    from ..functions.scalars import mapped

    return F.array_distinct(F.array_compact(F.array(*[mapped(F.lower(c), m) for c, m in maps])))


def nested(parent: DataFrame, child: DataFrame, key: str, foreign: str, fields: Sequence[str], name: str) -> DataFrame:
    """Parents with their children as a sorted array of structs (empty where there are none)."""
    lists = child.groupBy(F.col(foreign).alias("_f")).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    return parent.join(lists, F.col(key) == F.col("_f"), "left").drop("_f").withColumn(name, F.coalesce(name, F.array()))


def json_keys(df: DataFrame, id_column: str, column: str) -> DataFrame:
    """Every key and value at the top of a JSON text, without a schema."""
    return df.select(F.col(id_column).alias("id"), F.explode(F.from_json(column, "map<string,string>")).alias("json_key", "json_value"))


def leaves(df: DataFrame, id_column: str, column: str, worth: Column | None = None) -> DataFrame:
    """Every scalar anywhere in a JSON text: id, path, name (of the field that holds it, null in lists), kind (text, number, flag,
    nothing), value as text. NaN and infinities are numbers, as writers of JSON make them; nulls and texts that are no JSON have
    no scalars. worth: a condition on rows, so that texts which can't matter stay out of Python. Depth is unbounded, hence no
    built-in expression."""
    import json

    def scalars(text: str) -> Iterator[tuple]:
        todo = [("", None, json.loads(text))]
        while todo:
            path, name, node = todo.pop()
            if isinstance(node, dict):
                todo += [(f"{path}.{k}" if path else k, k, v) for k, v in reversed(node.items())]
            elif isinstance(node, list):
                todo += [(f"{path}[{i}]", None, v) for i, v in reversed(list(enumerate(node)))]
            elif node is None or isinstance(node, bool):
                yield path, name, "nothing" if node is None else "flag", None if node is None else str(node).lower()
            else:
                yield path, name, "text" if isinstance(node, str) else "number", str(node)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows: list[tuple] = []
            for key, text in zip(frame["id"], frame["text"], strict=True):
                try:
                    rows += [(key, *x) for x in scalars(text)]
                except (TypeError, ValueError, RecursionError):
                    continue
            yield pd.DataFrame(rows, columns=["id", "path", "name", "kind", "value"])

    chosen = df if worth is None else df.where(worth)
    key = df.schema[id_column].dataType.simpleString()
    return chosen.where(F.col(column).isNotNull()).select(F.col(id_column).alias("id"), F.col(column).alias("text")).mapInPandas(run, f"id {key}, path string, name string, kind string, value string")


def deep_references(df: DataFrame, id_column: str, column: str, names: Sequence[str]) -> DataFrame:
    """Texts under the given names anywhere in a JSON text: (id, name, target). Only texts that hold one of the names are parsed."""
    holds = F.col(column).rlike('"(?:' + "|".join(map(re.escape, names)) + r')"|\\\\u')
    return leaves(df, id_column, column, holds).where((F.col("kind") == "text") & F.col("name").isin(*names)).select("id", "name", F.col("value").alias("target"))


def turtle(graph: DataFrame) -> DataFrame:
    """One block of Turtle for each subject, its type first and the rest in order: s, value. Full addresses, as in n_triples."""
    escaped = F.regexp_replace(F.regexp_replace(F.regexp_replace("o", r"\\", r"\\\\"), '"', r'\\"'), "\n", r"\\n")
    o = F.when(F.col("is_iri"), F.concat(F.lit("<"), "o", F.lit(">"))).otherwise(F.concat(F.lit('"'), escaped, F.lit('"')))
    is_type = F.col("p") == RDF_TYPE
    p = F.when(is_type, "a").otherwise(F.concat(F.lit("<"), "p", F.lit(">")))
    blocks = graph.groupBy("s").agg(F.array_sort(F.collect_set(F.struct((~is_type).alias("rest"), F.concat_ws(" ", p, o).alias("line")))).alias("_l"))
    return blocks.select("s", F.concat(F.lit("<"), "s", F.lit("> "), F.array_join(F.transform("_l", lambda x: x["line"]), " ;\n    "), F.lit(" .")).alias("value"))


def json_ld_by_kind(df: DataFrame, identifier: Column, kind: Column, shapes: Mapping[str, tuple[Sequence[str], Mapping[str, Column]]], context: str, common: Mapping[str, Column]) -> DataFrame:
    """Documents of records of several kinds in one pass. shapes: kind -> (classes, fields); common: fields of all kinds (such as
    contributor, funder, licence), which come last. A record of another kind has no document and is left out."""
    out = F.lit(None).cast("string")
    for name, (classes, fields) in shapes.items():
        parts = [F.lit(context).alias("@context"), identifier.alias("@id"), F.array(*map(F.lit, classes)).alias("@type"), *[c.alias(n) for n, c in {**fields, **common}.items()]]
        out = F.when(kind == name, F.to_json(F.struct(*parts))).otherwise(out)
    return df.select(identifier.alias("id"), kind.alias("kind"), out.alias("document")).where("document is not null")

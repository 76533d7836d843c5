"""Records in the forms that others read: catalogues, envelopes, stamped and draft records, searches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.scalars import mapped

#: Size codes that mean the same.
SIZE_GROUPS = (
    ("r03", "lr03", "fr03", "aaa", "triplea"), ("r6", "lr6", "fr6", "aa", "doublea"), ("r14", "lr14", "c"), ("r20", "lr20", "d"), ("lr1", "r1", "n"), ("6lr61", "6f22", "9v"), ("18650",), ("21700",), ("26650",), ("14500",),
    ("4680",), ("cr2032",), ("cr2016",), ("cr2025",),
)


def size_aliases(c: Column) -> Column:
    """All codes of the size's group, or the code itself, as words."""
    key = F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    return mapped(key, {code: " ".join(group) for group in SIZE_GROUPS for code in group}, key)


def without_volatile(c: Column, keys: Sequence[str]) -> Column:
    """A JSON text without some keys at any depth, keys in order; null for what is no JSON. Documents have any shape and depth,
    which built-in expressions can't follow, hence Arrow batches."""
    import json

    gone = frozenset(keys)

    def strip(node):
        if isinstance(node, dict):
            return {k: strip(v) for k, v in node.items() if k not in gone}
        return [strip(v) for v in node] if isinstance(node, list) else node

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(text):
            try:
                return json.dumps(strip(json.loads(text)), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
            except (TypeError, ValueError):
                return None

        return texts.map(one)

    return run(c)


def stamped(df: DataFrame, stamp: Mapping[str, str]) -> DataFrame:
    """Contributor, funding, licence and the like where a record has none of its own."""
    return df.withColumns({k: F.coalesce(F.col(k), F.lit(v)) if k in df.columns else F.lit(v) for k, v in stamp.items()})


def draft(spark, kind: str, fields: Mapping[str, object]) -> DataFrame:
    """A record of a kind to be filled in: one row, nulls as text."""
    from ..kinds import BY_NAME

    values = [F.lit(v).cast("string").alias(k) if v is None else F.lit(v).alias(k) for k, v in fields.items()]
    return spark.range(1).select(F.struct(*values).alias(BY_NAME[kind].body), F.lit(kind).alias("kind"))


def datacite(df: DataFrame, identifier: Column, title: Column, year: Column, creator: Column, licence: Column) -> DataFrame:
    body = F.struct(
        F.struct(F.array(F.struct(title.alias("title"))).alias("titles"), F.array(F.struct(creator.alias("name"))).alias("creators"), year.cast("int").alias("publicationYear"), F.struct(F.lit("Dataset").alias("resourceTypeGeneral")).alias("types"),
                 F.array(F.struct(licence.alias("rights"))).alias("rightsList")).alias("attributes")
    )
    return df.select(identifier.alias("id"), F.to_json(body).alias("document"))


def dcat(df: DataFrame, identifier: Column, title: Column, licence: Column, url: Column, media: Column) -> DataFrame:
    body = F.struct(
        identifier.alias("@id"), F.lit("dcat:Dataset").alias("@type"), title.alias("dct:title"), licence.alias("dct:license"),
        F.array(F.struct(F.lit("dcat:Distribution").alias("@type"), url.alias("dcat:downloadURL"), media.alias("dcat:mediaType"))).alias("dcat:distribution"),
    )
    return df.select(identifier.alias("id"), F.to_json(body).alias("document"))


def ro_crate(files: DataFrame, dataset: str, path: Column, size: Column, checksum: Column) -> DataFrame:
    """One crate for each dataset: its files as parts, in order of path. Lists are as long as a dataset has files."""
    parts = files.groupBy(F.col(dataset).alias("id")).agg(F.array_sort(F.collect_list(F.struct(path.alias("@id"), F.lit("File").alias("@type"), size.cast("long").alias("contentSize"), checksum.alias("sha256")))).alias("parts"))
    return parts.select("id", F.to_json(F.struct(F.lit("https://w3id.org/ro/crate/1.1/context").alias("@context"), F.col("parts").alias("@graph"))).alias("document"))


def envelope(df: DataFrame, local_id: Column, kind: str, payload: Column, workflow: str) -> DataFrame:
    """A submission: what, from where, and a hash that tells whether it was sent before."""
    text = F.to_json(payload)
    return df.select(local_id.alias("source_local_id"), F.lit(kind).alias("resource_type"), text.alias("payload"), F.sha2(text, 256).alias("payload_hash"), F.lit(workflow).alias("workflow"))


def converted_fields(df: DataFrame, identifier: Column, fields: Mapping[str, tuple[Column, float]]) -> DataFrame:
    """Another schema's document of numbers in its units; what isn't there is left out."""
    return df.select(identifier.alias("id"), F.to_json(F.struct(*[(c * f).alias(n) for n, (c, f) in fields.items()])).alias("document"))


def search(df: DataFrame, title: str, kind: str, text: str | None = None, wanted: str | None = None) -> DataFrame:
    """Rows whose title holds the text, of one kind or all."""
    return df.where(P.contains_text(F.col(title), text) & P.equals(F.col(kind), wanted))


def changed(index: DataFrame, files: DataFrame) -> bool:
    """Whether a stored index is out of date: another number of files, or a file newer than it. Two numbers reach the driver."""
    have, now = index.agg(F.count(F.lit(1)), F.max("modificationTime")).first(), files.agg(F.count(F.lit(1)), F.max("modificationTime")).first()
    return tuple(have) != tuple(now)

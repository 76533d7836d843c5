"""Checks of publications: JSON documents of one node or a graph of nodes, read as variants, every failure a row (id, code, severity, path)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A scheme and something behind it.
ABSOLUTE = r"^[A-Za-z][A-Za-z0-9+.-]*:(?://)?+[^?#]"
#: Fields of a distribution, and what a digest looks like.
WANTED = ("schema:contentUrl", "schema:encodingFormat", "schema:isPartOf")
DIGEST = "^[A-Fa-f0-9]{64}$"
_NOTHING = "array<struct<code:string,severity:string,path:string>>"


def _field(v: Column, name: str, as_: str = "variant") -> Column:
    return F.try_variant_get(v, f'$["{name}"]', as_)


def _is(v: Column, kind: str) -> Column:
    """Whether a variant is of a kind (OBJECT, ARRAY, STRING); false where there is none."""
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def _absent(v: Column) -> Column:
    return v.isNull() | _is(v, "VOID")


def _text(v: Column, name: str) -> Column:
    """The field, if it is a text."""
    return F.when(_is(_field(v, name), "STRING"), _field(v, name, "string"))


def _list(v: Column) -> Column:
    """The elements of a list; none of anything else."""
    return F.coalesce(F.when(_is(v, "ARRAY"), F.try_variant_get(v, "$", "array<variant>")), F.try_variant_get(F.try_parse_json(F.lit("[]")), "$", "array<variant>"))


def _issue(fails: Column, code: str, severity: str, path: Column) -> Column:
    return F.when(F.coalesce(fails, F.lit(False)), F.struct(F.lit(f"publication.{code}").alias("code"), F.lit(severity).alias("severity"), path.alias("path")))


def nodes(documents: DataFrame, id_column: str, column: str) -> DataFrame:
    """Every node: id, pos, path, packaged (in a graph), node, node_id (null if it is no text or empty), types. Texts that are no
    JSON, nulls and lists without objects have no nodes."""
    read = documents.select(F.col(id_column).alias("id"), F.try_parse_json(F.col(column).cast("string")).alias("_doc"))
    graph = _field(F.col("_doc"), "@graph")
    packaged = _is(graph, "ARRAY")
    placed = F.transform(_list(graph), lambda x, i: F.struct(i.alias("pos"), F.format_string("@graph[%d]", i).alias("path"), x.alias("node")))
    inside = F.filter(placed, lambda e: _is(e["node"], "OBJECT"))
    alone = F.array(F.struct(F.lit(0).alias("pos"), F.lit("").alias("path"), F.col("_doc").alias("node")))
    found = read.select("id", packaged.alias("packaged"), F.explode(F.when(packaged, inside).when(_is(F.col("_doc"), "OBJECT"), alone)).alias("_n")).select("id", "packaged", "_n.*")
    types = _field(F.col("node"), "@type")
    named = F.transform(F.filter(_list(types), lambda x: _is(x, "STRING")), lambda x: F.try_variant_get(x, "$", "string"))
    return found.withColumn("node_id", F.nullif(_text(F.col("node"), "@id"), F.lit(""))).withColumn("types", F.when(_is(types, "STRING"), F.array(_field(F.col("node"), "@type", "string"))).otherwise(named))


def issues(documents: DataFrame, id_column: str, column: str, own: str, own_datasets: str, groups: Sequence[str] = (), severity: str = "error") -> DataFrame:
    """All failures of the documents: id, code, severity, path. own: how this store's ids begin, own_datasets: those of its
    datasets; groups: marks of test conditions that have no term. References between nodes are checked inside graphs alone. Missing
    licences and conditions without a term are warnings. A document of a null id is checked too, but its nodes meet those of no
    other."""
    found = nodes(documents, id_column, column)
    node, packaged = F.col("node"), F.col("packaged")
    at = lambda name: F.concat_ws(".", F.nullif("path", F.lit("")), F.lit(name))
    types = lambda *names: F.arrays_overlap("types", F.array(*map(F.lit, names)))
    dataset = F.array_contains("types", "schema:Dataset")
    own_dataset = dataset & packaged & F.col("node_id").startswith(own_datasets)
    about, parts, extra = (_field(node, f"schema:{n}") for n in ("about", "distribution", "additionalProperty"))
    missing = lambda v: _absent(v) | (_is(v, "ARRAY") & (F.size(_list(v)) == 0))
    single = F.array(
        _issue(F.col("node_id").isNull(), "node_missing_id", severity, at("@id")),
        _issue(dataset & ~_absent(about) & ~_is(about, "ARRAY"), "reference_invalid", severity, at("schema:about")),
        _issue(own_dataset & missing(about), "dataset_about_missing", severity, at("schema:about")),
        _issue(dataset & ~_absent(parts) & ~_is(parts, "ARRAY"), "distribution_invalid", severity, at("schema:distribution")),
        _issue(own_dataset & missing(parts), "dataset_distribution_missing", severity, at("schema:distribution")),
        _issue(types("dcat:Catalog", "schema:DataCatalog") & _unlicensed(node), "license_missing", "warning", F.col("path")),
    )
    element = lambda name, i: F.concat(at(name), F.format_string("[%d]", i))
    references = F.transform(_list(about), lambda x, i: _issue(dataset & _text(x, "@id").isNull(), "reference_invalid", severity, element("schema:about", i)))
    entries = F.flatten(F.transform(_list(parts), lambda x, i: _entry(x, element("schema:distribution", i), dataset, severity)))
    plan = types("schema:HowTo", "prov:Plan")
    unmapped = F.transform(_list(extra), lambda x: _issue(plan & _text(x, "schema:propertyID").isin(*groups), "test_condition_unmapped", "warning", at("schema:additionalProperty")))
    shape = found.select("id", F.explode(F.array_compact(F.concat(single, references, entries, unmapped).cast(_NOTHING))).alias("_i")).select("id", "_i.*")
    return shape.unionByName(_empty(documents, id_column, column, severity)).unionByName(_repeated(found, severity)).unionByName(_dangling(found, own, severity))


def _unlicensed(node: Column) -> Column:
    """Neither licence says anything."""
    out = F.lit(True)
    for name in ("schema:license", "dcterms:license"):
        v = _field(node, name)
        out = out & (_absent(v) | F.to_json(v).isin('""', "[]", "{}", "false", "0"))
    return out


def _entry(x: Column, path: Column, dataset: Column, severity: str) -> Column:
    url, digest, parent = (_field(x, f"schema:{n}") for n in ("contentUrl", "sha256", "isPartOf"))
    entry = dataset & _is(x, "OBJECT")
    wrong = lambda v, text, look: ~_absent(v) & ~F.coalesce(text.rlike(look), F.lit(False))
    under = lambda name: F.concat(path, F.lit(f".schema:{name}"))
    return F.array(
        _issue(dataset & ~_is(x, "OBJECT"), "distribution_invalid", severity, path),
        *[_issue(entry & _field(x, name).isNull(), "distribution_missing_field", severity, path) for name in WANTED],
        _issue(entry & wrong(url, _text(x, "schema:contentUrl"), ABSOLUTE), "distribution_url_invalid", severity, under("contentUrl")),
        _issue(entry & wrong(digest, _text(x, "schema:sha256"), DIGEST), "distribution_checksum_invalid", severity, under("sha256")),
        _issue(entry & wrong(parent, _text(parent, "@id"), ABSOLUTE), "distribution_parent_invalid", severity, under("isPartOf")),
    )


def _empty(documents: DataFrame, id_column: str, column: str, severity: str) -> DataFrame:
    doc = F.try_parse_json(F.col(column).cast("string"))
    graph = _field(doc, "@graph")
    without = F.when(_is(graph, "ARRAY"), ~F.exists(_list(graph), lambda x: _is(x, "OBJECT"))).otherwise(~_is(doc, "OBJECT"))
    return documents.where(without).select(F.col(id_column).alias("id"), F.lit("publication.node_missing").alias("code"), F.lit(severity).alias("severity"), F.lit("").alias("path"))


def _repeated(found: DataFrame, severity: str) -> DataFrame:
    """Nodes whose id another node of the document had before."""
    first = found.where("node_id is not null").groupBy(F.col("id").alias("_id"), F.col("node_id").alias("_node_id")).agg(F.min("pos").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    again = found.join(first, (F.col("id") == F.col("_id")) & (F.col("node_id") == F.col("_node_id")) & (F.col("pos") > F.col("_first")))
    return again.select("id", F.lit("publication.duplicate_node_id").alias("code"), F.lit(severity).alias("severity"), F.concat_ws(".", F.nullif("path", F.lit("")), F.lit("@id")).alias("path"))


def _dangling(found: DataFrame, own: str, severity: str) -> DataFrame:
    """References of datasets to ids of this store that no node of their graph has."""
    about = _list(_field(F.col("node"), "schema:about"))
    told = found.where(F.col("packaged") & F.array_contains("types", "schema:Dataset")).select("id", "path", F.posexplode(F.transform(about, lambda x: _text(x, "@id"))).alias("_at", "_target"))
    there = found.select(F.col("id").alias("_id"), F.col("node_id").alias("_node_id"))
    left = told.where(F.col("_target").startswith(own)).join(there, (F.col("id") == F.col("_id")) & (F.col("_target") == F.col("_node_id")), "left_anti")
    return left.select("id", F.lit("publication.reference_missing_node").alias("code"), F.lit(severity).alias("severity"), F.concat("path", F.format_string(".schema:about[%d].@id", "_at")).alias("path"))

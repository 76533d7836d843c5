"""Queries over a kind's table: a flat projection, a conjunction of optional predicates, a page in a total order.

A store is a mapping of kind names to DataFrames of whole records. Column paths are those of the record's body.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..kinds import BY_NAME
from ..operators.records import first_wins, page

Predicate = Callable[..., Column]


@dataclass(frozen=True)
class Plan:
    """kind, the flat columns of a row (name -> path), and for each filter the predicate and the flat column that it reads."""

    kind: str
    columns: Mapping[str, str]
    filters: Mapping[str, tuple[Predicate, str]]
    ranges: str | None = None  # flat column of type map<string, quantity struct> that property filters read
    fields: tuple[str, ...] = P.VALUE_FIELDS
    first_id_wins: bool = False
    ordered: tuple[str, ...] = field(default=("id",))


def _instance(kind: str, spec: str, *more: str) -> Plan:
    body = BY_NAME[kind].body
    columns = {"id": "id", "short_id": "short_id", "name": "name", spec: spec, **{m: m for m in more}}
    return Plan(kind, {n: f"{body}.{p}" for n, p in columns.items()}, {"id": (P.equals, "id"), "spec_id": (P.equals, spec), "short_id": (P.starts_text, "short_id"), "name": (P.equals_text, "name"), **{m: (P.equals_text, m) for m in more}})


def _spec(kind: str, *more: str) -> Plan:
    body = BY_NAME[kind].body
    columns = {"id": "id", "short_id": "short_id", "name": "name", **{m: m for m in more}}
    return Plan(kind, {n: f"{body}.{p}" for n, p in columns.items()}, {"id": (P.equals, "id"), "short_id": (P.starts_text, "short_id"), "name": (P.equals_text, "name"), **{m: (P.equals_text, m) for m in more}})


_SPEC_FIELDS = ("model", "manufacturer", "cell_format", "chemistry", "positive_electrode_basis", "negative_electrode_basis", "size_code", "country_of_origin")
_SPEC_FILTERS = {"id": (P.equals, "id"), "manufacturer": (P.resembles, "manufacturer"), "model": (P.contains_text, "model"), **{f: (P.equals_text, f) for f in _SPEC_FIELDS[2:]}}

PLANS: dict[str, Plan] = {
    "cell_specs": Plan("cell-spec", {"id": "cell_spec.id", "name": "cell_spec.name", **{f: f"cell_spec.{f}" for f in _SPEC_FIELDS}, "properties": "properties"}, _SPEC_FILTERS, "properties", P.OLD_VALUE_FIELDS, True),
    "library_cell_specs": Plan("cell-spec", {"id": "specification.id", "name": "specification.name", **{f: f"specification.{f}" for f in _SPEC_FIELDS}, "properties": "properties"}, _SPEC_FILTERS, "properties"),
    "cell_instances": Plan(
        "cell", {"id": "cell_instance.id", "short_id": "cell_instance.short_id", "cell_spec_id": "cell_instance.cell_spec_id", "serial_number": "cell_instance.serial_number", "batch_id": "cell_instance.batch_id", "datasets": "datasets"},
        {"id": (P.equals, "id"), "spec_id": (P.equals, "cell_spec_id"), "short_id": (P.starts_text, "short_id"), "serial_number": (P.equals_text, "serial_number"), "batch_id": (P.equals_text, "batch_id"),
         "dataset_id": (lambda c, v: P.equals(F.try_element_at(c, F.lit(1))["id"], v), "datasets"), "has_dataset": (lambda c, v: P.tri_state(F.coalesce(F.size(c), F.lit(0)) > 0, v), "datasets")},
    ),
    "datasets": Plan(
        "dataset", {"id": "dataset.id", "name": "dataset.name", "license": "dataset.license", "access_url": "dataset.access_url", "about": "dataset.about", "distributions": "dataset.distributions"},
        {"id": (P.equals, "id"), "name": (P.contains_text, "name"), "cell_id": (P.has_member, "about"), "test_id": (P.has_member, "about"), "license": (P.equals_text, "license"), "access_url": (P.equals_text, "access_url"),
         "encoding_format": (lambda c, v: P.equals_text(F.try_element_at(F.filter(c, lambda d: d["encoding_format"].isNotNull()), F.lit(1))["encoding_format"], v), "distributions")},
    ),
    "tests": Plan(
        "test", {"id": "test.id", "name": "test.name", "cell_id": "test.cell_id", "protocol_id": "test.protocol_id", "kind": "test.kind", "status": "test.status", "dataset_ids": "test.dataset_ids"},
        {"id": (P.equals, "id"), "cell_id": (P.equals, "cell_id"), "dataset_id": (P.has_member, "dataset_ids"), "kind": (P.equals_text, "kind"), "status": (P.equals_text, "status")},
    ),
    "test_specs": Plan(
        "test-protocol", {"id": "test_spec.id", "name": "test_spec.name", "kind": "test_spec.kind", "version": "test_spec.version", "facets": "facets"},
        {"id": (P.equals, "id"), "kind": (P.equals_text, "kind"), "version": (P.equals_text, "version"), "name": (P.contains_text, "name"),
         "mode": (lambda c, v: P.has_member(c["modes"], v), "facets"), "direction": (lambda c, v: P.has_member(c["directions"], v), "facets"), "tag": (lambda c, v: P.has_member(c["tags"], v), "facets"),
         "c_rate": (lambda c, v: P.has_number(c["c_rates"], v), "facets"), "has_cv_hold": (lambda c, v: P.tri_state(c["has_cv_hold"], v), "facets"), "has_rest": (lambda c, v: P.tri_state(c["has_rest"], v), "facets"), "has_eis": (lambda c, v: P.tri_state(c["has_eis"], v), "facets")},
    ),
    "material_specs": _spec("material-spec", "kind", "material_class", "electrode_polarity", "formula", "manufacturer"),
    "materials": _instance("material", "material_spec_id", "lot_id"),
    "electrode_specs": _spec("electrode-spec", "kind", "polarity", "manufacturer"),
    "electrodes": _instance("electrode", "electrode_spec_id", "batch_id"),
    **{f"{f.replace('-', '_')}_specs": _spec(f"{f}-spec") for f in ("separator", "electrolyte", "current-collector", "housing")},
    **{f"{f.replace('-', '_')}s": _instance(f, f"{f.replace('-', '_')}_spec_id") for f in ("separator", "electrolyte", "current-collector", "housing")},
    "parameter_sets": Plan(
        "parameter-set", {"id": "parameter_set.id", "short_id": "parameter_set.short_id", "name": "parameter_set.name", "material_kind": "parameter_set.material_kind", "scope": "parameter_set.scope", "claims": "parameter_set.claims"},
        {"id": (P.equals, "id"), "short_id": (P.starts_text, "short_id"), "name": (P.equals_text, "name"), "material_kind": (P.equals, "material_kind"), "scope": (P.equals, "scope"),
         "parameter": (lambda c, v: P.has_member(F.transform(c, lambda x: x["parameter"]), v), "claims")},
    ),
}
#: Other names of the kinds that the dispatcher takes.
ALIASES = {"cell-spec": "cell_specs", "cell": "cell_instances", "cell-instance": "cell_instances", "dataset": "datasets", "test": "tests", "test-protocol": "test_specs", "test-spec": "test_specs", "material-spec": "material_specs"}


def query(store: Mapping[str, DataFrame], what: str, limit: int | None = 50, offset: int = 0, properties: Mapping[str, tuple[float | None, float | None]] | None = None, **filters) -> DataFrame:
    """A page of flat rows of a kind. Filters of None don't apply; unknown kinds or filters are errors."""
    what = ALIASES.get(what, what)
    if what not in PLANS:
        raise ValueError(f"unknown kind {what!r}; known: {', '.join(sorted(PLANS))}")
    plan = PLANS[what]
    unknown = set(filters) - set(plan.filters)
    if unknown:
        raise ValueError(f"unknown filters of {what}: {', '.join(sorted(unknown))}")
    df = store[plan.kind]
    order = [F.col("_order")] if "_order" in df.columns else [F.col(c) for c in plan.ordered]
    rows = df.select(*[F.col(p).alias(n) for n, p in plan.columns.items()], *[c for c in ("origin", "_order") if c in df.columns])
    rows = rows.where(F.col("id").isNotNull())
    if plan.first_id_wins:
        rows = first_wins_by_window(rows, order)
    rows = rows.where(P.every(*[predicate(F.col(c), filters.get(n)) for n, (predicate, c) in plan.filters.items() if filters.get(n) is not None]))
    for key, bounds in (properties or {}).items():
        rows = rows.where(P.in_range(P.number_of(F.col(plan.ranges), key, plan.fields), *bounds))
    return (page(rows, order, limit, offset) if limit is not None else rows).drop("_order")


def first_wins_by_window(rows: DataFrame, order: list[Column]) -> DataFrame:
    """The first row of each id in scan order; a window, since maps can't be compared in an aggregate's key."""
    from pyspark.sql import Window as W

    return rows.withColumn("_n", F.row_number().over(W.partitionBy("id").orderBy(*order))).where("_n = 1").drop("_n")


def resolve_one(store: Mapping[str, DataFrame], model: str, **filters) -> str:
    """The id of the one cell spec of exactly this model; none or several are errors. The exact test comes before any limit."""
    found = query(store, "cell_specs", limit=None, **filters).where(P.equals_text(F.col("model"), model)).select("id").limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"{'no' if not found else 'more than one'} cell spec has the model {model!r}")
    return found[0][0]


def listing(df: DataFrame, identifier: Column, *names: Column) -> DataFrame:
    """id and the first name that is there."""
    return df.select(identifier.alias("id"), F.coalesce(*[F.nullif(F.trim(n), F.lit("")) for n in names]).alias("name"))


__all__ = ["PLANS", "first_wins", "listing", "query", "resolve_one"]

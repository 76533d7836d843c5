"""Schema rules as predicates: a JSON Schema's flat part (required, type, enum, pattern, format, bounds) as Rule rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalars import mapped
from .rules import Rule

#: Formats and what they look like; a date-time has a zone.
FORMATS = {
    "date-time": r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$", "date": r"^\d{4}-\d{2}-\d{2}$", "uri": r"^[A-Za-z][A-Za-z0-9+.-]*:\S+$", "email": r"^[^@\s]+@[^@\s]+\.[^@\s]+$",
}
_TYPES = {"integer": "long", "number": "double", "boolean": "boolean"}


def rules_of(schema: Mapping, columns: Mapping[str, Column], severity: str = "error") -> list[Rule]:
    """Rules over text columns (as read from open documents); a property that the table lacks is missing everywhere."""
    out = []
    for name in schema.get("required", []):
        out.append(Rule("schema.required", severity, name, columns.get(name, F.lit(None).cast("string")).isNull(), f"{name} is required"))
    for name, want in schema.get("properties", {}).items():
        if name not in columns:
            continue
        c = columns[name]
        text = c.cast("string")
        if want.get("type") in _TYPES:
            cast = c.try_cast(_TYPES[want["type"]]) if want["type"] != "integer" else F.when(text.rlike(r"^-?\d+$"), text.try_cast("long"))
            out.append(Rule("schema.type", severity, name, c.isNotNull() & cast.isNull(), f"{name} is no {want['type']}"))
        if "enum" in want:
            out.append(Rule("schema.enum", severity, name, c.isNotNull() & ~text.isin(*map(str, want["enum"])), f"{name} has no allowed value"))
        if "pattern" in want:
            out.append(Rule("schema.pattern", severity, name, ~text.rlike(want["pattern"]), f"{name} does not match"))
        if want.get("format") in FORMATS:
            out.append(Rule("schema.format", severity, name, ~text.rlike(FORMATS[want["format"]]), f"{name} is no {want['format']}"))
        if "minimum" in want:
            out.append(Rule("schema.minimum", severity, name, c.try_cast("double") < want["minimum"], f"{name} is too small"))
        if "maximum" in want:
            out.append(Rule("schema.maximum", severity, name, c.try_cast("double") > want["maximum"], f"{name} is too large"))
        if "maxLength" in want:
            out.append(Rule("schema.max_length", severity, name, F.length(text) > want["maxLength"], f"{name} is too long"))
    return out


def unknown_fields(schema: Mapping, columns: list[str]) -> list[str]:
    """Columns that a schema without additional properties does not know."""
    return [] if schema.get("additionalProperties", True) else [c for c in columns if c not in schema.get("properties", {})]


# Rules of single kinds

#: What a size code looks like, and the letter that it begins with by the cell's format.
SIZE_CODE = r"^[RP][A-Za-z0-9]+(?:[/-][A-Za-z0-9]+)*$"
SIZE_LETTERS = {"coin": "R", "cylindrical": "R", "pouch": "P", "prismatic": "P"}
#: Configurations whose electrodes have roles and no polarity.
ROLE_CONFIGURATIONS = ("half_cell", "half-cell", "three_electrode_cell", "three-electrode-cell", "three-electrode")


def size_code_rules(code: Column, form: Column, severity: str = "warning") -> list[Rule]:
    """A size code has the right look, and the right letter for its format; a blank one is none."""
    given = F.nullif(F.trim(code), F.lit(""))
    invalid = ~given.rlike(SIZE_CODE)
    wrong = F.left(given, F.lit(1)) != mapped(F.lower(F.trim(form)), SIZE_LETTERS)
    return [Rule("size_code_invalid", severity, "product.size_code", invalid, "must start with R or P"), Rule("size_code_prefix_mismatch", severity, "product.size_code", ~invalid & wrong, "another letter than the format's")]


def electrode_rules(configuration: Column, by_polarity: Column, by_role: Column, has_reference: Column) -> list[Rule]:
    """Electrodes are named by role in cells without polarity and by polarity in all others; never an error. by_polarity and
    by_role: whether holders of either kind are filled. An unstated configuration with a reference electrode is a half cell."""
    stated = F.lower(F.trim(configuration))
    roles_wanted = F.coalesce(stated.isin(*ROLE_CONFIGURATIONS), F.coalesce(has_reference, F.lit(False)))
    both = by_polarity & by_role
    return [
        Rule("electrode_holders_mixed", "warning", "electrodes", both, "named by polarity and by role"),
        Rule("electrode_role_expected", "warning", "electrodes", ~both & by_polarity & roles_wanted, "this cell has no polarity"),
        Rule("electrode_polarity_expected", "warning", "electrodes", ~both & by_role & ~roles_wanted, "a full cell has a polarity"),
    ]


def kind_rules(kind: Column, known: list[str], path: str, severity: str = "warning") -> list[Rule]:
    """A kind that the vocabulary lacks is always an error; a missing one is as severe as the policy says."""
    given = F.nullif(F.lower(F.trim(kind)), F.lit(""))
    return [Rule(f"{path}_kind_missing", severity, f"{path}_spec.kind", given.isNull(), "no kind"), Rule(f"{path}_kind_unknown", "error", f"{path}_spec.kind", ~given.isin(*[k.lower() for k in known]), "not in the vocabulary")]


def electrode_kind_rules(kind: Column, polarity: Column, known: Mapping[str, str | None], severity: str = "warning") -> list[Rule]:
    """An electrode's kind names an active material, whose polarity is the electrode's. known: kind -> polarity, or None of
    materials that are not active. A missing kind is as severe as the policy says, an unknown one is an error."""
    given = F.nullif(F.lower(F.trim(kind)), F.lit(""))
    implied = mapped(given, {k.lower(): p or "" for k, p in known.items()})
    return [
        Rule("electrode_kind_missing", severity, "electrode_spec.kind", given.isNull(), "no kind"),
        Rule("electrode_kind_unknown", "error", "electrode_spec.kind", given.isNotNull() & implied.isNull(), "not in the vocabulary"),
        Rule("electrode_kind_not_active", "warning", "electrode_spec.kind", implied == "", "not an active material"),
        Rule("electrode_polarity_conflict", "warning", "electrode_spec.polarity", (implied != "") & polarity.isin("positive", "negative") & (polarity != implied), "not the kind's polarity"),
    ]


def cell_link_rule(cells: Column, is_series: Column) -> Rule:
    """A dataset names its cell, unless it is a series."""
    return Rule("dataset_missing_cell_link", "warning", "dataset.about", ~F.coalesce(is_series, F.lit(False)) & (F.coalesce(F.size(cells), F.lit(0)) <= 0), "no cell")


def time_order_rule(path: str, *times: Column) -> Rule:
    """Times that are there must not fall."""
    wrong = F.lit(False)
    for i, a in enumerate(times):
        for b in times[i + 1 :]:
            wrong = wrong | F.coalesce(a > b, F.lit(False))
    return Rule("temporal_order_invalid", "error", path, wrong, "times fall")


def identifier_rules(identifier: Column, short: Column) -> list[Rule]:
    from ..functions.identity import normalised_uid, short_id_of_iri

    tail = F.element_at(F.split(F.rtrim(identifier, F.lit("/")), "/"), -1)
    return [
        Rule("short_id_mismatch", "error", "short_id", short.isNotNull() & (F.lower(short) != short_id_of_iri(identifier)), "not the identifier's"),
        Rule("identifier_uid_invalid", "error", "id", normalised_uid(tail).isNull(), "not an identifier"),
    ]

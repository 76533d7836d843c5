"""Validation as issue rows: every rule is a predicate over a table, every failure a row (id, code, severity, path, message)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import leaves
from .references import sized


@dataclass(frozen=True)
class Rule:
    code: str
    severity: str
    path: str
    fails: Column
    message: str


#: What each policy makes of the issues of a validator (error, warn, off).
POLICIES = {
    "default": {"schema": "error", "references": "error", "semantic": "warn", "publication": "error"},
    "strict": {"schema": "error", "references": "error", "semantic": "error", "publication": "error"},
    "publisher": {"schema": "error", "references": "error", "semantic": "error", "publication": "error"},
    "ingest": {"schema": "error", "references": "warn", "semantic": "warn", "publication": "error"},
}


def issues(df: DataFrame, id_column: str, rules: Sequence[Rule], path: str | None = None) -> DataFrame:
    """All failures in one pass over the table. path: the column that tells where, instead of the rules' own paths."""
    found = [F.when(F.coalesce(r.fails, F.lit(False)), F.struct(F.lit(r.code).alias("code"), F.lit(r.severity).alias("severity"), (F.col(path) if path else F.lit(r.path)).alias("path"), F.lit(r.message).alias("message"))) for r in rules]
    return df.select(F.col(id_column).alias("id"), F.explode(F.array_compact(F.array(*found))).alias("_i")).select("id", "_i.*")


def under_policy(found: DataFrame, validator: str, policy: str) -> DataFrame:
    level = POLICIES[policy][validator]
    return found.limit(0) if level == "off" else found.withColumn("severity", F.lit("warning") if level == "warn" else F.col("severity"))


def combined(*found: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)


def severities(found: DataFrame, *by: str) -> DataFrame:
    """Errors, warnings and ok for each group (or overall)."""
    grouped = found.groupBy(*by) if by else found.groupBy()
    return grouped.agg(F.count_if(F.col("severity") == "error").alias("n_errors"), F.count_if(F.col("severity") == "warning").alias("n_warnings")).withColumn("ok", F.col("n_errors") == 0)


def duplicated(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(F.col(key).alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", F.lit("duplicate_id").alias("code"), "n")


def not_finite(c: Column) -> Column:
    return F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf"))


def implausible_time(c: Column) -> Column:
    """Seconds outside 2000 to 2100; zero is allowed."""
    return (c != 0) & ((c < 946_684_800) | (c > 4_102_444_800))


def range_invalid(low: Column, typical: Column, high: Column) -> Column:
    return F.coalesce(low > high, F.lit(False)) | F.coalesce(low > typical, F.lit(False)) | F.coalesce(typical > high, F.lit(False))


def paired(values: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Pairs of properties whose lower is above the upper, in the same unit. values: id, property, value, unit."""
    wanted = sorted({x for p in pairs for x in p})
    wide = values.where(F.col("property").isin(wanted)).groupBy("id", "unit").agg(*[F.max(F.when(F.col("property") == p, F.col("value"))).alias(p) for p in wanted])
    broken = F.array_compact(F.array(*[F.when(F.col(a) > F.col(b), F.lit(f"{a} > {b}")) for a, b in pairs]))
    return wide.select("id", F.explode(broken).alias("message")).withColumn("code", F.lit("range_invalid"))


def unit_mismatches(values: DataFrame, allowed: dict[str, list[str]]) -> DataFrame:
    """Units that a property doesn't take. values: id, property, unit."""
    table = F.create_map(*[x for k, v in allowed.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return values.where(F.col("property").isin(*allowed) & ~F.coalesce(F.array_contains(F.try_element_at(table, F.col("property")), F.col("unit")), F.lit(False))).select("id", "property", "unit", F.lit("unit_mismatch").alias("code"))


def unmapped(df: DataFrame, id_column: str, column: str, known: Sequence[str]) -> DataFrame:
    """Values that the vocabulary lacks; nothing and `unknown` are let pass."""
    value = F.lower(F.trim(F.col(column)))
    return df.where(value.isNotNull() & ~value.isin("", "unknown") & ~value.isin(*[k.lower() for k in known])).select(F.col(id_column).alias("id"), F.col(column).alias("value"), F.lit("controlled_value_unmapped").alias("code"))


def claim_problem(quantity: Column, xs: Column, ys: Column, expression: Column, kind: Column, kinds: Sequence[str]) -> Column:
    """Why a claim is invalid, or null: exactly one form of value, curves of equal lengths and finite, a known class."""
    forms = quantity.isNotNull().cast("int") + (xs.isNotNull() | ys.isNotNull()).cast("int") + expression.isNotNull().cast("int")
    finite = lambda a: F.forall(a, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return (
        F.when(forms != 1, "one value form").when(xs.isNotNull() & (F.size(xs) != F.coalesce(F.size(ys), F.lit(-1))), "curve lengths")
        .when(xs.isNotNull() & ~(finite(xs) & finite(ys)), "curve not finite").when(~F.coalesce(kind.isin(*kinds), F.lit(False)), "unknown class")
    )


def leaf_issues(df: DataFrame, id_column: str, column: str) -> DataFrame:
    """Numbers anywhere in a JSON text that are not finite (errors), and times, fields named *_at, that are implausible (warnings):
    id, code, severity, path. Texts that can hold neither are not parsed."""
    text = F.col(column)
    worth = text.contains('_at"') | text.contains("NaN") | text.contains("Infinity") | text.rlike(r"\d[eE]|\d{300}|\\u")
    numbers = leaves(df, id_column, column, worth).where("kind = 'number'")
    value = F.col("value").try_cast("double")
    return issues(numbers, "id", [
        Rule("value_not_finite", "error", "path", not_finite(value), "not a number"),
        Rule("timestamp_implausible", "warning", "path", F.col("name").endswith("_at") & implausible_time(value), "time out of range"),
    ], "path").drop("message")


def graph_text_issues(df: DataFrame, id_column: str, column: str, terms: Sequence[str], published: bool) -> DataFrame:
    """Classes that are neither addresses (with a colon), keywords nor known terms, and, of what is published, ids that only mean
    something on the machine that wrote them: id, code, severity, path. Contexts are not looked at."""
    texts = leaves(df, id_column, column, F.col(column).contains("@")).where("kind = 'text'").where(~F.col("path").rlike(r"(^|[.\]])@context\b"))
    value = F.col("value")
    named = F.col("path").rlike(r"(^|[.\]])@type(\[\d+\])?$") & ~value.startswith("@") & ~value.contains(":") & ~value.isin(*terms)
    local = F.lit(published) & (F.col("name") == "@id") & (value != "") & ~value.startswith("@") & ~value.contains(":")
    return issues(texts, "id", [Rule("jsonld.type_term_unknown", "error", "path", named, "not a term"), Rule("jsonld.id_not_portable", "error", "path", local, "a local id")], "path").drop("message")


def mappability(values: DataFrame, classes: DataFrame, also_known: Sequence[str] = ()) -> DataFrame:
    """Properties that an export loses, as warnings: id, property, code. Those without a class, those with nothing but a text, and
    of several properties of one class the second by pos. values: id, pos, property, number, text; classes: property, class."""
    found = values.join(sized(classes), "property", "left").where(F.col("class").isNotNull() | ~F.col("property").isin(*also_known))
    code = F.when(F.col("class").isNull(), "property_unmapped").when(F.col("number").isNull() & F.col("text").isNotNull(), "value_text_only")
    alone = found.select("id", "property", code.alias("code")).where("code is not null")
    shared = found.where("class is not null").groupBy("id", "class").agg(F.array_sort(F.collect_set(F.struct("pos", "property"))).alias("_p")).where(F.size("_p") > 1)
    return alone.unionByName(shared.select("id", F.col("_p")[1]["property"].alias("property"), F.lit("property_alias_collision").alias("code")))


def rendered(found: DataFrame, by: str = "id") -> DataFrame:
    """One text for each record: its issues in order of path and code."""
    line = F.format_string("[%s] %s: %s", "severity", "path", "message")
    return found.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "code", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))

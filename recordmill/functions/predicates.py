"""Optional predicates of a record query. Each takes a column and an argument; an argument of None is no condition.

Equality, lists and ranges are plain comparisons beside a test for null, so that they reach the scan; those that ignore case
can't. NaN: a value that is not a number passes a range, as a comparison that is never false would let it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TRUE = F.lit


def always() -> Column:
    return F.lit(True)


def equals(c: Column, value) -> Column:
    """Exact, case-sensitive."""
    return always() if value is None else c.isNotNull() & (c == F.lit(value))


def equals_text(c: Column, value: str | None) -> Column:
    """Ignoring case, as text; null never equals."""
    return always() if value is None else F.coalesce(F.lower(c.cast("string")) == value.lower(), F.lit(False))


def contains_text(c: Column, value: str | None) -> Column:
    """Ignoring case; wildcards are literal."""
    return always() if value is None else F.coalesce(F.lower(c.cast("string")).contains(value.lower()), F.lit(False))


def starts_text(c: Column, value: str | None) -> Column:
    """Ignoring case; an empty prefix is no condition."""
    return always() if not value else F.coalesce(F.lower(c.cast("string")).startswith(value.lower()), F.lit(False))


def contains_either_way(c: Column, value: str | None) -> Column:
    """One text holds the other, ignoring case and outer spaces (an empty stored text is held by all)."""
    if value is None:
        return always()
    stored, wanted = F.lower(F.trim(c.cast("string"))), F.lit(value.strip().lower())
    return F.coalesce(F.contains(stored, wanted) | F.contains(wanted, stored), F.lit(False))


def resembles(c: Column, value: str | None, threshold: float = 0.8) -> Column:
    """contains_either_way, or a similarity ratio of at least the threshold; lengths that rule it out never reach Python."""
    if value is None:
        return always()
    from .fuzzy import ratio

    stored, wanted = F.lower(F.trim(c.cast("string"))), value.strip().lower()
    size = F.length(stored) + len(wanted)
    possible = 2 * F.least(F.length(stored), F.lit(len(wanted))) >= threshold * size
    scored = F.when(possible, ratio(F.when(possible, stored), F.lit(wanted))).otherwise(0.0)
    return contains_either_way(c, value) | F.coalesce(scored >= threshold, F.lit(False))


def in_range(c: Column, low: float | None = None, high: float | None = None, nan: bool = True) -> Column:
    """Inclusive; null fails if there is a bound. nan=False is for columns that can't hold NaN (or where it should fail): an
    upper bound then reaches the scan too. A lower bound always does, as NaN counts as larger than any number."""
    if low is None and high is None:
        return always()
    out = c.isNotNull()
    if low is not None:
        out = out & (c >= low)
    if high is not None:
        out = out & ((c <= high) | F.isnan(c.cast("double")) if nan else c <= high)
    return out


#: Field names tried in order for a quantity's number, in the newer and the older spelling.
VALUE_FIELDS = ("value", "typical_value", "max_value", "min_value")
OLD_VALUE_FIELDS = ("value", "value_typical", "value_max", "value_min")


def first_number(*columns: Column) -> Column:
    """The first that is not null, as a double."""
    return F.coalesce(*[c.cast("double") for c in columns])


def number_of(properties: Column, key: str, fields: Sequence[str] = VALUE_FIELDS) -> Column:
    """The number of a property bag's quantity (map of struct)."""
    quantity = F.try_element_at(properties, F.lit(key))
    return first_number(*[quantity[f] for f in fields])


def properties_in_range(values: Column, bounds: Mapping[str, tuple[float | None, float | None]]) -> Column:
    """Every named property of a map of numbers lies in its bounds; a missing one fails."""
    return reduce(lambda a, b: a & b, [in_range(F.try_element_at(values, F.lit(k)), *b) for k, b in bounds.items()], always())


def has_member(c: Column, value) -> Column:
    return always() if value is None else F.coalesce(F.array_contains(c, value), F.lit(False))


def tri_state(c: Column, wanted: bool | None) -> Column:
    return always() if wanted is None else F.coalesce(c, F.lit(False)) == F.lit(wanted)


def has_number(c: Column, value: float | None, tolerance: float = 1e-9) -> Column:
    """An array holds the number within the tolerance."""
    return always() if value is None else F.coalesce(F.exists(c, lambda x: F.abs(x - value) < tolerance), F.lit(False))


def fullmatch(c: Column, pattern: str) -> Column:
    return F.coalesce(c.rlike(f"^(?:{pattern})$"), F.lit(False))


def members_matching(c: Column, pattern: str) -> Column:
    """The array's elements that match as a whole."""
    return F.filter(c, lambda x: fullmatch(x, pattern))


#: Fixed value: six letters or digits at a name's end or before a dot.
SHORT_ID = r"-([a-z0-9]{6})(?:\.|$)"


def short_id(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, SHORT_ID, 1), F.lit(""))


def serial_matches(c: Column, token: str | Column) -> Column:
    """The same serial, or the same short id."""
    token = F.lit(token) if isinstance(token, str) else token
    known = (c != "") & (token != "")
    return F.coalesce(known & ((c == token) | (F.coalesce(short_id(token), token) == F.coalesce(short_id(c), c))), F.lit(False))


def one_of(c: Column, values: Sequence | None) -> Column:
    return always() if values is None else c.isNotNull() & c.isin(list(values))


def batch_or_serials(batch: Column, serial: Column, batch_id: str | None, serials: Sequence[str] | None) -> Column:
    """A batch takes precedence over a list of serials."""
    return equals(batch, batch_id) if batch_id is not None else one_of(serial, serials)


def every(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions, always())

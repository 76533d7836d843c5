"""Deterministic identifiers, as expressions without Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the digits of base 32 without i, l, o, u.
ALPHABET = "0123456789abcdefghjkmnpqrstvwxyz"


def _digit(value: Column) -> Column:
    return F.substring(F.lit(ALPHABET), value.cast("int") + 1, 1)


def _dashed_groups(digits: Column, first: int) -> Column:
    """Twenty hex digits from place `first` on as four dashed groups of four base-32 digits."""
    groups = []
    for g in range(4):
        value = F.conv(F.substring(digits, first + 5 * g, 5), 16, 10).cast("long")
        groups.append(F.concat(*[_digit(F.shiftrightunsigned(value, 5 * k) % 32) for k in (3, 2, 1, 0)]))
    return F.concat_ws("-", *groups)


def stable_uid(seed: Column) -> Column:
    """The low 80 bits of the first 16 bytes of the seed's SHA-256."""
    return _dashed_groups(F.sha2(seed, 256), 13)


def bytewise_uid(*parts: Column) -> Column:
    """One digit for each of the first 16 bytes (modulo 32) of the SHA-256 of the parts, joined by unit separators."""
    digits = F.sha2(F.concat_ws("\x1f", *parts), 256)
    chars = [_digit(F.conv(F.substring(digits, 1 + 2 * i, 2), 16, 10).cast("long") % 32) for i in range(16)]
    return F.concat_ws("-", *[F.concat(*chars[4 * g : 4 * g + 4]) for g in range(4)])


def sha1_uid(seed: Column) -> Column:
    """The first ten bytes of the seed's SHA-1."""
    return _dashed_groups(F.sha1(seed), 1)


def normalised_uid(c: Column) -> Column:
    """Lower case, no dashes, look-alikes replaced, dashed again; null where that is no uid."""
    token = F.translate(F.regexp_replace(F.lower(F.trim(c)), "-", ""), "oil", "011")
    dashed = F.concat_ws("-", *[F.substring(token, 1 + 4 * g, 4) for g in range(4)])
    return F.when(token.rlike(f"^[{ALPHABET}]{{16}}$"), dashed)


def short_id_of_iri(c: Column) -> Column:
    tail = F.element_at(F.split(F.rtrim(c, F.lit("/")), "/"), -1)
    return F.substring(F.regexp_replace(tail, "-", ""), 1, 6)


def seed_of(*parts: Column) -> Column:
    """Trimmed parts that are there, joined; null if none is (such a record is never the same as another)."""
    kept = [F.nullif(F.trim(p.cast("string")), F.lit("")) for p in parts]
    return F.nullif(F.concat_ws("::", *kept), F.lit(""))


def content_hash(*columns: Column) -> Column:
    """SHA-256 over the columns as JSON, volatile columns being those that aren't passed."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)

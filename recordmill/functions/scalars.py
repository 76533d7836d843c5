"""Scalar functions: times, names, numbers, units, references."""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def mapped(c: Column, table: Mapping[str, object], default: Column | None = None) -> Column:
    """The table's value for the text, else the default (null)."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    found = F.try_element_at(pairs, c)
    return found if default is None else F.coalesce(found, default)


# Times

def unix_time(c: Column) -> Column:
    """Seconds of a text: nine digits or more, or an ISO date or time (UTC unless it says otherwise); null for all else."""
    text = F.trim(c.cast("string"))
    iso = text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d+)?)?)?(Z|[+-]\d{2}(:?\d{2})?)?)?$")
    fixed = F.regexp_replace(F.regexp_replace(text, ",", "."), r"([T ]\d{2})(?=$|Z|[+-])", "$1:00")
    stamp = F.when(iso, F.try_to_timestamp(fixed))
    return F.when(text.rlike(r"^\d+$"), F.when(F.length(text) >= 9, text.try_cast("long"))).otherwise(F.unix_timestamp(stamp))


def unix_of_number(c: Column) -> Column:
    """A number cut towards zero; null if not finite."""
    value = c.cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < 9e18), F.when(value < 0, F.ceil(value)).otherwise(F.floor(value)).cast("long"))


def unix_of_timestamp(c: Column) -> Column:
    return F.unix_timestamp(c.cast("timestamp"))


def iso_time(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def year_of(seconds: Column) -> Column:
    return F.year(F.timestamp_seconds(seconds))


# Names

def resolved_time(c: Column, default: Column) -> Column:
    """struct<seconds, problem>: nothing given takes the default; what can't be read is a problem, not a null."""
    given, read = F.nullif(F.trim(c.cast("string")), F.lit("")), unix_time(c)
    return F.struct(F.when(given.isNull(), default.cast("long")).otherwise(read).alias("seconds"), F.when(given.isNotNull() & read.isNull(), "unparsable time").alias("problem"))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def first_keyword(c: Column, table: Mapping[str, str], default: str = "other") -> Column:
    """The value of the first keyword, in the table's order, that the lower-cased text holds."""
    out = None
    for word, value in table.items():
        test = F.lower(c).contains(word)
        out = F.when(test, value) if out is None else out.when(test, value)
    return F.lit(default) if out is None else out.otherwise(default)


def extracted(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, or null."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def batch_key(c: Column) -> Column:
    """A cycler file's batch: the organisation (up to the first underscore) in capitals, the rest in small letters, without the
    server's address and channel, which are the last part if that begins with four numbers between dots."""
    parts = F.split(c, "_")
    address = F.split(F.substring_index(F.element_at(parts, -1), "-", 1), r"\.")
    served = (F.size(address) == 4) & F.forall(address, lambda x: x.rlike(r"^\d{1,3}$")) & F.element_at(parts, -1).contains("-")
    kept = F.filter(F.when(served, F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts), lambda x: x != "")
    rest = F.lower(F.array_join(F.slice(kept, 2, F.greatest(F.size(kept) - 1, F.lit(0))), "_"))
    return F.concat(F.upper(F.element_at(kept, 1)), F.lit("__"), rest)


def label_of(c: Column) -> Column:
    """The name of `name / unit` or `name [unit]`."""
    t = F.trim(c)
    return F.when(t.contains(" / "), F.trim(F.substring_index(t, "/", 1))).when(t.rlike(r"\[[^\[]*\]$"), F.trim(F.regexp_extract(t, r"^(.*)\[[^\[]*\]$", 1))).otherwise(t)


def unit_of(c: Column) -> Column:
    t = F.trim(c)
    after = F.expr("null")
    after = F.when(t.contains(" / "), F.trim(F.regexp_extract(t, "/(.*)$", 1))).when(t.rlike(r"\[[^\[]*\]$"), F.trim(F.regexp_extract(t, r"\[([^\[]*)\]$", 1)))
    return F.nullif(after, F.lit(""))


def media_type(c: Column, table: Mapping[str, str], default: str = "application/octet-stream") -> Column:
    out = None
    for ending, kind in table.items():
        test = F.lower(c).endswith(ending)
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return F.lit(default) if out is None else out.otherwise(default)


# Numbers

#: Cells that mean that nothing is known, compared in lower case.
MISSING = ("", "nr", "na", "n/a", "none", "none_s", "unknown", "unk", "-", "--", "?", "tbd")


def cleaned(c: Column) -> Column:
    """Trimmed text, or null for a token that means nothing is known."""
    t = F.trim(c.cast("string"))
    return F.when(~F.lower(t).isin(*MISSING), t)


def finite_number(c: Column) -> Column:
    value = cleaned(c).try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


@F.pandas_udf(T.DoubleType())
def _six(values: pd.Series) -> pd.Series:
    return values.map(lambda x: float(f"{x:.6g}"), na_action="ignore")


def significant(c: Column) -> Column:
    """Rounded to six significant digits, by the exact value of the double. Built-in rounding goes by its shortest decimal
    form and so settles ties differently; hence Arrow batches."""
    return _six(c.cast("double"))


def fraction(value: Column, unit: Column) -> Column:
    """Percent as a fraction, rounded to six places; other units and texts pass."""
    return F.when(unit == "%", F.round(value.try_cast("double") / 100, 6)).otherwise(value.try_cast("double"))


def fraction_with_spread(value: Column, std_dev: Column, unit: Column) -> Column:
    """struct<value, std_dev>: both rescaled together."""
    return F.struct(fraction(value, unit).alias("value"), fraction(std_dev, unit).alias("std_dev"))


def normalised_unit(*candidates: Column) -> Column:
    """The first unit given, in small letters without spaces."""
    token = F.coalesce(*[F.nullif(F.lower(F.trim(c)), F.lit("")) for c in candidates])
    return F.replace(F.replace(token, F.lit(" "), F.lit("")), F.lit("ohms"), F.lit("ohm"))


def converted(value: Column, unit: Column, factors: Mapping[str, float]) -> Column:
    """In the target unit; no unit is taken as the target unit, an unknown one gives null."""
    return F.when(unit.isNull(), value).otherwise(value * mapped(unit, factors))


def volume_and_area(form: Column, diameter: Column, height: Column, width: Column, thickness: Column) -> Column:
    """struct<volume, area>, to six significant digits: round cells by diameter and height, others by their three sides."""
    round_ = F.lower(form).isin("cylindrical", "coin", "button") & (diameter != 0) & (height != 0)
    box = (width != 0) & (height != 0) & (thickness != 0)
    r = diameter / 2
    volume = F.when(round_, F.pi() * r * r * height).when(box, width * height * thickness)
    area = F.when(round_, 2 * F.pi() * r * height + 2 * F.pi() * r * r).when(box, 2 * (width * height + width * thickness + height * thickness))
    return F.struct(significant(volume).alias("volume"), significant(area).alias("area"))


# References

def doi_of(c: Column) -> Column:
    """The DOI in a DOI address, or null."""
    return extracted(F.trim(c), r"(?i)^https?://(?:dx\.)?doi\.org/(10\..+)$")


def citation_url(citation: Column, doi: Column) -> Column:
    """One address for a citation: DOIs in whatever form as an address, other texts as they are."""
    text, bare = F.nullif(F.trim(citation), F.lit("")), F.nullif(F.trim(doi), F.lit(""))
    as_url = lambda x: F.concat(F.lit("https://doi.org/"), x)
    from_text = F.coalesce(as_url(doi_of(text)), F.when(text.rlike(r"^10\.\d{4,9}/\S+$"), as_url(text)), text)
    return F.when(citation.isNotNull(), from_text).otherwise(as_url(F.coalesce(doi_of(bare), bare)))


def orcid(c: Column) -> Column:
    """The bare id, or null where it is none."""
    token = F.upper(F.rtrim(F.regexp_replace(F.trim(c), r"(?i)^https?://orcid\.org/", ""), F.lit("/")))
    return F.when(token.rlike(r"^\d{4}-\d{4}-\d{4}-\d{3}[\dX]$"), token)


def ror(c: Column) -> Column:
    t = F.trim(c)
    return F.when(t.startswith("http"), t).otherwise(F.concat(F.lit("https://ror.org/"), F.element_at(F.split(t, "/"), -1)))


def licence(c: Column, known: list[str]) -> Column:
    """Known identifiers in small letters, all else as it is."""
    t = F.trim(c)
    return F.when(F.lower(t).isin(*known), F.lower(t)).otherwise(t)


#: Hex digits of each checksum.
CHECKSUM_DIGITS = {"md5": 32, "sha256": 64, "sha512": 128}


def checksum_ok(algorithm: Column, value: Column) -> Column:
    """Whether the text has the shape of the algorithm's checksums; algorithms that are not known are let pass."""
    digits = mapped(F.replace(F.lower(algorithm), F.lit("-"), F.lit("")), CHECKSUM_DIGITS)
    return digits.isNull() | F.coalesce(value.rlike("^[0-9a-fA-F]+$") & (F.length(value) == digits), F.lit(False))


def expanded_iri(c: Column, prefixes: Mapping[str, str]) -> Column:
    """prefix:name as a full address where the prefix is known."""
    head, tail = F.substring_index(c, ":", 1), F.regexp_extract(c, "^[^:]*:(.*)$", 1)
    return F.when(c.contains(":"), F.coalesce(F.concat(mapped(head, prefixes), tail), c)).otherwise(c)


def compacted_iri(c: Column, prefixes: Mapping[str, str]) -> Column:
    out = c
    for prefix, base in prefixes.items():
        out = F.when(c.startswith(base), F.concat(F.lit(f"{prefix}:"), F.substr(c, F.lit(len(base) + 1)))).otherwise(out)
    return out


def without_secret(c: Column, secret: str) -> Column:
    return F.replace(c, F.lit(secret), F.lit("***")) if secret else c


def joined(*parts: Column, default: str) -> Column:
    """Parts that are there as `a | b | c`, or the default."""
    return F.coalesce(F.nullif(F.concat_ws(" | ", *parts), F.lit("")), F.lit(default))


#: Salts that a text of an electrolyte may name.
SALTS = ("LiPF6", "LiTFSI", "LiFSI", "LiBF4", "LiClO4", "LiBOB")


def electrolyte(c: Column) -> Column:
    """struct<concentration, salt, solvents: array<struct<name, fraction>>> of a text like `1M LiPF6 EC:EMC=3:7`.

    Fractions only where there is one for each solvent; a solvent named twice is one, its known fractions summed.
    """
    words = F.split(F.trim(F.regexp_replace(c, r"\s*=\s*", "=")), r"\s+")
    listed = F.try_element_at(F.filter(words, lambda w: F.split(w, "=")[0].contains(":") & F.forall(F.split(F.split(w, "=")[0], ":"), lambda n: n.rlike("^[A-Z]{2,4}$"))), F.lit(1))
    names = F.split(F.split(listed, "=")[0], ":")
    ratios = F.transform(F.split(F.try_element_at(F.split(listed, "="), F.lit(2)), ":"), lambda x: F.regexp_substr(x, F.lit(r"^\d+(\.\d+)?")).try_cast("double"))
    total = F.aggregate(ratios, F.lit(0.0), lambda a, x: a + x)
    usable = F.coalesce((F.size(ratios) == F.size(names)) & (total > 0), F.lit(False))
    shares = F.when(usable, F.transform(ratios, lambda x: F.round(x / total, 4))).otherwise(F.transform(names, lambda _: F.lit(None).cast("double")))
    pairs = F.arrays_zip(names.alias("name"), shares.alias("fraction"))
    unique = F.array_distinct(names)
    merged = F.transform(
        unique,
        lambda n: F.struct(
            n.alias("name"),
            F.aggregate(F.filter(pairs, lambda p: p["name"] == n), F.lit(None).cast("double"), lambda a, p: F.coalesce(F.round(a + p["fraction"], 4), a, p["fraction"])).alias("fraction"),
        ),
    )
    molar = F.regexp_replace(c, r"(\d)\s*M(\s|$)", "$1M ")
    strength = F.try_element_at(F.filter(F.split(molar, r"\s+"), lambda w: w.rlike(r"^[\d.]+M$")), F.lit(1))
    known = F.filter(F.split(c, r"[\s,;]+"), lambda w: mapped(F.lower(w), {x.lower(): x for x in SALTS}).isNotNull())
    return F.struct(F.rtrim(strength, F.lit("M")).try_cast("double").alias("concentration"), mapped(F.lower(F.try_element_at(known, F.lit(1))), {x.lower(): x for x in SALTS}).alias("salt"), merged.alias("solvents"))

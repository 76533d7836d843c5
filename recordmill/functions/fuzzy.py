"""Similarity of texts. The matching-blocks ratio has no built-in counterpart: Arrow batches, the standard library's matcher."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Twice the matched characters over all characters; null for nulls."""
    known: dict[tuple[str, str], float] = {}

    def one(a, b):
        if a is None or b is None:
            return None
        if (a, b) not in known:
            known[a, b] = difflib.SequenceMatcher(None, a, b).ratio()
        return known[a, b]

    return pd.Series([one(a, b) for a, b in zip(left, right, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def nearest_word(words: pd.Series, term: pd.Series) -> pd.Series:
    """The best ratio of the term to one of the words (0 of none); null for null. Each pair of texts is compared once a batch."""
    pairs = {(w, t) for ws, t in zip(words, term, strict=True) if ws is not None for w in ws}
    known = {pair: difflib.SequenceMatcher(None, pair[1], pair[0]).ratio() for pair in pairs}
    return pd.Series([None if ws is None else max((known[w, t] for w in ws), default=0.0) for ws, t in zip(words, term, strict=True)], dtype="float64")


def letters(c: Column) -> Column:
    """Small letters and digits alone."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def score(terms: list[str], maker: Column, model: Column, sizes: Column | None = None) -> Column:
    """How well a record answers a search of several terms (0 to 1), which is as well as it answers the worst of them.

    A term that is one of the size codes, or part of the name as a whole, is answered fully; that is decided by built-in
    expressions. Only rows where it is neither go to Python, for the most similar word.
    """
    wanted = [t for t in (re.sub("[^a-z0-9]", "", t.lower()) for t in terms) if t]
    if not wanted:
        return F.lit(0.0)
    name = F.concat_ws(" ", maker, model)
    whole = letters(name)
    words = F.array_distinct(F.array_remove(F.array_append(F.transform(F.split(F.trim(name), r"\s+"), letters), whole), ""))
    codes = F.split(F.coalesce(sizes, F.lit("")), r"\s+") if sizes is not None else F.array().cast("array<string>")
    answers = []
    for term in wanted:
        full = F.array_contains(codes, term) | whole.contains(term)
        answers.append(F.when(full, 1.0).otherwise(nearest_word(F.when(~full, words), F.lit(term))))
    return answers[0] if len(answers) == 1 else F.least(*answers)


def closest(c: Column, choices: list[str], cutoff: float = 0.6) -> Column:
    """The choice most like the text, or null."""
    ordered = sorted(choices)

    @F.pandas_udf(T.StringType())
    def find(text: pd.Series) -> pd.Series:
        found = {t: next(iter(difflib.get_close_matches(t, ordered, n=1, cutoff=cutoff)), None) for t in text.dropna().unique()}
        return text.map(found)

    return find(c)

"""Repetition rules from a suffix array of a text's words (operator 2).

The words of a batch of texts are numbered, the texts are laid end to end with a separator of its own after each, and the
suffix array is built by prefix doubling that goes on only with suffixes still tied. The ranks of every doubling level give
the longest common prefix of neighbouring suffixes. Intervals of the array whose common prefix is at least MIN_WORDS are
maximal repeated substrings if the words before them differ; the union of their spans, as a fraction of the text's words,
and the longest repeat are then held against limits. Repeats never cross texts, since separators differ.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import extended, map_arrow, texts_of

MIN_WORDS = 8
#: A text is kept if repeats cover at most this percentage of its words and none is longer than so many words.
MAX_COVERED_PERCENT = 30
MAX_REPEAT_WORDS = 60
#: Base rules: at least so many words; at most this percentage of words in 8-word windows found twice.
LEAST_WORDS = 20
MAX_WINDOW_PERCENT = 30
SYMBOLS = b"#*$%&|<>"
#: Words laid end to end at once; a longer text is one block of its own.
BLOCK_WORDS = 60_000


def suffix_array(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """Suffix array, its inverse, and the ranks at each doubling level as (words compared, rank at each position).

    Prefix doubling; from level to level only suffixes whose rank is shared are sorted again.
    """
    n = len(tokens)
    array = np.argsort(tokens)
    ordered = tokens[array]
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[array] = start  # a group's rank is the place of its first member
    levels = [(1, rank.copy())]
    step = 1
    while True:
        shared = np.zeros(n, bool)
        shared[:-1] |= ~first[1:]
        shared[1:] |= ~first[1:]
        places = np.flatnonzero(shared)
        if not len(places):
            break
        at = array[places]
        key = start[places] * (n + 1) + rank[np.minimum(at + step, n)] + 1
        by = np.argsort(key)
        array[places] = at[by]
        key = key[by]
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        first[places] = fresh
        start[places] = np.maximum.accumulate(np.where(fresh, places, 0))
        rank[array[places]] = start[places]
        step *= 2
        levels.append((step, rank.copy()))
    inverse = np.empty(n, np.int64)
    inverse[array] = np.arange(n)
    return array, inverse, levels


def common_prefixes(array: np.ndarray, levels: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """lcp[i]: words that suffixes i - 1 and i of the array have in common; lcp[0] is 0."""
    n = len(array)
    a, b = array[:-1].copy(), array[1:].copy()
    length = np.zeros(len(a), np.int64)
    for step, rank in reversed(levels):
        same = np.flatnonzero(rank[np.minimum(a, n)] == rank[np.minimum(b, n)])
        same = same[(a[same] < n) & (b[same] < n)]
        a[same] += step
        b[same] += step
        length[same] += step
    return np.concatenate([[0], length])


def maximal_repeats(tokens: np.ndarray, array: np.ndarray, lcp: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(words, first and last place in the array) of each maximal repeated substring of `least` words or more.

    An interval is maximal to the right because its least common prefix is more than that of its surroundings, and to the
    left when the words before its members are not all the same. Runs of the array below `least` are skipped at once.
    """
    before = np.where(array > 0, tokens[array - 1], -1)
    long = lcp >= least
    edges = np.flatnonzero(np.diff(np.concatenate([[0], long.astype(np.int8), [0]])))
    out: list[tuple[int, int, int]] = []
    # changes[i]: how many neighbours up to i have different words before them
    changes = np.concatenate([[0], np.cumsum(before[1:] != before[:-1])])
    for low, high in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        stack: list[tuple[int, int]] = []
        for i, value in enumerate([*lcp[low:high].tolist(), 0], low):
            left = i - 1
            while stack and stack[-1][0] > value:
                depth, left = stack.pop()
                if changes[i - 1] > changes[left] or array[left] == 0:
                    out.append((depth, left, i - 1))
            if value and (not stack or stack[-1][0] < value):
                stack.append((value, left))
    return out


@dataclass
class Repetition:
    words: int
    covered: int
    longest: int


def measure(texts_words: list[list[bytes]], least: int = MIN_WORDS) -> tuple[list[Repetition], list[list[tuple[int, int]]]]:
    """For each text: words, words covered by repeats of `least` words or more, longest repeat; and the union of the repeats'
    spans as maximal runs (first word, words)."""
    results: list[Repetition] = []
    spans: list[list[tuple[int, int]]] = []
    at = 0
    while at < len(texts_words):
        end, size = at, 0
        while end < len(texts_words) and (end == at or size + len(texts_words[end]) <= BLOCK_WORDS):
            size += len(texts_words[end])
            end += 1
        _measure_block(texts_words[at:end], least, results, spans)
        at = end
    return results, spans


def _measure_block(block: list[list[bytes]], least: int, results: list[Repetition], spans: list[list[tuple[int, int]]]) -> None:
    sizes = np.array([len(w) for w in block], np.int64)
    flat = [w for words in block for w in words]
    numbers = pd.factorize(np.array(flat, object))[0] if flat else np.zeros(0, np.int64)
    ends = np.cumsum(sizes + 1)
    starts = ends - sizes - 1
    tokens = np.empty(int(ends[-1]), np.int64)
    inside = np.ones(len(tokens), bool)
    inside[ends - 1] = False
    # Each text has numbers of its own, so that suffixes of different texts have nothing in common.
    tokens[inside] = numbers + len(block) + np.repeat(np.arange(len(block)), sizes) * (numbers.max(initial=0) + 1)
    tokens[~inside] = np.arange(len(block))
    array, _, levels = suffix_array(tokens)
    lcp = common_prefixes(array, levels)
    cover = np.zeros(len(tokens) + 1, np.int64)
    longest = np.zeros(len(block), np.int64)
    owner = np.repeat(np.arange(len(block)), sizes + 1)
    for depth, low, high in maximal_repeats(tokens, array, lcp, least):
        places = array[low : high + 1]
        cover[places] += 1
        cover[places + depth] -= 1
        doc = owner[places[0]]
        longest[doc] = max(longest[doc], depth)
    under = np.cumsum(cover[:-1]) > 0
    hidden = np.concatenate([[0], np.cumsum(under)])
    edges = np.diff(np.concatenate([[0], under.astype(np.int8), [0]]))  # a separator is never covered: runs stay in a text
    low, high = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    found: list[list[tuple[int, int]]] = [[] for _ in block]
    for a, b in zip(low.tolist(), high.tolist(), strict=True):
        found[owner[a]].append((a - int(starts[owner[a]]), b - a))
    for i in range(len(block)):
        results.append(Repetition(int(sizes[i]), int(hidden[ends[i] - 1] - hidden[starts[i]]), int(longest[i])))
        spans.append(found[i])


def verdict(r: Repetition, max_covered_percent: int = MAX_COVERED_PERCENT, max_repeat_words: int = MAX_REPEAT_WORDS) -> bool:
    return 100 * r.covered <= max_covered_percent * r.words and r.longest <= max_repeat_words


def repetition(df: DataFrame, text: str = "text", least: int = MIN_WORDS, max_covered_percent: int = MAX_COVERED_PERCENT, max_repeat_words: int = MAX_REPEAT_WORDS) -> DataFrame:
    """Add n_words, covered_words, longest_repeat (words), repeats (array of first word and words) and repetition_ok.

    Null and empty texts have no words and no repeats, and pass. Clashing columns are replaced; other columns, repeated rows
    and null keys are carried as they are.
    """
    from .common import with_columns

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        results, spans = measure([t.encode().split() for t in texts_of(batch.column(text))], least)
        kind = pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())]))
        added = {
            "n_words": pa.array([r.words for r in results], pa.int64()),
            "covered_words": pa.array([r.covered for r in results], pa.int64()),
            "longest_repeat": pa.array([r.longest for r in results], pa.int64()),
            "repeats": pa.array([[{"first": a, "words": n} for a, n in s] for s in spans], kind),
            "repetition_ok": pa.array([verdict(r, max_covered_percent, max_repeat_words) for r in results], pa.bool_()),
        }
        return with_columns(batch, added)

    return map_arrow(df, run, extended(df.schema, "n_words long, covered_words long, longest_repeat long, repeats array<struct<first:long,words:long>>, repetition_ok boolean"))


def _continuations(data: bytes) -> int:
    """Bytes that continue a UTF-8 character."""
    return int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) == 0x80))


def rules(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Base counts, base_failed and kept for each row of the input; null texts have no words and fail the base rule."""
    df = df.select(key, text)
    others = bytes(sorted(set(range(256)) - set(SYMBOLS)))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch.column(text))
        raw = [t.encode() for t in texts]
        words = [t.split() for t in raw]
        results, _ = measure(words)
        chars = [sum(map(len, w)) - _continuations(t) for w, t in zip(words, raw, strict=True)]
        symbols = [len(t.translate(None, others)) for t in raw]
        repeated = []
        for t in raw:
            lines = [x for x in t.split(b"\n") if x.strip()]
            repeated.append(len(lines) - len(set(lines)))
        failed = [r.words < LEAST_WORDS or 100 * r.covered > MAX_WINDOW_PERCENT * r.words for r in results]
        kept = [not f and verdict(r) for f, r in zip(failed, results, strict=True)]
        integers = [[r.words for r in results], chars, symbols, repeated, [r.covered for r in results]]
        return pa.RecordBatch.from_arrays(
            [batch.column(key), *[pa.array(x, pa.int64()) for x in integers], pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_())],
            names=[key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
        )

    kind = df.schema[key].dataType.simpleString()
    return map_arrow(df, run, f"{key} {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean")

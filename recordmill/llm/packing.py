"""Best-two-fit packing of tokenised documents into sequences of bounded length (operator 8).

A bin is filled greedily with the longest pieces that still fit; then the bin's smallest piece is replaced by two unpacked
ones whenever two fit the widened gap more tightly. A bin depends on lengths alone, so the plan is made on the histogram of
lengths: at most `capacity` rows reach the driver, whatever the corpus, and a bin's pattern is used as many times as the
counts allow. Pieces find their slot by their number among the pieces of their length, counted without a task per length.

Null texts are empty documents (one token, the separator). Repeated rows are documents of their own. An empty table gives
an empty result.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PATTERN, byte_letters, default_vocabulary
from .common import cut, extended, map_arrow, numbered, texts_of

CAPACITY = 2048
SEPARATOR = 0


@lru_cache(maxsize=2)
def _encoder(path: str):
    """A fast encoder for the vocabulary file; ids are the same as the tokenizers library's."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        parsed = json.load(file)
    letters = byte_letters()
    special = {t["content"]: t["id"] for t in parsed["added_tokens"]}
    ranks = {bytes(letters[c] for c in t): i for t, i in parsed["model"]["vocab"].items() if t not in special}
    core = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)._core_bpe
    return core, set(special)


@lru_cache(maxsize=2)
def _library(path: str):
    """The tokenizers library's own encoder for the vocabulary file."""
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def token_ids(path: str, text: str) -> bytes:
    """The text's ids as little-endian unsigned 32-bit integers. Texts that the fast encoder's backtracking pattern refuses (runs
    of a million spaces, say) go to the tokenizers library."""
    if not text:
        return b""
    core, special = _encoder(path)
    try:
        return bytes(core.encode_to_tiktoken_buffer(text, special))
    except ValueError:
        return np.array(_library(path).encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def pieces(df: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece: key, piece, start, length, ids_crc32. Only documents over the capacity are cut, and only their
    first piece is shorter than it."""
    path = path or default_vocabulary()
    df = df.select(key, text)
    tail = np.array([SEPARATOR], "<u4").tobytes()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[tuple[int, int, int, int, int]] = []
        for n, t in enumerate(texts_of(batch.column(text))):
            ids = token_ids(path, t) + tail
            total = len(ids) // 4
            first = total % capacity or capacity
            for i, start in enumerate([0, *range(first, total, capacity)]):
                end = first if i == 0 else start + capacity
                rows.append((n, i, start, end - start, zlib.crc32(ids[4 * start : 4 * end])))
        take, *columns = (np.array(rows, np.int64).reshape(-1, 5)).T
        return pa.RecordBatch.from_arrays(
            [batch.column(key).take(pa.array(take)), pa.array(columns[0].astype(np.int32)), *[pa.array(np.ascontiguousarray(c)) for c in columns[1:]]],
            names=[key, "piece", "start", "length", "ids_crc32"],
        )

    return map_arrow(df, run, extended(df.select(key).schema, "piece int, start long, length long, ids_crc32 long"))


def best_two_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Patterns of lengths (longest first) and how often each is used; together they hold every counted length once."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] += n
    plan: list[tuple[list[int], int]] = []
    grid = np.arange(capacity + 1)

    def largest(limit: int) -> int:
        found = np.flatnonzero(left[1 : limit + 1])
        return int(found[-1]) + 1 if len(found) else 0

    while longest := largest(capacity):
        taken = [longest]
        left[longest] -= 1
        gap = capacity - longest
        while gap and (longest := largest(gap)):
            taken.append(longest)
            left[longest] -= 1
            gap -= longest
        if gap:
            small = taken[-1]
            room = gap + small
            fits = np.maximum.accumulate(np.where(left > 0, grid, 0))
            a = np.flatnonzero(left[: room + 1])
            b = fits[room - a]
            alone = (b == a) & (left[a] < 2)
            b[alone] = fits[np.maximum(a[alone] - 1, 0)]
            both = np.where(b > 0, a + b, 0)
            if len(a) and both.max() > small:
                best = int(both.argmax())
                pair = sorted((int(a[best]), int(b[best])), reverse=True)
                left[small] += 1
                for x in pair:
                    left[x] -= 1
                taken = taken[:-1] + pair
        used = {x: taken.count(x) for x in set(taken)}
        more = min(int(left[x]) // n for x, n in used.items())
        for x, n in used.items():
            left[x] -= more * n
        plan.append((sorted(taken, reverse=True), more + 1))
    return plan


def slots(plan: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length, by pattern: rank from which it serves, first sequence, how many of the length it holds, offset of the first."""
    out: dict[int, list[list[int]]] = {}
    sequence = 0
    for taken, times in plan:
        offset = 0
        for length in sorted(set(taken), reverse=True):
            n = taken.count(length)
            rows = out.setdefault(length, [])
            rank = rows[-1][0] + rows[-1][4] if rows else 0
            rows.append([rank, sequence, n, offset, n * times])
            offset += n * length
        sequence += times
    return {length: tuple(np.array(rows, np.int64).T[:4]) for length, rows in out.items()}


def pack(df: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Pack every document: the columns of `pieces` with sequence_id and offset. Other columns of the input are not carried."""
    parts = cut(pieces(df, path, key, text, capacity))
    counts = {int(r[0]): int(r[1]) for r in parts.groupBy("length").count().collect()}  # at most `capacity` rows
    places = slots(best_two_fit(counts, capacity))
    ranked = numbered(parts, ["length"], [F.col(key), F.col("piece")], "rank")
    shared = df.sparkSession.sparkContext.broadcast(places)  # bounded by the number of patterns, a small multiple of the capacity

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        length = batch.column("length").to_numpy(zero_copy_only=False)
        rank = batch.column("rank").to_numpy(zero_copy_only=False)
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for size in np.unique(length).tolist():
            at = np.flatnonzero(length == size)
            ranks, first, per, begin = shared.value[size]
            i = np.searchsorted(ranks, rank[at], "right") - 1
            over = rank[at] - ranks[i]
            sequence[at] = first[i] + over // per[i]
            offset[at] = begin[i] + over % per[i] * size
        kept = [batch.column(n) for n in batch.schema.names if n != "rank"]
        return pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=[n for n in batch.schema.names if n != "rank"] + ["sequence_id", "offset"])

    columns = [key, "piece", "start", "length", "ids_crc32"]
    ranked = ranked.select(*columns, "rank")
    return map_arrow(ranked, run, extended(ranked.drop("rank").schema, "sequence_id long, offset long"))

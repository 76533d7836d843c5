"""Removal of repeated byte strings by blockwise suffix sorting (operator 3).

Every `LENGTH`-byte string that starts earlier (in a smaller document, or in the same one before) is removed wherever it
comes again. Equal strings have to meet in one bucket of suffixes, so a bucket is named by content: the least hash among the
16-byte strings inside the window, its anchor. Windows next to each other mostly share their anchor, so what travels is one
row for each run of windows (about one for 40 bytes of text), not one for each suffix:

1. anchors met once in the corpus are dropped: no string around them can repeat;
2. runs whose bytes are equal as a whole need no sorting: all but the first are repeats;
3. buckets that hold different runs are sorted, a block of whole buckets at a time, with a difference cover (see suffixes),
   so memory is bounded by a block; neighbours with a common prefix of LENGTH or more are one string. A window reaches HALF
   bytes or more beyond its anchor on one side: windows whose anchor with that side is met once in the bucket aren't sorted,
   since in a larger corpus more and more texts share an anchor by chance alone;
4. a bucket of more than BUCKET different runs is split by sampled splitters into ranges of its strings, each of a block's
   size, and the parts are sorted in the same way.

What is equal is found by order, not by gathering: copies of a run, and strings of a large bucket, are dealt out in ranges of
(key, text, place), so that equal ones may lie in several tasks, next to each other. Each task knows all but one of its
repeats by itself; whether the first of its least key came before is told by the greatest key of the range before. No
bucket, copy group or document list is gathered in one place. Runs "equal as a whole" are known by two 64-bit hashes, of the
anchor and of the run; strings of sorted buckets by their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import covered, cut, discard, map_arrow, numbered, ragged, release, small_batches
from .suffixes import equal_runs, sorted_suffixes

LENGTH = 100
GRAM = 16
#: What a window has beyond its anchor on one of its sides, at least.
HALF = (LENGTH - GRAM) // 2
#: A bucket of more different runs than this (some 3 MB of bytes) is split into parts, which tasks sort.
BUCKET = 20_000
#: Bytes of runs sorted at once in a task.
BLOCK = 1 << 20
#: Windows of runs whose grams are hashed at once.
CHUNK = 1 << 18
_BYTES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def _grams(data: np.ndarray) -> np.ndarray:
    """The hash of the GRAM bytes that start at each place."""
    h = _BYTES[data]
    base, step = _BASE, 1
    while step < GRAM:
        h = h[:-step] * np.uint64(base) + h[step:]
        base, step = base * base % (1 << 64), step * 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that share their anchor: anchor hash, text's number, first window (in data), number of windows.

    data: bytes of several texts, text i at starts[i]:ends[i]. A window belongs to the run of its leftmost least gram.
    """
    width = length - GRAM + 1
    found: list[tuple[np.ndarray, ...]] = []
    for at in range(0, max(0, len(data) - length + 1), CHUNK):
        h = _grams(data[at : at + CHUNK + length - 1])
        least = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)
        step = 1
        while 2 * step <= width:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        if width > step:
            least = np.minimum(least[: step - width], least[width - step :])
        anchor = (least & np.uint64(0xFFFFFF)).astype(np.int64)
        fresh = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        found.append((h[anchor[fresh]], at + fresh, at + np.concatenate([fresh[1:], [len(anchor)]])))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))  # type: ignore[return-value]
    h, low, high = (np.concatenate(x) for x in zip(*found, strict=True))
    # A run may lie over the border of texts: keep of it, for each text, the windows that end inside the text.
    last = ends - length + 1
    doc = np.searchsorted(ends, low, "right")
    out = []
    while len(low):
        inside = doc < len(ends)
        h, low, high, doc = h[inside], low[inside], high[inside], doc[inside]
        a, b = np.maximum(low, starts[doc]), np.minimum(high, last[doc])
        good = a < b
        out.append((h[good], doc[good], a[good], (b - a)[good]))
        more = high > ends[doc]
        h, high, doc = h[more], high[more], doc[more] + 1
        low = starts[np.minimum(doc, len(starts) - 1)]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else tuple(np.zeros(0, np.int64) for _ in range(4))  # type: ignore[return-value]


def _bytes_of(column: pa.Array) -> list[bytes]:
    return [b"" if t is None else t.encode() if isinstance(t, str) else t for t in column.to_pylist()]


def _runs_table(rows: DataFrame) -> DataFrame:
    """(h, c, row, start, n): c is the hash of the run's bytes, start counts from the text's beginning. rows: row, text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = _bytes_of(batch.column("text"))
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        joined = b"".join(texts)
        h, doc, at, n = runs(np.frombuffer(joined, np.uint8), starts, ends)
        digest = xxhash.xxh3_64_intdigest
        view = memoryview(joined)
        c = np.array([digest(view[a:b]) for a, b in zip(at.tolist(), (at + n + LENGTH - 1).tolist(), strict=True)], np.uint64)
        return pa.RecordBatch.from_arrays(
            [pa.array(h.astype(np.uint64).view(np.int64)), pa.array(c.view(np.int64)), batch.column("row").take(pa.array(doc.astype(np.int64))), pa.array((at - starts[doc]).astype(np.int32) if len(doc) else np.zeros(0, np.int32)), pa.array(n.astype(np.int32))],
            names=["h", "c", "row", "start", "n"],
        )

    return map_arrow(rows, run, "h long, c long, row long, start int, n int")


def _sort_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeats among the runs of whole buckets. The input is sorted by bucket (h); columns h, row, start, n, run."""
    held: list[tuple] = []
    size = 0
    block = _Block()

    def sift() -> Iterator[pa.RecordBatch]:
        block.add(held)
        if block.size >= BLOCK:
            yield from emit()

    def emit() -> Iterator[pa.RecordBatch]:
        spans = block.repeats()
        if len(spans[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in spans], names=["row", "a", "b"])

    for batch in batches:
        for item in zip(*[batch.column(n).to_pylist() for n in ("h", "row", "start", "n", "run")], strict=True):
            if size >= BLOCK and held[-1][0] != item[0]:
                yield from sift()
                held, size = [], 0
            held.append(item)
            size += len(item[4])
    if held:
        yield from sift()
        yield from emit()


def _shared(block: np.ndarray, begins: np.ndarray, n: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last but one of each run's windows that may be met in another run of its bucket: those that hold HALF bytes
    before the anchor, if these and the anchor are met again, and those that hold HALF bytes behind it, if these are. Hashes
    that meet by chance only keep more windows."""
    grams, width = _grams(block), LENGTH - GRAM + 1
    tries = width + 1 - n  # the anchor is the first gram of hash h among those that all windows of the run hold
    at, item = ragged(begins + n - 1, tries), np.repeat(np.arange(len(n)), tries)
    hit = np.flatnonzero(grams[at] == h[item].view(np.uint64))
    anchor = at[hit[np.unique(item[hit], return_index=True)[1]]]
    place = anchor - begins

    def met(there: np.ndarray, side: int) -> np.ndarray:
        mine, out = np.flatnonzero(there), np.zeros(len(n), bool)
        key = grams[anchor[mine]]
        for reach in range(HALF, 0, -GRAM):
            key = (key ^ grams[anchor[mine] + side * reach]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        _, which, times = np.unique(key, return_inverse=True, return_counts=True)
        out[mine] = times[which] > 1
        return out

    before, behind = met(place >= HALF, -1), met(place - (n - 1) <= HALF, 1)
    border = place - HALF  # the window with HALF bytes on both sides
    low = np.where(before, 0, np.maximum(border, 0))
    high = np.where(behind, n, np.minimum(border + 1, n))
    return low, np.where(before | behind, np.maximum(high, low), low)


class _Block:
    """Runs of whole buckets, without the windows that are met once, until they are enough to be sorted."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, held: list[tuple]) -> None:
        h, row, start, n = (np.array(x, np.int64) for x in list(zip(*held, strict=True))[:4])
        data = np.frombuffer(b"".join(x[4] for x in held), np.uint8)
        sizes = n + LENGTH - 1
        begins = np.cumsum(sizes) - sizes
        low, high = _shared(data, begins, n, h)
        left = np.flatnonzero(high > low)
        low, n = low[left], (high - low)[left]
        self.parts.append((h[left], row[left], start[left] + low, n, data[ragged(begins[left] + low, n + LENGTH - 1)]))
        self.size += len(self.parts[-1][4])

    def repeats(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The spans of repeats; the block is empty afterwards."""
        if not self.parts:
            return tuple(np.zeros(0, np.int64) for _ in range(3))  # type: ignore[return-value]
        h, row, start, n, block = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.__init__()
        return _repeats(h, row, start, n, block)


def _repeats(h: np.ndarray, row: np.ndarray, start: np.ndarray, n: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not len(h):
        return tuple(np.zeros(0, np.int64) for _ in range(3))  # type: ignore[return-value]
    sizes = n + LENGTH - 1
    begins = np.cumsum(sizes) - sizes
    at = ragged(begins, n)
    item = np.repeat(np.arange(len(n)), n)
    within = at - begins[item]
    bucket = np.unique(h, return_inverse=True)[1][item]
    order = sorted_suffixes(block, at, bucket, LENGTH)
    label = equal_runs(block, at, bucket, order, LENGTH)
    # The first of each class is the one of the smallest row and start; the others are repeats.
    where, place = row[item[order]], start[item[order]] + within[order]
    by = np.lexsort((place, where, label))
    again = np.zeros(len(by), bool)
    again[1:] = label[by][1:] == label[by][:-1]
    repeated = np.zeros(len(at), bool)
    repeated[order[by[again]]] = True
    return spans_of(repeated, item, row, start, within)


def spans_of(repeated: np.ndarray, item: np.ndarray, row: np.ndarray, start: np.ndarray, within: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte spans (row, a, b) that the repeated windows cover; windows next to each other in a run make one span."""
    edge = np.diff(np.concatenate([[0], repeated.astype(np.int8), [0]]))
    fresh = np.zeros(len(repeated), bool)
    fresh[1:] = (item[1:] != item[:-1]) & repeated[1:] & repeated[:-1]
    low = np.sort(np.concatenate([np.flatnonzero(edge == 1), np.flatnonzero(fresh)]))
    high = np.sort(np.concatenate([np.flatnonzero(edge == -1), np.flatnonzero(fresh)]))
    i = item[low]
    return row[i], start[i] + within[low], start[i] + within[high - 1] + LENGTH


def _windows(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A row for each window of each run, with its bytes."""
    row, start, n = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("row", "start", "n"))
    joined = np.frombuffer(b"".join(batch.column("run").to_pylist()), np.uint8)
    sizes = n + LENGTH - 1
    begins = np.cumsum(sizes) - sizes
    at, item = ragged(begins, n), np.repeat(np.arange(len(n)), n)
    every = np.lib.stride_tricks.sliding_window_view(joined, LENGTH)[at] if len(at) else np.zeros((0, LENGTH), np.uint8)
    offsets = pa.py_buffer(np.arange(0, LENGTH * (len(at) + 1), LENGTH, dtype=np.int32))
    strings = pa.Array.from_buffers(pa.binary(), len(at), [None, offsets, pa.py_buffer(np.ascontiguousarray(every))])
    return pa.RecordBatch.from_arrays([strings, pa.array(row[item]), pa.array((start[item] + at - begins[item]).astype(np.int32))], names=["w", "row", "start"])


#: What tasks over ranges of keys hand on: spans of repeats, and one row (low and high set) with the span of the range's very
#: first row, whose key may have come before, the range's least and greatest key, and its place.
_RANGED = "row long, a long, b long, low binary, high binary, place int"


def _span_batch(spans: tuple, low: bytes | None = None, high: bytes | None = None) -> pa.RecordBatch:
    from pyspark import TaskContext

    n, place = len(spans[0]), TaskContext.get().partitionId() if low is not None else None
    columns = [pa.array(np.asarray(x, np.int64)) for x in spans]
    return pa.RecordBatch.from_arrays([*columns, pa.array([low] * n, pa.binary()), pa.array([high] * n, pa.binary()), pa.array([place] * n, pa.int32())], names=["row", "a", "b", "low", "high", "place"])


def _copies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All but the first of runs with the same bytes; the input is sorted by (h, c, row, start)."""
    first = before = None
    for batch in batches:
        h, c, row, start, n = (batch.column(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("h", "c", "row", "start", "n"))
        if not len(h):
            continue
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (c[1:] == c[:-1])
        if before is None:
            first = (h[0], c[0], row[0], start[0], n[0])
        else:
            again[0] = before == (h[0], c[0])
        before = (h[-1], c[-1])
        yield _span_batch((row[again], start[again], start[again] + n[again] + LENGTH - 1))
    if first is not None:
        name = lambda pair: b"".join(int(x).to_bytes(8, "big", signed=True) for x in pair)
        yield _span_batch(([first[2]], [first[3]], [first[3] + first[4] + LENGTH - 1]), name(first[:2]), name(before))


def _sort_parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeats among the strings of one part of the large buckets (w, row, start), by the cover sort."""
    held = [b for b in batches if len(b)]
    if not held:
        return
    row, start = (np.concatenate([b.column(x).to_numpy(zero_copy_only=False).astype(np.int64) for b in held]) for x in ("row", "start"))
    strings = [w for b in held for w in b.column("w").to_pylist()]
    block = np.frombuffer(b"".join(strings), np.uint8)
    at, bucket = np.arange(0, len(block), LENGTH), np.zeros(len(strings), np.int64)
    order = sorted_suffixes(block, at, bucket, LENGTH)
    label = equal_runs(block, at, bucket, order, LENGTH)
    by = np.lexsort((start[order], row[order], label))
    again = np.zeros(len(by), bool)
    again[1:] = label[by][1:] == label[by][:-1]
    again, first = order[by[again]], order[by[0]]
    yield _span_batch((row[again], start[again], start[again] + LENGTH))
    yield _span_batch(([row[first]], [start[first]], [start[first] + LENGTH]), strings[first], strings[order[-1]])


def _settled(ranged: DataFrame) -> DataFrame:
    """Spans of tasks over ranges, with those of first rows whose key the range before ends in. One row a range is collected."""
    spans = ranged.where("low is null").select("row", "a", "b")
    again, before = [], None
    for edge in ranged.where("low is not null").orderBy("place").collect():
        if before is not None and edge["low"] == before:
            again.append((edge["row"], edge["a"], edge["b"]))
        before = edge["high"]
    return spans.unionByName(ranged.sparkSession.createDataFrame(again, "row long, a long, b long")) if again else spans


def _packed(rows: DataFrame) -> DataFrame:
    """The text column compressed, so that shuffling whole texts costs little disk; the name becomes z."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        press = zstandard.ZstdCompressor(level=1)
        names = [n for n in batch.schema.names if n != "text"]
        z = [None if t is None else press.compress(t.encode() if isinstance(t, str) else t) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(z, pa.binary())], names=[*names, "z"])

    schema = T.StructType([f for f in rows.schema.fields if f.name != "text"] + [T.StructField("z", T.BinaryType())])
    return map_arrow(rows, run, schema)


def _met(rows: DataFrame) -> DataFrame:
    """Runs whose anchor is met more than once."""
    table = _runs_table(rows)
    # Written first, so that the join's two sides are plain shuffles and Spark can split an anchor with very many runs.
    often = cut(table.groupBy("h").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("h"))
    release(rows.sparkSession)
    return table.join(often, "h")


def _firsts(met: DataFrame) -> DataFrame:
    """The first of the runs with the same bytes, and how many there are."""
    found = met.groupBy("h", "c").agg(F.min(F.struct("row", "start", "n")).alias("first"), F.count(F.lit(1)).alias("copies"))
    return found.select("h", "c", F.col("first.row").alias("row"), F.col("first.start").alias("start"), F.col("first.n").alias("n"), "copies")


def _fetch(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The bytes of the runs asked for."""
    press = zstandard.ZstdDecompressor()
    out: list[tuple] = []
    for row, z, asked in zip(*[batch.column(c).to_pylist() for c in ("row", "z", "asked")], strict=True):
        text = press.decompress(z)
        out += [(row, x["h"], x["start"], x["n"], x["large"], text[x["start"] : x["start"] + x["n"] + LENGTH - 1]) for x in asked]
    columns = list(zip(*out, strict=True)) if out else [[]] * 6
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["row", "h", "start", "n", "large", "run"])


def _fetched(rows: DataFrame, firsts: DataFrame) -> DataFrame:
    """The runs, with their bytes, of buckets that hold different ones."""
    buckets = firsts.groupBy("h").agg(F.count(F.lit(1)).alias("different")).where("different > 1")
    mixed = firsts.join(buckets, "h").select("row", "h", "start", "n", (F.col("different") > BUCKET).alias("large"))
    asked = mixed.groupBy("row").agg(F.collect_list(F.struct("h", "start", "n", "large")).alias("asked"))  # at most a text's own runs
    return map_arrow(_packed(rows).join(asked, "row"), _fetch, "row long, h long, start int, n int, large boolean, run binary")


def _later_copies(met: DataFrame) -> DataFrame:
    """A table of the spans of runs whose bytes came before as a whole."""
    keys = ["h", "c", "row", "start"]
    return cut(met.select(*keys, "n").repartitionByRange(_parts(met), *keys).sortWithinPartitions(*keys).mapInArrow(_copies, _RANGED))


def _sorted_repeats(fetched: DataFrame) -> DataFrame:
    small = fetched.where("not large").select("h", "row", "start", "n", "run")
    return small.repartition(_parts(fetched), "h").sortWithinPartitions("h").mapInArrow(_sort_blocks, "row long, a long, b long")


def _split_repeats(fetched: DataFrame) -> DataFrame | None:
    """A table of the spans of repeats in large buckets, whose strings are split by sampled splitters; None without such buckets."""
    large = fetched.where("large").select("row", "start", "n", "run")
    strings = large.agg(F.sum(F.col("n").cast("long"))).first()[0]
    if not strings:
        return None
    windows = cut(map_arrow(large, _windows, "w binary, row long, start int"))
    parts = max(_parts(fetched), -(-strings * LENGTH // BLOCK))
    out = cut(windows.repartitionByRange(parts, "w", "row", "start").mapInArrow(_sort_parts, _RANGED))
    discard(windows)
    return out


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def repeated_spans(rows: DataFrame) -> DataFrame:
    """Spans by text, not merged, of bytes covered by strings that start earlier: row, _spans. rows: row (unique long), text.

    Each phase ends in a written table, after which the shuffles behind it are given up.
    """
    spark = rows.sparkSession
    small_batches(spark)
    met = cut(_met(rows))
    release(spark)
    firsts = cut(_firsts(met))
    fetched = cut(_fetched(rows, firsts))
    release(spark)
    discard(firsts)
    copies = _later_copies(met)
    discard(met)
    release(spark)
    split = _split_repeats(fetched)
    spans = _settled(copies).unionByName(_sorted_repeats(fetched))
    if split is not None:
        spans = spans.unionByName(_settled(split))
    found = cut(spans.groupBy("row").agg(F.collect_list(F.struct("a", "b")).alias("_spans")))  # at most a text's own windows
    discard(fetched, copies, *([split] if split is not None else []))
    release(spark)
    return found


def _with_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """Add `row`, a unique long that orders texts as the key does. A unique integer key without nulls serves itself; otherwise
    rows are numbered: null keys come last, and rows that share a key go by their text's hash, repeated rows in any order."""
    if not isinstance(df.schema[key].dataType, T.IntegralType):
        return numbered(df, [], [F.col(key).asc_nulls_last(), F.xxhash64(text)], "row")
    count = df.agg(F.count(F.lit(1)).alias("n"), F.count(key).alias("known")).first()
    unique = count["n"] == count["known"] and df.select(key).distinct().count() == count["n"]
    if unique:
        return df.withColumn("row", F.col(key).cast("long"))
    return numbered(df, [], [F.col(key).asc_nulls_last(), F.xxhash64(text)], "row")


def _spans_by_text(df: DataFrame, key: str, text: str) -> DataFrame:
    """The table's columns as _in_0, _in_1, …, but the text, which is compressed (z); and the spans to remove (_spans, null: none)."""
    place = {n: f"_in_{i}" for i, n in enumerate(df.columns)}
    rows = _with_rows(df.select(*[F.col(n).alias(p) for n, p in place.items()]), place[key], place[text]).withColumnRenamed(place[text], "text")
    return _packed(rows).join(repeated_spans(rows.select("row", "text")), "row", "left")


def _cuts(spans: list | None) -> list[tuple[int, int]]:
    if not spans:
        return []
    return covered(np.array([s["a"] for s in spans]), np.array([s["b"] for s in spans]))


def digest(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of the input: key, n_bytes, n_removed, n_spans, kept_sha256. Null texts count as empty."""
    marked = _spans_by_text(df.select(key, text), key, text).select(F.col("_in_0").alias(key), "z", "_spans")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        press = zstandard.ZstdDecompressor()
        out: list[tuple] = []
        for z, spans in zip(batch.column("z").to_pylist(), batch.column("_spans").to_pylist(), strict=True):
            data = press.decompress(z) if z is not None else b""
            cuts = _cuts(spans)
            at, kept = 0, hashlib.sha256()
            for a, b in cuts:
                kept.update(data[at:a])
                at = b
            kept.update(data[at:])
            out.append((len(data), sum(b - a for a, b in cuts), len(cuts), kept.hexdigest()))
        n, removed, spans, kept = zip(*out, strict=True) if out else ((), (), (), ())
        return pa.RecordBatch.from_arrays(
            [batch.column(key), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.string())],
            names=[key, "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )

    kind = df.schema[key].dataType.simpleString()
    return map_arrow(marked, run, f"{key} {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def whole_characters(data: bytes, cuts: list[tuple[int, int]]) -> bytes:
    """What is left without the spans, each narrowed to whole UTF-8 characters."""
    out, at = [], 0
    for a, b in cuts:
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]])


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The table with repeated strings taken out of its texts (whole characters only), columns as they were.

    Texts that are repeats from end to end leave nothing and go; null texts and texts that were empty before stay.
    """
    names = df.columns
    marked = _spans_by_text(df, key, text)
    marked = marked.select(*[F.col("z" if n == text else f"_in_{i}") for i, n in enumerate(names)], "_spans")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        press = zstandard.ZstdDecompressor()
        kept, texts = [], []
        for n, (z, spans) in enumerate(zip(batch.column("z").to_pylist(), batch.column("_spans").to_pylist(), strict=True)):
            data = press.decompress(z) if z is not None else None
            left = whole_characters(data, _cuts(spans)) if data else data
            if left or not data:
                kept.append(n)
                texts.append(None if left is None else left.decode())
        picked = batch.take(pa.array(kept, pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == text else picked.column(i) for i, n in enumerate(names)], names=names)

    return map_arrow(marked, run, df.schema)

"""SimHash near-duplicates by exact tiled comparison (operator 7).

A text's fingerprint is the bitwise majority of the XXH64 hashes of its 3-word shingles. Equal fingerprints are one node.
Distinct fingerprints within a radius r agree on at least one of r + 1 bit fields; each is sent once for each field, and the
fingerprints that share a field's value form a group. A group is cut into tiles in order of population count, and pairs of
tiles are compared whole with numpy exclusive-or and bit counts; a pair of tiles is skipped when its population counts differ
by more than the radius. No pair of fingerprints within the radius can be missed, and no group has to fit one task: every
pair of tiles is a row of its own. Each comparison hands on a spanning forest of its links, not all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, extended, map_arrow, numbered, texts_of, with_columns
from .components import components

RADIUS = 2
WORDS = 3
SEED = 42
TILE = 1024


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Bit k is set if it is set in more than half of the hashes. No words: zero."""
    tokens = (text or "").encode().lower().split()  # bytes: A-Z alone is lowered, and the six ASCII spaces alone divide
    if not tokens:
        return 0
    if len(tokens) <= words:
        hashes = [xxhash.xxh64_intdigest(b" ".join(tokens), SEED)]
    else:
        joined, digest = b" ".join(tokens), xxhash.xxh64_intdigest
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        ends = np.cumsum(sizes + 1) - 1
        starts = ends - sizes
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[: 1 - words].tolist(), ends[words - 1 :].tolist(), strict=True)]
    return majority(np.array(hashes, np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in more than half of the hashes; none of no hashes."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):  # bounds the memory of a very long text
        part = hashes[at : at + 8192].astype("<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def close(left: np.ndarray, right: np.ndarray, radius: int, rows: int = 128) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (in left, in right) of all pairs of fingerprints within the radius, by exclusive-or and bit counts of some rows at
    a time against those of the other side whose population counts differ by no more than the radius."""
    bits, others = np.bitwise_count(left).astype(np.int64), np.bitwise_count(right).astype(np.int64)
    by, against = np.argsort(bits, kind="stable"), np.argsort(others, kind="stable")
    sorted_bits, sorted_right = others[against], right[against]
    for at in range(0, len(by), rows):
        mine = by[at : at + rows]
        low, high = np.searchsorted(sorted_bits, [bits[mine[0]] - radius, bits[mine[-1]] + radius + 1])
        if low < high:
            i, j = np.nonzero(np.bitwise_count(left[mine][:, None] ^ sorted_right[low:high]) <= radius)
            yield mine[i], against[low + j]


def fingerprints(df: DataFrame, text: str = "text", name: str = "fp") -> DataFrame:
    """Add the fingerprint as a signed long; a clashing column is replaced."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(t) for t in texts_of(batch.column(text))], np.uint64)
        return with_columns(batch, {name: pa.array(found.view(np.int64))})

    return map_arrow(df, run, extended(df.schema, f"{name} long"))


def _forest(left: np.ndarray, right: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between two tiles of fingerprints (the same tile twice: inside it)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = x = parent.get(p, p)
        return x

    out = []
    for rows, columns in close(left, right, radius):
        for a, b in zip(left[rows].tolist(), right[columns].tolist(), strict=True):
            if a != b and (x := root(a)) != (y := root(b)):
                parent[max(x, y)] = min(x, y)
                out.append((a, b))
    return out


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (u, v) that connect exactly what pairs of fingerprints within the radius connect. distinct: one column fp, no repeats."""
    bounds = [round(64 * i / (radius + 1)) for i in range(radius + 2)]
    fields = F.array(*[F.struct(F.lit(i).alias("field"), F.shiftrightunsigned(F.shiftleft("fp", 64 - b), 64 - b + a).alias("part")) for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))])
    sent = distinct.select("fp", F.explode(fields).alias("_f")).select("fp", "_f.field", "_f.part")
    sizes = sent.groupBy("field", "part").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sent = sent.join(sizes, ["field", "part"]).withColumn("bits", F.bit_count("fp"))
    sent = numbered(sent.where(F.col("n") > 0), ["field", "part"], [F.col("bits"), F.col("fp")], "place")
    tiles = sent.groupBy("field", "part", F.floor(F.col("place") / tile).alias("tile")).agg(F.collect_list("fp").alias("fps"), F.min("bits").alias("low"), F.max("bits").alias("high"))
    tiles = cut(tiles)  # at most `tile` fingerprints a row

    bands = tiles.groupBy("field", "part").agg(F.count(F.lit(1)).alias("tiles")).where("tiles > 1")
    other = tiles.select("field", "part", *[F.col(c).alias(f"{c}2") for c in ("tile", "low", "high", "fps")])
    many = tiles.join(bands.select("field", "part"), ["field", "part"], "left_semi")
    pairs = many.join(other, ["field", "part"]).where((F.col("tile") < F.col("tile2")) & (F.col("low2") - F.col("high") <= radius)).select("fps", "fps2")
    work = tiles.select("fps", F.col("fps").alias("fps2")).unionByName(pairs)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found: list[tuple[int, int]] = []
            for a, b in zip(frame["fps"], frame["fps2"], strict=True):
                found += _forest(np.asarray(a, np.int64).view(np.uint64), np.asarray(b, np.int64).view(np.uint64), radius)
            yield pd.DataFrame(np.array(found, np.uint64).reshape(-1, 2).view(np.int64), columns=["u", "v"])

    return work.repartition(F.hash("fps", "fps2")).mapInPandas(run, "u long, v long").distinct()


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row for each row of the input: key, fingerprint (16 hex digits), component_id.

    component_id is the smallest key reachable over links of at most `radius` differing bits. Texts without words (null and
    empty ones too) have the fingerprint zero and are linked like any other. Rows with a null key take part in links, but
    their key never names a component unless all keys of the component are null. Repeated keys stay as separate rows.
    """
    marked = cut(fingerprints(df.select(key, text), text).drop(text))
    nodes = roots(marked.groupBy("fp").agg(F.min(key).alias("least")), radius)
    named = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    of = nodes.join(named, "root").select("fp", "component_id")
    return marked.join(of, "fp").select(key, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def roots(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows (one for each fingerprint fp) with the least fingerprint that links reach (root)."""
    found = components(links(distinct.select("fp"), radius))
    return distinct.join(found, F.col("fp") == F.col("node"), "left").select(*distinct.columns, F.coalesce("component", "fp").alias("root"))

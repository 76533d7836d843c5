"""SimHash near-duplicates verified by exact Jaccard similarity of sets of 5-word shingles (operator 7 as a filter of texts; its
query has a contract of its own: 3 words, 2 bits).

Words are those of `simhash`: A-Z lowered, divided by ASCII spaces; a text of fewer words is one shingle. Texts with equal sets
are one node. A node's fingerprint is the bitwise majority of its shingles' hashes. At similarity 4/5 fingerprints of 64 bits
differ in about ten bits, too many for bit fields to route them; so nodes meet by shingles instead. Every set is put in one
order, rare shingles first, and two sets of similarity 4/5 or more then share one of their first n - ceil(4n/5) + 1 shingles.
Nodes that share one are compared in tiles, by exclusive-or and bit counts of fingerprints (RADIUS), by sizes, and by exclusive-or
of parity maps: each shingle flips one of 256 bits, so that maps never differ in more bits than sets do in shingles, and at
similarity 4/5 sets differ in no more than a ninth of their sizes' sum. In tiles the maps grow with the sets (WIDEST), so that
texts of one mould that are less similar are told apart there. The pairs that are left are verified on the whole texts. The
order only decides the cost; it comes from a sketch of counts over all texts.

A large group of near copies costs links by member, not by pair: shingles that the same nodes share are one; nodes are compared
with a few leaders of each shingle first, then each piece of work hands on a spanning forest of its pairs, and pairs that these
links connect already are never listed. Texts travel compressed, and only those of candidates;
everything else is decided on row numbers. What carries much is joined with the numbers of the rows that go, not of those that
stay: they are fewer as a rule, and where Spark finds them small enough for a broadcast, nothing else moves.
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

from .common import cut, discard, map_arrow, ragged, release, small_batches, texts_of
from .components import components
from .simhash import close, majority

WORDS = 5
#: The least similarity, as a fraction.
SIMILAR = (4, 5)
#: Differing bits of fingerprints beyond which a pair isn't verified. Pairs of similarity 4/5 differ in 9.7 bits on average, with
#: a standard deviation of 2.9; beyond 24 they are about one in two million. Of the smallest sets, 4 shingles against 5, they are
#: one in 8,000 (12 bits on average).
RADIUS = 24
#: Words of 64 bits of a node's parity map.
MAPS = ("_m0", "_m1", "_m2", "_m3")
#: Bits of the widest map that travels into tiles; the map of a smaller set has two to four bits a shingle.
WIDEST = 4096
#: Counters of the sketch of shingle counts, a power of two; its sums (8 bytes each) are what the driver gets, whatever the input.
COUNTERS = 1 << 19
#: Nodes of one shingle that are compared in one piece of work; more are dealt out by pairs of tiles.
TILE = 1024
#: Words whose hashes a worker keeps (about 200 bytes each, until it ends).
KNOWN_WORDS = 100_000
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class _Words(dict):
    """Hashes of words, kept."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        found = xxhash.xxh64_intdigest(word, 42)
        if len(word) <= 64:
            self[word] = found
        return found


_WORDS = _Words()


def hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """The hashes of the text's shingles in order, repeats included; none without words."""
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(_WORDS.__getitem__, tokens), np.uint64, len(tokens))
    wide = min(words, len(each))
    out = np.full(len(each) - wide + 1, wide, np.uint64)
    for k in range(wide):
        out = (out ^ each[k : len(each) - wide + 1 + k]) * _BASE
        out ^= out >> np.uint64(29)
    out *= _MIX
    return out ^ (out >> np.uint64(32))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The hashes of the text's distinct shingles in order."""
    return np.unique(hashes(text, words))


def prefix(found: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of the set, enough for any similar set to share one. counts: the sketch's."""
    n, (a, b) = len(found), SIMILAR
    size = n - -(-a * n // b) + 1 if n else 0
    return found[np.argsort(counts[_counter(found, len(counts))], kind="stable")[:size]]


def _counter(found: np.ndarray, counters: int) -> np.ndarray:
    return (found >> np.uint64(65 - int(counters).bit_length())).astype(np.int64)


def counted(df: DataFrame, text: str = "text", counters: int = COUNTERS) -> np.ndarray:
    """How often shingles are met (one a text), by counter, over all texts. Each task adds up its own texts' counters."""
    blocks = 64

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(counters, np.int64)
        for batch in batches:
            found = [shingles(t) for t in texts_of(batch.column(0))]
            if found:
                sums += np.bincount(_counter(np.concatenate(found), counters), minlength=counters)
        if sums.any():
            yield _blocks(sums.reshape(blocks, -1))

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, z in zip(batch.column("block").to_pylist(), batch.column("z").to_pylist(), strict=True):
                part = np.frombuffer(zstandard.decompress(z), np.int64)
                sums[block] = sums[block] + part if block in sums else part
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zstandard.compress(s.tobytes()) for s in sums.values()], pa.binary())], names=["block", "z"])

    small_batches(df.sparkSession)
    parts = df.select(text).mapInArrow(run, "block int, z binary").repartition(8, "block").mapInArrow(add, "block int, z binary")
    out = np.zeros((blocks, counters // blocks), np.int64)
    for block, z in parts.collect():  # 64 rows of fixed size
        out[block] = np.frombuffer(zstandard.decompress(z), np.int64)
    return out.reshape(-1)


def _blocks(sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), pa.array([zstandard.compress(s.tobytes()) for s in sums], pa.binary())], names=["block", "z"])


def parity(found: np.ndarray) -> np.ndarray:
    """A map of 256 bits, each set if an odd number of the shingles fall on it; four signed words."""
    odd = np.bincount((found & np.uint64(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def wide(found: np.ndarray) -> bytes:
    """A parity map of two to four bits a shingle, 256 at least and WIDEST at most. Half of it on the other half, by exclusive-or,
    is the map of half the width."""
    bits = min(WIDEST, max(256, 1 << (2 * len(found) - 1).bit_length()))
    odd = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _apart(left: np.ndarray, right: np.ndarray, maps: np.ndarray) -> np.ndarray:
    """In how many bits the maps of each pair (places in maps) differ, at the lesser width of the two."""
    out = np.zeros(len(left), np.int64)
    words = np.fromiter((len(m) // 8 for m in maps), np.int64, len(maps))
    width = np.minimum(words[left], words[right])
    for w in np.unique(width).tolist():
        mine = np.flatnonzero(width == w)
        rows, place = np.unique(np.concatenate([left[mine], right[mine]]), return_inverse=True)
        folded = np.stack([np.bitwise_xor.reduce(np.frombuffer(maps[r], np.uint64).reshape(-1, w), axis=0) for r in rows.tolist()])
        for at in range(0, len(mine), step := (1 << 20) // w):
            i, j = place[: len(mine)][at : at + step], place[len(mine) :][at : at + step]
            out[mine[at : at + step]] = np.bitwise_count(folded[i] ^ folded[j]).sum(1, dtype=np.int64)
    return out


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def marks(df: DataFrame, text: str = "text") -> DataFrame:
    """A written table of the rows: the columns as _in_0, _in_1, … but the text, which is compressed (z); a number (_row); the
    set's digest (_set), size (_size), fingerprint (_fp), parity maps (_m0 to _m3, _map) and first shingles (_first)."""
    spark = df.sparkSession
    counts = spark.sparkContext.broadcast(counted(df, text))  # of fixed size
    names = [n for n in df.columns if n != text]
    placed = df.select(F.monotonically_increasing_id().alias("_row"), *[F.col(n).alias(f"_in_{df.columns.index(n)}") for n in names], F.col(text).alias("_words"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        press, order = zstandard.ZstdCompressor(level=1), counts.value
        texts = batch.column("_words").to_pylist()
        sets = [shingles(t) for t in texts]
        added = {
            "z": pa.array([None if t is None else press.compress(t.encode()) for t in texts], pa.binary()),
            "_set": pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
            "_size": pa.array([len(s) for s in sets], pa.int32()),
            "_fp": pa.array(np.array([majority(s) for s in sets], np.uint64).view(np.int64)),
            **dict(zip(MAPS, map(pa.array, np.array([parity(s) for s in sets], np.int64).reshape(-1, 4).T), strict=True)),
            "_map": pa.array([wide(s) for s in sets], pa.binary()),
            "_first": _lists([prefix(s, order) for s in sets]),
        }
        kept = [n for n in batch.schema.names if n != "_words"]
        return pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], *added.values()], names=[*kept, *added])

    schema = T.StructType([*placed.drop("_words").schema.fields, *T.StructType.fromDDL("z binary, _set binary, _size int, _fp long, _m0 long, _m1 long, _m2 long, _m3 long, _map binary, _first array<long>").fields])
    return cut(map_arrow(placed, run, schema))


def _neighbours(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, node) whose h comes again beside them; the input is sorted. What the borders of the range may share with the next
    ranges is told by two rows more: the first and the last one, with their place and whether they are still alone (edge 1 and 2
    if so, else 3 and 4)."""
    from pyspark import TaskContext

    def rows(h, node, place=None, edge=0) -> pa.RecordBatch:
        n = len(h)
        return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(node, pa.int64()), pa.array([place] * n, pa.int32()), pa.array([edge] * n, pa.int32())], names=["h", "node", "place", "edge"])

    first = held = None  # held: the last row so far, and whether it has company
    for batch in batches:
        h, node = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("h", "node"))
        if not len(h):
            continue
        company = np.zeros(len(h) + 1, bool)  # with the row before
        company[1:-1] = h[1:] == h[:-1]
        if held is not None:
            company[0] = h[0] == held[0]
            if held[2] or company[0]:
                yield rows([held[0]], [held[1]])
            if first is not None and first[2] is None:
                first = (first[0], first[1], bool(company[0]))
        else:
            first = (int(h[0]), int(node[0]), bool(company[1]) if len(h) > 1 else None)
        shared = (company[:-1] | company[1:])[:-1]
        yield rows(h[:-1][shared], node[:-1][shared])
        held = (int(h[-1]), int(node[-1]), bool(company[len(h) - 1]))
    if held is not None:
        place = TaskContext.get().partitionId()
        if held[2]:
            yield rows([held[0]], [held[1]])
        yield rows([first[0]], [first[1]], place, 3 if first[2] else 1)
        yield rows([held[0]], [held[1]], place, 4 if held[2] else 2)


def _tokens(marked: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes by first shingles that they share with others: h, node.

    Shingles meet by order: one shuffle into ranges of (h, node), so that one shingle may lie in several tasks, and one row at
    each border of a range is settled by its neighbour. Two rows a range are collected.
    """
    spark = marked.sparkSession
    copies = cut(marked.select(F.col("_row").alias("node")).join(nodes.select("node"), "node", "left_anti"))  # fewer than the nodes, as a rule
    sent = marked.select(F.col("_row").alias("node"), "_first").join(copies, "node", "left_anti").select(F.explode("_first").alias("h"), "node")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(sent.repartitionByRange(parts, "h", "node").sortWithinPartitions("h", "node").mapInArrow(_neighbours, "h long, node long, place int, edge int"))
    edges = ranged.where("edge > 0").orderBy("place", F.pmod(F.col("edge") - 1, F.lit(2))).collect()
    added = set()
    for (low, high), (before, after) in zip(zip(edges[::2], edges[1::2], strict=True), zip([None, *edges[1::2]], [*edges[2::2], None], strict=False), strict=False):
        if low["edge"] == 1 and before is not None and before["h"] == low["h"]:
            added.add((low["h"], low["node"]))
        if high["edge"] == 2 and after is not None and after["h"] == high["h"]:
            added.add((high["h"], high["node"]))
    shared = ranged.where("edge = 0").select("h", "node")
    if added:
        shared = shared.unionByName(spark.createDataFrame(sorted(added), "h long, node long"))
    out = cut(shared)
    discard(ranged, copies)
    return out


def _told_apart(tokens: DataFrame) -> DataFrame:
    """Of shingles that the same nodes share, one; the others would list the same pairs. Equal sets of nodes are known by two
    64-bit hashes, their number and their least and greatest node."""
    whose = tokens.groupBy("h").agg(F.count(F.lit(1)).alias("_n"), F.min("node").alias("_a"), F.max("node").alias("_b"), *[F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"_x{i}") for i in (3, 4)])
    one = cut(whose.groupBy("_n", "_a", "_b", "_x3", "_x4").agg(F.min("h").alias("h")).select("h"))
    out = cut(tokens.join(one, "h"))
    discard(one)
    return out


def _with_leaders(tokens: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (u, v), u < v, that are close, of nodes with leaders of a shingle they share: the first node, the last and two by hashes."""
    led = tokens.groupBy("h").agg(F.array(F.min("node"), F.max("node"), F.min_by("node", F.xxhash64("node", F.lit(1))), F.min_by("node", F.xxhash64("node", F.lit(2)))).alias("leaders"))
    pairs = tokens.join(led, "h").select("node", F.explode("leaders").alias("to")).where("node <> to").select(F.least("node", "to").alias("u"), F.greatest("node", "to").alias("v")).distinct()
    traits = ("_size", "_fp", *MAPS)
    side = lambda n: nodes.select(F.col("node").alias(n), *[F.col(c).alias(f"{c}_{n}") for c in traits]).hint("merge")
    both = pairs.join(side("u"), "u").join(side("v"), "v")
    a, b = SIMILAR
    differ = lambda c: F.bit_count(F.col(f"{c}_u").bitwiseXOR(F.col(f"{c}_v")))
    near = (b * F.least("_size_u", "_size_v") >= a * F.greatest("_size_u", "_size_v")) & (differ("_fp") <= RADIUS) & ((a + b) * sum(differ(c) for c in MAPS) <= (b - a) * (F.col("_size_u") + F.col("_size_v")))
    return both.where(near).select("u", "v")


def _listed(columns: dict[str, np.ndarray], forest: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of nodes of the same piece of work whose fingerprints, sizes and maps are close and whose parts differ; forest: of
    these only some that connect the same parts."""
    changed = np.zeros(len(columns["h"]), bool)
    changed[1:] = False
    for c in ("h", "low", "high"):
        changed[1:] |= columns[c][1:] != columns[c][:-1]
    starts = np.flatnonzero(np.concatenate([[True], changed[1:]])) if len(changed) else np.zeros(0, np.int64)
    sizes = np.diff(np.concatenate([starts, [len(changed)]]))
    fps, a, b = columns["_fp"].view(np.uint64), [], []
    few = sizes <= 64  # many small pieces side by side, a large one by itself
    rows = ragged(starts[few], sizes[few])
    ends = np.repeat(starts[few] + sizes[few], sizes[few])
    for at in range(0, len(rows), 1 << 16):
        mine, until = rows[at : at + (1 << 16)], ends[at : at + (1 << 16)]
        left = np.repeat(mine, until - mine - 1)
        right = ragged(mine + 1, until - mine - 1)
        good = np.bitwise_count(fps[left] ^ fps[right]) <= RADIUS
        a.append(left[good])
        b.append(right[good])
    for start, size in zip(starts[~few].tolist(), sizes[~few].tolist(), strict=True):
        place = np.arange(start, start + size)
        if columns["low"][start] == columns["high"][start]:
            left, right = place, place
        else:
            left, right = place[columns["tile"][place] == columns["low"][start]], place[columns["tile"][place] != columns["low"][start]]
        for i, j in close(fps[left], fps[right], RADIUS):
            a.append(left[i])
            b.append(right[j])
    left, right = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
    node, part, size = columns["node"], columns["part"], columns["_size"].astype(np.int64)
    x, y = SIMILAR
    good = (part[left] != part[right]) & (y * np.minimum(size[left], size[right]) >= x * np.maximum(size[left], size[right]))
    left, right = left[good], right[good]
    differ = sum(np.bitwise_count(columns[c][left].view(np.uint64) ^ columns[c][right].view(np.uint64)).astype(np.int64) for c in MAPS)
    good = (x + y) * differ <= (y - x) * (size[left] + size[right])
    left, right = left[good], right[good]
    good = np.ones(len(left), bool)
    if "_map" in columns and len(left):
        good = (x + y) * _apart(left, right, columns["_map"]) <= (y - x) * (size[left] + size[right])
    if (columns["low"] != columns["high"]).any():  # small pieces of two tiles list pairs inside a tile too, which are harmless
        good &= node[left] != node[right]
    left, right = left[good], right[good]
    if forest and len(left):
        _, firsts = np.unique(np.sort(np.stack([part[left], part[right]]), axis=0), axis=1, return_index=True)
        firsts = firsts[_joining(part[left[firsts]], part[right[firsts]])]
        left, right = left[firsts], right[firsts]
    u, v = node[left], node[right]
    both = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)]), axis=1) if len(u) else np.zeros((2, 0), np.int64)
    return both[0], both[1]


def _joining(a: np.ndarray, b: np.ndarray) -> list[int]:
    """The places of links that join what the links before leave apart."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = x = parent.get(p, p)
        return x

    out = []
    for n, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        if (x := root(x)) != (y := root(y)):
            parent[max(x, y)] = min(x, y)
            out.append(n)
    return out


def _forests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the pairs of each piece of work, by parts."""
    return _pieces(batches, True)


def _pieces(batches: Iterable[pa.RecordBatch], forest: bool = False) -> Iterator[pa.RecordBatch]:
    """Pairs of each piece of work; the input is sorted by (h, low, high). Only the last piece of a batch is held over."""
    names = ("h", "low", "high", "tile", "node", "part", "_size", "_fp", *MAPS, "_map")
    held = None
    for batch in batches:
        now = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in names}
        if held is not None:
            now = {n: np.concatenate([held[n], now[n]]) for n in names}
        same = (now["h"] == now["h"][-1]) & (now["low"] == now["low"][-1]) & (now["high"] == now["high"][-1])
        last = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
        held = {n: now[n][last:] for n in names}
        if last:
            yield _pairs_batch(*_listed({n: now[n][:last] for n in names}, forest))
    if held is not None:
        yield _pairs_batch(*_listed(held, forest))


def _pairs_batch(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _left_over(tokens: DataFrame, found: DataFrame, marked: DataFrame, pieces=_pieces) -> DataFrame:
    """Pairs of nodes that share a shingle, that the links found so far leave in different parts, and that are close; of each
    piece of work what `pieces` hands on."""
    parts = components(found).withColumnRenamed("node", "_node")
    now = cut(tokens.join(parts, F.col("node") == F.col("_node"), "left").select("node", "h", F.coalesce("component", "node").alias("part")))
    still = now.groupBy("h").agg(F.min("part").alias("_a"), F.max("part").alias("_b"), F.count(F.lit(1)).alias("_n")).where("_a <> _b")
    tiles = F.ceil(F.col("_n") / TILE).cast("int")
    dealt = now.join(still.select("h", tiles.alias("_tiles")), "h").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("_tiles")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)))
    dealt = dealt.select("h", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "node", "part")
    dealt = dealt.join(marked.select(F.col("_row").alias("node"), "_size", "_fp", *MAPS, "_map").hint("merge"), "node")
    out = cut(dealt.repartition("h", "low", "high").sortWithinPartitions("h", "low", "high").mapInArrow(pieces, "u long, v long").distinct())
    discard(now)
    return out


def _verified(pairs: DataFrame, marked: DataFrame) -> DataFrame:
    """A written table of the pairs whose sets are similar; whole texts are read, compressed, of the nodes in pairs alone."""
    pairs = cut(pairs)
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("_row")).distinct()
    held = cut(marked.select("_row", "z").join(wanted, "_row", "left_semi"))
    both = pairs.join(held.select(F.col("_row").alias("u"), F.col("z").alias("zu")).hint("merge"), "u").join(held.select(F.col("_row").alias("v"), F.col("z").alias("zv")).hint("merge"), "v")
    x, y = SIMILAR

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        press, sets, kept = zstandard.ZstdDecompressor(), {}, []

        def of(node: int, z: bytes | None) -> np.ndarray:
            if node not in sets:
                if len(sets) >= 64:
                    sets.clear()
                sets[node] = shingles(None if z is None else press.decompress(z).decode())
            return sets[node]

        for u, v, zu, zv in zip(*[batch.column(c).to_pylist() for c in ("u", "v", "zu", "zv")], strict=True):
            a, b = of(u, zu), of(v, zv)
            same = len(np.intersect1d(a, b, assume_unique=True))
            kept.append(y * same >= x * (len(a) + len(b) - same))
        mask = pa.array(kept, pa.bool_())
        return pa.RecordBatch.from_arrays([batch.column("u").filter(mask), batch.column("v").filter(mask)], names=["u", "v"])

    out = cut(map_arrow(both, run, "u long, v long"))
    discard(pairs, held)
    release(marked.sparkSession)
    return out


def links(marked: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (u, v) that connect exactly what pairs of similar nodes connect. nodes: one row (node, _size, _fp, parity map) for each
    distinct set, by one of its rows."""
    every = _tokens(marked, nodes)
    release(marked.sparkSession)
    tokens = _told_apart(every)
    discard(every)
    near = _verified(_with_leaders(tokens, nodes), marked)
    made = [near]
    for pieces in (_forests, _pieces):
        rest = _left_over(tokens, near, marked, pieces)
        release(marked.sparkSession)
        more = _verified(rest, marked)
        near = near.unionByName(more)
        made += [rest, more]
    out = cut(near)
    discard(tokens, *made)
    return out


def survivors(rows: DataFrame, root: str, key: str, *ties: str) -> DataFrame:
    """For each root the key and ties of the row with the smallest key (null keys last), then the smallest ties."""
    best = rows.groupBy(root).agg(F.min(F.struct(F.col(key).isNull().alias("_none"), F.col(key).alias("_key"), *ties)).alias("_best"))
    return best.select("_best._key", *[f"_best.{c}" for c in ties])


def drop_similar(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of texts that links of similarity 4/5 or more connect stays: the one with the smallest key, null
    keys last, any one among rows of an equal key. Rows of other groups stay whatever their keys; null and empty texts and texts
    without words are one group. The columns are the input's, in their order; an empty table stays empty."""
    names = df.columns
    marked = marks(df, text)
    release(df.sparkSession)
    nodes = cut(marked.groupBy("_set").agg(F.min("_row").alias("node"), *[F.min(c).alias(c) for c in ("_size", "_fp", *MAPS)]))
    found = components(links(marked, nodes)).withColumnRenamed("node", "_node")
    roots = nodes.join(found, F.col("node") == F.col("_node"), "left").select("_set", F.coalesce("component", "node").alias("_root"))
    place = f"_in_{names.index(key)}"
    kept = survivors(marked.select("_row", place, "_set").join(roots, "_set"), "_root", place, "_row").select("_row")
    gone = cut(marked.select("_row").join(kept, "_row", "left_anti"))
    release(df.sparkSession)
    columns = [("z", text) if n == text else (f"_in_{i}", n) for i, n in enumerate(names)]
    left = marked.select("_row", *[c for c, _ in columns]).join(gone, "_row", "left_anti").select(*[c for c, _ in columns])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        press = zstandard.ZstdDecompressor()
        texts = pa.array([None if z is None else press.decompress(z).decode() for z in batch.column("z").to_pylist()], pa.string())
        return pa.RecordBatch.from_arrays([texts if c == "z" else batch.column(c) for c, _ in columns], names=names)

    return map_arrow(left, run, df.schema)

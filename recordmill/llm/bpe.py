"""Byte-level BPE with a contiguous rank array (operator 6), from a public vocabulary file that is read, never trained.

A word's parts are held as an array of boundaries and, beside it, the rank of each pair of neighbouring parts. The array is
scanned for the smallest rank, that boundary is deleted and the two ranks beside it are looked up anew. This runs for all
new short words of a batch side by side; words over 40 bytes take a heap over linked parts, with the same result.

Texts: null counts as empty (no ids). Very long texts are handled whole. Ids don't depend on batch or partition.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import itertools
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import extended, map_arrow, ragged, texts_of, with_columns

#: Fixed value: the byte-level scheme's pattern of pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words of up to so many bytes share a width of rows; longer ones than the last go one by one.
WIDTHS = (0, 6, 9, 12, 16, 24, 40)
#: Entries of the per-worker memo of chunks; beyond it the memo starts anew, so that memory stays bounded.
MEMO = 300_000
_NONE = (1 << 31) - 1
_MIX = 0x9E3779B97F4A7C15


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The scheme's letter for each byte: printable ones stand for themselves, the others for code points from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in printable}
    for n, b in enumerate(b for b in range(256) if b not in set(printable)):
        letters[chr(256 + n)] = b
    return letters


class Merges:
    """The merge list as an open-addressed hash table over (left id, right id), looked up for whole arrays at once."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        bits = max(10, (4 * len(pairs)).bit_length())
        self.shift, size = np.uint64(64 - bits), 1 << bits
        keys = np.full(size + 64, -1, np.int64)
        self.rank, self.made = np.full(size + 64, _NONE, np.int32), np.zeros(size + 64, np.int32)
        self.steps = 0
        for (a, b), (rank, made) in pairs.items():
            key = a << 32 | b
            at = key * _MIX % (1 << 64) >> int(self.shift)
            step = 0
            while keys[at + step] != -1:
                step += 1
            keys[at + step], self.rank[at + step], self.made[at + step] = key, rank, made
            self.steps = max(self.steps, step)
        self.keys, self.pairs = keys, pairs

    def slots(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The slot of each pair, or a slot whose rank is _NONE."""
        key = left.astype(np.int64) << 32 | right
        at = (key.view(np.uint64) * np.uint64(_MIX) >> self.shift).astype(np.int64)
        wrong = np.flatnonzero(self.keys[at] != key)
        for _ in range(self.steps):
            at[wrong] += 1
            wrong = wrong[(self.keys[at[wrong]] != key[wrong]) & (self.keys[at[wrong] - 1] != -1)]
            if not len(wrong):
                break
        found = self.keys[at] == key
        return np.where(found, at, len(self.keys) - 1)


def merge_short(table: Merges, parts: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Ids of many short words at once: a row of parts for each word (padded with -1 to one width).

    Every row holds its parts and the ranks of neighbouring parts side by side. A round finds each row's smallest rank,
    deletes that boundary and looks up the two ranks beside it; rows without a rank left are done.
    """
    out: list = [None] * len(parts)
    rows, left = np.arange(len(parts)), sizes.copy()
    ranks = table.rank[table.slots(parts[:, :-1].ravel(), parts[:, 1:].ravel())].reshape(len(parts), -1)
    while len(rows):
        at = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
        least = ranks[np.arange(len(rows)), at] if ranks.shape[1] else np.full(len(rows), _NONE)
        done = least == _NONE
        if done.any():
            for r, p, n in zip(rows[done].tolist(), parts[done], left[done].tolist(), strict=True):
                out[r] = p[:n]
            keep = ~done
            rows, left, parts, ranks, at = rows[keep], left[keep], parts[keep], ranks[keep], at[keep]
            if not len(rows):
                break
        i = np.arange(len(rows))
        made = table.made[table.slots(parts[i, at], parts[i, at + 1])]
        mask = np.ones(parts.shape, bool)
        mask[i, at + 1] = False
        parts[i, at] = made
        parts = parts[mask].reshape(len(rows), -1)
        mask = np.ones(ranks.shape, bool)
        mask[i, at] = False
        ranks = ranks[mask].reshape(len(rows), -1)
        left -= 1
        has = np.flatnonzero(at < ranks.shape[1])
        ranks[has, at[has]] = table.rank[table.slots(parts[has, at[has]], parts[has, at[has] + 1])]
        has = np.flatnonzero(at > 0)
        ranks[has, at[has] - 1] = table.rank[table.slots(parts[has, at[has] - 1], parts[has, at[has]])]
    return out


def merge_long(pairs: dict[tuple[int, int], tuple[int, int]], parts: list[int]) -> list[int]:
    """Ids of one long word: the same merges, the smallest rank taken from a heap over linked parts; stale entries are skipped."""
    n = len(parts)
    parts = list(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(pairs[p][0], i, *p) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in pairs]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if parts[i] != a or j >= n or parts[j] != b:
            continue
        parts[i], parts[j] = pairs[a, b][1], -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (p := (parts[i], parts[k])) in pairs:
                heapq.heappush(heap, (pairs[p][0], i, *p))
        if (h := before[i]) >= 0 and (p := (parts[h], parts[i])) in pairs:
            heapq.heappush(heap, (pairs[p][0], h, *p))
    return [p for p in parts if p >= 0]


class Codec:
    """Encoder and decoder over one vocabulary file of the tokenizers library (JSON with vocab, merges, added tokens)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            parsed = json.load(file)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        self.special = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        vocabulary = {raw(t): i for t, i in parsed["model"]["vocab"].items() if t not in self.special}
        pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(parsed["model"]["merges"]):
            a, b = map(raw, pair if isinstance(pair, list) else pair.split(" "))
            pairs.setdefault((vocabulary[a], vocabulary[b]), (rank, vocabulary[a + b]))
        self.table = Merges(pairs)
        self.byte_ids = np.array([vocabulary[bytes([b])] for b in range(256)], np.int32)
        tokens = [b""] * (max([*vocabulary.values(), *self.special.values()]) + 1)
        for token, i in vocabulary.items():
            tokens[i] = token
        for token, i in self.special.items():
            tokens[i] = token.encode()
        self.token_sizes = np.array([len(t) for t in tokens], np.int64)
        self.token_starts = np.cumsum(self.token_sizes) - self.token_sizes
        self.token_buffer = np.frombuffer(b"".join(tokens), np.uint8)
        self.decimal = [str(i).encode() for i in range(len(tokens))]
        self.words = regex.compile(PATTERN)
        self.odd_space = regex.compile(r" (?:\s|$)")
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        #: Chunk of text -> its ids as little-endian unsigned 32-bit integers.
        self.memo: dict[str, bytes] = {}

    def merge_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word, by the rank array for short words and the heap for long ones."""
        sizes = np.array([len(w) for w in words], np.int64)
        out: list = [None] * len(words)
        for low, high in itertools.pairwise(WIDTHS):
            pick = np.flatnonzero((sizes > low) & (sizes <= high))
            for pick in np.array_split(pick, len(pick) // 50_000 + 1):
                if not len(pick):
                    continue
                n = sizes[pick]
                flat = np.frombuffer(b"".join([words[i] for i in pick.tolist()]), np.uint8)
                parts = np.full((len(pick), high), -1, np.int32)
                parts[np.arange(high) < n[:, None]] = self.byte_ids[flat]
                for i, ids in zip(pick.tolist(), merge_short(self.table, parts, n), strict=True):
                    out[i] = ids
        for i in np.flatnonzero(sizes > WIDTHS[-1]).tolist():
            out[i] = np.array(merge_long(self.table.pairs, self.byte_ids[np.frombuffer(words[i], np.uint8)].tolist()), np.int32)
        return out

    def _learn(self, chunks: list[str], memo: dict[str, bytes]) -> None:
        """Put the ids of the chunks into the memo."""
        words: list[bytes] = []
        counts = []
        for chunk in chunks:
            found = [chunk] if chunk[1:].isalpha() and chunk[0] == " " else self.words.findall(chunk)
            counts.append(len(found))
            words.extend(map(str.encode, found))
        ids = self.merge_words(words)
        sizes = np.concatenate([[0], np.cumsum([len(i) for i in ids])]) if ids else np.zeros(1, np.int64)
        flat = np.concatenate(ids).astype("<u4").tobytes() if ids else b""
        ends = sizes[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)] * 4
        for chunk, a, b in zip(chunks, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            memo[chunk] = flat[a:b]

    def _pieces(self, text: str) -> list[str]:
        """A space before a non-space always starts a pre-token, so a text without special tokens or other runs of spaces
        is cut there; the space stays with what follows. Other texts go through the pattern as a whole."""
        if not text:
            return []
        if self.specials is not None and any(s in text for s in self.special):
            out, at = [], 0
            for m in self.specials.finditer(text):
                out += [*self._pieces(text[at : m.start()]), m[0]]
                at = m.end()
            return out + self._pieces(text[at:])
        if self.odd_space.search(text):
            return self.words.findall(text)
        first, *rest = text.split(" ")
        return ([first] if first else []) + list(map(" ".__add__, rest))

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers; strings of special tokens become those tokens."""
        collecting = gc.isenabled()
        gc.disable()  # millions of strings, no cycles
        try:
            return self._encode_many(texts)
        finally:
            if collecting:
                gc.enable()

    def _encode_many(self, texts: list[str]) -> list[bytes]:
        pieces = [self._pieces(t) for t in texts]
        if len(self.memo) > MEMO:
            self.memo.clear()
        memo = self.memo
        for token, i in self.special.items():
            memo[token] = np.array([i], "<u4").tobytes()
        new = set(itertools.chain.from_iterable(pieces)).difference(memo)
        if new:
            self._learn(list(new), memo)
        out = [b"".join(map(memo.__getitem__, p)) for p in pieces]
        for chunk in new:
            if len(chunk) > 100:
                del memo[chunk]
        return out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_many([text])[0], "<u4").tolist()

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The bytes that the ids stand for; ids outside the vocabulary stand for none."""
        ids = ids[ids < len(self.token_sizes)].astype(np.int64)
        return self.token_buffer[ragged(self.token_starts[ids], self.token_sizes[ids])].tobytes()

    def decode(self, ids) -> str:
        return self.decode_bytes(np.asarray(ids, np.int64)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(df: DataFrame, path: str | None = None, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the column of ids (array<int>) of every whole text. Null texts get an empty array; a clashing column is replaced."""
    path = path or default_vocabulary()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = codec(path)
        parts = bpe.encode_many(texts_of(batch.column(text)))
        offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts])]).astype(np.int32)
        values = np.frombuffer(b"".join(parts), "<u4").astype(np.int32)
        return with_columns(batch, {ids: pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))})

    return map_arrow(df, run, extended(df.schema, f"{ids} array<int>"))


def decode(df: DataFrame, path: str | None = None, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add the text that the ids stand for; invalid UTF-8 is replaced, null ids give an empty text."""
    path = path or default_vocabulary()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = codec(path)
        return with_columns(batch, {text: pa.array([bpe.decode(x or []) for x in batch.column(ids).to_pylist()], pa.string())})

    return map_arrow(df, run, extended(df.schema, f"{text} string"))


def digest(df: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode every whole text in one pass and return the digests of both, one row for each row of the input.

    Columns: the key as it is (null and repeated keys stay), n_tokens long, ids_sha256, decoded_sha256.
    """
    path = path or default_vocabulary()
    df = df.select(key, text)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = codec(path)
        decimal = bpe.decimal
        n, ids_hex, text_hex = [], [], []
        for encoded in bpe.encode_many(texts_of(batch.column(text))):
            ids = np.frombuffer(encoded, "<u4")
            n.append(len(ids))
            ids_hex.append(hashlib.sha256(b",".join(map(decimal.__getitem__, ids.tolist()))).hexdigest())
            text_hex.append(hashlib.sha256(bpe.decode_bytes(ids).decode("utf-8", "replace").encode()).hexdigest())
        return pa.RecordBatch.from_arrays(
            [batch.column(key), pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())],
            names=[key, "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return map_arrow(df, run, extended(df.select(key).schema, "n_tokens long, ids_sha256 string, decoded_sha256 string"))

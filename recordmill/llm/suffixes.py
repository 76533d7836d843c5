"""Sorting the suffixes of one block of bytes with a difference cover (for operator 3).

A set D of residues is a difference cover modulo v when every residue is a difference of two of its members: for any two
positions i and j there is a shift below v that puts both on sampled positions (those whose residue is in D). So the
samples' ranks are computed first, for the whole block, by doubling steps of v; then the suffixes of each bucket are sorted
by their first v bytes and remaining ties, however long, are settled by one comparison of sample ranks each. Ties are
settled for all buckets of the block side by side, by three-way partition around a pivot of each group.
"""

from __future__ import annotations

import numpy as np

#: A perfect difference set of size 6 modulo 31.
MODULUS, COVER = 31, (1, 5, 11, 24, 25, 27)


def shifts() -> np.ndarray:
    """shifts()[a, b]: the least shift that puts positions of residues a and b on samples."""
    out = np.zeros((MODULUS, MODULUS), np.int64)
    for a in range(MODULUS):
        for b in range(MODULUS):
            out[a, b] = next(d for d in range(MODULUS) if (a + d) % MODULUS in COVER and (b + d) % MODULUS in COVER)
    return out


SHIFTS = shifts()


def words(padded: np.ndarray, at: np.ndarray, count: int) -> list[np.ndarray]:
    """The big-endian 64-bit words at the positions; comparing them in turn compares the bytes. padded: with 8 bytes to spare."""
    every = np.lib.stride_tricks.as_strided(padded, shape=(len(padded) - 7, 8), strides=(1, 1))
    return [every[at + 8 * k].copy().view(">u8").ravel().astype(np.uint64) for k in range(count)]


def classes(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The order by several keys (most significant first) and, in that order, the rank of each distinct combination."""
    order = np.lexsort(keys[::-1])
    fresh = np.zeros(len(order), bool)
    for key in keys:
        k = key[order]
        fresh[1:] |= k[1:] != k[:-1]
    return order, np.cumsum(fresh)


def sample_ranks(padded: np.ndarray, size: int, depth: int) -> np.ndarray:
    """At each sampled position the rank of its first `depth` bytes or more among the samples; -1 elsewhere."""
    sampled = np.zeros(MODULUS, bool)
    sampled[list(COVER)] = True
    at = np.flatnonzero(np.resize(sampled, size))
    rank = np.full(size + depth + 2 * MODULUS, -1, np.int64)
    if not len(at):
        return rank
    order, ranks = classes(words(padded, at, 4))
    rank[at[order]] = ranks
    reach = MODULUS  # 32 bytes are compared, but steps go by the modulus
    while reach < depth and ranks[-1] + 1 < len(at):
        order, ranks = classes([rank[at], rank[at + reach]])
        rank[at[order]] = ranks
        reach *= 2
    return rank


def sorted_suffixes(block: np.ndarray, at: np.ndarray, bucket: np.ndarray, depth: int, seed: int = 11) -> np.ndarray:
    """An order of the suffixes that start at `at`: by bucket, then by at least their first `depth` bytes.

    Every suffix must have `depth` bytes in the block; depth must be more than the modulus.
    """
    if not len(at):
        return np.zeros(0, np.int64)
    padded = np.concatenate([block, np.zeros(depth + 64, np.uint8)])
    rank = sample_ranks(padded, len(block), depth)
    order, group = classes([bucket, *words(padded, at, 4)])
    sizes = np.bincount(group)
    active = np.flatnonzero(sizes[group] > 1)  # places in the order whose suffix is still tied
    group = group[active]
    random = np.random.default_rng(seed)
    while len(active):
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        lengths = np.diff(np.concatenate([starts, [len(group)]]))
        pivots = np.repeat(starts + (random.random(len(starts)) * lengths).astype(np.int64), lengths)
        here, there = at[order[active]], at[order[active[pivots]]]
        shift = SHIFTS[here % MODULUS, there % MODULUS]
        side = np.sign(rank[here + shift] - rank[there + shift])
        key = np.repeat(np.arange(len(starts)) * 3, lengths) + side + 1
        by = np.argsort(key, kind="stable")
        order[active] = order[active[by]]
        key = key[by]
        sizes = np.bincount(key)
        open_ = (key % 3 != 1) & (sizes[key] > 1)
        active, group = active[open_], key[open_]
    return order


def equal_runs(block: np.ndarray, at: np.ndarray, bucket: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """In sorted order, a label that neighbours share if they are of one bucket and their common prefix has `depth` bytes or more."""
    padded = np.concatenate([block, np.zeros(depth + 64, np.uint8)])
    a, b = at[order[:-1]], at[order[1:]]
    same = bucket[order[:-1]] == bucket[order[1:]]
    every = np.lib.stride_tricks.as_strided(padded, shape=(len(padded) - 7, 8), strides=(1, 1))
    for k in [*range(0, depth - 7, 8), depth - 8]:
        left = np.flatnonzero(same)
        same[left] = every[a[left] + k].copy().view(np.uint64).ravel() == every[b[left] + k].copy().view(np.uint64).ravel()
    return np.concatenate([[0], np.cumsum(~same)]) if len(order) else np.zeros(0, np.int64)

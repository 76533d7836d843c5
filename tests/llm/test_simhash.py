import random

import numpy as np
import xxhash

from recordmill.llm import components, simhash


def plain(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", words)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint():
    for text in [None, "", " \t", "One", "one two", "A b C", "É x\x1cy z\x85w", "a b c d e f a b c", "w " * 500]:
        assert simhash.fingerprint(text) == plain(text)


def classes(fps, ids, radius=2):
    f = np.array(fps, np.uint64)
    near = np.bitwise_count(f[:, None] ^ f) <= radius
    label = np.array(ids)
    while True:
        new = np.where(near, label, 1 << 60).min(1)
        if (new == label).all():
            return label.tolist()
        label = new


def test_links_of_clustered_fingerprints(spark, monkeypatch):
    random.seed(7)
    fps = {random.getrandbits(64) for _ in range(300)}
    for base in list(fps)[:20]:
        for _ in range(12):
            base ^= 1 << random.randrange(64)
            fps.add(base)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    found = {r.node: r.component for r in components.components(simhash.links(df, tile=4)).collect()}
    label = classes(fps, range(len(fps)))
    groups: dict[int, set] = {}
    for s, g in zip(signed, label, strict=True):
        groups.setdefault(g, set()).add(found.get(s, s))
    assert all(len(x) == 1 for x in groups.values()) and len({next(iter(x)) for x in groups.values()}) == len(groups)


def test_near_duplicates_equal_brute_force(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    rows = simhash.near_duplicates(df).orderBy("doc_id").collect()
    texts = [r.text for r in df.orderBy("doc_id").collect()]
    assert [int(r.fingerprint, 16) for r in rows] == [plain(t) for t in texts]
    assert [r.component_id for r in rows] == classes([plain(t) for t in texts], [r.doc_id for r in rows])


def test_nulls_repeats_and_empty_tables(spark):
    df = spark.createDataFrame([(3, None, "a"), (2, "", "b"), (None, " ", "c"), (7, "x y z w", "d"), (7, "x y z w", "e")], "doc_id long, text string, fp string")
    rows = simhash.near_duplicates(df).collect()
    assert sorted(r.component_id for r in rows) == [2, 2, 2, 7, 7] and all(len(r.fingerprint) == 16 for r in rows)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (5, 5), (None, 3), (4, 3), (20, 21), (21, 22), (22, 23), (23, 24), (24, 25)]
    df = spark.createDataFrame(links, "u long, v long")
    assert {r.node: r.component for r in components.components(df).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8, **{n: 20 for n in range(20, 26)}}


def test_close_finds_every_pair():
    random.seed(5)
    left = np.array([random.getrandbits(64) for _ in range(300)], np.uint64)
    right = np.concatenate([left ^ np.uint64(1 << 9), np.array([0, 2**64 - 1], np.uint64)])
    for radius in (0, 2, 20, 64):
        found = {(int(a), int(b)) for i, j in simhash.close(left, right, radius, 16) for a, b in zip(i, j, strict=True)}
        assert found == {(a, b) for a in range(len(left)) for b in range(len(right)) if (int(left[a]) ^ int(right[b])).bit_count() <= radius}

import random

import numpy as np
from pyspark.sql import functions as F

from recordmill.llm import similar

from .test_pipeline import by_id, stages  # noqa: F401


def plain(text, words=5):
    w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()]
    return frozenset(b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()


def groups(texts):
    """The smallest place that links of Jaccard 0.8 or more reach, for each text."""
    sets = [plain(t) for t in texts]
    root = list(range(len(sets)))

    def of(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] or both and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((of(a), of(b)))
                root[y] = x
    return [of(x) for x in range(len(sets))]


def survivors(rows):
    """The rows (key, text) of least key of each group, in order of keys."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    return [r for n, (r, g) in enumerate(zip(rows, groups([t for _, t in rows]), strict=True)) if n == g]


def test_documents_equal_brute_force(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    kept = similar.drop_similar(df)
    want = survivors([tuple(r) for r in df.collect()])
    assert sorted(tuple(r) for r in kept.collect()) == want and len(want) < df.count()


def test_chains_and_borders_equal_brute_force(spark, monkeypatch):
    random.seed(3)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(12):
        now = [random.choice(words) for _ in range(random.randrange(5, 90))]
        for _ in range(8):  # edits on both sides of 0.8, some of them in chains
            rows.append((len(rows), " ".join(now)))
            edited = list(now)
            for _ in range(random.randrange(0, 3)):
                edited[random.randrange(len(edited))] = random.choice(words)
            now = edited if random.random() < 0.7 else now
    common_line = " ".join(words[:40])
    rows += [(len(rows) + i, f"{common_line} {random.choice(words)} {random.choice(words)} {i}") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = survivors(rows)
    assert 12 < len(want) < len(rows)
    assert sorted(tuple(r) for r in similar.drop_similar(df).collect()) == want
    # Pairs alone give the same, in tiles of a few nodes too.
    monkeypatch.setattr(similar, "_with_leaders", lambda tokens, nodes: tokens.select(F.col("node").alias("u"), F.col("node").alias("v")).limit(0))
    monkeypatch.setattr(similar, "TILE", 4)
    assert sorted(tuple(r) for r in similar.drop_similar(df).collect()) == want


def test_different_texts_under_one_key_stay(spark):
    x, y, p, q, r, s = (" ".join(f"{c}{i}" for i in range(60)) for c in "xypqrs")
    rows = [(3, x), (5, x + " more"), (5, y), (7, p), (7, q), (None, r), (None, s), (None, s), (8, None), (9, " \t")]
    kept = similar.drop_similar(spark.createDataFrame(rows, "doc_id long, text string"))
    order = lambda t: (t[0] is None, t[0] or 0, t[1] or "")
    assert sorted((tuple(t) for t in kept.collect()), key=order) == sorted([(3, x), (5, y), (7, p), (7, q), (None, r), (None, s), (8, None)], key=order)
    assert similar.drop_similar(kept.limit(0)).count() == 0


def test_pipeline_drops_texts_of_similarity(stages):  # noqa: F811
    before = [(r.doc_id, r.text) for r in by_id(stages[2]).values()]
    assert sorted(by_id(stages[3])) == [k for k, _ in survivors(before)]


def test_pieces_list_every_close_pair_of_large_groups():
    random.seed(1)
    n = 300
    columns = {"h": np.repeat([1, 2, 2, 2], n), "low": np.repeat([0, 0, 0, 1], n), "high": np.repeat([0, 0, 1, 1], n), "tile": np.zeros(4 * n, np.int64)}
    columns["tile"][2 * n + n // 2 :] = 1
    columns |= {"node": np.concatenate([np.arange(n)] * 4), "part": np.concatenate([np.arange(n)] * 4), "_size": np.full(4 * n, 100), **{c: np.zeros(4 * n, np.int64) for c in similar.MAPS}}
    columns["_fp"] = np.array([random.getrandbits(64) for _ in range(n)] * 4, np.uint64).view(np.int64)
    u, v = similar._listed(columns)
    fp = columns["_fp"].view(np.uint64)
    near = {(a, b) for a in range(n) for b in range(a + 1, n) if (int(fp[a]) ^ int(fp[b])).bit_count() <= similar.RADIUS}
    assert set(zip(u.tolist(), v.tolist(), strict=True)) == near


def test_parity_maps_bound_the_difference():
    rng = np.random.default_rng(3)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 300, 200).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(2))
        differ = int(np.bitwise_count(similar.parity(a).view(np.uint64) ^ similar.parity(b).view(np.uint64)).sum())
        assert differ <= len(np.setxor1d(a, b))


def test_texts_of_one_mould_make_few_pairs(spark):
    """Texts that share much and are less similar than 4/5: a pair of them is hardly ever listed, and links are still found."""
    random.seed(5)
    words = [f"w{i}" for i in range(5000)]
    base = [random.choice(words) for _ in range(400)]
    rows = []
    for n in range(120):
        now = list(base)
        for at in range(3 + n % 3, 400, 34):  # a dozen words, some 60 of 396 shingles: similarity 0.74 to each other
            now[at] = random.choice(words)
        rows.append((n, " ".join(now)))
        if n % 10 == 0:  # a near copy that only its own text is like
            rows.append((1000 + n, " ".join([*now[:-2], "other", "end"])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(tuple(r) for r in similar.drop_similar(df).collect()) == survivors(rows)
    marked = similar.marks(df)
    nodes = marked.select(F.col("_row").alias("node"), "_size", "_fp", *similar.MAPS)
    tokens = similar._told_apart(similar._tokens(marked, nodes))
    none = tokens.select(F.col("node").alias("u"), F.col("node").alias("v")).limit(0)
    listed = {tuple(r) for r in similar._left_over(tokens, none, marked).collect()}
    sets = {r._row: plain(t) for r, (_, t) in zip(sorted(marked.select("_row", "_in_0").collect(), key=lambda r: r._in_0), sorted(rows), strict=True)}
    near = {(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    assert near <= listed and len(listed) < len(near) + len(rows)
    forest = {tuple(r) for r in similar._left_over(tokens, none, marked, similar._forests).collect()}
    assert forest <= listed


def test_shingles_of_the_same_nodes_are_one(spark):
    tokens = spark.createDataFrame([(h, n) for h, ns in {1: (1, 2), 2: (2, 1), 3: (1, 2, 3), 4: (1, 3), 5: (3, 2, 1)}.items() for n in ns], "h long, node long")
    assert sorted(tuple(r) for r in similar._told_apart(tokens).collect()) == [(1, 1), (1, 2), (3, 1), (3, 2), (3, 3), (4, 1), (4, 3)]


def test_maps_of_any_width_bound_the_difference():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, k, k).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(7)) for k in (3, 150, 300, 320, 900, 5000)]
    maps = np.array([similar.wide(s) for s in sets], object)
    assert {len(m) * 8 for m in maps} >= {256, 512, similar.WIDEST}
    left, right = (x.ravel() for x in np.meshgrid(range(len(sets)), range(len(sets))))
    for a, b, n in zip(left, right, similar._apart(left, right, maps), strict=True):
        assert n <= len(np.setxor1d(sets[a], sets[b])) and (a != b or n == 0)

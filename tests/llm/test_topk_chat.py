import random

import numpy as np
from pyspark.sql import functions as F

from recordmill.llm import chat, topk


def brute(rows, is_query, k):
    ok = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in sorted({(i, tuple(v)) for i, v in ok if is_query(i)}):
        found = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in ok if i != q and len(w) == len(v)))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found[:k])]
    return sorted(out)


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "QUERIES", 3)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 0.2, 8).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(9)] + [(2000, [0.0] * 8), (2050, [0.0] * 8), (2001, None), (2002, []), (2003, [None] * 8), (2004, [float("nan")] * 8), (None, [1.0] * 8), (2100, [0.1, 0.2]), (2101, [0.3, 0.1]), (3, rows[3][1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute(rows, lambda i: i % 50 == 0, 5)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.top_k(df.where("vec_id in (2100, 2101)"), F.col("vec_id") % 50 == 0).count() == 1


def brute_best(vectors, query, own, k=5):
    return sorted(((int(v @ query), i) for i, v in enumerate(vectors) if i not in own), key=lambda x: (-x[0], x[1]))[:k]


def test_reading_stops_early_where_bounds_allow():
    rng = np.random.default_rng(1)
    vectors = (rng.pareto(1.2, (4000, 3)) * 20).astype(np.int64)
    lists, read = topk.Lists(vectors), {}
    queries = np.array([[3, 1, 2], [1, -1, 0], [0, 0, 0]])
    got = lists.best(queries, [np.array([0]), np.array([5]), np.array([], int)], np.arange(4000), 5, read)
    assert got[0] == brute_best(vectors, queries[0], {0}) and got[1] == brute_best(vectors, queries[1], {5}) and got[2] == [(0, i) for i in range(5)]
    one = {}
    lists.best(queries[:1], [np.array([0])], np.arange(4000), 5, one)
    assert one["depth"] < 0.7 and one["direct"] <= topk.FINALISTS * 5 / 4000


def test_flat_data_is_read_to_the_end_and_exact():
    """Components of one size: the bounds close late, and still few scores are computed directly."""
    rng = np.random.default_rng(2)
    vectors = rng.integers(-60, 60, (3000, 48))
    queries = vectors[:40]
    read = {}
    got = topk.Lists(vectors).best(queries, [np.array([i]) for i in range(40)], np.arange(3000), 5, read)
    assert got == [brute_best(vectors, q, {i}) for i, q in enumerate(queries)]
    assert read["direct"] / read["queries"] < 0.02


def test_equal_vectors_and_small_blocks():
    vectors = np.array([[2, -1]] * 70 + [[1, 1]])
    assert topk.Lists(vectors).best(np.array([[1, 1]]), [np.array([70])], np.arange(71)[::-1], 3)[0] == [(1, 69), (1, 68), (1, 67)]
    assert topk.Lists(vectors[:2]).best(np.array([[1, 1]]), [np.array([0])], np.arange(2), 3)[0] == [(1, 1)]


def test_large_components_stay_exact():
    vectors = np.array([[2**40, 1], [2**40, 2], [2**40, 3]], np.int64)
    assert [p for _, p in topk.Lists(vectors).best(np.array([[2**40, 1]]), [np.zeros(0, np.int64)], np.arange(3), 2)[0]] == [2, 1]


def test_a_repeated_query_key_gets_one_list(spark):
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (1, [3.0, 0.0]), (2, [0.0, 2.0]), (3, [0.1, 0.1])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, k=2).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in got] == [(50, 1, 1, 768 * 256), (50, 2, 2, 512 * 256)]


def render(turns, perspective):
    out = ""
    masks = []
    for _, speaker, text in turns:
        own = speaker == perspective
        role = "system" if speaker == "system" else "assistant" if own else "user"
        head = f"<|{role}{f' name={speaker}' if role == 'user' else ''}|>\n"
        start = len(out)
        out += head + text + "<|end|>\n"
        masks.append((start, len(out), start + len(head) if own else None, len(out) - 1 if own else None))
    return out, masks


def test_every_perspective(spark):
    random.seed(2)
    rows = []
    for conv in range(12):
        people = ["anna", "bob", "system", "é"][: 2 + conv % 3]
        rows += [(conv, t, random.choice(people), "x" * random.randrange(9)) for t in range(random.randrange(1, 40))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got: dict = {}
    for r in chat.perspectives(df).orderBy("conv_id", "perspective", "start").collect():
        got.setdefault((r.conv_id, r.perspective), []).append(r)
    for conv in range(12):
        turns = [r[1:] for r in rows if r[0] == conv]
        for person in {s for _, s, _ in turns} - {"system"}:
            text, masks = render(turns, person)
            mine = got.pop((conv, person))
            assert "".join(r.segment for r in mine) == text
            assert [(r.start, r.end, r.mask_start, r.mask_end) for r in mine] == masks
    assert not got


def test_odd_conversations(spark):
    rows = [(None, 0, None, None, "n"), (None, None, "a", "", "n"), (1, 0, "system", "only", "n"), (2, 0, "a", "same", "n"), (2, 0, "a", "same", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, name string")
    out = chat.perspectives(df).collect()
    assert {(r.conv_id, r.perspective) for r in out} == {(None, "unknown"), (None, "a"), (2, "a")} and len(out) == 6
    two = sorted((r.start, r.end) for r in out if r.conv_id == 2)
    assert two[0][1] == two[1][0]
    assert chat.perspectives(df.limit(0)).count() == 0


def test_turns_of_one_number_and_speaker_go_by_text(spark):
    texts = ["nut", "lime", "fig", "kiwi", "pear", "apple"]
    df = spark.createDataFrame([(1, 4, "a", t) for t in texts], "conv_id long, turn long, role string, text string").repartition(3)
    rows = chat.perspectives(df).orderBy("start").collect()
    assert [r.segment.split("\n")[1].removesuffix("<|end|>") for r in rows] == sorted(texts)


def test_a_very_long_turn_and_a_hot_conversation(spark):
    rows = [(1, 0, "a", "x" * 200_000), (1, 1, "b", "y")] + [(2, t, "ab"[t % 2], str(t)) for t in range(400)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    out = {(r.conv_id, r.perspective, r.turn): r for r in chat.perspectives(df).collect()}
    assert len(out) == 804 and out[1, "b", 1].start == out[1, "b", 0].end > 200_000
    assert all(out[2, "a", t].end == out[2, "a", t + 1].start for t in range(399))

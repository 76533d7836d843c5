import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from recordmill.llm import repetition, suffix_dedup, suffixes


def test_difference_cover():
    cover = suffixes.COVER
    assert {(a - b) % suffixes.MODULUS for a in cover for b in cover} == set(range(suffixes.MODULUS))


def test_sorted_suffixes_equal_plain_sorting():
    rng = np.random.default_rng(0)
    block = rng.integers(97, 99, 3000).astype(np.uint8)
    block[1000:1400] = block[200:600]
    block[2000:2300] = 97
    depth = 60
    at = rng.permutation(len(block) - 200)[:2000]
    bucket = at % 3
    order = suffixes.sorted_suffixes(block, at, bucket, depth)
    raw = block.tobytes()
    got = [(bucket[i], raw[at[i] : at[i] + depth]) for i in order]
    assert got == sorted(got)
    label = suffixes.equal_runs(block, at, bucket, order, depth)
    assert [a == b for a, b in zip(got, got[1:], strict=False)] == [a == b for a, b in zip(label, label[1:], strict=False)]


def brute(docs, length=100):
    seen, out = set(), []
    for doc_id, text in docs:
        data = (text or "").encode()
        mask = bytearray(len(data))
        for k in range(len(data) - length + 1):
            window = data[k : k + length]
            if window in seen:
                mask[k : k + length] = b"\1" * length
            seen.add(window)
        kept = bytes(b for b, m in zip(data, mask, strict=True) if not m)
        spans = sum(1 for k in range(len(mask)) if mask[k] and (k == 0 or not mask[k - 1]))
        out.append((doc_id, len(data), sum(mask), spans, hashlib.sha256(kept).hexdigest()))
    return out


def made(seed):
    random.seed(seed)
    word = lambda n=6: "".join(random.choice("abcdeé ") for _ in range(n))
    passage = [word(80) + word(180) for _ in range(3)]
    docs = [(i, word(random.randrange(400))) for i in range(40)]
    docs += [(100 + i, word(i % 7) + passage[i % 3] + word(i % 5) + passage[(i + 1) % 3][: 90 + i]) for i in range(60)]
    docs += [(300 + i, docs[50][1]) for i in range(5)] + [(400, "x" * 700), (401, "x" * 99), (402, "x" * 100), (403, "ab" * 300), (404, ""), (405, None)]
    long = word(30_000)
    return docs + [(500, long), (501, long[5000:] + word(50))]


def test_dedup_equals_brute_force(spark, monkeypatch):
    docs = made(1)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted(tuple(r) for r in suffix_dedup.digest(df).collect())
    assert got == brute(docs)
    monkeypatch.setattr(suffix_dedup, "BUCKET", 3)  # large buckets are split into parts
    monkeypatch.setattr(suffix_dedup, "BLOCK", 5000)
    assert sorted(tuple(r) for r in suffix_dedup.digest(df).collect()) == got


def test_a_passage_in_most_texts_is_split_over_tasks(spark, monkeypatch):
    random.seed(9)
    word = lambda n: "".join(random.choice("abcdefgh ") for _ in range(n))
    passage, letter = word(260), word(180)
    docs = [(i, word(random.randrange(60)) + passage + word(random.randrange(90))) for i in range(250)] + [(1000 + i, letter) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(suffix_dedup, "BUCKET", 50)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 20_000)
    assert sorted(tuple(r) for r in suffix_dedup.digest(df).collect()) == brute(docs)


def test_text_keys_go_in_their_order(spark):
    text = "".join(random.Random(4).choices("abcdef", k=150))
    got = suffix_dedup.digest(spark.createDataFrame([("b", text), ("a10", text), ("a9", text)], "doc_id string, text string")).collect()
    assert {r.doc_id: r.n_removed for r in got} == {"a10": 0, "a9": 150, "b": 150}


def test_dedup_of_repeated_and_null_keys(spark):
    text = "".join(random.Random(4).choices("abcdef", k=300))
    docs = [(1, text), (1, text), (None, text), (0, "q" + text)]
    got = suffix_dedup.digest(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in got) == [(False, 0, 0), (False, 1, 300), (False, 1, 300), (True, 0, 300)]
    assert suffix_dedup.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_remove_repeats_keeps_columns_and_characters(spark):
    text = "é" * 10 + "".join(random.Random(4).choices("abcdef", k=300)) + "é"
    df = spark.createDataFrame([(1, text, 7), (2, "xé" + text[9:] + "tail", 8), (3, text, 9), (4, None, 1), (5, "", 2)], "doc_id long, text string, row int")
    out = {r.doc_id: r for r in suffix_dedup.remove_repeats(df).collect()}
    assert out[1].text == text and out[2].text.endswith("tail") and len(out[2].text) < 20 and 3 not in out
    assert out[4].text is None and out[5].text == "" and out[2].row == 8


def repeats(words, length):
    count = Counter(tuple(words[i : i + length]) for i in range(len(words) - length + 1))
    mask = [0] * len(words)
    for i in range(len(words) - length + 1):
        if count[tuple(words[i : i + length])] > 1:
            mask[i : i + length] = [1] * length
    longest = next((n for n in range(len(words) - 1, 0, -1) if max(Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1)).values()) > 1), 0)
    return sum(mask), longest if longest >= length else 0


def test_repetition_equals_brute_force():
    random.seed(1)
    docs = [[bytes([97 + random.randrange(2)]) for _ in range(random.randrange(60))] for _ in range(150)] + [[b"x"] * 50, [], [b"a"] * 8, [b"a"] * 9]
    for least in (3, 8):
        results, spans = repetition.measure(docs, least)
        for words, r, s in zip(docs, results, spans, strict=True):
            assert (r.words, r.covered, r.longest) == (len(words), *repeats(words, least))
            assert sum(n for _, n in s) == r.covered


def test_repetition_columns(spark):
    line = "one two three four five six seven eight nine ten"
    df = spark.createDataFrame([(1, f"{line}\n{line}", 3), (None, None, 3), (2, "", 3)], "doc_id long, text string, n_words int")
    out = {r.text: r for r in repetition.repetition(df).collect()}
    assert out[f"{line}\n{line}"].covered_words == 20 and not out[f"{line}\n{line}"].repetition_ok and out[None].n_words == 0
    rules = {r.n_words: r for r in repetition.rules(df).collect()}
    assert rules[20].n_dup_lines == 1 and rules[20].n_repeat_words == 20 and rules[20].base_failed and rules[0].base_failed
    assert repetition.rules(df.limit(0)).count() == 0
    many = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(400)) + (" " + " ".join(f"r{i}" for i in range(61))) * 2)], "doc_id long, text string")
    row = repetition.rules(many.withColumn("text", F.col("text"))).first()
    assert not row.base_failed and not row.kept  # 122 of 522 words are covered, but one repeat is too long


def test_windows_of_anchors_met_by_chance_are_not_sorted(monkeypatch):
    """Runs that share an anchor and little else never reach the sort; each window that is met again does."""
    rng = np.random.default_rng(7)
    texts = []
    for n in range(60):
        own = lambda k: rng.integers(97, 123, k).astype(np.uint8)  # noqa: E731, B023
        texts.append(np.concatenate([own(200), np.frombuffer(b"the very same 16 bytes and more.", np.uint8), own(200)]).tobytes())
    shared = rng.integers(97, 123, 130).astype(np.uint8).tobytes()
    texts[10] = texts[10][:150] + shared + texts[10][150:]
    texts[40] = texts[40][:90] + shared + texts[40][90:]
    texts[50] = texts[20][100:330]
    ends = np.cumsum([len(t) for t in texts])
    joined = b"".join(texts)
    h, doc, at, n = suffix_dedup.runs(np.frombuffer(joined, np.uint8), ends - [len(t) for t in texts], ends)
    rows = [(int(h[i].view(np.int64)), int(doc[i]), int(at[i] - (ends[doc[i]] - len(texts[doc[i]]))), int(n[i]), joined[at[i] : at[i] + n[i] + 99]) for i in range(len(h))]
    batch = pa.RecordBatch.from_pylist([dict(zip(("h", "row", "start", "n", "run"), r, strict=True)) for r in sorted(rows)])
    sorted_ = []
    monkeypatch.setattr(suffix_dedup, "sorted_suffixes", lambda block, at, *rest: sorted_.append(len(at)) or suffixes.sorted_suffixes(block, at, *rest))
    spans = lambda: {(r, i) for b in suffix_dedup._sort_blocks(iter([batch])) for r, a, e in zip(*[c.to_pylist() for c in b.columns], strict=True) for i in range(a, e - 99)}
    found, total = spans(), sum(sorted_)
    seen, want, times = {}, set(), {}
    for r, t in enumerate(texts):
        for i in range(len(t) - 99):
            times[t[i : i + 100]] = times.get(t[i : i + 100], 0) + 1
            if seen.setdefault(t[i : i + 100], (r, i)) != (r, i):
                want.add((r, i))
    assert found == want and len(want) == 31 + 131
    repeated = sum(k for k in times.values() if k > 1)
    met = sum(r[3] for r in rows if sum(q[0] == r[0] for q in rows) > 1)
    assert repeated <= total < (repeated + met) / 2
    for size in (1, 5000, len(joined)):  # blocks that end with a bucket, and with the last one
        monkeypatch.setattr(suffix_dedup, "BLOCK", size)
        assert spans() == want

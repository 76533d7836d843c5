import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from recordmill.llm import bpe, packing

ODD = [
    "", "a", "  ", "a  b", "a   b \n c", " x", "x ", "<|endoftext|>hi <|endoftext|>", "it's 's 12 ½²x", "x" * 1000 + "ab" * 600, "日本語 テキスト x  y", "a\n \nfoo", "a\t b", "é \x1c \x1cz",
    "don't  stop", "\n\n y\r\n", " \nfoo", "aé" * 900, "İ  x", "é é",
]


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(bpe.default_vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


def test_codec_equals_the_library(reference, spark, small):
    texts = ODD + [r[0] for r in spark.read.parquet(f"{small}/documents.parquet").where("doc_id % 10 = 1").select("text").collect()]
    random.seed(5)
    texts += ["".join(random.choice("ab .,'\n\té日½1") for _ in range(random.randrange(60))) for _ in range(200)]
    codec = bpe.Codec(bpe.default_vocabulary())
    for text, encoded in zip(texts, codec.encode_many(texts), strict=True):
        ids = reference.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoded, "<u4").tolist() == ids
        assert np.frombuffer(packing.token_ids(bpe.default_vocabulary(), text), "<u4").tolist() == ids
        assert codec.decode(ids) == reference.decode(ids, skip_special_tokens=False)


def test_digests_equal_the_library_on_every_document(reference, spark, small):
    from hashlib import sha256

    df = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    df = df.unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "x" * 300_000), (-4, "\u00e9 " * 40_000), (7, "again")], df.schema))
    digest = lambda text: sha256(text.encode()).hexdigest()
    want = []
    for r in df.collect():
        ids = reference.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), digest(",".join(map(str, ids))), digest(reference.decode(ids, skip_special_tokens=False))))
    assert sorted(tuple(r) for r in bpe.digest(df).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()) == sorted(want)


def test_short_and_long_merges_agree():
    codec = bpe.Codec(bpe.default_vocabulary())
    random.seed(2)
    words = [bytes(random.choice(b"theanding") for _ in range(n)) for n in range(1, 41) for _ in range(5)]
    for word, ids in zip(words, codec.merge_words(words), strict=True):
        assert ids.tolist() == bpe.merge_long(codec.table.pairs, codec.byte_ids[np.frombuffer(word, np.uint8)].tolist())


def test_encode_decode_columns(spark):
    df = spark.createDataFrame([(1, "héllo", [9]), (1, None, None), (None, "", [])], "doc_id long, text string, ids array<int>")
    out = bpe.decode(bpe.encode(df)).orderBy("text").collect()
    assert [(r.text, r.decoded) for r in out] == [(None, ""), ("", ""), ("héllo", "héllo")]
    assert out[0].ids == [] and len(out[2].ids) > 1
    assert bpe.digest(df.limit(0)).count() == 0
    assert bpe.digest(df).count() == 3


def test_plan_packs_every_length_once():
    random.seed(3)
    for capacity in (10, 50):
        counts = {n: random.randrange(0, 40) for n in range(1, capacity + 1)}
        counts = {n: c for n, c in counts.items() if c}
        plan = packing.best_two_fit(dict(counts), capacity)
        used: dict[int, int] = {}
        for taken, times in plan:
            assert sum(taken) <= capacity
            for n in taken:
                used[n] = used.get(n, 0) + times
        assert used == counts
        bins = sum(t for _, t in plan)
        gaps: list[int] = []  # first fit, longest first
        for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
            i = next((i for i, g in enumerate(gaps) if g >= n), None)
            gaps.append(capacity - n) if i is None else gaps.__setitem__(i, gaps[i] - n)
        assert bins <= len(gaps) + 1


def test_two_smaller_ones_replace_a_smaller_piece():
    assert packing.best_two_fit({7: 1, 2: 2, 1: 0}, 10)[0] == ([7, 2], 1)
    # 6 + 3 leaves 1; the two of 2 fill the gap of 4 wholly
    assert packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10)[0] == ([6, 2, 2], 1)


def test_pack(spark, small, reference):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", F.lit(1).alias("rank"), F.lit(2).alias("length"))
    docs = docs.unionByName(spark.createDataFrame([(None, None, 0, 0), (5000, "", 0, 0), (5001, "ab " * 9000, 0, 0), (5001, "ab " * 9000, 0, 0)], docs.schema))
    rows = packing.pack(docs).collect()
    want = []
    for doc_id, text, *_ in docs.collect():
        ids = [*reference.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want.append((doc_id, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted([tuple(r[:5]) for r in rows], key=key) == sorted(want, key=key)
    bins: dict[int, list] = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= 1.01 * -(-sum(r.length for r in rows) // 2048) + 1
    assert packing.pack(docs.limit(0)).count() == 0

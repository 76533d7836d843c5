import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordmill.llm import language, quality, registry, toxicity

BIGGER = "/root/testdata/sf0.01"


def test_gram_vectors_are_bound_and_bundled():
    space = language.Space(256)
    a, b, c = (space.letter(ord(x)).astype(int) for x in "abc")
    keys, counts = space.grams("ABC, abc!")
    assert counts.sum() == 7  # " abc abc " has seven windows of three
    word = np.roll(a, 2) * np.roll(b, 1) * c
    space_vector = space.letter(32).astype(int)
    want = 2 * word + 2 * np.roll(space_vector, 2) * np.roll(a, 1) * b + 2 * np.roll(b, 2) * np.roll(c, 1) * space_vector + np.roll(c, 2) * np.roll(space_vector, 1) * a
    assert (space.vector("ABC, abc!") == want).all()
    assert space.vector("12 !") is None and language.Space(256).vector("") is None


def test_language_on_held_out_documents(spark):
    rows = registry.op4_language_id(spark, BIGGER).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{BIGGER}/documents.parquet").collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and {r.doc_id for r in held} == {d for d in truth if zlib.crc32(str(d).encode()) % 4 == 2}
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.98 and all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_rows(spark):
    train = spark.createDataFrame([(i, "the cat and the hat on the mat", "en", "s") for i in range(4)] + [(10 + i, "der hund und die katze auf dem dach", "de", "s") for i in range(4)] + [(None, None, None, None)], "doc_id long, text string, lang string, score string")
    model = language.fit(train, F.lit(True))
    out = {r.text: r for r in language.predict(train.unionByName(spark.createDataFrame([(1, "123", None, None), (2, "", None, None)], train.schema)), model).collect()}
    assert list(model) == ["de", "en"] and out[None].lang_pred == "und" and out["123"].lang_pred == "und" and out["the cat and the hat on the mat"].lang_pred == "en"
    assert language.predict(train.limit(1), {}).first().lang_pred == "und" and language.fit(train.limit(0), F.lit(True)) == {}


def plain_bundle(text, dimensions=language.DIMENSIONS):
    space = language.Space(dimensions)
    letters = [ord(c) for c in " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())]
    letters = [32, *letters, 32]
    out = np.zeros(dimensions)
    for i in range(len(letters) - 2):
        one = np.ones(dimensions)
        for k in range(3):
            one = one * np.roll(space.letter(letters[i + k]).astype(float), 2 - k)
        out += one
    return out


def test_predictions_equal_plain_bundles(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet").where("length(text) < 1500").limit(30)
    texts = {r.doc_id: r for r in df.collect()}
    model = language.fit(df, F.col("doc_id") % 2 == 0)
    prototypes: dict = {}
    for r in texts.values():
        if r.doc_id % 2 == 0:
            prototypes[r.lang] = prototypes.get(r.lang, 0) + plain_bundle(r.text)
    assert sorted(model) == sorted(prototypes)
    for r in language.predict(df, model).collect():
        v = plain_bundle(r.text)
        cosines = {k: float(v @ p / np.linalg.norm(v) / np.linalg.norm(p)) for k, p in prototypes.items()}
        assert r.lang_pred == max(sorted(cosines), key=cosines.get) and r.score == pytest.approx(max(cosines.values()), abs=1e-4)


def test_language_of_long_texts_ties_and_many_languages(spark, monkeypatch):
    space = language.Space(64)
    text = "".join(random.Random(3).choices([chr(c) for c in range(0x4E00, 0x4E00 + 3000)], k=30_000))
    whole = space.vector(text)
    monkeypatch.setattr(language, "TABLE", 5000)
    monkeypatch.setattr(language, "CHUNK", 500)
    small = language.Space(64)
    assert (small.vector(text) == whole).all() and len(small.rows) <= 5000
    rows = [(i, f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}", f"l{i}") for i in range(1300)] + [(5000, "same words", "za"), (5001, "same words", "zb")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df, F.lit(True))
    assert len(model) == 1302
    monkeypatch.setattr(language, "BLOCK", 100)
    assert language.predict(df.where("doc_id = 5001"), model).first().lang_pred == "za"  # equal cosines go to the first name
    assert language.predict(df.limit(0), model).count() == 0


def test_toxicity_scores_equal_plain_sums(spark, small):
    """The query's scores: sums of weights over distinct hashes of words, stems, pairs and skip pairs."""
    df = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    model = toxicity.fit(df, spark.read.parquet(f"{small}/labels.parquet"), F.lit(True))
    weights = dict(zip(model.index.tolist(), model.weight.tolist(), strict=True))
    mask, mix = (1 << 64) - 1, lambda x: ((x ^ x >> 31) * int(toxicity._A) & ((1 << 64) - 1)) >> 64 - toxicity.BITS
    a, b, c = int(toxicity._A), int(toxicity._B), int(toxicity._C)

    def plain(text):
        words = "".join(x.lower() if "A" <= x <= "Z" else x if x.isalnum() or ord(x) > 127 else " " for x in text).encode().split(b" ")
        words = [w for w in words if w]
        h = [zlib.crc32(w) + 1 for w in words]
        seen = {mix(x * a & mask) for x in h} | {mix((zlib.crc32(w[:n]) * b + n) & mask) for w in words for n in toxicity.STEMS if len(w) > n}
        seen |= {mix((x * b & mask) ^ (y * c + 1 & mask)) for x, y in zip(h, h[1:], strict=False)} | {mix((x * c & mask) ^ (y * b + 2 & mask)) for x, y in zip(h, h[2:], strict=False)}
        return 1 / (1 + np.exp(-(sum(weights.get(i, 0.0) for i in seen) + model.bias)))

    rows = toxicity.score(df.unionByName(df.limit(3)), model).collect()
    assert weights and all(r.score == pytest.approx(plain(r.text or ""), abs=1e-5) for r in rows) and len(rows) == df.count() + 3
    long = spark.createDataFrame([(1, (df.first().text + " ") * 3000)], df.schema)
    assert 0 <= toxicity.score(long, model).first().score <= 1


def plain_ftrl(features, labels, epochs):
    z, n, w = {}, {}, {}
    bias = "bias"

    def weight(i):
        free = 0 if i == bias else toxicity.L1
        zi = z.get(i, 0.0)
        if abs(zi) <= free:
            return 0.0
        return -(zi - np.sign(zi) * free) / ((toxicity.BETA + n.get(i, 0.0) ** 0.5) / toxicity.ALPHA + toxicity.L2)

    for _ in range(epochs):
        for x, y in zip(features, labels, strict=True):
            items = [*x, bias]
            w = {i: weight(i) for i in items}
            g = 1 / (1 + np.exp(-sum(w.values()))) - y
            for i in items:
                old = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - ((old + g * g) ** 0.5 - old**0.5) / toxicity.ALPHA * w[i]
                n[i] = old + g * g
    return {i: weight(i) for i in z if i != bias and weight(i)}, weight(bias)


def test_ftrl_equals_plain_updates():
    rng = random.Random(3)
    features = [np.array(sorted(rng.sample(range(50), 8))) for _ in range(300)]
    labels = [int(7 in f.tolist()) for f in features]
    model = toxicity.ftrl(features, labels, 2)
    weights, bias = plain_ftrl([f.tolist() for f in features], labels, 2)
    assert model.bias == pytest.approx(bias) and dict(zip(model.index.tolist(), model.weight.tolist(), strict=True)) == pytest.approx(weights, rel=1e-5)
    assert 7 in weights and len(weights) < 50


def test_toxicity_on_held_out_documents(spark, small):
    big = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in registry.op5_toxicity(spark, big).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{big}/labels.parquet").collect()}
    held = [(rows[d], y) for d, y in labels.items() if rows[d].held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r, _ in held)
    found, wrong = sum(r.predicted for r, y in held if y), sum(r.predicted for r, y in held if not y)
    assert found > 0.8 * sum(y for _, y in held) and wrong <= 0.02 * len(held)


def test_toxicity_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, "you idiot", 5), (2, "hello", 5), (3, None, 5), (4, "", 5), (None, "x", 5)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    out = toxicity.score(docs, toxicity.fit(docs, labels, F.lit(True))).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out) and out[2].score == out[3].score
    assert toxicity.score(docs, toxicity.fit(docs, labels.limit(0), F.lit(True))).where("score = 0.5").count() == 5
    assert toxicity.score(docs.limit(0), toxicity.Model(np.zeros(0, np.int64), np.zeros(0, np.float32), 0.0)).count() == 0


def test_quality_keeps_clean_documents(spark):
    rows = registry.op10_quality_classifier(spark, BIGGER).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{BIGGER}/labels.parquet").collect()}
    assert len(rows) == 1000
    good = [r.kept for r in rows if labels.get(r.doc_id) == 1]
    bad = [r.kept for r in rows if labels.get(r.doc_id) == 0]
    assert sum(good) / len(good) > 0.99 and sum(bad) / len(bad) < 0.1


def plain_posteriors(rows, rate, k_host, k_path):
    """Quality of (host, path, logit) rows, by loops."""
    chance = lambda x: 1 / (1 + np.exp(-x))
    out = []
    for i, (h, p, x) in enumerate(rows):
        hosts = [chance(y) for j, (a, _, y) in enumerate(rows) if a == h and j != i]
        paths = [chance(y) for j, (a, b, y) in enumerate(rows) if (a, b) == (h, p) and j != i]
        host = min(max((sum(hosts) + k_host * rate) / (len(hosts) + k_host), 1e-6), 1 - 1e-6)
        path = min(max((sum(paths) + k_path * host) / (len(paths) + k_path), 1e-6), 1 - 1e-6)
        out.append(chance(x + np.log(path / (1 - path)) - np.log(rate / (1 - rate))))
    return out


def test_sites_change_verdicts_as_plain_sums_do(spark, monkeypatch):
    rng = random.Random(8)
    rows = [("good.org", f"p{i % 3}", 3 + rng.random()) for i in range(120)] + [("bad.org", f"p{i % 3}", -3 - rng.random()) for i in range(120)]
    rows += [("good.org", "p0", -0.4), ("bad.org", "p0", 0.4), ("good.org", "new", -0.4), ("alone.org", "x", 0.4), (None, None, 0.4), (None, None, 0.4), ("good.org", "p1", 3.5), ("good.org", "p1", 3.5)]
    df = spark.createDataFrame([(i, *r, "t") for i, r in enumerate(rows)], "doc_id long, h string, p string, doc_logit double, quality_score string").repartition(3)
    got = {r.doc_id: r for r in quality.judged(df, F.col("h"), F.col("p")).collect()}
    _, rate, strength = quality.posteriors(df, "h", "p")
    want = plain_posteriors(rows, rate, strength["host"], strength["path"])
    assert [got[i].quality_score for i in range(len(rows))] == pytest.approx(want)
    verdicts = {r[:2]: got[i].quality_kept for i, r in enumerate(rows) if abs(r[2]) == 0.4}
    assert verdicts == {("good.org", "p0"): True, ("bad.org", "p0"): False, ("good.org", "new"): True, ("alone.org", "x"): True, (None, None): True}
    monkeypatch.setattr(quality, "BROADCAST_SITES", 0)  # the way without a broadcast gives the same
    again = {r.doc_id: r.quality_score for r in quality.judged(df, F.col("h"), F.col("p")).collect()}
    assert [again[i] for i in range(len(rows))] == pytest.approx(want)


def test_sites_of_pages(spark, small):
    host, path = quality.site_of(F.col("url"))
    urls = [("https://www.Example.org/en/12?x=1", "example.org", "example.org/en"), ("http://a.b:80", "a.b", "a.b"), ("no address", None, ""), (None, None, "")]
    df = spark.createDataFrame([(u,) for u, _, _ in urls], "url string").select(host.alias("h"), path.alias("p"))
    assert [(r.h, r.p) for r in df.collect()] == [u[1:] for u in urls]
    pages = spark.read.parquet(f"{small}/pages.parquet").withColumn("doc_logit", F.pmod(F.col("page_id"), F.lit(7)) - 3.0)
    out = quality.judged(pages, host, path, keep=["page_id"])
    assert out.count() == pages.count() and out.select("host_posterior").distinct().count() > 5


def test_features_of_long_and_empty_texts(monkeypatch):
    text = "".join(random.Random(1).choices("abc é\n", k=5000))
    whole = quality.features(text)
    monkeypatch.setattr(quality, "CHUNK", 97)
    assert quality.features(text) == pytest.approx(whole) and np.linalg.norm(whole[quality.SHAPE :]) == pytest.approx(1)
    assert not quality.features("").any() and not quality.features(" \n").any()


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, "good text here.", "a", "x", 1), (2, "## $$ %%", "a", None, 2), (3, None, None, None, 3), (None, "", "b", "x", 4)], "doc_id long, text string, source string, lang string, doc_logit int")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 0)], "doc_id long, quality int")
    out = quality.classify(docs, labels, F.col("source"), F.col("lang"))
    assert out.count() == 4 and out.where("quality_score between 0 and 1").count() == 4 and out.columns.count("doc_logit") == 1
    assert quality.classify(docs, labels.limit(0), F.col("source"), F.col("lang")).count() == 4
    assert quality.classify(docs.limit(0), labels, F.col("source"), F.col("lang")).count() == 0

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from recordmill.llm import bpe, common

from .test_suffixes import brute

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = common.table(spark, FOLDER, "documents")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = common.cut(stage(spark, docs, FOLDER))
        out.append(docs)
    return out


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_keep_the_columns(stages):
    assert all(s.columns == list(corpus_pipeline.COLUMNS) for s in stages[1:-1]) and 4 <= len(corpus_pipeline.STAGES) <= 5


def test_filters_reject_and_keep(spark, stages):
    labels = {r.doc_id: r for r in common.table(spark, FOLDER, "labels").collect()}
    before, good, clean = (set(by_id(s)) for s in stages[:3])
    assert clean <= good <= before
    assert not {d for d in good if d in labels and labels[d].quality == 0} and not {d for d in clean if d in labels and labels[d].toxic == 1}
    spotless = {d for d, r in labels.items() if r.quality == 1 and r.toxic == 0 and d in before}
    assert len(spotless & clean) >= 0.98 * len(spotless)


def test_repeats_are_cut(stages):
    before = sorted((r.doc_id, r.text) for r in stages[3].collect())
    after = by_id(stages[4])
    for doc_id, size, removed, _, _ in brute(before):
        if removed == 0:
            assert after[doc_id].text == dict(before)[doc_id]
        elif removed < size:
            left = len(after[doc_id].text.encode())
            assert size - removed <= left <= size - removed + 40 and after[doc_id].n_chars == len(after[doc_id].text)


def test_everything_left_is_packed(stages):
    library = Tokenizer.from_file(bpe.default_vocabulary())
    packed: dict = {}
    for r in stages[5].orderBy("doc_id", "piece").collect():
        packed.setdefault(r.doc_id, []).append(r)
    for r in stages[4].collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 0]
        assert [p.ids_crc32 for p in packed.pop(r.doc_id)] == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in _cuts(ids)]
    assert not packed


def _cuts(ids):
    first = len(ids) % 2048 or 2048
    return [ids[:first], *[ids[a : a + 2048] for a in range(first, len(ids), 2048)]]

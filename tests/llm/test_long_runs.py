import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from recordmill.llm import bpe, packing


@pytest.mark.parametrize("text", ["a" + " " * 1_100_000 + "b", "a" + "\n" * 1_500_000, " \n" * 800_000 + "x <|endoftext|>"])
def test_runs_of_over_a_million_spaces(text):
    ids = Tokenizer.from_file(bpe.default_vocabulary()).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.token_ids(bpe.default_vocabulary(), text), "<u4").tolist() == ids


def test_pack_takes_a_very_long_run(spark):
    text = "a" + " " * 1_100_000 + "b"
    ids = [*Tokenizer.from_file(bpe.default_vocabulary()).encode(text, add_special_tokens=False).ids, 0]
    rows = packing.pack(spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")).where("doc_id = 1").orderBy("piece").collect()
    assert sum(r.length for r in rows) == len(ids) and [r.ids_crc32 for r in rows] == [zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in rows]

"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams (operator 5).

A text's features are its distinct words, the words' stems (their first bytes), pairs of neighbouring words and pairs with
one word between, hashed. FTRL-proximal keeps a learning rate for each coordinate and sets weights to exactly zero by an L1 term, so the model is a short list of
indices and weights that is broadcast; scoring looks up hashes in one pass and never joins.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import extended, map_arrow, texts_of, with_columns

BITS = 20
#: Bound of the training sample: about so many labelled documents, chosen by a hash of their id.
TRAIN_DOCUMENTS = 6000
#: Passes over the sample.
PASSES = 8
ALPHA, BETA, L1, L2 = 1.0, 1.0, 8.0, 0.5
#: Lengths in bytes of the stems of longer words.
STEMS = (4, 5)
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def hashed(text: str) -> np.ndarray:
    """Hash indices of every word, stem, neighbouring pair and pair with one word between (repeats included)."""
    words = text.encode().translate(_LETTERS).split()
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words)) + np.uint64(1)
    one = h * _A
    stems = [np.array([zlib.crc32(w[:n]) for w in words if len(w) > n], np.uint64) * _B + np.uint64(n) for n in STEMS]
    two = (h[:-1] * _B) ^ (h[1:] * _C + np.uint64(1))
    skip = (h[:-2] * _C) ^ (h[2:] * _B + np.uint64(2))
    every = np.concatenate([one, *stems, two, skip])
    every ^= every >> np.uint64(31)
    every *= _A
    return (every >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class Model:
    index: np.ndarray
    weight: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.index] = self.weight
        return out


def ftrl(features: list[np.ndarray], labels: list[int], epochs: int = PASSES) -> Model:
    """FTRL-proximal over the texts in the order given; features of a text are distinct, with value one. The last is the bias."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    bias = np.array([1 << BITS])

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        free = np.where(i == bias, 0.0, L1)
        return np.where(np.abs(zi) <= free, 0.0, -(zi - np.sign(zi) * free) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(epochs):
        for x, y in zip(features, labels, strict=True):
            i = np.concatenate([x, bias])
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            rate = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - rate * w
            n[i] += g * g
    final = weights(np.arange(1 << BITS))
    index = np.flatnonzero(final)
    return Model(index, final[index].astype(np.float32), float(weights(bias)[0]))


def fit(df: DataFrame, labels: DataFrame, trainable: Column, key: str = "doc_id", text: str = "text", label: str = "toxic", documents: int = TRAIN_DOCUMENTS, passes: int = PASSES) -> Model:
    """Learn from labelled rows of `labels` that may be learned from. Null keys, labels and texts teach nothing; of several
    labels of one document the highest counts. Without labels the model scores 0.5 everywhere."""
    known = labels.where(trainable & F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.max(label).alias("_y"))
    count = known.count()
    share = int(1e6 * min(1.0, documents / max(count, 1)))
    sample = known.where(F.pmod(F.xxhash64(key, F.lit(3)), F.lit(1_000_000)) < share).select(F.col(key).alias("_key"), "_y")
    rows = df.where(F.col(text).isNotNull()).select(F.col(key).alias("_id"), F.col(text).alias("text"))
    rows = rows.join(F.broadcast(sample), F.col("_id") == F.col("_key"))  # at most about `documents` rows of two numbers
    rows = rows.select(F.xxhash64("_key", F.lit(5)).alias("order"), F.col("_y").cast("int").alias("y"), "text")

    def indexed(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = [np.unique(hashed(t)).astype(np.int32) for t in texts_of(batch.column("text"))]
        return pa.RecordBatch.from_arrays([batch.column("order"), batch.column("y"), pa.array(x, pa.list_(pa.int32()))], names=["order", "y", "x"])

    # The scan hashes; a shuffle brings the sample's distinct indices (at most 2^BITS a text) into one task.
    rows = map_arrow(rows, indexed, "order long, y int, x array<int>").repartition(1).sortWithinPartitions("order", "x")

    def run(batches):
        features, ys = [], []
        for batch in batches:
            x = batch.column("x")
            features += [x[i].values.to_numpy() for i in range(len(x))]
            ys += [int(y > 0) for y in batch.column("y").to_pylist()]
        m = ftrl(features, ys, passes) if ys else Model(np.zeros(0, np.int64), np.zeros(0, np.float32), 0.0)
        yield pa.RecordBatch.from_arrays([pa.array([m.index.tolist()], pa.list_(pa.int64())), pa.array([m.weight.tolist()], pa.list_(pa.float64())), pa.array([m.bias])], names=["index", "weight", "bias"])

    found = rows.mapInArrow(run, "index array<long>, weight array<double>, bias double").collect()  # one row, as sparse as L1 makes it
    if not found:
        return Model(np.zeros(0, np.int64), np.zeros(0, np.float32), 0.0)
    return Model(np.array(found[0][0], np.int64), np.array(found[0][1], np.float32), float(found[0][2]))


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add score (0 to 1) and predicted (1 from 0.5 on). Null texts score as empty ones; clashing columns are replaced."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m: Model = shared.value
        if "table" not in run.__dict__:  # once a task
            run.__dict__["table"] = m.table()
        held = run.__dict__["table"]
        out = []
        for t in texts_of(batch.column(text)):
            i = hashed(t)
            i = np.unique(i[held[i] != 0])
            out.append(1 / (1 + np.exp(-np.clip(float(held[i].sum(dtype=np.float64)) + m.bias, -35, 35))))
        scores = np.array(out, np.float64)
        return with_columns(batch, {"score": pa.array(scores), "predicted": pa.array((scores >= 0.5).astype(np.int32))})

    return map_arrow(df, run, extended(df.schema, "score double, predicted int"))

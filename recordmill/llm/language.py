"""Language identification by hyperdimensional profiles (operator 4).

Every letter has a random vector of +1 and -1 drawn from its code point. An n-gram's vector binds its letters' vectors,
each rotated by its place, by multiplication; a text's vector bundles its n-grams by addition. A language's prototype is the
bundle of its training texts, and a text belongs to the language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import extended, map_arrow, texts_of, with_columns

DIMENSIONS = 1024
GRAM = 3
SEED = 7
#: Bound of the training sample: about so many documents of each language, chosen by a hash of their id.
TRAIN_PER_LANGUAGE = 1500
UNKNOWN = "und"
#: n-gram vectors kept in a worker; beyond it the table starts anew.
TABLE = 40_000
#: A table of languages of at most so many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_LANGUAGES = 100_000
#: Prototypes that texts are compared with at once.
BLOCK = 4096
#: n-grams of a text that are looked up at once.
CHUNK = 4096


class Space:
    """Letter and n-gram vectors, made on demand and the same everywhere."""

    def __init__(self, dimensions: int = DIMENSIONS, gram: int = GRAM, seed: int = SEED):
        self.dimensions, self.gram, self.seed = dimensions, gram, seed
        self.letters: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.vectors = np.zeros((1024, dimensions), np.int8)
        self.alpha = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            self.letters[code] = (np.random.default_rng([self.seed, code]).integers(0, 2, self.dimensions) * 2 - 1).astype(np.int8)
        return self.letters[code]

    def grams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams of letters, other characters reduced to one space between words, and their counts."""
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letters = self.alpha[np.minimum(codes, 0x10FFFF)]
        codes = np.concatenate([[32], np.where(letters, codes, 32), [32]]).astype(np.int64)
        codes = codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])]
        if len(codes) < self.gram or not letters.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        key = codes[: len(codes) - self.gram + 1].copy()
        for k in range(1, self.gram):
            key = key << 21 | codes[k : len(codes) - self.gram + 1 + k]
        return np.unique(key, return_counts=True)

    def vector(self, text: str) -> np.ndarray | None:
        """The text's bundle; None without letters."""
        keys, counts = self.grams(text)
        if not len(keys):
            return None
        out = np.zeros(self.dimensions, np.float32)
        for k in range(0, len(keys), CHUNK):
            out += counts[k : k + CHUNK].astype(np.float32) @ self._vectors(keys[k : k + CHUNK].tolist()).astype(np.float32)
        return out

    def _vectors(self, keys: list[int]) -> np.ndarray:
        """The vectors of some n-grams; at most TABLE are kept, whatever a text holds."""
        rows = self.rows
        if len(rows) + len(keys) > TABLE:
            rows.clear()
        for key in keys:
            if key not in rows:
                if len(rows) == len(self.vectors):
                    self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
                made = np.ones(self.dimensions, np.int8)
                for place in range(self.gram):
                    made = made * np.roll(self.letter(key >> 21 * place & 0x1FFFFF), place)
                self.vectors[len(rows)] = made
                rows[key] = len(rows)
        return self.vectors[np.fromiter(map(rows.__getitem__, keys), np.int64, len(keys))]


@lru_cache(maxsize=1)
def space(dimensions: int, gram: int, seed: int) -> Space:
    return Space(dimensions, gram, seed)


def fit(df: DataFrame, trainable: Column, lang: str = "lang", text: str = "text", key: str = "doc_id", per_language: int = TRAIN_PER_LANGUAGE) -> dict[str, np.ndarray]:
    """Prototypes of all languages of the rows that may be learned from (null languages, texts and keys teach nothing; languages
    whose texts have no letter have none). About `per_language` documents of each are read, chosen by a hash of their key."""
    known = df.where(trainable & F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull())
    shares = known.groupBy(F.col(lang).alias("_lang")).agg((F.least(F.lit(1.0), per_language / F.count(F.lit(1))) * 1_000_000).cast("long").alias("_share"))
    if shares.count() <= BROADCAST_LANGUAGES:
        shares = F.broadcast(shares)
    sample = known.join(shares, F.col(lang) == F.col("_lang")).where(F.pmod(F.xxhash64(key, F.lit(SEED)), F.lit(1_000_000)) < F.col("_share"))
    sample = sample.select(F.col(lang).alias("lang"), F.col(text).alias("text")).repartition(8)

    def run(batches):
        vectors = space(DIMENSIONS, GRAM, SEED)
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, t in zip(batch.column("lang").to_pylist(), texts_of(batch.column("text")), strict=True):
                if (v := vectors.vector(t)) is not None:
                    sums[name] = sums.get(name, 0) + v.astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([s.tolist() for s in sums.values()], pa.list_(pa.float64()))], names=["lang", "vector"])

    prototypes: dict[str, np.ndarray] = {}
    for name, v in sample.mapInArrow(run, "lang string, vector array<double>").collect():  # eight rows a language
        prototypes[name] = prototypes.get(name, 0) + np.array(v)
    return {name: prototypes[name] / max(np.linalg.norm(prototypes[name]), 1e-12) for name in sorted(prototypes)}


def predict(df: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text") -> DataFrame:
    """Add lang_pred and score (the cosine, 0 to 1). Null texts, texts without a letter and models without languages give
    `und` and 0; equal cosines go to the first name. Clashing columns are replaced; all rows stay."""
    names = list(prototypes)
    matrix = np.array([prototypes[n] for n in names], np.float32).reshape(-1, DIMENSIONS)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        vectors = space(DIMENSIONS, GRAM, SEED)
        found, scores = [], []
        for t in texts_of(batch.column(text)):
            v = vectors.vector(t) if names else None
            if v is None or not (size := float(np.linalg.norm(v))):
                found.append(UNKNOWN)
                scores.append(0.0)
                continue
            best, cosine = 0, -2.0
            for at in range(0, len(matrix), BLOCK):
                cosines = matrix[at : at + BLOCK] @ v / size
                if float(cosines.max()) > cosine:
                    best, cosine = at + int(cosines.argmax()), float(cosines.max())
            found.append(names[best])
            scores.append(min(1.0, max(0.0, cosine)))
        return with_columns(batch, {"lang_pred": pa.array(found, pa.string()), "score": pa.array(scores, pa.float64())})

    return map_arrow(df, run, extended(df.schema, "lang_pred string, score double"))

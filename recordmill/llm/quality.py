"""Quality by hierarchical empirical Bayes over hosts and their paths (operator 10).

A logistic regression on hashed byte n-grams and a few measures of shape, learned from labels, gives each document's own
evidence. The documents' probabilities are then summed by host and by path in two grouped aggregations; a beta-binomial prior is
fitted by moments over the hosts, and again over the paths around their host, so that sites with few documents shrink towards
their host and hosts towards the corpus. A document's final probability is its own evidence, with the prior odds of the corpus
replaced by those of its path; the document itself is left out of its path's sums and of its host's.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, extended, map_arrow, texts_of, with_columns

#: Measures of shape, and buckets of hashed n-grams of 1 to 3 bytes.
SHAPE, GRAMS, LONGEST = 9, 512, 3
FEATURES = SHAPE + GRAMS
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
#: Bytes of a text whose n-grams are hashed at once.
CHUNK = 1 << 20
#: Bound of the training sample: about so many labelled documents, chosen by a hash of their id.
TRAIN_DOCUMENTS = 8000
RIDGE = 1.0
#: A table of path posteriors of at most so many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_SITES = 100_000
THRESHOLD = 0.5


def grams(raw: bytes) -> np.ndarray:
    """Square roots of the shares of hashed n-grams, of length one; zeros for an empty text."""
    out = np.zeros(GRAMS)
    every = np.frombuffer(raw, np.uint8)
    for at in range(0, len(every), CHUNK):
        part = every[at : at + CHUNK + LONGEST - 1].astype(np.uint64)
        code = np.zeros(len(part), np.uint64)
        for n in range(1, LONGEST + 1):
            code = (code[: len(part) - n + 1] << np.uint64(8)) | part[n - 1 :]
            mine = code[: min(CHUNK, len(code))]
            out += np.bincount(((mine + np.uint64(n)) * _ODD[n - 1] >> np.uint64(55)).astype(np.int64), minlength=GRAMS)
    return np.sqrt(out / max(1.0, out.sum()))


def shape(raw: bytes) -> list[float]:
    """Lengths, letter cases, kinds of bytes and repetitions of a text."""
    words = raw.split()
    n = len(words)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower = int(counts[65:91].sum()), int(counts[97:123].sum())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return [
        float(np.log1p(n)),
        upper / max(1, upper + lower),
        counts[48:58].sum() / len(raw),
        counts[128:].sum() / len(raw),
        float(np.log1p(len(raw) / n)),
        len(set(words)) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        float(np.log1p(n / max(1, len(lines)))),
        float(np.log1p(max(map(len, words)))),
    ]


def features(text: str) -> np.ndarray:
    """The whole text's features; zeros for a text without words."""
    raw = text.encode()
    if not raw.split():
        return np.zeros(FEATURES)
    return np.concatenate([shape(raw), grams(raw)])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.clip((x - self.mean) / self.scale, -8, 8) @ self.weight + self.bias, -30, 30)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, rounds: int = 20) -> Model:
    """Ridge logistic regression by Newton steps on standardised features."""
    if not len(x):
        return Model(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), 0.0)
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1.0
    z = np.column_stack([np.clip((x - mean) / scale, -8, 8), np.ones(len(x))])
    penalty = np.diag([ridge] * x.shape[1] + [1e-6])
    w = np.zeros(z.shape[1])
    w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * np.maximum(p * (1 - p), 1e-6)[:, None]) + penalty, z.T @ (y - p) - penalty @ w)
        w += step * min(1.0, 5 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-4:
            break
    return Model(mean, scale, w[:-1], float(w[-1]))


def fit(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", documents: int = TRAIN_DOCUMENTS) -> Model:
    """Learn from labelled documents; null keys, labels and texts teach nothing, of several labels the lowest counts. Without
    labels every document gets even odds."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.min(label).alias("_y"))
    share = int(1e6 * min(1.0, documents / max(known.count(), 1)))
    sample = known.where(F.pmod(F.xxhash64(key, F.lit(9)), F.lit(1_000_000)) < share).select(F.col(key).alias("_key"), "_y")
    rows = df.where(F.col(text).isNotNull()).select(F.col(key).alias("_id"), F.col(text).alias("text"))
    rows = rows.join(F.broadcast(sample), F.col("_id") == F.col("_key")).select(F.xxhash64("_id").alias("order"), F.col("_y").cast("int").alias("y"), "text")  # about `documents` pairs of numbers

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [features(t).astype(np.float32).tobytes() for t in texts_of(batch.column("text"))]
        return pa.RecordBatch.from_arrays([batch.column("order"), batch.column("y"), pa.array(found, pa.binary())], names=["order", "y", "x"])

    got = map_arrow(rows, run, "order long, y int, x binary").orderBy("order", "x").collect()  # about `documents` rows of FEATURES numbers
    return logistic(np.array([np.frombuffer(r[2], np.float32) for r in got], float).reshape(-1, FEATURES), np.array([float(r[1] > 0) for r in got]))


def evidence(df: DataFrame, model: Model, text: str = "text", name: str = "doc_logit") -> DataFrame:
    """Add the log-odds that the document is good by its text alone; null texts count as empty."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([features(t) for t in texts_of(batch.column(text))], float).reshape(-1, FEATURES)
        return with_columns(batch, {name: pa.array(model.logit(x))})

    return map_arrow(df, run, extended(df.schema, f"{name} double"))


def _prior_strength(sites: DataFrame, parent: Column | float) -> float:
    """Pseudo-documents of the prior, by the method of moments over sites of two documents or more.

    The observed spread of site rates around their parent, less what chance explains, is the spread that the prior has.
    """
    rate = F.col("good") / F.col("n")
    mean = parent if isinstance(parent, Column) else F.lit(float(parent))
    found = sites.where("n >= 2").agg(
        F.sum(F.col("n") * (rate - mean) * (rate - mean)).alias("spread"), F.sum(mean * (1 - mean)).alias("chance"), F.sum(F.col("n") * mean * (1 - mean)).alias("total"), F.count(F.lit(1)).alias("sites")
    ).first()
    if not found["sites"] or not found["total"]:
        return 100.0
    beyond = (found["spread"] - found["chance"]) / found["total"]
    return float(np.clip(1 / max(beyond, 1e-4) - 1, 1.0, 1000.0))


def posteriors(scored: DataFrame, host: str, path: str) -> tuple[DataFrame, float, dict[str, float]]:
    """Path table (host, path, n, good, host_n, host_good), the corpus rate and the prior strengths. scored: host, path, doc_logit."""
    chance = 1 / (1 + F.exp(-F.col("doc_logit")))
    paths = cut(scored.groupBy(host, path).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(chance).alias("good")))
    hosts = paths.groupBy(host).agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    total = hosts.agg(F.sum("n"), F.sum("good")).first()
    rate = (total[1] + 0.5) / (total[0] + 1.0) if total[0] else 0.5
    over_hosts = _prior_strength(hosts, rate)
    hosts = hosts.select(F.col(host).alias("_host"), F.col("n").alias("host_n"), F.col("good").alias("host_good"))
    paths = paths.join(hosts, F.col(host).eqNullSafe(F.col("_host"))).drop("_host")
    over_paths = _prior_strength(paths, (F.col("host_good") + over_hosts * rate) / (F.col("host_n") + over_hosts))
    return paths, rate, {"host": over_hosts, "path": over_paths}


def site_of(url: Column) -> tuple[Column, Column]:
    """Host (without `www.`, in lower case) and path level (host and first segment) of an address; null for what is none."""
    host = F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(?:[wW]{3}\.)?([^/?#:]+)", 1)), F.lit(""))
    segment = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]*)", 1)
    return host, F.concat_ws("/", host, F.nullif(segment, F.lit("")))


def classify(df: DataFrame, labels: DataFrame, host: Column, path: Column, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """Learn from the labels, then `judged`."""
    return judged(evidence(df, fit(df, labels, key, text), text), host, path, threshold, df.columns if keep is None else keep)


def judged(scored: DataFrame, host: Column, path: Column, threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """The columns to keep, doc_logit, host_posterior, path_posterior (both without the document itself), quality_score (0 to 1)
    and quality_kept; all rows stay. scored: rows with doc_logit.

    Null hosts and paths are sites of their own; repeated rows count as documents of their own; even odds are kept. Clashing
    columns are replaced. An empty table gives an empty result. The rows are written once, so that texts are read once.
    """
    new = ("doc_logit", "host_posterior", "path_posterior", "quality_score", "quality_kept")
    names = [n for n in (scored.columns if keep is None else keep) if n not in new]
    held = cut(scored.select(*[F.col(n).alias(f"_in_{i}") for i, n in enumerate(names)], "doc_logit", host.alias("_h"), path.alias("_p")).withColumn("_row", F.monotonically_increasing_id()))
    sites, rate, strength = posteriors(held.select("_h", "_p", "doc_logit"), "_h", "_p")
    sites = sites.select(F.col("_h").alias("_site"), F.col("_p").alias("_sub"), "n", "good", "host_n", "host_good")
    same_site = F.col("_h").eqNullSafe(F.col("_site")) & F.col("_p").eqNullSafe(F.col("_sub"))
    own = 1 / (1 + F.exp(-F.col("doc_logit")))
    k_host, k_path = strength["host"], strength["path"]
    by_host = (F.greatest(F.col("host_good") - own, F.lit(0.0)) + k_host * rate) / (F.col("host_n") - 1 + k_host)
    by_path = (F.greatest(F.col("good") - own, F.lit(0.0)) + k_path * F.col("host_posterior")) / (F.col("n") - 1 + k_path)
    odds = lambda p: F.log(p / (1 - p))
    safe = lambda p: F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    final = 1 / (1 + F.exp(-(F.col("doc_logit") + odds(F.col("path_posterior")) - float(np.log(rate / (1 - rate))))))
    verdict = lambda rows: rows.withColumn("host_posterior", safe(by_host)).withColumn("path_posterior", safe(by_path)).withColumn("quality_score", final).withColumn("quality_kept", F.col("quality_score") >= threshold)
    if sites.count() <= BROADCAST_SITES:
        out = verdict(held.join(F.broadcast(sites), same_site))
    else:  # sites are joined with numbers alone, whatever a hot site's share; texts only meet their own row
        numbers = verdict(held.select("_row", "_h", "_p", "doc_logit").join(sites, same_site)).select("_row", *[n for n in new if n != "doc_logit"])
        out = held.join(numbers, "_row")
    return out.select(*[F.col(f"_in_{i}").alias(n) for i, n in enumerate(names)], *new)

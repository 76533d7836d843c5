"""Exact top-k search by no-random-access aggregation (operator 9).

The score of a vector for a query is an inner product, a sum over one sorted list for each component: read from the top for a
positive query component and from the bottom for a negative one. Lists are read in small steps. After each step a vector has a
lower bound (entries not yet read count as the list's worst) and an upper bound (they count as the list's frontier). A vector
whose upper bound is below the k-th best lower bound is out. Reading stops when no vector outside the last few (FINALISTS for
each place) can qualify, or when the lists are read to their ends; then the finalists' scores are resolved. Nothing but the
bounds ends the reading: on data whose bounds stay open the lists are read whole.

Vectors are cut into blocks, whose lists are built once, and the stated queries into bundles of blocks that are passed over
them. A list is sorted, so an entry is read exactly if its value is beyond the frontier: one matrix product gives the bounds of
a block of vectors for a block of queries. Each pair yields at most k rows a query, merged by query. Components are integers,
floor(factor * x), so that scores are exact.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, numbered

FACTOR = 256
K = 5
#: Vectors in a block of candidates, queries compared at once, and blocks of queries in a bundle.
BLOCK, QUERIES, BUNDLE = 4096, 512, 8
#: Steps in which a list is read from end to end.
STEPS = 16
#: Vectors that may be left, for each of the k places, when reading stops.
FINALISTS = 4
#: Share of a block that is left on average when bounds are kept for single queries and not for the block.
SPARSE = 0.04


class Lists:
    """A block's sorted lists: for each component the vectors' values in rising order."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.largest = float(np.abs(vectors.astype(np.float64)).max(initial=0))
        self.kind = np.float32 if self.largest < 1e6 else np.float64
        self.columns = np.ascontiguousarray(vectors.T.astype(self.kind))  # by component
        self.rising = np.sort(self.columns, axis=1)
        self.extent = np.abs(self.rising[:, [0, -1]]).max(axis=1).astype(np.float64) if len(vectors) else np.zeros(len(self.columns))

    def best(self, queries: np.ndarray, own: list[np.ndarray], ids: np.ndarray, k: int, read: dict | None = None) -> list[list[tuple[int, int]]]:
        """For each query (score, position) of the k best vectors but its own positions, ties to the smaller id."""
        n, m = len(self.vectors), len(queries)
        up, down = (np.clip(queries, *b).astype(self.kind) for b in ((0, None), (None, 0)))
        # What rounding may do to a sum, by the sum of its terms' sizes.
        slack = (np.abs(queries).astype(np.float64) @ self.extent) * (4e-7 if self.kind is np.float32 else 1e-15) * (len(self.columns) + 8) + 0.5
        alive = np.ones((m, n), bool)
        for i, places in enumerate(own):
            alive[i, places] = False
        bar = np.full(m, -np.inf)
        # The k-th best of the groups' best lower bounds is one that k vectors reach, and cheaper than the k-th best of all.
        groups = np.unique(np.linspace(0, n, max(k, n // 32), endpoint=False).astype(np.int64))
        open_, out = np.arange(m), [None] * m
        few = FINALISTS * k

        def close(i: int, finalists: np.ndarray, depth: int) -> None:
            out[i] = self._resolved(finalists, queries[i], ids, k)
            if read is not None:
                read["depth"], read["direct"], read["queries"] = read.get("depth", 0) + depth / n, read.get("direct", 0) + len(finalists) / n, read.get("queries", 0) + 1

        step = 0
        while len(open_) and step < STEPS:
            step += 1
            depth = -(-n * step // STEPS)
            top, bottom = self.rising[:, n - depth], self.rising[:, depth - 1]
            first, last = self.rising[:, 0], self.rising[:, -1]
            upper = up[open_] @ np.maximum(self.columns, top[:, None]) + down[open_] @ np.minimum(self.columns, bottom[:, None])
            lower = up[open_] @ np.where(self.columns >= top[:, None], self.columns, first[:, None]) + down[open_] @ np.where(self.columns <= bottom[:, None], self.columns, last[:, None])
            for i, q in enumerate(open_.tolist()):
                lower[i, own[q]] = -np.inf
            if len(groups) >= k:
                bar[open_] = np.maximum(bar[open_], np.partition(np.maximum.reduceat(lower, groups, axis=1), len(groups) - k, axis=1)[:, len(groups) - k] - slack[open_])
            reach = np.nextafter((bar[open_] - slack[open_]).astype(self.kind), self.kind(-np.inf))
            now = alive[open_] & (upper >= reach[:, None])
            alive[open_] = now
            counts = np.count_nonzero(now, axis=1)
            for i in open_[counts <= few].tolist():
                close(i, np.flatnonzero(alive[i]), depth)
            open_ = open_[counts > few]
            if len(open_) and counts[counts > few].mean() < SPARSE * n:
                break
        for i in open_.tolist():
            finalists, depth = np.flatnonzero(alive[i]), -(-n * step // STEPS)
            for later in range(step + 1, STEPS + 1):
                if len(finalists) <= few:
                    break
                depth = -(-n * later // STEPS)
                values = self.columns[:, finalists]
                top, bottom = self.rising[:, n - depth, None], self.rising[:, depth - 1, None]
                lower = up[i] @ np.where(values >= top, values, self.rising[:, :1]) + down[i] @ np.where(values <= bottom, values, self.rising[:, -1:])
                bar[i] = max(bar[i], float(np.partition(lower, len(lower) - k)[len(lower) - k]) - slack[i])
                upper = up[i] @ np.maximum(values, top) + down[i] @ np.minimum(values, bottom)
                finalists = finalists[upper.astype(np.float64) + slack[i] >= bar[i]]
            close(i, finalists, depth)
        return out  # type: ignore[return-value]

    def _resolved(self, at: np.ndarray, query: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int]]:
        scores = self.scores(at, query)
        if len(at) > k:
            least = np.partition(scores, len(scores) - k)[len(scores) - k]
            at, scores = at[scores >= least], scores[scores >= least]
        return sorted(zip(map(int, scores), at.tolist(), strict=True), key=lambda x: (-x[0], ids[x[1]]))[:k]

    def scores(self, at: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Exact inner products; in doubles while those hold them exactly, else in Python's integers."""
        if self.largest * float(np.abs(query.astype(np.float64)).max(initial=0)) * max(1, len(query)) < 2.0**53:
            return self.vectors[at].astype(np.float64) @ query.astype(np.float64)
        return np.array([sum(int(a) * int(b) for a, b in zip(v, query, strict=True)) for v in self.vectors[at]], object)


def _blocks(vectors: DataFrame, size: int, name: str) -> DataFrame:
    """Rows of up to `size` vectors of one length: dim, block, ids, values (flat). vectors: id, v (array<long>)."""
    placed = numbered(vectors.withColumn("dim", F.size("v")), ["dim"], [F.col("id")], "place")
    grouped = placed.groupBy("dim", F.floor(F.col("place") / size).alias(f"{name}_block")).agg(F.collect_list(F.struct("id", "v")).alias("rows"))
    return grouped.select("dim", f"{name}_block", F.col("rows.id").alias(f"{name}_ids"), F.flatten("rows.v").alias(f"{name}_values"))


def _searched(batches: Iterable[pa.RecordBatch], key: str, k: int) -> Iterator[pa.RecordBatch]:
    """The k best of each block of vectors (c_…) for the queries (q_…) beside it."""
    for batch in batches:
        for row in range(len(batch)):
            dim = batch.column("dim")[row].as_py()
            ci, cv, qi, qv = (batch.column(c)[row].values.to_numpy(zero_copy_only=False) for c in ("c_ids", "c_values", "q_ids", "q_values"))
            by = np.argsort(ci, kind="stable")
            ids, lists = ci[by], Lists(cv.reshape(-1, dim)[by])
            queries = qv.reshape(-1, dim)
            out: list[tuple[int, int, int]] = []
            for at in range(0, len(qi), QUERIES):
                some = qi[at : at + QUERIES]
                low, high = np.searchsorted(ids, some, "left"), np.searchsorted(ids, some, "right")
                found = lists.best(queries[at : at + QUERIES], [np.arange(a, b) for a, b in zip(low, high, strict=True)], ids, k)
                out += [(int(q), int(ids[p]), int(s)) for q, best in zip(some, found, strict=True) for s, p in best]
            columns = list(zip(*out, strict=True)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", key, "score"])


def top_k(df: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = K, factor: int = FACTOR) -> DataFrame:
    """query_id, rank (from 1), the candidate's key, score. Candidates are all rows with another key than the query's.

    Vectors that are null, empty, or hold null or non-finite components take no part, nor do null keys; only vectors of the
    query's length are compared. Repeated rows are candidates of their own; a repeated query is answered once, and a key that is
    a query with several vectors gets one list, the k best scores of any of them. Equal scores go to the smaller key. Scores are
    exact while they fit a long. An empty table gives no rows; other columns are ignored.
    """
    spark = df.sparkSession
    sound = F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.where(F.col(key).isNotNull() & sound).select(F.col(key).cast("long").alias("id"), F.transform(vector, lambda x: F.floor(x.cast("double") * factor).cast("long")).alias("v"), is_query.alias("q"))
    rows = cut(rows)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    candidates = cut(_blocks(rows.select("id", "v"), BLOCK, "c"))
    queries = cut(_blocks(rows.where("q").select("id", "v").dropDuplicates(["id", "v"]), QUERIES, "q"))
    # The stated queries, in bundles of blocks, against all rows, in blocks. One length of vectors may be all there is, so both
    # sides carry a salt: a bundle is sent once to each salt, a block of vectors once to each bundle.
    salts = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("salt")
    bundles = queries.groupBy("dim", F.floor(F.col("q_block") / BUNDLE).alias("bundle")).agg(F.collect_list(F.struct("q_ids", "q_values")).alias("_q"))
    bundles = cut(bundles.select("dim", "bundle", F.flatten("_q.q_ids").alias("q_ids"), F.flatten("_q.q_values").alias("q_values")))
    asked = bundles.select("dim", "bundle", salts)
    work = candidates.withColumn("salt", F.pmod(F.col("c_block"), F.lit(parts)).cast("int")).join(asked, ["dim", "salt"]).repartition(parts, "dim", "bundle", "salt")
    work = work.join(bundles.select("dim", "bundle", "q_ids", "q_values", salts).repartition(parts, "dim", "bundle", "salt"), ["dim", "bundle", "salt"])

    key_of = "spark.sql.execution.arrow.maxRecordsPerBatch"
    usual = spark.conf.get(key_of)
    spark.conf.set(key_of, "4")  # rows are whole blocks
    try:
        found = cut(work.mapInArrow(lambda batches: _searched(batches, key, k), f"query_id long, {key} long, score long"))
    finally:
        spark.conf.set(key_of, usual)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc(key))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), key, "score")

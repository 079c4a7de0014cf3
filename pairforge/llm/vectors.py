r"""Exact top-k search with vector-approximation cells (operator 5).

Vectors become integers, ``floor(scale * x)``.  Each task packs its vectors
into blocks and quantises a block into 16 cells a dimension.  For a block of
queries one matrix product with the cells' centres gives every pair's lower and upper
bound of the inner product.  The k-th largest lower bound (or the k-th best
exact score so far) rules out most vectors; the rest are read exactly in the order of
their upper bounds until the k-th result is certain, ties included.

Queries are sent to the tasks in shards of bounded size (``SHARD_BYTES``), every
shard against all rows; a task keeps k results a query, and one window a query
joins the tasks' results.

Defined results: vectors that are null or hold a null or non-finite component
take no part, nor do rows without id; vectors are compared with vectors of their
own length; a repeated query id is one query (its smallest vector), repeated
candidates each count; scores beyond a long are held at its ends; ties go to the
smaller id; an empty table gives no rows; other columns are not read.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELLS = 16
BLOCK = 8192
SHARD_BYTES = 32 << 20
_LONG = (1 << 63) - 1


def integers(ids: pa.Array, vectors: pa.Array, scale: float) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Valid vectors by length: (ids, integer components as doubles)."""
    sizes = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    values = vectors.flatten()
    flat = values.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        flat = np.floor(flat * scale)  # nulls come as NaN
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    width = np.maximum(sizes, 0)
    ends = np.cumsum(width)
    known = ~ids.is_null().to_numpy(zero_copy_only=False)
    ok = (sizes >= 0) & known & (bad[ends] == bad[ends - width])
    numbers = ids.fill_null(0).to_numpy(zero_copy_only=False)
    out = {}
    for d in np.unique(sizes[ok]).tolist():
        rows = np.flatnonzero(ok & (sizes == d))
        out[d] = (numbers[rows].astype(np.int64), flat[((ends - width)[rows][:, None] + np.arange(d)).ravel()].reshape(len(rows), d))
    return out


def exact(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Exact inner products of one query with some vectors, held within a long."""
    if not m.size or float(np.abs(q).max()) * float(np.abs(m).max()) * len(q) < 2 ** 53:
        return (m @ q).astype(np.int64)
    qi = [int(x) for x in q]
    return np.array([max(-_LONG - 1, min(_LONG, sum(a * int(b) for a, b in zip(qi, row)))) for row in m], dtype=np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    o = np.lexsort((ids, -scores.astype(object) if scores.size and scores.min() == -_LONG - 1 else -scores))[:k]
    return scores[o], ids[o]


class Search:
    """The best k of the vectors met so far, for queries of one length."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, q, k
        none = np.empty(0, np.int64)
        self.scores, self.found = [none] * len(ids), [none] * len(ids)
        self.read = 0

    def block(self, ids: np.ndarray, m: np.ndarray) -> None:
        k, q = self.k, self.q
        if not len(ids):
            return
        lo, hi = (m.min(axis=0), m.max(axis=0)) if m.shape[1] else (np.zeros(0), np.zeros(0))
        width = np.maximum(np.ceil((hi - lo + 1) / CELLS), 1.0)
        cells = np.minimum((m - lo) // width, CELLS - 1).astype(np.uint8)
        centre = lo + cells * width + (width - 1) / 2
        with np.errstate(over="ignore", invalid="ignore"):
            middle = q @ centre.T
            # half a cell a component, and what doubles may lose on very large numbers
            slack = np.abs(q) @ ((width - 1) / 2) + 1e-9 * (np.abs(q) @ np.maximum(np.abs(lo), np.abs(hi))) + 1e-6
            far = not np.abs(middle).max() + slack.max() < 2 ** 62  # bounds beyond a long say nothing
        if far:
            middle, slack = np.zeros_like(middle), np.zeros_like(slack)
        for i in range(len(q)):
            mine = ids != self.ids[i]
            mid = middle[i]
            bar = -np.inf
            if not far:
                if int(mine.sum()) > k:
                    bar = np.partition(mid[mine], -k)[-k] - slack[i]
                if len(self.scores[i]) == k:
                    bar = max(bar, float(self.scores[i][-1]))
            rest = np.flatnonzero(mine & (mid + slack[i] >= bar))
            rest = rest[np.argsort(-mid[rest], kind="stable")]
            at, step = 0, 4 * k
            while at < len(rest):
                full = len(self.scores[i]) == k
                if full and not far and mid[rest[at]] + slack[i] < self.scores[i][-1]:
                    break  # no later one can reach the k-th score
                now = rest[at:at + step]
                self.read += len(now)
                self.scores[i], self.found[i] = _best(np.concatenate([self.scores[i], exact(q[i], m[now])]),
                                                      np.concatenate([self.found[i], ids[now]]), k)
                at += step


def top_k(df: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
          scale: float = 256.0, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` of each query's k best rows but its own."""
    spark = df.sparkSession

    def plain(d: DataFrame) -> DataFrame:
        return d.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))

    asked = plain(queries).filter("id IS NOT NULL").groupBy("id").agg(F.min("v").alias("v"))
    total = asked.agg(F.sum(8 * F.greatest(F.size("v"), F.lit(0)) + 16)).first()[0] or 0
    shards = -(-int(total) // shard_bytes)
    rows = plain(df)
    results = None
    for s in range(shards):
        mine = asked.filter(F.pmod(F.xxhash64("id"), F.lit(shards)) == s) if shards > 1 else asked
        sent = spark.sparkContext.broadcast(mine.toArrow().combine_chunks().to_batches())
        found = rows.mapInArrow(_searcher(sent, k, scale), "query_id bigint, vec_id bigint, score bigint")
        results = found if results is None else results.union(found)
    if results is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return results.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")


def _searcher(sent, k: int, scale: float):
    def run(batches):
        searches: dict[int, Search] = {}
        for b in sent.value:
            for d, (ids, q) in integers(b.column("id"), b.column("v"), scale).items():
                o = np.argsort(ids)
                searches[d] = Search(ids[o], q[o], k)
        held: dict[int, list] = {}

        def flush(d: int) -> None:
            parts = held.pop(d)
            searches[d].block(np.concatenate([x for x, _ in parts]), np.concatenate([m for _, m in parts]))

        for b in batches:
            for d, (ids, m) in integers(b.column("id"), b.column("v"), scale).items():
                if d not in searches:
                    continue
                for at in range(0, len(ids), BLOCK):
                    held.setdefault(d, []).append((ids[at:at + BLOCK], m[at:at + BLOCK]))
                    if sum(len(x) for x, _ in held[d]) >= BLOCK:
                        flush(d)
        for d in list(held):
            flush(d)
        for s in searches.values():
            n = [len(x) for x in s.scores]
            if sum(n):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(s.ids, n)), pa.array(np.concatenate(s.found)),
                                                  pa.array(np.concatenate(s.scores))], ["query_id", "vec_id", "score"])
    return run

"""Exact top-k search by distributed histogram selection.

Queries are taken in blocks of a fixed number of vectors, each block against all candidates. Every score is computed as
an integer inner product. Histograms of the scores, refined around each query's k-th highest value, are summed over the
cluster until that value is known exactly; scores above it and the ties at it with the smallest ids are the result. A
task sends only the bins that can hold a k-th value: those at or above its own k-th highest.

Components become floor(scale * x) with x as double. Vectors that are null or hold a null or a non-finite component take
no part, nor do those of another length than the most frequent one (the smallest of equals). A candidate with the
query's own id is left out; repeated rows count each. Fewer than k candidates: all. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Queries scored at once, and bins per refinement of a histogram.
BLOCK_QUERIES, BINS = 2048, 1024
#: Candidates scored in one matrix product.
ROWS = 512


def _chunks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            b = batch.slice(lo, ROWS)
            vec = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            yield b.column("id").to_numpy(), vec


def _scores(vec: np.ndarray, ids: np.ndarray, q: np.ndarray, qids: np.ndarray) -> np.ndarray:
    """Integer scores, candidates by queries; a query's own row gets the least value."""
    limit = float(np.abs(vec).max(initial=0)) * float(np.abs(q).max(initial=0)) * vec.shape[1]
    if limit < 2**53:
        s = (vec.astype(np.float64) @ q.T.astype(np.float64)).astype(np.int64)
    else:
        s = vec @ q.T
    own = np.searchsorted(qids, ids)
    hit = np.flatnonzero((own < len(qids)) & (qids[np.minimum(own, len(qids) - 1)] == ids))
    s[hit, own[hit]] = np.iinfo(np.int64).min
    return s


def _histogram(q, qids, low, width, k):
    """Counts of scores in BINS bins of `width` from `low` (per query); the last bin also holds all above."""

    def run(batches):
        dim, n = q.shape[1], len(qids)
        counts = np.zeros((n, BINS + 1), np.int64)
        base = np.arange(n, dtype=np.int64) * (BINS + 1)
        for ids, vec in _chunks(batches, dim):
            s = _scores(vec, ids, q, qids)
            keep = s >= low[None, :]
            c, j = np.nonzero(keep)
            b = np.minimum((s[c, j] - low[j]) // width[j], BINS)
            counts += np.bincount(base[j] + b, minlength=n * (BINS + 1)).reshape(n, BINS + 1)
        above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1]
        useful = (counts > 0) & (above - counts < k)
        i, b = np.nonzero(useful)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(counts[i, b])], ["i", "b", "n"])

    return run


def _winners(q, qids, kth, k):
    """Scores above the k-th value, and this task's k smallest ids at it."""

    def run(batches):
        dim = q.shape[1]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        ties: list[tuple[np.ndarray, np.ndarray]] = []
        for ids, vec in _chunks(batches, dim):
            s = _scores(vec, ids, q, qids)
            c, j = np.nonzero(s > kth[None, :])
            found.append((j, ids[c], s[c, j]))
            c, j = np.nonzero((s == kth[None, :]) & (s > np.iinfo(np.int64).min))
            ties.append(_least(j, ids[c], k))
            if len(ties) > 16:
                ties = [_least(np.concatenate([x[0] for x in ties]), np.concatenate([x[1] for x in ties]), k)]
        if not found:
            return
        j = np.concatenate([x[0] for x in found])
        tj, tid = _least(np.concatenate([x[0] for x in ties]), np.concatenate([x[1] for x in ties]), k)
        at = np.concatenate([j, tj])
        yield pa.RecordBatch.from_arrays(
            [pa.array(qids[at]), pa.array(np.concatenate([*[x[1] for x in found], tid])), pa.array(np.concatenate([*[x[2] for x in found], kth[tj]]))],
            ["query_id", "vec_id", "score"],
        )

    return run


def _least(j: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k smallest ids of each j."""
    order = np.lexsort((ids, j))
    j, ids = j[order], ids[order]
    first = np.searchsorted(j, j, side="left")
    keep = np.arange(len(j)) - first < k
    return j[keep], ids[keep]


def integer_vectors(df: DataFrame, scale: float, id_col: str, vec_col: str) -> DataFrame:
    v = F.transform(F.col(vec_col), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    ok = F.col(vec_col).isNotNull() & F.col(id_col).isNotNull() & F.forall(F.col(vec_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.where(F.coalesce(ok, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), v.cast("array<bigint>").alias("v"))


def top_k(df: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k highest scores of each query (ids divisible by `every`).

    Rows that share an id are one query, by the least of their vectors, and candidates each. Vectors of another length than
    most have take no part. Other columns are ignored; an empty table gives no rows.
    """
    spark = df.sparkSession
    vecs = materialize(integer_vectors(df, scale, id_col, vec_col), "vectors")
    dims = vecs.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    blocks: list[DataFrame] = []
    if dims and dims[0]["d"] > 0:
        vecs = vecs.where(F.size("v") == dims[0]["d"])
        queries = vecs.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
        last = None
        while True:  # blocks in id order; one block at a time is held here
            part = queries if last is None else queries.where(F.col("id") > last)
            rows = part.orderBy("id").limit(BLOCK_QUERIES).collect()
            if not rows:
                break
            last = rows[-1]["id"]
            blocks.append(_block(vecs, np.array([r["v"] for r in rows], np.int64), np.array([r["id"] for r in rows], np.int64), k))
            if len(rows) < BLOCK_QUERIES:
                break
    if not blocks:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rows = blocks[0]
    for b in blocks[1:]:
        rows = rows.unionByName(b)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _block(vecs: DataFrame, q: np.ndarray, qids: np.ndarray, k: int) -> DataFrame:
    n = len(qids)
    bound = vecs.select(F.max(F.aggregate("v", F.lit(0).cast("bigint"), lambda a, x: F.greatest(a, F.abs(x))))).first()[0] or 0
    most = int(bound) * int(np.abs(q).sum(axis=1).max(initial=0)) + 1
    low = np.full(n, -most, np.int64)
    width = np.full(n, -(-(2 * most + 1) // BINS), np.int64)
    kth = np.full(n, np.iinfo(np.int64).min, np.int64)
    live = np.arange(n)
    while len(live):
        got = vecs.mapInArrow(_histogram(q[live], qids[live], low[live], width[live], k), "i int, b int, n long").groupBy("i", "b").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros((len(live), BINS + 1), np.int64)
        counts[got["i"].to_numpy(), got["b"].to_numpy()] = got["n"].to_numpy()
        above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1]  # at or above bin b
        enough = above >= k
        has = enough.any(axis=1)
        b = BINS - np.argmax(enough[:, ::-1], axis=1)  # the highest bin that reaches k
        done = ~has | (width[live] == 1)
        kth[live[has]] = low[live[has]] + b[has] * width[live[has]]
        low[live[has]] += b[has] * width[live[has]]
        kth[live[~has]] = -most - 1  # fewer than k candidates: all
        width[live] = -(-width[live] // BINS)
        live = live[~done]
    return vecs.mapInArrow(_winners(q, qids, kth, k), "query_id long, vec_id long, score long")

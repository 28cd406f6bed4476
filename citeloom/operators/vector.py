"""Exact cosine search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries held by a task at once.
BLOCK = 1024


def cosine_top_k(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, doc_id, score, rk. docs: doc_id, v; queries: query_id, v. Blocks of queries against all documents; a task
    keeps a running k best and sends them at its end. Null vectors and ones of another length than the queries' take no part."""
    q = queries.where(F.col("v").isNotNull())
    numbered = q.select(F.col("query_id").cast("long").alias("query_id"), "v", F.row_number().over(Window.orderBy("query_id", F.xxhash64("v"))).alias("no"))
    out = None
    for at in range(0, q.count(), BLOCK):  # queries are a stated set; a block of them travels to the tasks
        got = numbered.where(F.col("no").between(at + 1, at + BLOCK)).orderBy("no").toArrow()
        vectors = _matrix(got["v"].combine_chunks(), None)[0]
        block = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "v").mapInArrow(_search(got["query_id"].to_numpy(), vectors, k), "query_id long, doc_id long, score double")
        out = block if out is None else out.unionByName(block)
    if out is None:
        return docs.sparkSession.createDataFrame([], "query_id long, doc_id long, score double, rk int")
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), "doc_id")
    return out.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)


def _matrix(column: pa.Array, width: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows of a list column, and which rows they are of; others than `width` long (the first row's, if None) are left out."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(column.offsets.to_numpy())
    known = column.is_valid().to_numpy(zero_copy_only=False)
    width = int(size[known][0]) if width is None and known.any() else width or 0
    rows = np.flatnonzero(known & (size == width))
    flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width) if width else np.zeros((len(rows), 0))
    return flat / np.maximum(np.linalg.norm(flat, axis=1, keepdims=True), 1e-12), rows


def _search(ids: np.ndarray, q: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(ids), 0), -np.inf)
        docs = np.zeros((len(ids), 0), np.int64)
        for batch in batches:
            v, rows = _matrix(batch.column("v"), q.shape[1])
            if not len(rows):
                continue
            doc = batch.column("doc_id").to_numpy(zero_copy_only=False)[rows].astype(np.int64)
            scores = np.concatenate([best, np.round(q @ v.T, 12)], axis=1)
            names = np.concatenate([docs, np.broadcast_to(doc, (len(ids), len(doc)))], axis=1)
            if scores.shape[1] > k:  # all that tie with the k-th stay in play, the smaller ids of them are kept
                order = np.lexsort((names, -np.round(scores, 6)), axis=1)[:, :k]
                scores, names = np.take_along_axis(scores, order, 1), np.take_along_axis(names, order, 1)
            best, docs = scores, names
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, best.shape[1])), pa.array(docs.ravel()), pa.array(best.ravel())], ["query_id", "doc_id", "score"])

    return run

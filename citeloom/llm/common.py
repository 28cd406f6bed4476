"""Shared pieces: tables in the cluster's shared folder, gapless ranks, Arrow text blocks, vectorised hashing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles; a single longer text is handled alone.
BLOCK_BYTES = 1 << 20
#: Bytes of a batch of rows sent to Python where Spark's own default, 64 MB, would hold.
BATCH_BYTES, _SPARKS = 4 << 20, 64 << 20


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python in batches of BATCH_BYTES or so: the buffers of one batch stand in the executor beside its heap, and again in
    the worker. A size that the session was given stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in (f"{_SPARKS}b", "64m", "64MB"):
        spark.conf.set(key, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; only a local session that names none gets one made."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="citeloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def materialize(df: DataFrame, name: str, **options: str | int) -> DataFrame:
    """Cuts the lineage: writes df as a Parquet table in the shared folder and reads it again. options: of the writer."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gapless_rank(df: DataFrame, keys: list[str], ties: list[Column], salt: list[Column], rows: int, name: str) -> DataFrame:
    """Adds `name`: 0, 1, 2, ... within each value of `keys`, however large a group is.

    Rows of a group are dealt into hash cells of a bounded size; cells are counted, the counts are summed up per key, and
    a row's number is its cell's offset plus its place in the cell. Keys are not null. Only `rows`/20,000 (512 at least) counts per key meet.
    """
    cells = int(max(512, rows // 20_000))
    df = df.withColumn("_cell", F.pmod(F.xxhash64(*salt), F.lit(cells)))
    counts = df.groupBy(*keys, "_cell").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(upto), F.lit(0))).drop("_n")
    place = F.row_number().over(Window.partitionBy(*keys, "_cell").orderBy(*ties))
    joined = df.withColumn("_place", place).join(starts, [*keys, "_cell"])
    return joined.select(*[c for c in df.columns if c != "_cell"], (F.col("_start") + F.col("_place") - 1).cast("long").alias(name))


def text_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column laid end to end, and the offsets of its rows; a null is empty."""
    arr = arr.combine_chunks() if isinstance(arr, pa.ChunkedArray) else arr
    arr = arr.cast(pa.large_string())
    if arr.null_count:
        arr = arr.fill_null("")
    offs = np.frombuffer(arr.buffers()[1], dtype=np.int64)[arr.offset : arr.offset + len(arr) + 1]
    raw = arr.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offs[0] : offs[-1]] if raw is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def _release() -> None:
    """Gives freed memory back to the system: a worker process lives through many tasks of different sizes."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows of at most `limit` bytes of text: (rows, bytes, offsets)."""
    seen = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offs = text_bytes(batch.column(column))
        lo, n = 0, batch.num_rows
        while lo < n:
            hi = int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1
            hi = min(n, max(lo + 1, hi))
            yield batch.slice(lo, hi - lo), data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
            lo = hi
        seen += len(data)
    if seen > limit:
        _release()


_MUL = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, BLOCK_BYTES + 4096)
        both = []
        for base in (_MUL, _INV):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _POWERS[:] = both
    return _POWERS[0], _POWERS[1]


def prefix_hashes(values: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash modulo 2**64: `span_hash` gives any span's hash in constant time."""
    n = len(values)
    out = np.zeros(n + 1, np.uint64)
    if n:
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * _powers(n)[0][:n], out=out[1:])
    return out


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end)."""
    inv = _powers(len(prefix))[1]
    return mix((prefix[end] - prefix[start]) * inv[start] + (end - start).astype(np.uint64))


#: Bytes that separate words: blank and \x09 to \x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(data: np.ndarray, offs: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes that aren't in `gap`, cut where a document ends: (starts, ends, document of each)."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~gap[data]
    first = np.zeros(n + 1, bool)
    first[offs] = True
    prev = np.empty(n, bool)
    prev[0] = False
    prev[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~prev | first[:n]))
    nxt = np.empty(n, bool)
    nxt[-1] = False
    nxt[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~nxt | first[1:])) + 1
    docs = np.searchsorted(offs, starts, side="right") - 1
    return starts, ends, docs


def word_hashes(data: np.ndarray, offs: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, document) of each word, A-Z lower-cased."""
    starts, ends, docs = word_spans(data, offs, gap)
    return span_hash(prefix_hashes(LOWER[data]), starts, ends), docs


#: For word shingles: everything below 0x80 that isn't a letter or digit separates words.
NONWORD = np.ones(256, bool)
NONWORD[128:] = False
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    NONWORD[_a:_b] = False

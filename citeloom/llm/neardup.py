"""N-gram Jaccard join by MinHash banding, verified on full n-gram sets.

A document's n-grams are runs of five words (letters, digits and bytes from 0x80 on; A-Z lower-cased), as 64-bit hashes;
fewer words make one n-gram. Documents with equal sets form a class, which takes part once. Band and row counts come from
the recall wanted at the threshold. Band hashes are shuffled; classes that share a band are connected, and what is
connected is verified on full sets. A connected set that fits a block has all its pairs verified there, each text sent
once. A larger one is taken apart into its band cells (the classes that share one band hash), and a pair is verified in the
first cell it shares, so chains of cells cost no more than the cells. A cell larger than a block is dealt into square blocks
over many tasks. A block gives sums per class, never pairs. Within a cell of m different texts m * m / 2 pairs are compared
and m * m / BLOCK_DOCS texts are sent: exact numbers of links need that much.

Every row is a document of its own; rows equal in doc_id and text are copies of each other like any others. Rows that share
a doc_id but not the text are told apart by their text. No n-grams (null or wordless text): a class of its own without
links. Null ids stay null; they come after all others, and where a class_id or copy_id has only such rows to name, it is a
negative hash of the text. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NONWORD, blocks, materialize, mix, prefix_hashes, span_hash, word_spans
from .graph import components

#: Classes of a block and bytes of its texts; candidates (some 60 bytes each) that may be broadcast; columns of a product.
BLOCK_DOCS, BLOCK_TEXT, BROADCAST_ROWS, COLUMNS = 256, 16 << 20, 400_000, 2048
#: Tasks that a connected set is dealt over when its classes learn its first document.
SALT = 16
_KEY = ("z", "k", "a", "b")


def bands_for(threshold: float, recall: float) -> tuple[int, int]:
    """(bands, rows) with 1 - (1 - t^rows)^bands >= recall: of row counts up to 8 the one that lets least of a similarity of half the threshold pass, within 64 hashes."""
    best = None
    for rows in range(1, 9):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))
        noise = 1 - (1 - (threshold / 2) ** rows) ** bands
        if bands * rows <= 64 and (best is None or noise < best[0]):
            best = (noise, bands, rows)
    return best[1], best[2]


def shingles(data: np.ndarray, offs: np.ndarray, n: int) -> list[np.ndarray]:
    """The sorted n-gram hashes of each document."""
    starts, ends, docs = word_spans(data, offs, NONWORD)
    w = span_hash(prefix_hashes(LOWER[data]), starts, ends)
    count = len(offs) - 1
    begin = np.searchsorted(docs, np.arange(count + 1))
    m = max(0, len(w) - n + 1)
    h = np.zeros(m, np.uint64)
    for k in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[k : k + m]
    h = mix(h)
    out = []
    for d in range(count):
        a, b = begin[d], begin[d + 1]
        if b - a >= n:
            out.append(np.unique(h[a : b - n + 1]))
        elif b > a:
            x = np.uint64(b - a)
            for v in w[a:b]:
                x = x * np.uint64(0x9E3779B97F4A7C15) + v
            out.append(mix(np.array([x])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _signatures(n: int, bands: int, rows: int):
    rng = np.random.default_rng(97)
    mul = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) | np.uint64(1)
    add = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch, data, offs in blocks(batches, "text"):
                sets = shingles(data, offs, n)
                size = np.array([len(s) for s in sets], np.int64)
                some = np.flatnonzero(size)
                band = np.zeros((len(sets), bands), np.uint64)
                f1, f2 = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
                if len(some):
                    flat = np.concatenate(sets)
                    at = (np.cumsum(size) - size)[some]
                    f1[some] = np.add.reduceat(mix(flat + np.uint64(1)), at)
                    f2[some] = np.add.reduceat(mix(flat + np.uint64(2)), at)
                    for j in range(bands * rows):
                        least = np.minimum.reduceat(flat * mul[j] + add[j], at)
                        band[some, j // rows] = mix(band[some, j // rows] * np.uint64(0x9E3779B97F4A7C15) + least + np.uint64(j))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(size > 0, bands, 0))]).astype(np.int32)), pa.array(band[some].ravel().view(np.int64)))
                own = [batch.column(c) for c in ("doc_id", *_KEY)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.diff(offs)), pa.array(size), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), lists], ["doc_id", *_KEY, "bytes", "size", "f1", "f2", "bands"])

    return run


def _overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """|A n B| for rows `left` against rows `right`. Columns that occur in the same documents count as one with a weight."""
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, col, count = np.unique(flat, return_inverse=True, return_counts=True)
    keep = count[col] > 1
    row, col = row[keep], col[keep]
    mark = np.zeros(len(count), np.uint64)
    np.add.at(mark, col, mix(row.astype(np.uint64) + np.uint64(7)))
    patterns, first, weight = np.unique(mark[count > 1], return_index=True, return_counts=True)
    chosen = np.full(len(count), -1, np.int64)
    chosen[np.flatnonzero(count > 1)[first]] = np.arange(len(first))
    pick = chosen[col] >= 0
    row, col = row[pick], chosen[col[pick]]
    out = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for lo in range(0, len(patterns), COLUMNS):
        a, b = np.searchsorted(col, (lo, lo + COLUMNS))
        x = np.zeros((len(sets), min(COLUMNS, len(patterns) - lo)), np.float32)
        x[row[a:b], col[a:b] - lo] = 1
        out += (x[left] * weight[lo : lo + x.shape[1]].astype(np.float32)) @ x[right].T
    return out


def _verify(n: int, threshold: float):
    """Sums per class over its block: copies behind its links, and the least class it is connected with there."""

    def group(rows: list[tuple], band: int, i: int, j: int) -> tuple[list, list, list]:
        rows = list({r[0]: r for r in rows}.values())
        texts = pa.array([r[1] for r in rows])
        sets = [s for _, data, offs in blocks(iter([pa.RecordBatch.from_arrays([texts], ["text"])]), "text") for s in shingles(data, offs, n)]
        ids, copies, side = (np.array([r[c] for r in rows]) for c in (0, 2, 3))
        left = np.flatnonzero(side == i)
        right = left if i == j else np.flatnonzero(side == j)
        if not len(left) or not len(right):
            return [], [], []
        size = np.array([len(s) for s in sets], np.float64)
        over = _overlaps(sets, left, right).astype(np.float64)
        linked = over >= threshold * (size[left][:, None] + size[right][None, :] - over) - 1e-9
        if i == j:
            np.fill_diagonal(linked, False)
        if band >= 0:  # this must be the first band that the two share
            bands = np.array([r[4] for r in rows])
            linked &= bands[left, band][:, None] == bands[right, band][None, :]
            for k in range(band):
                linked &= bands[left, k][:, None] != bands[right, k][None, :]
        root = ids.copy()
        while True:  # least id over links until nothing changes
            big = np.iinfo(np.int64).max
            new = root.copy()
            new[left] = np.minimum(new[left], np.where(linked, root[right][None, :], big).min(axis=1))
            new[right] = np.minimum(new[right], np.where(linked, new[left][:, None], big).min(axis=0))
            if (new == root).all():
                break
            root = new
        links = np.zeros(len(rows), np.int64)
        links[left] += linked @ copies[right]
        if i != j:
            links[right] += linked.T @ copies[left]
        hit = np.flatnonzero(links)
        return ids[hit].tolist(), root[hit].tolist(), links[hit].tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def flush():
            out = group(rows, *key[1:])
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["a", "b", "links"])

        with np.errstate(over="ignore"):
            for batch in batches:
                cols = [batch.column(c).to_pylist() for c in ("cell", "band", "i", "j", "v", "text", "n", "blk", "bands")]
                for cell, band, i, j, *row in zip(*cols, strict=True):
                    if key != (cell, band, i, j):
                        if rows:
                            yield flush()
                        key, rows = (cell, band, i, j), []
                    rows.append(tuple(row))
            if rows:
                yield flush()

    return run


def _blocks(members: DataFrame) -> DataFrame:
    """cell, band, nb: the blocks that the rows of a cell are dealt into."""
    return members.groupBy("cell", "band").agg(F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("bytes") / BLOCK_TEXT)).cast("int").alias("nb"))


def join(docs: DataFrame, threshold: float = 0.8, n: int = 5, recall: float = 0.9995, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id (least doc_id of those connected by links), copy_id (least doc_id with the same n-grams), n_links, and
    leads (whether it is the one of its connected group that comes first), text_a, text_b (hashes of the text that tell rows of a doc_id apart)."""
    spark = docs.sparkSession
    bands, rows = bands_for(threshold, recall)
    ident = F.col(id_col).cast("long")
    keyed = docs.select(ident.alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("a"), F.xxhash64(F.lit(1), text_col).alias("b"))
    keyed = keyed.select("*", F.col("doc_id").isNull().alias("z"), F.coalesce("doc_id", F.col("a").bitwiseOR(F.lit(-(1 << 63)))).alias("k"))
    sig = materialize(keyed.mapInArrow(_signatures(n, bands, rows), "doc_id long, z boolean, k long, a long, b long, bytes long, size long, f1 long, f2 long, bands array<long>"), "signatures")
    some = sig.where("size > 0")
    lead = F.struct(*_KEY)
    classes = some.groupBy("f1", "f2").agg(F.min(lead).alias("lead"), F.count("*").alias("n"), F.max("bytes").alias("bytes"), F.first("bands").alias("bands"))
    classes = materialize(classes.withColumn("v", F.monotonically_increasing_id()), "classes")
    spread = classes.select("v", F.posexplode("bands").alias("band", "h"))
    shared = materialize(spread.groupBy("band", "h").agg(F.min("v").alias("pivot"), F.max("v").alias("most")).where("pivot < most").select("band", "h", "pivot"), "bands")
    found = spread.join(shared, ["band", "h"])
    comp = components(found.select(F.col("pivot").alias("a"), F.col("v").alias("b")))
    cand = comp.join(classes, "v").select("v", "lead.*", "n", "bytes", "bands", F.col("c").alias("cell"), F.lit(-1).alias("band"))
    cand = materialize(cand, "candidates")
    size = materialize(_blocks(cand), "sizes")
    large = size.where("nb > 1").select("cell")
    members = cand.join(size.where("nb = 1"), ["cell", "band"]).withColumn("bands", F.lit(None).cast("array<long>"))
    if not large.isEmpty():
        apart = cand.join(large, "cell").drop("cell", "band").select("*", F.posexplode("bands").alias("band", "h"))
        apart = materialize(apart.join(shared.select("band", "h"), ["band", "h"]).withColumn("cell", F.xxhash64("band", "h")).drop("h"), "cells")
        members = members.unionByName(apart.join(_blocks(apart), ["cell", "band"]))
    few = members.count() <= BROADCAST_ROWS
    texts = keyed.where(F.col("text").isNotNull()).select(*_KEY, "text")
    full = texts.join(F.broadcast(members) if few else members, [*_KEY])
    dealt = full.withColumn("blk", F.pmod(F.xxhash64("v"), F.col("nb")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    dealt = dealt.withColumn("i", F.least("blk", "o")).withColumn("j", F.greatest("blk", "o"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spot = F.pmod(F.xxhash64("cell", "band") + F.col("i") * F.col("nb") + F.col("j") - F.floor(F.col("i") * (F.col("i") + 1) / 2), F.lit(parts)).cast("int")
    placed = dealt.select(spot.alias("spot"), "cell", "band", "i", "j", "v", "text", "n", "blk", "bands")
    placed = placed.repartitionById(parts, "spot").sortWithinPartitions("cell", "band", "i", "j", "v")
    found = materialize(placed.drop("spot").mapInArrow(_verify(n, threshold), "a long, b long, links long"), "links")
    links = found.groupBy(F.col("a").alias("v")).agg(F.sum("links").alias("links"))
    labels = components(found)
    first = labels.join(classes.select("v", "lead"), "v").groupBy("c").agg(F.min("lead").alias("first"))
    spots = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))  # a large connected set is dealt over several tasks
    named = labels.withColumn("s", F.pmod("v", F.lit(SALT)).cast("int")).join(first.withColumn("s", spots), ["c", "s"]).select("v", "first")
    about = classes.select("f1", "f2", "v", "lead", "n").join(named, "v", "left").join(links, "v", "left")
    about = materialize(about.select("f1", "f2", F.coalesce("first", "lead").alias("first"), "lead", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")), "about")
    named = some.select("doc_id", lead.alias("own"), "f1", "f2").join(about, ["f1", "f2"])
    hashes = lambda c: [F.col(f"{c}a").alias("text_a"), F.col(f"{c}b").alias("text_b")]
    named = named.select("doc_id", F.col("first.k").alias("class_id"), F.col("lead.k").alias("copy_id"), "n_links", (F.col("own") == F.col("first")).alias("leads"), *hashes("own."))
    alone = sig.where("size = 0").select("doc_id", F.col("k").alias("class_id"), F.col("k").alias("copy_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("leads"), *hashes(""))
    return named.unionByName(alone)

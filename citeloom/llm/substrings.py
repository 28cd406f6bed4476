"""Removal of repeated 50-byte strings by prefix-free parsing and suffix sorting.

Parsing. A rolling hash over 16 bytes triggers phrase starts, so equal text is parsed alike wherever it stands. A unit is a
phrase with the `span` - 1 bytes that follow it in the parse: it holds every string of `span` bytes that starts in the
phrase. Units are known by 128-bit BLAKE2 digests of their bytes. A unit that a smaller doc_id bears is removed wherever
else it stands, and only its first bearers go on; highly repetitive text is settled here, on one row a different unit.

Suffix sorting. What first bearers still share lies around a shared piece: every string of `span` bytes has a least piece
of PIECE bytes, and equal strings have the same. Pieces that stand in several documents are sought by 32-bit hashes in
buckets. The stretches of text around them are sent, and in a bucket the different stretches are the dictionary, their
places the parse. The dictionary's suffixes are sorted by their bytes, `span` deep, into a suffix array; as the parse
decides nothing beyond `span` bytes, its array is the order of the bearers (doc_id, place) of a stretch. Put together they
are the corpus order: a run of equal strings with its bearers, all but the least of which lose the string. Hashes only
choose what is compared there; bytes decide.

Memory. Documents travel as rows of about a megabyte and are worked on in chunks; a bucket answers for BUCKET_BYTES of text
and is sorted in slices of SLICE starts. A piece that more than HOT rows bear goes another way: its strings are grouped by
their bytes in a plain aggregation, which combines before the shuffle, and joined back. Answers for rows are broadcast below
BROADCAST_BYTES; a corpus above BUCKETED_BYTES is written in buckets by row, so that answers are dealt to its rows and the
corpus itself isn't shuffled again.

Null texts are empty, null ids count as the largest id, rows of equal id as one document. A text below `span` bytes keeps
all. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, materialize, mix, prefix_hashes, shared_dir, span_hash

#: Bytes of a row of documents; bytes hashed at once; bytes of text a bucket of pieces answers for; starts sorted at once.
ROW_BYTES, CHUNK, BUCKET_BYTES, SLICE = 1 << 20, 1 << 20, 8 << 20, 1 << 19
#: Rows that may bear a piece in its bucket; answers that may be broadcast; corpus from which on rows are written in buckets.
HOT, BROADCAST_BYTES, BUCKETED_BYTES = 20_000, 40 << 20, 2 << 30
#: Text of a bucket of rows, which one task reads; of a Parquet row group there, which its reader holds at once; most such buckets.
PART_BYTES, GROUP_BYTES, MOST_PARTS = 32 << 20, 8 << 20, 50_000
#: Width of the trigger, mean length of a phrase, width of a piece.
TRIGGER, PHRASE, PIECE = 16, 192, 28
#: How rows are written: so many to a row group. Else the writer looks at a group's size from 100 rows on only, and groups of 100 MB and more
#: stand, which a reader holds at once, its vector doubled.
_SMALL_GROUPS = {"parquet.block.size": GROUP_BYTES, "parquet.block.row.count.limit": GROUP_BYTES // ROW_BYTES, "parquet.page.size.row.check.min": 1}
_MOST = (1 << 63) - 1
_ROW = "row long, ids array<long>, offs array<int>, starts array<int>, data binary"
_NONE = np.zeros(0, np.int64)
_SPAN = np.uint32


def _phrases(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where phrases start: at triggers, and where a document begins."""
    found = [offs[:-1][np.diff(offs) > 0]]
    for a in range(0, len(data) - TRIGGER + 1, CHUNK):
        part = data[a : a + CHUNK + TRIGGER - 1]
        at = np.arange(len(part) - TRIGGER + 1)
        hit = a + at[span_hash(prefix_hashes(part), at, at + TRIGGER) % np.uint64(PHRASE) == 0]
        doc = np.searchsorted(offs, hit, side="right") - 1
        found.append(hit[hit + TRIGGER <= offs[doc + 1]])
    return np.unique(np.concatenate(found))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 32
    ints = pa.list_(pa.int32())
    for batch, data, offs in blocks(batches, "text", ROW_BYTES):
        cols = [pa.array([row], pa.int64()), pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())), pa.array([offs.astype(np.int32)], ints), pa.array([_phrases(data, offs).astype(np.int32)], ints), pa.array([data.tobytes()], pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, ["row", "ids", "offs", "starts", "data"])
        row += 1


class Row:
    """A row of documents: bytes, offsets, ids, and its phrases."""

    def __init__(self, batch: pa.RecordBatch, i: int, span: int):
        get = lambda c: batch.column(c)[i]
        self.row, self.span = get("row").as_py(), span
        self.data = np.frombuffer(get("data").as_buffer(), np.uint8)
        self.offs = get("offs").values.to_numpy().astype(np.int64)
        self.start = get("starts").values.to_numpy().astype(np.int64)
        ids = get("ids").values
        self.raw_ids = ids.to_pylist()
        self.ids = ids.fill_null(_MOST).to_numpy()
        self.doc = np.searchsorted(self.offs, self.start, side="right") - 1
        self.end = np.minimum(np.append(self.start[1:], len(self.data)), self.offs[self.doc + 1])
        self.gone = _NONE
        if "settled" in batch.schema.names and (found := get("settled").values) is not None:
            places = found.field("places")
            least = np.repeat(found.field("least").to_numpy(), pc.list_value_length(places).to_numpy())
            at = places.flatten().to_numpy().astype(np.int64)
            self.gone = at[self.ids[self.doc[at]] > least]

    def units(self) -> list[bytes]:
        data, stop = memoryview(self.data), np.minimum(self.end + self.span - 1, self.offs[self.doc + 1])
        return [hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(self.start.tolist(), stop.tolist(), strict=True)]

    def last(self) -> np.ndarray:
        """Behind the last start of a string in each phrase."""
        return np.minimum(self.end, self.offs[self.doc + 1] - self.span + 1)

    def pieces(self):
        """The least pieces of the strings that start in phrases not settled: (keys, documents, first and last start of a string of each)."""
        n, span = len(self.data), self.span
        wide, m = span - PIECE + 1, n - span + 1
        if m <= 0:
            return np.zeros(0, np.uint64), _NONE, _NONE, _NONE
        alive = np.ones(len(self.start), bool)
        alive[self.gone] = False
        last = self.last()
        ok = alive & (last > self.start)
        edge = np.zeros(n + 1, np.int8)
        edge[self.start[ok]] += 1
        np.subtract.at(edge, last[ok], 1)
        is_open = np.cumsum(edge, dtype=np.int8)[:m] > 0
        keys, places, begins = [], [], []
        for a in range(0, m, CHUNK):
            begin = np.flatnonzero(is_open[a : a + CHUNK])
            if not len(begin):
                continue
            part = self.data[a : a + CHUNK + span - 1]
            at = np.arange(len(part) - PIECE + 1)
            key = span_hash(prefix_hashes(part), at, at + PIECE)
            x = (key & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
            size = 1
            while 2 * size <= wide:
                x = np.minimum(x[:-size], x[size:])
                size *= 2
            if size < wide:
                x = np.minimum(x[: len(x) - (wide - size)], x[wide - size :])
            place = (x[begin] & np.uint64(0xFFFFFFFF)).astype(np.int64)
            keys.append(key[place])
            places.append(a + place)
            begins.append(a + begin)
        if not keys:
            return np.zeros(0, np.uint64), _NONE, _NONE, _NONE
        key, place, begin = map(np.concatenate, (keys, places, begins))
        head = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (begin[1:] != begin[:-1] + 1)))
        tail = np.append(head[1:], len(begin)) - 1
        # Least hashes crowd near 0; mixed (one to one), they fall evenly into buckets.
        return mix(key[head]), np.searchsorted(self.offs, begin[head], side="right") - 1, begin[head], begin[tail]


def _each(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[tuple[Row, pa.RecordBatch, int]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Row(batch, i, span), batch, i


def _runs(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of runs of equal values."""
    cut = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else _NONE
    return cut, np.append(cut[1:], len(a)) if len(a) else _NONE


def _units(span: int):
    """Each different unit of a row once: digest, least and largest bearer, its phrases."""

    def run(batches):
        for r, _, _ in _each(batches, span):
            found: dict[bytes, list[int]] = {}
            for i, d in enumerate(r.units()):
                found.setdefault(d, []).append(i)
            if not found:
                continue
            digest = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
            size = np.fromiter(map(len, found.values()), np.int64, len(found))
            begin = np.append(0, np.cumsum(size))
            flat = np.concatenate([np.array(v, np.int32) for v in found.values()])
            ids = r.ids[r.doc[flat]]
            cols = [pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy()), pa.array(np.minimum.reduceat(ids, begin[:-1])), pa.array(np.maximum.reduceat(ids, begin[:-1])), pa.array(np.full(len(size), r.row)), pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(flat))]
            yield pa.RecordBatch.from_arrays(cols, ["h", "g", "lo", "hi", "row", "places"])

    return run


def _bucket(key: np.ndarray, n: int) -> np.ndarray:
    return ((key >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _ask(span: int, buckets: int):
    """Per row and bucket: the different pieces (32 bits each) and whether the row has each in several documents."""

    def run(batches):
        for r, _, _ in _each(batches, span):
            key, doc, _, _ = r.pieces()
            order = np.argsort(key, kind="stable")
            u, doc = key[order], doc[order]  # documents ascend within a key
            head, end = _runs(u)
            u, many = u[head], doc[head] < doc[end - 1] if len(head) else _NONE
            b = _bucket(u, buckets)
            cut, ends = _runs(b)
            low = mix(u).astype(np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array(b[cut].astype(np.int32)), pa.array(np.full(len(cut), r.row)), pa.array([low[x:y].tobytes() for x, y in zip(cut, ends, strict=True)], pa.binary()), pa.array([np.packbits(many[x:y]).tobytes() for x, y in zip(cut, ends, strict=True)], pa.binary())], ["bucket", "row", "keys", "many"])

    return run


def _answer(hot_rows: int):
    """For each row of a bucket: which of its pieces stand in several documents, and which of them in very many rows."""

    def run(t: pa.Table) -> pa.Table:
        keys = [np.frombuffer(k, np.uint32) for k in t["keys"].to_pylist()]
        many = [np.unpackbits(np.frombuffer(m, np.uint8), count=len(k)) for m, k in zip(t["many"].to_pylist(), keys, strict=True)]
        flat = np.concatenate(keys)
        u, inv, count = np.unique(flat, return_inverse=True, return_counts=True)
        hot = ((count > 1) | (np.bincount(inv, np.concatenate(many), len(u)) > 0))[inv]
        very = (count > hot_rows)[inv]
        cut = np.cumsum([0, *map(len, keys)])
        bits = lambda x, a, b: np.packbits(x[a:b]).tobytes() if x[a:b].any() else None
        cols = [pa.array([bits(x, a, b) for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()) for x in (hot, very)]
        return pa.table({"row": t["row"], "bucket": t["bucket"], "hot": cols[0], "very": cols[1]})

    return run


def _chosen(r: Row, batch: pa.RecordBatch, i: int, buckets: int):
    """The pieces of a row with their answers: (buckets, keys, documents, first and last starts, whether hot, whether in very many rows)."""
    key, doc, first, last = r.pieces()
    u, inv = np.unique(key, return_inverse=True)
    b = _bucket(u, buckets)
    hot, very = np.zeros(len(u), bool), np.zeros(len(u), bool)
    for a in batch.column("answers")[i].as_py() or ():
        x, y = np.searchsorted(b, (a["bucket"], a["bucket"] + 1))
        for mark, bits in ((hot, a["hot"]), (very, a["very"])):
            if bits:
                mark[x:y] = np.unpackbits(np.frombuffer(bits, np.uint8), count=y - x).astype(bool)
    return b[inv], key, doc, first, last, hot[inv], very[inv]


def _send(span: int, buckets: int):
    """The stretches around pieces that stand in several documents, but those of pieces in very many rows."""

    def run(batches):
        for r, batch, i in _each(batches, span):
            if not batch.column("answers")[i].as_py():
                continue
            where, key, doc, first, last, hot, very = _chosen(r, batch, i, buckets)
            pick = np.flatnonzero(hot & ~very)
            pick = pick[np.argsort(where[pick], kind="stable")]
            raw, low = r.data.tobytes(), (mix(key) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            out = [[] for _ in range(7)]
            for x, y in zip(*_runs(where[pick]), strict=True):
                p = pick[x:y]
                f, n = first[p], last[p] - first[p] + span
                texts = b"".join([raw[s : s + c] for s, c in zip(f.tolist(), n.tolist(), strict=True)])
                for col, v in zip(out, (int(where[p[0]]), r.row, low[p].tobytes(), r.ids[doc[p]].tobytes(), f.astype(np.uint32).tobytes(), n.astype(np.uint16).tobytes(), texts), strict=True):
                    col.append(v)
            kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 5)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["bucket", "row", "key", "doc", "first", "n", "data"])

    return run


def _strings(span: int, buckets: int):
    """The strings around pieces in very many rows, one by one: each different one once a document."""

    def run(batches):
        for r, batch, i in _each(batches, span):
            if not batch.column("answers")[i].as_py():
                continue
            _, _, doc, first, last, _, very = _chosen(r, batch, i, buckets)
            raw, found = r.data.tobytes(), {}
            for d, a, b in zip(r.ids[doc[very]].tolist(), first[very].tolist(), last[very].tolist(), strict=True):
                for at in range(a, b + 1):
                    found.setdefault((raw[at : at + span], d), []).append(at)
            cols = [pa.array([k[0] for k in found], pa.binary()), pa.array([k[1] for k in found], pa.int64()), pa.array([r.row] * len(found), pa.int64()), pa.array(list(found.values()), pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, ["s", "doc", "row", "at"])

    return run


def suffix_array(data: bytes, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The starts in the order of the `depth` bytes that follow them, and which differ from the one before.

    Eight bytes at a time from the left: only runs that are still equal are sorted on.
    """
    view = np.ndarray((max(0, len(data) - 7),), ">u8", data, strides=(1,))
    order = np.arange(len(starts))
    differs = np.zeros(len(starts), bool)
    differs[:1] = True
    todo = order.copy()  # places of the array whose run isn't alone yet
    for k in [*range(0, depth - 7, 8), *([depth - 8] if depth % 8 else [])]:
        key = view[starts[order[todo]] + k].astype(np.uint64)
        run = np.cumsum(differs[todo])
        by = np.lexsort((key, run))
        order[todo] = order[todo[by]]
        key, run = key[by], run[by]
        new = np.append(True, (key[1:] != key[:-1]) | (run[1:] != run[:-1]))
        differs[todo] |= new
        alone = new & np.append(new[1:], True)
        todo = todo[~alone]
        if not len(todo):
            break
    return order, differs


def _decide(span: int, most: int = SLICE):
    """Puts the strings of a bucket into corpus order; per row the stretches of bytes whose strings have a smaller bearer."""

    def ordered(words: list[bytes], word: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """words: the dictionary; word, doc: the parse. Which (bearer, start in its word) have a smaller bearer."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        begin = np.cumsum(size) - size
        many = size - span + 1
        upto = np.cumsum(many) - many
        of = np.repeat(np.arange(len(words)), many)
        step = np.arange(many.sum()) - upto[of]
        order, differs = suffix_array(b"".join(words), begin[of] + step, span)
        least_of_word = np.full(len(words), _MOST)
        np.minimum.at(least_of_word, word, doc)
        heads = np.flatnonzero(differs)
        least = np.empty(len(of), np.int64)
        least[order] = np.repeat(np.minimum.reduceat(least_of_word[of[order]], heads), np.diff(np.append(heads, len(of))))
        best = np.minimum.reduceat(least, upto)
        bearer = np.flatnonzero(best[word] < doc)
        n = many[word[bearer]]
        which = np.repeat(bearer, n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        gone = least[upto[word[which]] + at] < doc[which]
        return which[gone], at[gone]

    def run(t: pa.Table) -> pa.Table:
        rows = t["row"].to_numpy()
        key, doc, first, n = ([np.frombuffer(x, k) for x in t[c].to_pylist()] for c, k in (("key", np.uint32), ("doc", np.int64), ("first", np.uint32), ("n", np.uint16)))
        row = np.repeat(rows, [len(x) for x in doc])
        key, doc, first, n = (np.concatenate(x) for x in (key, doc, first, n))
        data, at = b"".join(t["data"].to_pylist()), np.append(0, np.cumsum(n, dtype=np.int64))
        by = np.argsort(key, kind="stable")
        heads, ends = _runs(key[by])
        starts = np.cumsum(np.append(0, n[by].astype(np.int64) - span + 1))
        out, x = [], 0
        while x < len(heads):  # slices of whole keys
            y = max(x + 1, int(np.searchsorted(starts[ends], starts[heads[x]] + most, side="right")))
            p = by[heads[x] : ends[y - 1]]
            known: dict[bytes, int] = {}
            word = np.array([known.setdefault(data[at[i] : at[i + 1]], len(known)) for i in p.tolist()])
            w, s = ordered(list(known), word, doc[p])
            if len(w):
                cut = np.flatnonzero(np.append(True, (w[1:] != w[:-1]) | (s[1:] != s[:-1] + 1)))
                tail = np.append(cut[1:], len(w)) - 1
                f = first[p[w[cut]]].astype(np.int64)
                out.append((row[p[w[cut]]], f + s[cut], f + s[tail] + span))
            x = y
        if not out:
            return pa.table({"row": pa.array([], pa.int64()), "cuts": pa.array([], pa.binary())})
        row, begin, end = (np.concatenate(c) for c in zip(*out, strict=True))
        by = np.lexsort((begin, row))
        row, spans = row[by], np.stack([begin[by], end[by] - begin[by]], 1).astype(_SPAN)
        x, y = _runs(row)
        return pa.table({"row": row[x], "cuts": pa.array([_packed(spans[i:j]) for i, j in zip(x, y, strict=True)], pa.binary())})

    return run


def _packed(spans: np.ndarray) -> bytes:
    """Spans (begin, length) in four and two bytes."""
    return spans[:, 0].tobytes() + spans[:, 1].astype(np.uint16).tobytes()


def _unpacked(cuts: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(cuts) // 6
    begin = np.frombuffer(cuts, _SPAN, n).astype(np.int64)
    return begin, begin + np.frombuffer(cuts, np.uint16, n, 4 * n)


def _finish(span: int):
    def run(batches):
        for r, batch, i in _each(batches, span):
            gone = np.zeros(len(r.data) + 1, np.int32)
            last = r.last()[r.gone] - 1
            s = r.gone[last >= r.start[r.gone]]
            last = last[last >= r.start[r.gone]]
            np.add.at(gone, r.start[s], 1)
            np.add.at(gone, last + span, -1)
            for cuts in batch.column("cuts")[i].as_py() or ():
                begin, end = _unpacked(cuts)
                np.add.at(gone, begin, 1)
                np.add.at(gone, end, -1)
            if "singles" in batch.schema.names and (at := batch.column("singles")[i].values) is not None:
                np.add.at(gone, at.to_numpy(), 1)
                np.add.at(gone, at.to_numpy() + span, -1)
            dead = np.cumsum(gone)[:-1] > 0
            out = [[], [], [], []]
            for a, b in zip(r.offs[:-1].tolist(), r.offs[1:].tolist(), strict=True):
                d = dead[a:b]
                removed = int(np.count_nonzero(d))
                runs = int(d[:1].sum() + np.count_nonzero(d[1:] & ~d[:-1])) if removed else 0
                kept = r.data[a:b][~d] if removed else r.data[a:b]
                for col, v in zip(out, (b - a, removed, runs, hashlib.sha256(kept.tobytes()).hexdigest()), strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(r.raw_ids, pa.int64()), *[pa.array(c, pa.int64()) for c in out[:3]], pa.array(out[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def _corpus(docs: DataFrame, bucketed_from: int) -> tuple[DataFrame, int]:
    """The rows, and their bytes. A large corpus is dealt by row into a bucketed table, so joins on `row` leave it in place."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = materialize(slim.mapInArrow(_rows, _ROW), "rows", **_SMALL_GROUPS)
    total = rows.agg(F.coalesce(F.sum(F.length("data")), F.lit(0))).first()[0]
    if total < bucketed_from:
        return rows, total
    spark, parts, name = docs.sparkSession, int(min(MOST_PARTS, max(8, total // PART_BYTES))), f"rows_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/tables/{name}"
    rows.repartition(parts, "row").write.options(compression="zstd", path=path, **_SMALL_GROUPS).bucketBy(parts, "row").sortBy("row").saveAsTable(name)
    return spark.table(name), total


def _with(rows: DataFrame, answers: DataFrame, size: int, bucketed: bool) -> DataFrame:
    """Brings to each row what concerns it; `size`: bytes of the answers."""
    side = F.broadcast(answers) if size <= BROADCAST_BYTES else answers.hint("shuffle_hash") if bucketed else answers
    return rows.join(side, "row", "left")


def dedup_substrings(docs: DataFrame, span: int = 50, hot_rows: int = HOT, bucketed_from: int = BUCKETED_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    rows, total = _corpus(docs, bucketed_from)
    bucketed = total >= bucketed_from
    count = rows.count()
    buckets = int(max(64, total // BUCKET_BYTES))
    units = materialize(rows.mapInArrow(_units(span), "h long, g long, lo long, hi long, row long, places array<int>"), "units")
    first = materialize(units.groupBy("h", "g").agg(F.min("lo").alias("least"), F.max("hi").alias("most")).where("least < most").select("h", "g", "least"), "dictionary")
    gone = units.join(first, ["h", "g"]).where("hi > least")
    settled = materialize(gone.groupBy("row").agg(F.collect_list(F.struct("places", "least")).alias("settled")), "parse")
    size = settled.agg(F.coalesce(F.sum(F.expr("aggregate(settled, 0L, (n, s) -> n + 16 + 4 * size(s.places))")), F.lit(0))).first()[0]
    open_rows = _with(rows, settled, size + 16 * count, bucketed)
    asked = open_rows.mapInArrow(_ask(span, buckets), "bucket int, row long, keys binary, many binary")
    answers = materialize(asked.groupBy("bucket").applyInArrow(_answer(hot_rows), "row long, bucket int, hot binary, very binary").where("hot IS NOT NULL"), "answers")
    size, n_very = answers.agg(F.coalesce(F.sum(F.length("hot") + F.coalesce(F.length("very"), F.lit(0)) + 12), F.lit(0)), F.count("very")).first()
    told = _with(open_rows, answers.groupBy("row").agg(F.collect_list(F.struct("bucket", "hot", "very")).alias("answers")), size, bucketed)
    sent = told.mapInArrow(_send(span, buckets), "bucket int, row long, key binary, doc binary, first binary, n binary, data binary")
    cuts = materialize(sent.groupBy("bucket").applyInArrow(_decide(span), "row long, cuts binary"), "cuts")
    size = cuts.agg(F.coalesce(F.sum(F.length("cuts") + 16), F.lit(0))).first()[0]
    per_row = cuts.groupBy("row").agg(F.collect_list("cuts").alias("cuts"))
    done = _with(open_rows, per_row, size + 16 * count, bucketed)
    if n_very:
        each = materialize(told.mapInArrow(_strings(span, buckets), "s binary, doc long, row long, at array<int>"), "strings")
        least = each.groupBy("s").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").select("s", "least")
        at = materialize(each.join(least, "s").where("doc > least").groupBy("row").agg(F.flatten(F.collect_list("at")).alias("singles")), "singles")
        done = _with(done, at, at.agg(F.coalesce(F.sum(4 * F.size("singles") + 16), F.lit(0))).first()[0], bucketed)
    return done.mapInArrow(_finish(span), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")

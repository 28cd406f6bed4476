"""Best-fit packing by large-item matching.

Texts become byte-level BPE ids and one end id 0. A document over the capacity is cut into full pieces, its first piece
taking the remainder. Pieces above a third of the capacity fit at most twice into a sequence: greedy matching pairs each
with the largest partner that fits. Smaller pieces then go, largest first, into the tightest gap that takes them.

Sizes are integers up to the capacity, so the plan is made on counts of sizes, never on documents: what the driver holds
depends on the capacity alone. Pieces of a size are numbered without gaps and looked up in the plan by (size, number).

Null texts are empty (one end id). Repeated rows are packed each. Ids equal those of the tokenizers library: the words of a block
are cut as the vocabulary's pattern cuts them, and each different one is encoded once per worker (known by a 64-bit hash);
texts with letters beyond Latin-1 or contractions go to the encoder whole, and texts that may spell a special token go to
the tokenizers library itself.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, gapless_rank, materialize, prefix_hashes, span_hash

#: Words that a worker remembers; beyond it the memory starts anew.
CACHE_WORDS = 1_500_000
_STATE: dict = {}

# Byte classes of the plain path: 0 white space, 1 letter, 2 number, 3 other. Bytes from 0x80 on are letters there.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[48:58] = 2
_QUOTED = np.zeros(256, bool)
_QUOTED[list(b"sdmtlvr")] = True


def _odd(data: np.ndarray) -> np.ndarray:
    """Places that need the full encoder: other letters than those of Latin-1, contractions, special tokens."""
    nxt = np.append(data[1:], np.uint8(0))
    lead = data >= 0xC0
    bad = (lead & (data != 0xC3)) | ((data == 0xC3) & ((nxt == 0x97) | (nxt == 0xB7)))
    return np.flatnonzero(bad | ((data == 0x27) & _QUOTED[nxt]) | ((data == 0x3C) & (nxt == 0x7C)))


def _word_starts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where the vocabulary's pattern begins a word: at runs of a class, one blank going to the run after it."""
    n = len(data)
    cls = _CLASS[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    start = edge[:n].copy()
    start[1:] |= cls[1:] != cls[:-1]
    last = np.zeros(n, bool)  # the last white space before something else of the same document
    last[:-1] = (cls[:-1] == 0) & (cls[1:] != 0) & ~edge[1:n]
    after_blank = np.zeros(n, bool)
    after_blank[1:] = last[:-1] & (data[:-1] == 0x20)
    return np.flatnonzero((start & ~after_blank) | last)


class Encoder:
    """text -> little-endian 32-bit ids."""

    def __init__(self, json_path: str, rank_path: str, pattern: str):
        import tiktoken

        with open(rank_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.json_path, self.full = json_path, None
        self._forget()
        self.single = self.bpe._core_bpe.encode_single_piece

    def _whole(self, text: str):
        if self.full is None:
            from tokenizers import Tokenizer

            self.full = Tokenizer.from_file(self.json_path)
        return self.full.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> np.ndarray:
        """One text by the libraries themselves."""
        return np.array(self._whole(text) if "<|" in text else self.bpe.encode_ordinary(text), np.uint32)

    def _remember(self, key: np.ndarray, start: np.ndarray, end: np.ndarray, raw: bytes) -> np.ndarray:
        """Where the words' ids are kept; new words are encoded."""
        if len(self.keys) > CACHE_WORDS:
            self._forget()
        pos = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
        new = np.flatnonzero(self.keys[pos] != key) if len(self.keys) else np.arange(len(key))
        if len(new):
            single = self.single
            ids = [single(raw[a:b]) for a, b in zip(start[new].tolist(), end[new].tolist(), strict=True)]
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            keys = np.concatenate([self.keys, key[new]])
            order = np.argsort(keys, kind="stable")
            self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(size) - size])[order]
            self.size = np.concatenate([self.size, size])[order]
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum()))])
            self.keys = keys[order]
            pos = np.searchsorted(self.keys, key)
        return pos

    def _forget(self) -> None:
        self.keys, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        self.at = self.size = np.zeros(0, np.int64)

    def encode_block(self, data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
        """The ids of each text of a block of UTF-8 bytes."""
        docs = len(offs) - 1
        odd = np.zeros(docs, bool)
        odd[np.searchsorted(offs, _odd(data), side="right") - 1] = True
        starts = _word_starts(data, offs) if len(data) else np.zeros(0, np.int64)
        starts = starts[~odd[np.searchsorted(offs, starts, side="right") - 1]] if odd.any() else starts
        doc = np.searchsorted(offs, starts, side="right") - 1
        ends = np.minimum(np.append(starts[1:], len(data)), offs[doc + 1])
        key, first, which = np.unique(span_hash(prefix_hashes(data), starts, ends), return_index=True, return_inverse=True)
        raw = data.tobytes()
        pick = self._remember(key, starts[first], ends[first], raw)
        at, size, flat = self.at[pick], self.size[pick], self.flat
        n = size[which]
        total = np.append(0, np.cumsum(n))
        out = flat[np.repeat(at[which] - total[:-1], n) + np.arange(total[-1])]
        bounds = total[np.searchsorted(doc, np.arange(docs + 1))]
        return [self.encode(raw[offs[i] : offs[i + 1]].decode()) if odd[i] else out[bounds[i] : bounds[i + 1]] for i in range(docs)]


def encoder(name: str) -> Encoder:
    if name not in _STATE:
        import public_tokenizers as P

        _STATE[name] = Encoder(P.path(f"{name}.json"), P.path(f"{name}.tiktoken"), P.PATTERN)
    return _STATE[name]


def _pieces(name: str, cap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(name)
        for batch, data, offs in blocks(batches, "text"):
            out: list[list] = [[], [], [], [], []]
            for doc, x in zip(batch.column("doc_id").to_pylist(), enc.encode_block(data, offs), strict=True):
                ids = x.astype("<u4").tobytes() + b"\0\0\0\0"
                n = len(ids) // 4
                at, k, take = 0, 0, n if n <= cap else (n % cap or cap)
                while at < n:
                    for col, v in zip(out, (doc, k, at, take, zlib.crc32(ids[4 * at : 4 * (at + take)])), strict=True):
                        col.append(v)
                    at, k, take = at + take, k + 1, cap
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def plan(counts: dict[int, int], cap: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Runs (size, first number, first sequence, offset): number i of a size goes to sequence first + i - first number.

    A run lasts to the next run of its size. Returns the runs and the number of sequences.
    """
    left = {s: n for s, n in counts.items() if n}
    used = {s: 0 for s in left}
    runs: list[tuple[int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> (first sequence, sequences)
    sizes: list[int] = []
    made = 0

    def place(size: int, first: int, n: int, offset: int) -> None:
        runs.append((size, used[size], first, offset))
        used[size] += n
        left[size] -= n

    def open_gap(gap: int, first: int, n: int) -> None:
        if gap <= 0 or not n:
            return
        if gap not in gaps:
            gaps[gap] = []
            insort(sizes, gap)
        gaps[gap].append((first, n))

    large = sorted(s for s in left if 3 * s > cap)
    for s in reversed(large):  # greedy matching: each with the largest partner that fits
        while left[s]:
            i = bisect_left(large, cap - s + 1) - 1
            while i >= 0 and (not left[large[i]] or large[i] > s):
                i -= 1
            p = large[i] if i >= 0 else None
            if p is None or (p == s and left[s] < 2):
                n = left[s]
                if p == s and i > 0:  # the last of its size may still pair with a smaller one
                    i -= 1
                    while i >= 0 and not left[large[i]]:
                        i -= 1
                    if i >= 0:
                        q = large[i]
                        place(s, made, 1, 0)
                        place(q, made, 1, s)
                        open_gap(cap - s - q, made, 1)
                        made += 1
                        continue
                place(s, made, n, 0)
                open_gap(cap - s, made, n)
                made += n
            elif p == s:
                n = left[s] // 2
                place(s, made, n, 0)
                place(s, made, n, s)
                open_gap(cap - 2 * s, made, n)
                made += n
            else:
                n = min(left[s], left[p])
                place(s, made, n, 0)
                place(p, made, n, s)
                open_gap(cap - s - p, made, n)
                made += n
    for s in sorted((x for x in left if 3 * x <= cap), reverse=True):
        while left[s]:
            i = bisect_left(sizes, s)
            if i == len(sizes):  # a new sequence takes as many of this size as fit at once, then stays open
                each = cap // s
                n = max(1, left[s] // each)
                fit = min(each, left[s])
                first = made
                made += n
                for k in range(fit):
                    place(s, first, n, k * s)
                open_gap(cap - fit * s, first, n)
                continue
            gap = sizes[i]
            first, n = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                sizes.pop(i)
            take = min(n, left[s])
            place(s, first, take, cap - gap)
            open_gap(gap - s, first, take)
            open_gap(gap, first + take, n - take)
    return runs, made


def _lookup(runs: list[tuple[int, int, int, int]]):
    order = sorted(runs)
    size, rank, first, offset = (np.array([r[k] for r in order], np.int64) for k in range(4))
    by_size = {int(s): (int(np.searchsorted(size, s)), int(np.searchsorted(size, s, side="right"))) for s in np.unique(size)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = batch.column("length").to_numpy(), batch.column("_number").to_numpy()
            at = np.zeros(len(length), np.int64)
            for s in np.unique(length):
                lo, hi = by_size[int(s)]
                mine = length == s
                at[mine] = lo + np.searchsorted(rank[lo:hi], number[mine], side="right") - 1
            cols = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(first[at] + number - rank[at]), pa.array(offset[at])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pack(docs: DataFrame, cap: int = 2048, tokenizer: str = "byte_bpe_50k", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = materialize(slim.mapInArrow(_pieces(tokenizer, cap), _PIECE), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most cap rows
    runs, _ = plan(counts, cap)
    ties = [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")]
    numbered = gapless_rank(pieces, ["length"], ties, ties[:2], sum(counts.values()), "_number")
    return numbered.mapInArrow(_lookup(runs), _PIECE + ", sequence_id long, offset long")

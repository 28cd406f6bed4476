"""Benchmark decontamination by latent semantic retrieval.

Words (as in the n-gram join) are hashed to FEATURES terms; their document frequencies come from all documents. A basis
of RANK dimensions is the distributed randomised SVD of the TF-IDF matrix A of passages: those of all benchmark items and of
all documents, multiplied block-wise over the cluster. Subspace iteration over the items gives the directions O that the
pass over the documents starts from; A'(AO) of that one pass is the basis, by Nystroem's approximation of A'A. Every passage of every document, windows of 24
and of 48 words at every 12th word, is then projected, and items with a cosine of at least MIN_COSINE are candidates. A
candidate is a leak if the longest common subsequence of the item and the text around the passage covers LEAK of the
item's words, or PARAPHRASE of them together with ANSWER of its answer: the different words of its last sentence (its
last third, if it has one sentence).

Beside the cosine, whatever the words weigh, a passage is a candidate if the text around it holds so many of an item's
rarest words that LEAK of the item may be there; for items of which FREQUENT of the words stand in many documents, so many
that PARAPHRASE may. No text that could pass the comparison with that share is lost (`Items.rarest`).

The result has one row per leaked (doc_id, item_id): the best cosine, lcs_share and answer_share. Items of fewer than
SHORT words must occur in full: fewer words say too little for a share of them. Null texts, items and documents without a
word take no part; rows with a null doc_id are searched and keep it; repeated rows and equal items count each; other columns
are ignored; empty tables give no rows. The items are taken in blocks of ITEMS; a document is read and cut into words once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NONWORD, blocks, gapless_rank, materialize, prefix_hashes, span_hash, text_bytes, word_spans

FEATURES, RANK, OVER, ITEMS = 1 << 15, 64, 16, 1024
STEP, MIN_COSINE, LEAK, PARAPHRASE, ANSWER, SHORT = 12, 0.4, 0.8, 0.6, 0.75, 8
#: A term's weight is ln(documents / its documents) less this (less half of ln(documents), where that is smaller): frequent words
#: weigh nothing in the cosine, so a passage of such words alone has a cosine of 0.
COMMON = 3.0
#: Items with so large a share of frequent words get candidates for PARAPHRASE, not only for LEAK, without the cosine.
FREQUENT = 2 / 3
#: Words of a passage that the basis is made of; words projected at once; feature ranges that partial products are summed in.
PASSAGE, WORDS, RANGES = 48, 1 << 16, 256


def _words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of each word."""
    starts, ends, docs = word_spans(data, offs, NONWORD)
    return span_hash(prefix_hashes(LOWER[data]), starts, ends), docs


def _terms(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(20) & np.uint64(FEATURES - 1)).astype(np.int64)


def _frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(FEATURES, np.int64), 0
    for batch, data, offs in blocks(batches, "text"):
        h, docs = _words(data, offs)
        begin, t = np.searchsorted(docs, np.arange(batch.num_rows + 1)), _terms(h)
        for lo in range(0, batch.num_rows, 64):  # a row of flags for each document
            hi = min(lo + 64, batch.num_rows)
            has = np.zeros((hi - lo, FEATURES), bool)
            has[docs[begin[lo] : begin[hi]] - lo, t[begin[lo] : begin[hi]]] = True
            df += has.sum(0, dtype=np.uint8)
        n += batch.num_rows
    f = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(f, -1).astype(np.int32)), pa.array(np.append(df[f], n))], ["f", "n"])


def _passages(h: np.ndarray, docs: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit TF-IDF rows of consecutive passages: (passage, term, weight) by passage; terms that weigh nothing are left out."""
    t = _terms(h)
    part = docs * (1 << 32) + (np.arange(len(h)) - np.searchsorted(docs, docs, side="left")) // PASSAGE
    part = np.cumsum(np.append(True, part[1:] != part[:-1])) - 1 if len(h) else part
    some = np.flatnonzero(idf[t] > 0)
    key, n = np.unique(part[some] * FEATURES + t[some], return_counts=True)
    part, t = key // FEATURES, key % FEATURES
    w = n * idf[t]
    return part, t, w / np.sqrt(np.bincount(part, w * w))[part] if len(w) else w


def _product(q: np.ndarray, idf: np.ndarray):
    """A'(Aq) over this task's passages, by ranges of features."""

    def run(batches):
        out = np.zeros((FEATURES, q.shape[1]))
        for _, data, offs in blocks(batches, "text"):
            part, t, w = _passages(*_words(data, offs), idf)
            if not len(t):
                continue
            w = w.astype(np.float32)
            new = np.append(True, part[1:] != part[:-1])
            cut, row = np.flatnonzero(new), np.cumsum(new) - 1
            most = int(np.diff(np.append(cut, len(t))).max())  # PASSAGE at most
            at, weight = np.zeros((len(cut), most), np.int64), np.zeros((len(cut), 1, most), np.float32)
            at[row, np.arange(len(t)) - cut[row]] = t
            weight[row, 0, np.arange(len(t)) - cut[row]] = w
            y = np.empty((len(cut), q.shape[1]), np.float32)
            for k in range(0, len(cut), 256):
                y[k : k + 256] = np.matmul(weight[k : k + 256], q.take(at[k : k + 256], 0))[:, 0]
            by = np.argsort(t.astype(np.uint16), kind="stable")
            cut = np.flatnonzero(np.append(True, t[by][1:] != t[by][:-1]))
            size = np.diff(np.append(cut, len(t)))
            order = np.argsort(-size, kind="stable")
            cut, size = cut[order], size[order]
            sums = np.zeros((len(cut), q.shape[1]), np.float32)
            for j in range(min(8, int(size[0]))):  # the j-th passage of every term at once
                x = by[cut[: np.searchsorted(-size, -j)] + j]
                sums[: len(x)] += y.take(row[x], 0) * w[x][:, None]
            for j in range(np.searchsorted(-size, -8)):  # the other passages of frequent terms
                x = by[cut[j] + 8 : cut[j] + size[j]]
                sums[j] += w[x] @ y.take(row[x], 0)
            out[t[by[cut]]] += sums
        parts = np.array_split(out, RANGES)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([p.astype(np.float32).tobytes() for p in parts], pa.binary())], ["part", "m"])

    return run


def _add(t: pa.Table) -> pa.Table:
    total = reduce(np.add, [np.frombuffer(m, np.float32) for m in t["m"].to_pylist()])
    return pa.table({"part": t["part"].slice(0, 1), "m": pa.array([total.tobytes()], pa.binary())})


def _summed(texts: DataFrame, q: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """A'(Aq) over all texts."""
    parts = texts.select("text").mapInArrow(_product(q.astype(np.float32), idf), "part int, m binary").groupBy("part").applyInArrow(_add, "part int, m binary").orderBy("part").collect()
    return np.concatenate([np.frombuffer(r["m"], np.float32).reshape(-1, q.shape[1]) for r in parts]).astype(np.float64) if parts else np.zeros(q.shape)


def basis(texts: DataFrame, items: DataFrame, idf: np.ndarray, rank: int = RANK, rounds: int = 2) -> np.ndarray:
    """Leading right singular vectors [FEATURES, rank] of the passages of all texts and items."""
    q = np.linalg.qr(np.random.default_rng(3).normal(size=(FEATURES, rank + OVER)))[0]
    for _ in range(rounds):
        q = np.linalg.qr(_summed(items, q, idf) + 1e-3 * q)[0]
    y = _summed(texts, q, idf) + _summed(items, q, idf)
    shift = 1e-6 * max(1.0, float(np.linalg.norm(y)))
    y += shift * q
    core = q.T @ y
    half = np.linalg.cholesky((core + core.T) / 2)
    vectors, values, _ = np.linalg.svd(np.linalg.solve(half, y.T).T, full_matrices=False)
    return np.ascontiguousarray(vectors[:, np.argsort(-values)[:rank]])


def places(a: list[int]) -> dict[int, int]:
    """The positions of each word of a as bits."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    return where


def lcs(a: list[int], b: list[int], where: dict[int, int] | None = None) -> tuple[int, int]:
    """Length of the longest common subsequence, and a's positions in one as bits; bit-parallel over a."""
    where = where or places(a)
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        if m := where.get(x):
            u = v & m
            v = (v + u | v - u) & full
    return len(a) - bin(v).count("1"), full & ~v


class Items:
    """A block of benchmark items."""

    def __init__(self, ids: list[int], texts: list[str], weight: np.ndarray, v: np.ndarray):
        idf = np.maximum(0.0, weight)
        keep = [(i, t) for i, t in zip(ids, texts, strict=True) if t]
        self.ids, self.words, self.sets, self.places, self.answers, self.rare, self.spare, rows = [], [], [], [], [], [], [], []
        for i, t in keep:
            h = _words(*text_bytes(pa.array([t])))[0]
            if not len(h):
                continue
            last = [s for s in re.split(r"(?<=[.!?])\s+", t.strip()) if s]
            tail = _words(*text_bytes(pa.array([last[-1]])))[0] if len(last) > 1 else h[-max(1, len(h) // 3) :]
            self.ids.append(i)
            self.words.append(h.tolist())
            self.sets.append(set(h.tolist()))
            self.places.append(places(h.tolist()))
            self.answers.append(set((tail if len(tail) else h).tolist()))
            spare, rare = self.rarest(h, weight[_terms(h)])
            self.spare.append(spare)
            self.rare.append(rare)
            x = (v[_terms(h)] * idf[_terms(h)][:, None]).sum(0)
            rows.append(x / max(1e-9, np.linalg.norm(x)))
        self.vectors = np.array(rows, np.float32).reshape(-1, v.shape[1])
        self.sizes = np.array(list(map(len, self.words)), np.int64)

    @staticmethod
    def rarest(h: np.ndarray, weight: np.ndarray) -> tuple[int, np.ndarray]:
        """How many places an item may miss, and the words of its rarest places, one more than twice as many.

        A common subsequence that misses at most `spare` places misses at most so many of these, and each place takes a
        word of its own from the text: a text with at most `spare` of these words can't hold it.
        """
        share = 1.0 if len(h) < SHORT else PARAPHRASE if (weight <= 0).mean() >= FREQUENT else LEAK
        spare = len(h) - int(np.ceil(share * len(h) - 1e-9))
        return spare, np.unique(h[np.argsort(-weight, kind="stable")[: 2 * spare + 1]])

    def members(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The items' words, sorted; the places of each word in each item as bits [words + 1, items], the last row for any
        other word; and how many places a bit stands for."""
        vocab = np.unique(np.array([x for s in self.sets for x in s], np.uint64))
        bits = np.zeros((len(vocab) + 1, len(self.sets)), np.uint64)
        each = -(-self.sizes // 64)
        for i, w in enumerate(self.words):
            at = np.uint64(1) << (np.arange(len(w)) // each[i]).astype(np.uint64)
            np.bitwise_or.at(bits[:, i], np.searchsorted(vocab, np.array(w, np.uint64)), at)
        return vocab, bits, each


def _search_all(many: list[Items], idf: np.ndarray, v: np.ndarray):
    """Searches blocks of items in one pass over the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = [_search(items, idf, v) for items in many]
        for batch, data, offs in blocks(batches, "text"):
            words = _words(data, offs)
            for one in search:
                yield one(batch, *words)

    return run


def _search(items: Items, idf: np.ndarray, v: np.ndarray):
    table = (v * idf[:, None]).astype(np.float32)

    def windows(h: np.ndarray, docs: np.ndarray):
        """First words of the steps, step of each word, and for both sizes the windows' unit vectors and ends; a document's last window may be shorter."""
        first = np.searchsorted(docs, docs, side="left")
        step = docs * (1 << 32) + (np.arange(len(h)) - first) // STEP
        new = np.append(True, step[1:] != step[:-1])
        cut = np.flatnonzero(new)
        t, seg = _terms(h), np.cumsum(new) - 1
        some = np.flatnonzero(idf[t] > 0)
        place = some - cut[seg[some]]
        sums = np.zeros((len(cut), table.shape[1]), np.float32)
        for j in range(STEP):  # the j-th word of every step at once
            w = some[place == j]
            sums[seg[w]] += np.take(table, t[w], axis=0)
        at, doc = np.append(cut, len(h)), docs[cut]
        pair, quad = sums.copy(), sums.copy()
        n = np.arange(len(cut))
        ends = {2: n + 1, 4: n + 1}
        for k in (1, 2, 3):
            same = np.flatnonzero(doc[k:] == doc[: len(doc) - k]) if len(doc) > k else np.zeros(0, int)
            if k == 1:
                pair[same] += sums[same + 1]
                ends[2][same] = same + 2
            quad[same] += sums[same + k]
            ends[4][same] = same + k + 1
        for x in (pair, quad):
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        return cut, seg, ((pair, at[ends[2]]), (quad, at[ends[4]]))

    def around(spot: np.ndarray, cut: np.ndarray, bits: np.ndarray):
        """Gives, for steps first..last and items, the places of the items whose words these steps hold, in whole bits."""
        n = len(items.ids)
        size = np.append(cut[1:], len(spot)) - cut
        words = np.full((STEP, len(cut)), len(bits) - 1)
        for j in range(STEP):
            w = np.flatnonzero(size > j)
            words[j, w] = spot[cut[w] + j]
        words *= n
        known, places = np.zeros(len(cut) * n, bool), np.zeros(len(cut) * n, np.uint64)

        def of(first: np.ndarray, last: np.ndarray, item: np.ndarray) -> np.ndarray:
            need, most = np.zeros(len(known), bool), int((last - first).max(initial=0)) + 1
            at = [np.minimum(first + k, last) * n + item for k in range(most)]
            for x in at:
                need[x] = True
            cells = np.flatnonzero(need > known)
            known[cells] = True
            step, one = np.divmod(cells, n)
            got = np.zeros(len(cells), np.uint64)
            for w in words:
                got |= bits.ravel().take(w.take(step) + one)
            places[cells] = got
            out = np.zeros(len(item), np.uint64)
            for x in at:
                out |= places.take(x)
            return np.bitwise_count(out).astype(np.int64)

        return of

    def exact(spot: np.ndarray, seg: np.ndarray, steps: int, rare: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """The longer windows (step * items + item, also more than once) of which the steps around hold enough of the item's rarest words."""
        start, size, of = rare
        at = np.flatnonzero(spot < len(size) - 1)
        at = at[size[spot[at]] > 0]
        k = size[spot[at]]
        item = of[np.repeat(start[spot[at]] - np.cumsum(k) + k, k) + np.arange(k.sum())]
        wide = 2 * steps + 8 * STEP
        key = np.sort(item * wide + np.repeat(seg[at], k))
        item, step = key // wide, key % wide
        spare, around = np.array(items.spare, np.int64), -(-items.sizes // STEP)
        last = np.arange(len(key)) + spare[item]
        ok = np.flatnonzero(last < len(key))
        ok = ok[item[last[ok]] == item[ok]]
        # A window of 4 steps from t on, with `around` steps on both sides, has both ends of the run of spare + 1 words.
        lo, hi = np.maximum(0, step[last[ok]] - 3 - around[item[ok]]), np.minimum(steps - 1, step[ok] + around[item[ok]])
        some = hi >= lo
        lo, n, item = lo[some], (hi - lo + 1)[some], item[ok][some]
        t = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        return t * len(items.ids) + np.repeat(item, n)

    def covered(spot: np.ndarray, bits: np.ndarray, item: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Places of the items whose words the texts spot[s:e] hold, in whole bits."""
        out = np.zeros(len(s), np.int64)
        for k in range(0, len(s), 4096):
            c = slice(k, k + 4096)
            acc = np.zeros(len(s[c]), np.uint64)
            for j in range(int((e[c] - s[c]).max())):
                acc |= bits[spot[np.minimum(s[c] + j, e[c] - 1)], item[c]]
            out[c] = np.bitwise_count(acc)
        return out

    def judge(item: int, text: list[int]):
        a = items.words[item]
        if len(a) < SHORT:
            full = any(text[i : i + len(a)] == a for i in range(len(text) - len(a) + 1))
            return (1.0, 1.0) if full else None
        n, bits = lcs(a, text, items.places[item])
        share = n / len(a)
        if share < PARAPHRASE:
            return None
        hit = {x for i, x in enumerate(a) if bits >> i & 1}
        answer = len(items.answers[item] & hit) / len(items.answers[item])
        return (share, answer) if share >= LEAK or answer >= ANSWER else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, bits, each = items.members()
        of = np.repeat(np.arange(len(items.ids)), [len(x) for x in items.rare])
        word = np.searchsorted(vocab, np.concatenate([*items.rare, np.zeros(0, np.uint64)]))
        size = np.bincount(word, minlength=len(vocab) + 1)
        rare = (np.cumsum(size) - size, size, of[np.argsort(word, kind="stable")])
        spare = np.array(items.spare, np.int64)
        maybe = np.zeros(1 << 20, bool)
        maybe[vocab & np.uint64(0xFFFFF)] = True
        # Each window lies in some round together with the text around it.
        overlap = 5 + 2 * -(-int(items.sizes.max(initial=0)) // STEP)
        most = max(WORDS, 4 * STEP * overlap)
        for batch, data, offs in blocks(batches, "text"):
            h, docs = _words(data, offs)
            begin = np.searchsorted(docs, np.arange(batch.num_rows + 1))
            ids = batch.column("doc_id").to_pylist()
            best: dict[tuple[int, int], tuple[float, float, float]] = {}
            seen: set[tuple[int, int, int, int]] = set()
            lo = 0 if items.ids else len(h)
            while lo < len(h):
                hi = min(len(h), lo + most)
                if hi < len(h):  # a later round starts a whole window and its text before the end, at a step of its document
                    d = docs[hi]
                    back = begin[d] + max(0, (hi - begin[d]) // STEP - overlap) * STEP
                    nxt = max(back, lo + STEP) if back > lo else hi
                else:
                    nxt = hi
                cut, seg, sizes = windows(h[lo:hi], docs[lo:hi])
                spot = np.full(hi - lo, len(vocab))
                some = np.flatnonzero(maybe[h[lo:hi] & np.uint64(0xFFFFF)])
                at = np.searchsorted(vocab, h[lo:hi][some])
                same = vocab[np.minimum(at, len(vocab) - 1)] == h[lo:hi][some]
                spot[some[same]] = at[same]
                held, cosines = around(spot, cut, bits), []
                for x, b in sizes[::-1]:
                    cos = x @ items.vectors.T
                    hit = cos >= MIN_COSINE
                    if cosines:  # the longer window with the same start holds the text of the shorter
                        hit &= cosines[0] < MIN_COSINE
                    else:
                        hit.ravel()[exact(spot, seg, len(cut), rare)] = True
                    cosines.append(cos)
                    pair = np.flatnonzero(hit)
                    win, item = np.divmod(pair, len(items.ids))
                    near = cos.ravel()[pair] >= MIN_COSINE
                    doc = docs[lo + cut[win]]
                    s = np.maximum(begin[doc], lo + cut[win] - items.sizes[item])
                    e = np.minimum(begin[doc + 1], lo + b[win] + items.sizes[item])
                    # Texts that match too few of the item's places can't be leaks: first by the steps that they lie in, then by
                    # their words. Texts that reach beyond this round are compared without a bound.
                    inside = (s >= lo) & (e <= hi)
                    first, last = seg[np.maximum(s, lo) - lo], seg[np.minimum(e, hi) - 1 - lo]
                    need = np.where(near, PARAPHRASE * items.sizes[item], items.sizes[item] - spare[item])
                    may = np.flatnonzero(np.where(inside, held(first, last, item) * each[item] >= need, near))
                    some = may[inside[may]]
                    enough = covered(spot, bits, item[some], s[some] - lo, e[some] - lo) * each[item[some]] >= need[some]
                    for k in np.sort(np.append(may[~inside[may]], some[enough])):
                        d, i, at, end = int(doc[k]), int(item[k]), int(s[k]), int(e[k])
                        if ((d, i) in best and best[d, i][0] == 1.0) or (d, i, at, end) in seen:
                            continue
                        seen.add((d, i, at, end))
                        found = judge(i, h[at:end].tolist())
                        if found:
                            old = best.get((d, i))
                            new = (found[0], found[1], float(cos[win[k], i]))
                            best[d, i] = max(old, new) if old else new
                lo = nxt
            rows = [(ids[d], items.ids[i], c, s, a) for (d, i), (s, a, c) in best.items()]
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["doc_id", "item_id", "cosine", "lcs_share", "answer_share"])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine, lcs_share, answer_share of each leak."""
    texts = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    schema = "doc_id long, item_id long, cosine double, lcs_share double, answer_share double"
    counts = {r["f"]: r["n"] for r in texts.select("text").mapInArrow(_frequency, "f int, n long").groupBy("f").agg(F.sum("n").alias("n")).collect()}
    n = counts.pop(-1, 0)
    df = np.zeros(FEATURES)
    df[list(counts)] = list(counts.values())
    weight = np.log((2 + n) / (1 + df)) - min(COMMON, np.log(1 + n) / 2)
    idf = np.maximum(0.0, weight)
    v = basis(texts, items, idf)
    # Blocks by gapless numbers: ids may repeat or be null.
    salt = [F.col("item_id"), F.col("text")]
    numbered = materialize(gapless_rank(items.withColumn("_k", F.lit(0)), ["_k"], salt, salt, items.count(), "no"), "items")
    out = []
    for k in range(0, numbered.count(), ITEMS):
        got = numbered.where(F.col("no").between(k, k + ITEMS - 1)).orderBy("no").collect()
        out.append(texts.mapInArrow(_search(Items([r["item_id"] for r in got], [r["text"] for r in got], weight, v), idf, v), schema))
    return reduce(DataFrame.unionByName, out) if out else docs.sparkSession.createDataFrame([], schema)

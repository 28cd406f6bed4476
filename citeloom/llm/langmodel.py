"""Language-model scoring with a gated recurrent network.

Word counts over all learning documents give a smoothed unigram base; the words beyond the network's vocabulary share one
symbol, whose probability is split by those counts, so the score is a probability of the very text. The network (one
gated recurrent layer, numpy) is trained by truncated backpropagation on all learning documents; its softmax is factored
into word classes. The documents are dealt into ROUNDS by a hash of their id. In a round each task trains on its documents
from the same weights, and the weights are averaged by the tokens behind them. In scoring, the state runs through a whole
document, window by window.

Counts stay in a table. Only the words above a count that at most `HEAD` words reach are held in workers; the other
words of a document meet their counts in a join, so nothing that is broadcast grows with the corpus.

Words are runs of bytes other than blank and \\x09-\\x0D, A-Z lower-cased, known by a 64-bit hash; an end follows. A null
text is empty: its end only. Without learning documents all counts are 0. Repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, materialize, word_hashes
from .langid import fold

#: Words whose counts workers hold at most; classes, words of a class; size of the state.
HEAD, CLASSES, PER_CLASS, STATE = 1 << 18, 64, 64, 16
VOCAB = CLASSES * PER_CLASS
#: Training: parallel texts, steps of truncated backpropagation, step size.
LANES, STEPS, RATE = 192, 16, 0.25
#: Rounds of training; tokens of all rounds that a task has at least, on average; ranges of weights that are averaged at once.
ROUNDS, TASK_TOKENS, RANGES = 4, 500_000, 256
#: Scoring: bytes of text at once, texts side by side, states per softmax.
SCORE_BYTES, SIDE, WINDOW = 1 << 22, 1024, 1 << 13
_LN10 = float(np.log(10))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words, sent whenever a million different ones have come up."""
    keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for _, data, offs in blocks(batches, "text"):
        u, n = np.unique(word_hashes(data, offs)[0].view(np.int64), return_counts=True)
        both, inv = np.unique(np.concatenate([keys, u]), return_inverse=True)
        keys, sums = both, np.bincount(inv, np.concatenate([sums, n]), len(both)).astype(np.int64)
        if len(keys) > 1_000_000:
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums)], ["h", "c"])
            keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums)], ["h", "c"])


def word_counts(texts: DataFrame) -> DataFrame:
    """h, c: how often each word comes up."""
    return texts.select("text").mapInArrow(_counts, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def head(counts: DataFrame, most: int = HEAD) -> tuple[np.ndarray, np.ndarray, int]:
    """The words with at least a certain count, the least for which they are at most `most`: hashes (sorted), counts, and that count."""
    level = F.floor(F.log2("c") * 64).cast("int")
    levels = sorted(((r["k"], r["n"], r["least"]) for r in counts.groupBy(level.alias("k")).agg(F.count("*").alias("n"), F.min("c").alias("least")).collect()), reverse=True)
    total, least = 0, None
    for _, n, low in levels:
        if total + n > most:
            break
        total, least = total + n, low
    if least is None:
        least = levels[0][2] + 1 if levels else 1
    got = counts.where(F.col("c") >= least).toArrow()
    h, c = got["h"].to_numpy(), got["c"].to_numpy()
    order = np.argsort(h)
    return h[order], c[order], least


def _powers(logits: np.ndarray) -> np.ndarray:
    """exp in place, of logits kept below what single precision holds."""
    np.minimum(logits, 60, out=logits)
    return np.exp(logits, out=logits)


class Network:
    """Symbols 0..VOCAB-1: 0 stands for all other words, 1 for the end. A symbol's class is symbol // PER_CLASS."""

    NAMES = ("gate", "u", "wc", "ww", "bc", "bw")

    def __init__(self, words: np.ndarray, freq: np.ndarray):
        rng = np.random.default_rng(5)
        self.words, self.symbol = np.sort(words), np.argsort(words) + 2  # sorted hashes and their symbols
        p = np.maximum(freq, 0.5).reshape(CLASSES, PER_CLASS)
        self.bc = np.log(p.sum(1) / p.sum()).astype(np.float32)
        self.bw = np.log(p / p.sum(1, keepdims=True)).astype(np.float32)
        f = np.float32
        self.gate = rng.normal(0, 0.1, (3, VOCAB, STATE)).astype(f)  # input embedding through the gates' input weights
        self.gate[0] -= 1
        self.u = rng.normal(0, 0.15, (3, STATE, STATE)).astype(f)
        self.wc = np.zeros((STATE, CLASSES), f)
        self.ww = np.zeros((CLASSES, STATE, PER_CLASS), f)
        self.acc = {k: np.full(getattr(self, k).shape, 1e-2, f) for k in self.NAMES}  # squared gradients so far

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, self.symbol[at], 0)

    def step(self, h: np.ndarray, x: np.ndarray):
        g, a = self.gate.take(x, 1), h @ self.u
        zr = g[:2]
        zr += a[:2]
        np.negative(zr, out=zr)
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        z, r, c, ac = zr[0], zr[1], g[2], a[2]
        c += r * ac
        np.tanh(c, out=c)
        new = c - h
        new *= z
        new += h
        return new, z, r, c, ac

    def log_prob(self, h: np.ndarray, y: np.ndarray) -> np.ndarray:
        """ln of the class and of the word within it."""
        k = y // PER_CLASS
        lc = _powers(h @ self.wc + self.bc)
        out = np.log(np.maximum(lc[np.arange(len(y)), k], 1e-30) / lc.sum(1)).astype(np.float64)
        order = np.argsort(k, kind="stable")
        cuts = np.searchsorted(k[order], np.arange(CLASSES + 1))
        hs, w = h[order], (y % PER_CLASS)[order]
        part = np.empty(len(y))
        for i in range(CLASSES):
            a, b = cuts[i], cuts[i + 1]
            if a < b:
                lw = _powers(hs[a:b] @ self.ww[i] + self.bw[i])
                part[a:b] = np.log(np.maximum(lw[np.arange(b - a), w[a:b]], 1e-30) / lw.sum(1))
        out[order] += part
        return out

    def weights(self) -> np.ndarray:
        return np.concatenate([x.ravel() for k in self.NAMES for x in (getattr(self, k), self.acc[k])])

    def set_weights(self, w: np.ndarray) -> None:
        for k in self.NAMES:
            for x in (getattr(self, k), self.acc[k]):
                x[...], w = w[: x.size].reshape(x.shape), w[x.size :]

    def train(self, x: np.ndarray, y: np.ndarray, fresh: np.ndarray) -> None:
        """x, y, fresh: steps by lanes; input and target symbols, and whether a text begins. Adagrad on clipped gradients."""
        def move(name, g, rows=None):
            np.minimum(np.maximum(g, -0.5, out=g), 0.5, out=g)
            v, a = getattr(self, name), self.acc[name]
            if rows is None:
                a += g * g
                v -= RATE * g / np.sqrt(a)
            else:
                at = (slice(None), rows) if name == "gate" else rows
                sums = a[at] + g * g
                a[at] = sums
                g *= RATE
                g /= np.sqrt(sums, out=sums)
                v[at] -= g

        h = np.zeros((x.shape[1], STATE), np.float32)
        for t0 in range(0, x.shape[0], STEPS):
            xs, ys, goes_on = x[t0 : t0 + STEPS], y[t0 : t0 + STEPS], np.float32(~fresh[t0 : t0 + STEPS, :, None])
            kept, hs = [], np.empty((*xs.shape, STATE), np.float32)
            for t in range(len(xs)):
                before = h * goes_on[t]
                h, *parts = self.step(before, xs[t])
                hs[t] = h
                kept.append((before, *parts))
            hs, yy = hs.reshape(-1, STATE), ys.ravel()
            n = np.float32(1 / LANES)
            k = yy // PER_CLASS
            order = np.argsort(k, kind="stable")
            hs, k, yo = hs.take(order, 0), k[order], yy[order]
            at = np.arange(len(k))
            pc = _powers(hs @ self.wc + self.bc)
            pc *= n / pc.sum(1, keepdims=True)
            pc[at, k] -= n
            dho = pc @ self.wc.T
            gwc, gbc = hs.T @ pc, pc.sum(0)
            cuts = np.searchsorted(k, np.arange(CLASSES + 1))
            some = np.flatnonzero(cuts[1:] > cuts[:-1])
            pw = self.bw.take(k, 0)
            spans = [slice(cuts[i], cuts[i + 1]) for i in some]
            for i, rows in zip(some, spans, strict=True):
                pw[rows] += hs[rows] @ self.ww[i]
            _powers(pw)
            pw *= n / pw.sum(1, keepdims=True)
            pw[at, yo % PER_CLASS] -= n
            gww, gbw = np.empty((len(some), STATE, PER_CLASS), np.float32), np.empty((len(some), PER_CLASS), np.float32)
            for j, (i, rows) in enumerate(zip(some, spans, strict=True)):
                p = pw[rows]
                dho[rows] += p @ self.ww[i].T
                np.matmul(hs[rows].T, p, out=gww[j])
                p.sum(0, out=gbw[j])
            dh = np.empty_like(dho)
            dh[order] = dho
            gu, dg, back = np.zeros_like(self.u), np.empty((3, *xs.shape, STATE), np.float32), np.zeros_like(h)
            dh, ut = dh.reshape(*xs.shape, STATE), self.u.transpose(0, 2, 1).copy()
            da = np.empty((3, *h.shape), np.float32)
            for t in range(len(xs) - 1, -1, -1):
                before, z, r, c, ac = kept[t]
                d = dh[t]
                d += back
                dz = d * z
                back = d - dz
                dc = np.multiply(c, c, out=dg[2, t])
                np.subtract(1, dc, out=dc)
                dc *= dz
                dz *= c - before
                dz *= 1 - z
                np.multiply(dc, r, out=da[2])
                ac *= da[2]
                ac *= 1 - r
                da[0], da[1], dg[0, t], dg[1, t] = dz, ac, dz, ac
                gu += before.T @ da
                back += (da @ ut).sum(0)
                back *= goes_on[t]
            rows, inv = np.unique(xs.ravel(), return_inverse=True)
            columns = dg.reshape(3, -1, STATE).transpose(0, 2, 1).reshape(3 * STATE, -1)
            sums = np.array([np.bincount(inv, c, len(rows)) for c in columns], np.float32)
            move("gate", np.ascontiguousarray(sums.reshape(3, STATE, -1).transpose(0, 2, 1)), rows)
            for name, g in (("u", gu), ("wc", gwc), ("bc", gbc)):
                move(name, g)
            for name, g in (("ww", gww), ("bw", gbw)):
                move(name, g, None if len(some) == CLASSES else some)


def _lanes(symbols: np.ndarray, begin: np.ndarray, side: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Deals texts (symbols with their end) to lanes of similar length; per lane the places of its tokens, longest lane first."""
    size = np.diff(begin)
    order = np.argsort(-size, kind="stable")
    n = max(1, min(side, len(order)))
    load, lanes = np.zeros(n, np.int64), [[] for _ in range(n)]
    import heapq

    heap = [(0, i) for i in range(n)]
    for d in order:
        s, i = heapq.heappop(heap)
        lanes[i].append(np.arange(begin[d], begin[d + 1]))
        load[i] = s + size[d]
        heapq.heappush(heap, (s + int(size[d]), i))
    out = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in lanes]
    by = np.argsort(-load, kind="stable")
    return [out[i] for i in by], load[by]


def _with_ends(values: np.ndarray, docs: np.ndarray, n: int, end) -> tuple[np.ndarray, np.ndarray]:
    """Puts an end behind each document's values: (values, where each document begins)."""
    size = np.bincount(docs, minlength=n) + 1
    begin = np.append(0, np.cumsum(size))
    out = np.full(begin[-1], end, values.dtype)
    out[np.arange(len(values)) + docs] = values
    return out, begin


def _score(net: Network, symbols: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """ln probability of each text's symbols."""
    lanes, load = _lanes(symbols, begin, SIDE)
    doc = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    prev = np.append(1, symbols[:-1])
    first = np.zeros(len(symbols), bool)
    first[begin[:-1]] = True
    prev[first] = 1
    places = np.full((len(lanes), int(load[0])), -1, np.int64)
    for i, p in enumerate(lanes):
        places[i, : len(p)] = p
    places = np.ascontiguousarray(places.T)
    active = np.searchsorted(-load, -np.arange(len(places)), side="left")
    out = np.zeros(len(begin) - 1)
    h = np.zeros((len(lanes), STATE), np.float32)
    hs, ps, held = [], [], 0
    for t in range(len(places)):
        p = places[t, : active[t]]
        h = h[: len(p)] * ~first[p][:, None]
        h = net.step(h, prev[p])[0]
        hs.append(h)
        ps.append(p)
        held += len(p)
        if held >= WINDOW or t + 1 == len(places):
            at = np.concatenate(ps)
            out += np.bincount(doc[at], net.log_prob(np.concatenate(hs), symbols[at]), len(out))
            hs, ps, held = [], [], 0
    return out


def _scorer(net: Network, h: np.ndarray, c: np.ndarray):
    """Per document: the network's part, the sums over words with known counts, and the hashes of the rest."""
    logs = np.log10(c + 0.1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 36
        for batch, data, offs in blocks(batches, "text", SCORE_BYTES):
            n = batch.num_rows
            words, docs = word_hashes(data, offs)
            words = words.view(np.int64)
            at = np.minimum(np.searchsorted(h, words), max(0, len(h) - 1))
            known = h[at] == words if len(h) else np.zeros(len(words), bool)
            sym = net.symbols(words)
            symbols, begin = _with_ends(sym, docs, n, 1)
            ln = _score(net, symbols, begin)
            log_c = np.where(known, logs[at] if len(h) else 0.0, 0.0)
            other = sym == 0
            rest = ~known
            size = np.bincount(docs[rest], minlength=n)
            tail = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(words[rest]))
            sums = [np.bincount(docs, w, n) for w in (log_c, known, other, np.where(other, log_c, 0.0))]
            cols = [pa.array(key + np.arange(n)), batch.column("doc_id"), batch.column("held_out"), pa.array(np.bincount(docs, minlength=n) + 1), pa.array(ln), pa.array(sums[0]), pa.array(sums[1].astype(np.int64)), pa.array(sums[2].astype(np.int64)), pa.array(sums[3]), tail]
            key += n
            yield pa.RecordBatch.from_arrays(cols, ["key", "doc_id", "held_out", "n_tokens", "ln", "log_c", "known", "other", "other_log_c", "tail"])

    return run


def _lessons(y: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Input symbols, targets and beginnings, steps by lanes."""
    y = y.reshape(lanes, -1)
    x = np.concatenate([np.ones((lanes, 1), np.int64), y[:, :-1]], 1)
    return x.T.copy(), y.T.copy(), (x == 1).T.copy()


def _trainer(net: Network):
    """Trains on a task's texts: its tokens and weights, by ranges of weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, rest = 0, np.zeros(0, np.int64)
        for b, data, offs in blocks(batches, "text"):
            words, docs = word_hashes(data, offs)
            y = np.concatenate([rest, _with_ends(net.symbols(words.view(np.int64)), docs, b.num_rows, 1)[0]])
            n += len(y) - len(rest)
            whole = len(y) // LANES * LANES
            if whole:
                net.train(*_lessons(y[:whole], LANES))
            rest = y[whole:]
        if len(rest):
            net.train(*_lessons(rest, 1))
        if n:
            parts = np.array_split(net.weights(), RANGES)
            yield pa.RecordBatch.from_arrays([pa.array(range(RANGES), pa.int32()), pa.array([n] * RANGES, pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], ["part", "n", "m"])

    return run


def _average(t: pa.Table) -> pa.Table:
    n = t["n"].to_numpy()
    mean = sum(k / n.sum() * np.frombuffer(m.as_py(), np.float32) for k, m in zip(n, t["m"], strict=True)).astype(np.float32)
    return pa.table({"part": t["part"].slice(0, 1), "n": pa.array([n.sum()], pa.int64()), "m": pa.array([mean.tobytes()], pa.binary())})


def train(net: Network, texts: DataFrame, n: int) -> int:
    """Trains net on all texts, of n tokens together; gives the number of tokens it has seen."""
    kind, seen = "part int, n long, m binary", 0
    dealt = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(ROUNDS))
    for k in range(ROUNDS):
        part = texts.where(dealt == k).select("text").coalesce(max(1, n // TASK_TOKENS))
        got = part.mapInArrow(_trainer(net), kind).groupBy("part").applyInArrow(_average, kind).orderBy("part").collect()
        if got:
            net.set_weights(np.concatenate([np.frombuffer(r["m"], np.float32) for r in got]))
            seen += got[0]["n"]
    return seen


def score(docs: DataFrame, learn_mod: int = 10) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. docs: doc_id, text."""
    held = F.coalesce(fold("doc_id", learn_mod) == 0, F.lit(False))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held.alias("held_out"))
    texts = slim.where(~F.col("held_out"))
    counts = materialize(word_counts(texts), "counts")
    ends = texts.count()
    total, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n, v = total + ends, kinds + (ends > 0)
    h, c, least = head(counts)
    top = np.lexsort((h, -c))[: VOCAB - 2]
    freq = np.zeros(VOCAB)
    freq[2 : 2 + len(top)] = c[top]
    freq[0], freq[1] = total - c[top].sum(), ends
    net = Network(h[top], freq)
    train(net, texts, n)
    rows = materialize(slim.mapInArrow(_scorer(net, h, c), "key long, doc_id long, held_out boolean, n_tokens long, ln double, log_c double, known long, other long, other_log_c double, tail array<long>"), "scored")
    words = rows.select("key", F.explode("tail").alias("h"))
    seen = words.join(counts.where(F.col("c") < least), "h", "left")
    tail = seen.groupBy("key").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.1)).alias("t"), F.count("c").alias("k"))
    all_rows = rows.drop("tail").join(tail, "key", "left")
    t, k = F.coalesce("t", F.lit(0.0)), F.coalesce("k", F.lit(0))
    rest_n, rest_v = int(freq[0]), kinds - len(top)
    end = float(np.log10(ends + 0.1))
    base = F.col("log_c") + t + F.lit(end) - F.col("n_tokens") * F.lit(float(np.log10(n + 0.1 * (v + 1))))
    other = F.col("other_log_c") + t - F.col("other") * F.lit(float(np.log10(rest_n + 0.1 * (rest_v + 1))))
    return all_rows.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + k + F.lit(int(ends > 0))).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("ln") / _LN10 + other).alias("score")
    )

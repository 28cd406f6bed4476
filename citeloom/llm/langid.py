"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the hashed 1- to 3-grams of the lower-cased code points of a whole text, weighted by their share of the
text's n-grams and by inverse document frequency over all learning documents. The labels are those of all learning
documents. Weights are learned from all of them by the follow-the-regularised-leader rule with elastic-net penalties: each
task makes its steps over small groups of its documents, then the sums of gradients and of their squares are averaged over the
tasks. A label with more than its equal share of the documents weighs as much as that share. A fifth of the documents, by a
hash, is kept out; over all of it the losses under each of PENALTIES (of the leader) and each temperature are summed. The L1
penalty is the largest whose loss is within TOLERANCE of the least, the temperature that of its least loss. Prediction reads a
text once and needs no shuffle.

A text that is null or holds no letter is `und` with score 0. Without learnable documents every text is `und`. Repeated
rows are predicted each; rows with a null doc_id are learning rows; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, mix

#: Hashed n-gram features; few documents are passed over PASSES times at most, until MET have been met.
FEATURES, PASSES, MET = 1 << 16, 4, 16000
#: Documents of a step at most, and steps of a pass at least (of one document each, if there are so few); documents of a task at
#: least; ranges of features that the tasks' sums are averaged in.
GROUP, LEAST_STEPS, TASK_DOCS, RANGES = 32, 500, 4000, 64
ALPHA, BETA, L2 = 0.3, 1.0, 1e-4
#: L1 penalties to choose from (the least holds while weights are learned), and the loss that the choice may cost; temperatures.
PENALTIES, TOLERANCE = (0.01, 0.03, 0.1, 0.3), 0.02
HEAT = np.exp(np.linspace(np.log(0.01), np.log(20), 241))
_MARK = np.uint64(32)
#: Bytes of text handled at once: each makes three n-grams of some hundred bytes of arrays.
BLOCK = 1 << 19


def _code_points(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points, and where each document's begin; UTF-8 is valid."""
    lead = (data & 0xC0) != 0x80
    pos = np.flatnonzero(lead)
    b0 = data[pos].astype(np.uint32)
    pad = np.concatenate([data, np.zeros(3, np.uint8)])
    b1, b2, b3 = ((pad[pos + k] & 0x3F).astype(np.uint32) for k in (1, 2, 3))
    cp = np.where(b0 < 0x80, b0, np.where(b0 < 0xE0, (b0 & 31) << 6 | b1, np.where(b0 < 0xF0, (b0 & 15) << 12 | b1 << 6 | b2, (b0 & 7) << 18 | b1 << 12 | b2 << 6 | b3)))
    upper = ((cp >= 65) & (cp <= 90)) | ((cp >= 0xC0) & (cp <= 0xDE) & (cp != 0xD7))
    return np.where(upper, cp + 32, cp), np.searchsorted(pos, offs)


def _letters(cp: np.ndarray) -> np.ndarray:
    """Whether a code point is a letter; beyond Latin-1 Python's own table is asked, once for each different one."""
    out = ((cp >= 97) & (cp <= 122)) | ((cp >= 0xDF) & (cp <= 0xFF) & (cp != 0xF7)) | (cp == 0xAA) | (cp == 0xB5) | (cp == 0xBA)
    far = np.flatnonzero(cp > 0xFF)
    if len(far):
        u, inv = np.unique(cp[far], return_inverse=True)
        out[far] = np.array([chr(c).isalpha() for c in u.tolist()])[inv]
    return out


def _grams(cp: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n = 1, 2, 3: the features of the n-grams, and where each document's begin."""
    c = cp.astype(np.uint64)
    out = []
    doc_end = np.repeat(at[1:], np.diff(at))
    place = np.arange(len(c))
    h = np.zeros(len(c), np.uint64)
    for n in (1, 2, 3):
        part = np.zeros(len(c), np.uint64)
        part[: len(c) - n + 1] = c[n - 1 :] if len(c) >= n else 0
        h = h * np.uint64(0x100000001B3) + part + np.uint64(n)
        ok = place + n <= doc_end
        f = (mix(h[ok]) & np.uint64(FEATURES - 1)).astype(np.int64)
        before = np.append(0, np.cumsum(ok))
        out.append((f, before[at]))
    return out


def _document_frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df = np.zeros(FEATURES, np.int64)
    last = np.full(FEATURES, -1, np.int64)
    docs = 0
    for _, data, offs in blocks(batches, "text", BLOCK):
        cp, at = _code_points(data, offs)
        for f, begin in _grams(cp, at):
            for d in range(len(offs) - 1):
                x = f[begin[d] : begin[d + 1]]
                if len(x):
                    last[x] = place = np.arange(len(x))
                    df[x[last[x] == place]] += 1
        docs += len(offs) - 1
    i = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(i, -1).astype(np.int32)), pa.array(np.append(df[i], docs))], ["f", "n"])


class Model:
    """labels, idf, weights[FEATURES, labels], bias, temperature."""

    def __init__(self, labels: list[str], idf: np.ndarray):
        k = len(labels)
        self.labels, self.idf = labels, idf
        self.weights, self.bias, self.temperature = np.zeros((FEATURES, k), np.float32), np.zeros(k), 1.0

    def settle(self, z: np.ndarray, n: np.ndarray, penalty: float, temperature: float) -> Model:
        w = _leader(z, n, penalty)
        self.seen, self.penalty, self.temperature = n[:-1] > 0, penalty, temperature
        self.weights, self.bias = (w[:-1] * self.idf[:, None] * 10).astype(np.float32), w[-1]
        return self

    def predict(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(label or -1, probability) of each document."""
        docs, k = len(offs) - 1, len(self.labels)
        cp, at = _code_points(data, offs)
        total, logits = np.zeros(docs), np.zeros((docs, k))
        for f, begin in _grams(cp, at):
            some = np.flatnonzero(begin[1:] > begin[:-1])
            if len(some):
                logits[some] += np.add.reduceat(self.weights[f], begin[some], axis=0, dtype=np.float64)
            total += np.diff(begin)
        p = _softmax((logits / np.maximum(total, 1)[:, None] + self.bias) / self.temperature)
        letters = np.append(0, np.cumsum(_letters(cp)))
        none = letters[at[1:]] == letters[at[:-1]]
        return np.where(none, -1, p.argmax(axis=1)), np.where(none, 0.0, p.max(axis=1))


def _leader(z: np.ndarray, n: np.ndarray, penalty: float) -> np.ndarray:
    """The weights that lead under the elastic net: zero where the summed gradient stays within the L1 penalty."""
    return np.where(np.abs(z) <= penalty, 0.0, -(z - np.sign(z) * penalty) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _learner(z: np.ndarray, n: np.ndarray, idf: np.ndarray, labels: list[str], weigh: np.ndarray, group: int):
    """Steps over a task's documents from (z, n): its (z, n) and the number of its documents, by ranges of features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zs, ns, docs, k, scale = z.copy(), n.copy(), 0, len(labels), idf * 10
        code = {x: j for j, x in enumerate(labels)}
        ones = lambda n: np.ones(n, np.float32)
        for batch, data, offs in blocks(batches, "text", BLOCK):
            y = np.array([code[x] for x in batch.column("lang").to_pylist()])
            cp, at = _code_points(data, offs)
            grams = _grams(cp, at)
            total = np.maximum(1, sum(np.diff(b) for _, b in grams))
            for lo in range(0, len(y), group):
                hi = min(lo + group, len(y))
                w = _leader(zs, ns, PENALTIES[0])
                table, size, logits = (w[:-1] * scale[:, None]).astype(np.float32), total[lo:hi, None], np.zeros((hi - lo, k))
                for x, b in grams:
                    for d in range(lo, hi):
                        logits[d - lo] += ones(b[d + 1] - b[d]) @ table.take(x[b[d] : b[d + 1]], 0)
                p = _softmax(logits / size + w[-1])
                r = (p - (np.arange(k) == y[lo:hi, None])) * weigh[y[lo:hi], None]
                g = np.zeros((FEATURES + 1, k))
                f = np.concatenate([x[b[lo] : b[hi]] for x, b in grams])
                many = np.concatenate([np.diff(b[lo : hi + 1]) for _, b in grams])
                for j in range(k - 1):  # a document's gradients add up to nothing over the labels
                    g[:-1, j] = np.bincount(f, np.repeat(np.tile(r[:, j] / size[:, 0], 3), many), FEATURES) * scale
                g[-1, :-1] = r[:, :-1].sum(0)
                g[:, -1] = -g[:, :-1].sum(1)
                more = ns + g * g
                zs += g - (np.sqrt(more) - np.sqrt(ns)) / ALPHA * w
                ns = more
            docs += len(y)
        if docs:
            parts = np.array_split(np.concatenate([zs, ns], 1).astype(np.float32), RANGES)
            yield pa.RecordBatch.from_arrays([pa.array(range(RANGES), pa.int32()), pa.array([docs] * RANGES, pa.int64()), pa.array([x.tobytes() for x in parts], pa.binary())], ["part", "n", "m"])

    return run


def _mean(t: pa.Table) -> pa.Table:
    n = t["n"].to_numpy()
    mean = sum(k / n.sum() * np.frombuffer(m.as_py(), np.float32) for k, m in zip(n, t["m"], strict=True)).astype(np.float32)
    return pa.table({"part": t["part"].slice(0, 1), "n": pa.array([n.sum()], pa.int64()), "m": pa.array([mean.tobytes()], pa.binary())})


def _losses(z: np.ndarray, n: np.ndarray, idf: np.ndarray, labels: list[str], weigh: np.ndarray):
    """The summed losses of a task's documents under each penalty and temperature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, code, sums = len(labels), {x: j for j, x in enumerate(labels)}, np.zeros((len(PENALTIES), len(HEAT)))
        w = np.stack([_leader(z, n, p) for p in PENALTIES], 1)
        table, bias = (w[:-1] * idf[:, None, None] * 10).astype(np.float32).reshape(FEATURES, -1), w[-1]
        for batch, data, offs in blocks(batches, "text", BLOCK):
            y = np.array([code[x] for x in batch.column("lang").to_pylist()])
            logits, total = np.zeros((len(y), table.shape[1])), np.zeros(len(y))
            for f, begin in _grams(*_code_points(data, offs)):
                for d in range(len(y)):
                    logits[d] += table.take(f[begin[d] : begin[d + 1]], 0).sum(0)
                total += np.diff(begin)
            logits = (logits / np.maximum(1, total)[:, None]).reshape(len(y), -1, k) + bias
            for d in range(len(y)):
                p = _softmax(logits[d][:, None, :] / HEAT[:, None])
                sums -= weigh[y[d]] * np.log(np.maximum(p[:, :, y[d]], 1e-12))
        yield pa.RecordBatch.from_arrays([pa.array(range(sums.size), pa.int32()), pa.array(sums.ravel())], ["i", "loss"])

    return run


def train(docs: DataFrame, learn: Column) -> Model | None:
    """docs: doc_id, text, lang. Everything is learnt from every row where `learn` holds; a fifth of them chooses penalty and temperature."""
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    counts = {r["f"]: r["n"] for r in rows.select("text").mapInArrow(_document_frequency, "f int, n long").groupBy("f").agg(F.sum("n").alias("n")).collect()}
    n = counts.pop(-1, 0)
    if not n:
        return None
    df = np.zeros(FEATURES)
    df[list(counts)] = list(counts.values())
    idf = np.log((1 + n) / (1 + df)) + 1
    kept_out = F.pmod(F.xxhash64("doc_id", "text", F.lit(7)), F.lit(5)) == 0
    sizes = {(r["lang"], r["out"]): r["n"] for r in rows.groupBy("lang", kept_out.alias("out")).agg(F.count("*").alias("n")).collect()}
    labels = sorted({x for x, _ in sizes})
    taught = sum(c for (_, out), c in sizes.items() if not out)
    split = 4 < n and 0 < taught < n
    lessons, tests = (rows.where(~kept_out), rows.where(kept_out)) if split else (rows, rows)
    taught = taught if split else n
    weigh = np.array([min(1.0, n / len(labels) / sum(sizes.get((x, out), 0) for out in (False, True))) for x in labels])
    state, k = np.zeros((FEATURES + 1, 2 * len(labels))), len(labels)
    kind, group = "part int, n long, m binary", int(np.clip(taught // LEAST_STEPS, 1, GROUP))
    for _ in range(int(np.clip(MET // taught, 1, PASSES))):
        run = _learner(state[:, :k], state[:, k:], idf, labels, weigh, group)
        got = lessons.select("text", "lang").coalesce(max(1, taught // TASK_DOCS)).mapInArrow(run, kind).groupBy("part").applyInArrow(_mean, kind).orderBy("part").collect()
        state = np.concatenate([np.frombuffer(r["m"], np.float32) for r in got]).reshape(state.shape).astype(np.float64)
    z, squares = state[:, :k], state[:, k:]
    found = tests.select("text", "lang").mapInArrow(_losses(z, squares, idf, labels, weigh), "i int, loss double").groupBy("i").agg(F.sum("loss").alias("loss")).orderBy("i").collect()
    loss = np.array([r["loss"] for r in found]).reshape(len(PENALTIES), -1) / sum(weigh[labels.index(x)] * c for (x, out), c in sizes.items() if out or not split)
    best = max(i for i in range(len(PENALTIES)) if loss[i].min() <= loss.min() + TOLERANCE)
    return Model(labels, idf).settle(z, squares, PENALTIES[best], float(HEAT[int(np.argmin(loss[best]))]))


def _predictor(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in blocks(batches, "text", BLOCK):
            if model is None:
                lang, score = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            else:
                best, score = model.predict(data, offs)
                lang = [*model.labels, "und"]
                lang = [lang[b] for b in best.tolist()]
            rest = [batch.column(c) for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(lang, pa.string()), pa.array(score)], [*[c for c in batch.schema.names if c != "text"], "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score. docs: doc_id, held_out, text."""
    return docs.select("doc_id", "held_out", "text").mapInArrow(_predictor(model), "doc_id long, held_out boolean, lang_pred string, score double")


def fold(id_col: str, parts: int) -> Column:
    return F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % parts


def identify(docs: DataFrame) -> DataFrame:
    """Learns from the documents outside the held-out fold and predicts all."""
    held = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", held.alias("held_out"))
    return predict(slim, train(slim, ~F.col("held_out")))


def _keeper(model: Model | None, min_score: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in blocks(batches, "text", BLOCK):
            if model is not None:
                best, score = model.predict(data, offs)
                yield batch.filter(pa.array((best >= 0) & (score >= min_score)))

    return run


def keep_identified(docs: DataFrame, min_score: float = 0.3) -> DataFrame:
    """The documents, all columns, whose language is identified: not `und`, and the best language has at least `min_score`."""
    held = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    model = train(docs.select("doc_id", "text", "lang", held.alias("held_out")), ~F.col("held_out"))
    return docs.mapInArrow(_keeper(model, min_score), docs.schema)

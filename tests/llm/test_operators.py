"""The operators against brute force on small and awkward inputs: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from citeloom.llm import decontaminate, htmltext, langid, langmodel, linededup, neardup, packing, sharding, substrings, topk
from citeloom.llm.common import text_bytes

WORDS = ["alpha", "beta", "gamma", "delta", "über", "straße", "niño", "of", "the", "and", "la", "der"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    base = ["\n".join(" ".join(rng.choices(WORDS, k=rng.randint(3, 12))) + f" w{rng.randint(0, 500)}" for _ in range(rng.randint(1, 9))) for _ in range(40)]
    out = base + base[:5] + [base[6] + " tail", base[7].replace("alpha", "omega"), "x" * 49, "y" * 50, "y" * 51, "", None, "Long " * 4000 + base[8]]
    return list(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ["en", "de", None][i % 3], f"s{i}", "clash") for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _k string").drop("_k")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


def test_sharding(spark, docs, texts):
    rows = sharding.shard_by_bytes(docs, 7).collect()
    assert len(rows) == len(texts)
    by = {}
    for r in rows:
        text = dict(texts)[r["doc_id"]] or ""
        assert r["size"] == len(text.encode()) + 16 and r["text_crc32"] == zlib.crc32(text.encode())
        by.setdefault(text, set()).add(r["shard"])
    assert all(len(s) == 1 for s in by.values())
    for s in {r["shard"] for r in rows}:
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert sharding.shard_by_bytes(empty(spark)).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_least_capacity(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 2, 5, 50]) for _ in range(rng.randint(1, 40))]
    k = rng.randint(1, 8)
    segs = sharding.Segments([(i, i, s, True) for i, s in enumerate(sizes)])

    def needed(cap):
        n, left = 1, cap
        for s in sizes:
            if s > cap:
                return 10**9
            if s > left:
                n, left = n + 1, cap
            left -= s
        return n

    assert segs.least(k, False) == next(c for c in range(1, sum(sizes) + 1) if needed(c) <= k)


def test_packing(spark, docs, texts):
    from tokenizers import Tokenizer

    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack(docs, 64).collect()
    seqs = {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        ids = np.array([*tok.encode(dict(texts)[r["doc_id"]] or "", add_special_tokens=False).ids, 0], "<u4")
        assert zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(empty(spark)).count() == 0


@pytest.mark.parametrize("text", ["it's we'll  x", "a  b\n\n c\t d  ", "", "   ", "<|endoftext|> x", "日本 語 x", "é×÷ü", " a", "''s", "1 2  3", "...  !!\r\n\r\nab ñ1é", "a \x85 b\xa0c"])
def test_ids(text):
    import pyarrow as pa

    import public_tokenizers
    from citeloom.llm.common import text_bytes
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert list(packing.encoder("byte_bpe_50k").encode_block(*text_bytes(pa.array([text])))[0]) == tok.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(10))
def test_plan(seed):
    rng = random.Random(seed)
    counts = {rng.randint(1, 100): rng.randint(1, 30) for _ in range(rng.randint(1, 40))}
    runs, made = packing.plan(counts, 100)
    bins = [[] for _ in range(made)]
    for s, n in counts.items():
        mine = sorted(r for r in runs if r[0] == s)
        for i in range(n):
            r = [x for x in mine if x[1] <= i][-1]
            bins[r[2] + i - r[1]].append((r[3], s))
    for b in bins:
        at = 0
        for offset, s in sorted(b):
            assert offset == at
            at += s
        assert 0 < at <= 100


def test_top_k(spark):
    rng = random.Random(2)
    vecs = [(i, [rng.choice([0.0, 0.5, 1.0]) for _ in range(4)]) for i in range(60)] + [(100, None), (101, [1.0, None, 0.0, 0.0]), (102, [float("nan")] * 4), (103, [1.0])]
    got = topk.top_k(spark.createDataFrame(vecs, "vec_id long, embedding array<float>"), 5).collect()
    ints = {i: [int(np.floor(64 * x)) for x in v] for i, v in vecs[:60]}
    for q in (0, 20, 40):
        want = sorted((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q)[:5]
        assert [(-r["score"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == want
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    twice = [(20, [1.0, 0.0], 1), (20, [0.0, 1.0], 2), (3, [1.0, 0.0], 3), (3, [0.0, 2.0], 4), (4, [0.0, 1.0], 5)]
    rows = topk.top_k(spark.createDataFrame(twice, "vec_id long, embedding array<float>, id int"), 5).orderBy("rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in rows] == [(20, 3, 8192), (20, 4, 4096), (20, 3, 0)]


def removed_strings(rows):
    """Brute force: id -> sorted (n_bytes, n_removed, n_spans, sha256), ids alike as one document, null ids last."""
    last = 1 << 63
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            s = b[p : p + 50]
            least[s] = min(least.get(s, last), last if i is None else i)
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        dead = bytearray(len(b))
        for p in range(len(b) - 49):
            if least[b[p : p + 50]] < (last if i is None else i):
                dead[p : p + 50] = b"\1" * 50
        kept = bytes(x for x, d in zip(b, dead) if not d)
        out.setdefault(i, []).append((len(b), sum(dead), len(re.findall(b"\1+", bytes(dead))), hashlib.sha256(kept).hexdigest()))
    return {i: sorted(v) for i, v in out.items()}


def dedupped(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]))
    return {i: sorted(v) for i, v in out.items()}


def test_substrings(spark, docs, texts):
    assert dedupped(substrings.dedup_substrings(docs)) == removed_strings(texts)
    assert substrings.dedup_substrings(empty(spark)).count() == 0


def test_substring_pieces_spread():
    """Buckets get like numbers of pieces: the first of 64 held a third of them when least hashes dealt them."""
    data = np.random.default_rng(1).integers(97, 123, 200_000).astype(np.uint8)
    offs = np.array([0, len(data)])
    ints = pa.list_(pa.int32())
    row = pa.record_batch({"row": pa.array([0]), "ids": pa.array([[1]]), "offs": pa.array([offs], ints), "starts": pa.array([substrings._phrases(data, offs)], ints), "data": pa.array([data.tobytes()])})
    n = np.bincount(substrings._bucket(substrings.Row(row, 0, 50).pieces()[0], 64), minlength=64)
    assert n.sum() > 10_000 and n.max() < 2 * n.mean()


@pytest.mark.parametrize("bucketed_from", [0, 1 << 60])
def test_substring_row_groups(spark, bucketed_from):
    """Rows of a megabyte stand in row groups of 8 MB: before, all of a task, up to 100 and more, stood in one, which a reader holds at once."""
    from urllib.parse import urlparse

    import pyarrow.parquet as pq

    docs = spark.range(0, 40, 1, 1).selectExpr("id AS doc_id", "repeat(cast(id + 10 AS string), 500000) AS text")
    rows, total = substrings._corpus(docs, bucketed_from)
    files = [pq.ParquetFile(urlparse(f).path).metadata for f in rows.inputFiles()]
    groups = [m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)]
    assert total == 40_000_000 and rows.count() == sum(groups) and max(groups) * substrings.ROW_BYTES <= substrings.GROUP_BYTES


@pytest.mark.parametrize("hot_rows, bucketed_from", [(substrings.HOT, 0), (1, 1 << 60), (0, 0)])
def test_substrings_other_ways(spark, texts, hot_rows, bucketed_from):
    rng = random.Random(3)
    line = " ".join(rng.choices(WORDS, k=14))
    rows = [*texts, *texts[3:6], (None, texts[2][1]), (None, "nobody else has this " * 9), (7, line + " seven"), (7, "x " + line)]
    rows += [(100 + i, f"{rng.random()} {line} {rng.random()}" + "\0" * rng.randint(40, 90)) for i in range(30)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, "a", "b", 1) for i, t in rows], "doc_id long, text string, row string, data string, ids int").repartition(5)
    got = dedupped(substrings.dedup_substrings(df, hot_rows=hot_rows, bucketed_from=bucketed_from))
    assert got == removed_strings(rows)


@pytest.mark.parametrize("most", [1, 40, 1 << 19])
def test_corpus_order_of_a_bucket(most):
    rng = random.Random(most)
    texts = ["".join(rng.choices("ab", k=rng.randint(50, 60))) if k % 3 else "ab" * 26 for k in range(60)]
    docs = [rng.randint(1, 20) for _ in texts]
    pack = lambda v, k: np.array(v, k).tobytes()
    halves = [range(0, 25), range(25, 60)]
    cols = {"row": [0, 1], "key": [pack([0] * len(h), np.uint32) for h in halves], "doc": [pack([docs[i] for i in h], np.int64) for h in halves], "first": [pack([1000 * i for i in h], np.uint32) for h in halves], "n": [pack([len(texts[i]) for i in h], np.uint16) for h in halves], "data": ["".join(texts[i] for i in h).encode() for h in halves]}
    got = [{"row": r["row"], "a": a, "b": b} for r in substrings._decide(50, most)(pa.table(cols)).to_pylist() for a, b in zip(*(x.tolist() for x in substrings._unpacked(r["cuts"])))]
    least = {}
    for t, d in zip(texts, docs):
        for p in range(len(t) - 49):
            least[t[p : p + 50]] = min(least.get(t[p : p + 50], 99), d)
    want = {(i, p) for i, (t, d) in enumerate(zip(texts, docs)) for p in range(len(t) - 49) if least[t[p : p + 50]] < d}
    assert {(r["a"] // 1000, p) for r in got for p in range(r["a"] % 1000, r["b"] % 1000 - 49)} == want
    assert all(r["row"] == (r["a"] // 1000 >= 25) for r in got)


def test_suffix_array():
    rng = random.Random(2)
    data = bytes(rng.choices(b"ab\0", k=400)) + b"ab" * 60
    for depth in (8, 13, 50):
        starts = np.array(rng.sample(range(len(data) - depth + 1), 300))
        order, differs = substrings.suffix_array(data, starts, depth)
        texts = [data[s : s + depth] for s in starts[order].tolist()]
        assert texts == sorted(texts) and differs.tolist() == [i == 0 or texts[i] != texts[i - 1] for i in range(300)]


def deduped_lines(rows):
    """Brute force, from the definition: (id, text) -> text without repeated chunks."""
    def order(row):
        return (row[0] is None, row[0] or 0)

    def cut(text):
        lines, out, prev = text.split("\n"), [[]], 0
        for x in lines:
            h = int(hashlib.md5(x.encode()).hexdigest()[:8], 16)
            out[-1].append(x)
            if (prev * 31 + h) % linededup.SPARSE == 0:
                out.append([])
            prev = h
        return out if out[-1] else out[:-1]

    seen, out = set(), {}
    for row in sorted({r for r in rows if r[1] is not None}, key=order):
        keep = []
        for c in cut(row[1]):
            if len(c) < linededup.LEAST or "\n".join(c) not in seen:
                keep += c
            if len(c) >= linededup.LEAST:
                seen.add("\n".join(c))
        out[row] = "\n".join(keep)
    return out


@pytest.mark.parametrize("few", [linededup.BROADCAST_ROWS, 0])
def test_line_dedup(spark, texts, monkeypatch, few):
    monkeypatch.setattr(linededup, "BROADCAST_ROWS", few)
    rows = [*texts, texts[3], (90, "one\ntwo\none\ntwo\none\ntwo\nthree\none\ntwo"), (91, "\n\n\n\n"), (92, "\n\n\n\n")]
    df = spark.createDataFrame([(i, t, -1, "gone", [1], 5, 6) for i, t in rows], "doc_id long, text string, _k long, gone string, _out array<int>, n_removed long, d int")
    got = linededup.dedup_lines(df)
    assert got.columns == ["doc_id", "text", "_k", "gone", "_out", "d", "n_lines", "n_removed"]
    want, found = deduped_lines(rows), got.collect()
    assert len(found) == len(rows)
    by = {}
    for i, t in rows:
        by.setdefault(i, set()).add(t)
    for r in found:
        (t,) = by[r["doc_id"]]
        assert r["text"] == (want[r["doc_id"], t] if t is not None else None)
        assert r["n_lines"] == (len(t.split("\n")) if t is not None else 0)
        assert (r["_k"], r["gone"], r["_out"], r["d"]) == (-1, "gone", [1], 6)
    assert sum(r["n_removed"] for r in found) > 20
    assert linededup.dedup_lines(empty(spark)).count() == 0


def test_line_dedup_of_repeated_and_null_ids(spark):
    lines = "\n".join(f"shared line {k}" for k in range(12))
    own = "\n".join(f"unrelated line {k}" for k in range(12))
    for i in (7, None):
        rows = linededup.dedup_lines(spark.createDataFrame([(1, lines), (i, lines), (i, own), (i, own)], "doc_id long, text string")).collect()
        assert sorted(r["text"] for r in rows if "unrelated" in r["text"]) == [own, own]
        assert [r["n_removed"] > 3 for r in rows if r["doc_id"] == i and "unrelated" not in r["text"]] == [True]
        assert [r["n_removed"] for r in rows if r["doc_id"] == 1] == [0]


def grams(t):
    w = re.findall(rb"[a-z0-9\x80-\xff]+", (t or "").encode().lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def linked_rows(rows):
    """Brute force: for each row the rows it is linked with, and those it is connected with (itself too)."""
    sets = [grams(t) for _, t in rows]
    links = [{j for j, s in enumerate(sets) if j != i and s and own and len(s & own) >= 0.8 * len(s | own)} for i, own in enumerate(sets)]
    groups = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        groups.append(seen)
    return links, groups


@pytest.mark.parametrize("block, few", [(neardup.BLOCK_DOCS, neardup.BROADCAST_ROWS), (4, 0)])
def test_near_duplicates(spark, texts, monkeypatch, block, few):
    monkeypatch.setattr(neardup, "BLOCK_DOCS", block)
    monkeypatch.setattr(neardup, "BROADCAST_ROWS", few)
    rng = random.Random(9)
    vocab = [f"v{i}" for i in range(400)]
    long = rng.choices(vocab, k=90)
    rows = [*texts, texts[2], texts[50], (None, texts[4][1]), (None, "nobody has this text but me alone"), (3, " ".join(long))]
    for i in range(40):  # a chain: ever further from `long`
        at = rng.randrange(len(long))
        long = [*long[:at], rng.choice(vocab), *long[at + 1 :]] if i % 3 else long[:]
        rows.append((200 + i, " ".join(long) + "." * (i % 2)))
    links, groups = linked_rows(rows)
    assert max(map(len, groups)) > 30 and any(len(links[i]) < len(g) - 1 for i, g in enumerate(groups))
    df = spark.createDataFrame([(i, t, 1, 2, "c") for i, t in rows], "doc_id long, text string, k long, v long, cell string").repartition(3)
    got = {}
    for r in neardup.join(df).collect():
        got.setdefault((r["doc_id"], r["text_a"], r["text_b"]), []).append(r)
    hashes = df.select("doc_id", "text", *[h.alias(c) for h, c in ((F.xxhash64("text"), "a"), (F.xxhash64(F.lit(1), "text"), "b"))]).distinct().collect()
    key = {(r["doc_id"], r["text"]): (r["doc_id"], r["a"], r["b"]) for r in hashes}
    for (i, row), link, group in zip(enumerate(rows), links, groups):
        mine = got[key[row]]
        assert len(mine) == rows.count(row) and {r["n_links"] for r in mine} == {len(link)}
        ids = [rows[j][0] for j in group if rows[j][0] is not None]
        assert not ids or {r["class_id"] for r in mine} == {min(ids)}
        assert ids or all(r["class_id"] < 0 for r in mine)
        twins = [rows[j][0] for j in range(len(rows)) if grams(rows[j][1]) == grams(row[1]) and grams(row[1]) and rows[j][0] is not None]
        assert not twins or {r["copy_id"] for r in mine} == {min(twins)}
    for group in map(frozenset, groups):
        assert len({key[rows[j]] for j in group if got[key[rows[j]]][0]["leads"]}) == 1
    assert neardup.join(empty(spark)).count() == 0


def test_near_duplicates_of_repeated_ids(spark):
    one = " ".join(f"word{k}" for k in range(60))
    rows = [(1, one), (1, "something else entirely that no other document says"), (2, one.replace("word59", "other")), (5, "given twice as it is for once"), (5, "given twice as it is for once")]
    got = {(r["doc_id"], r["n_links"], r["class_id"]) for r in neardup.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1, 1), (1, 0, 1), (2, 1, 1), (5, 1, 5)}


def test_decontamination(spark, docs):
    item = "the quick crimson llama silently ordered seventeen purple lanterns before dawn arrived. Its answer was marigold under glass."
    leak = [(900, "intro words here " * 20 + item + " and more text " * 9), (901, "nothing to see"), (902, None)]
    d = docs.select("doc_id", "text").unionByName(spark.createDataFrame(leak, "doc_id long, text string"))
    got = decontaminate.leaks(d, spark.createDataFrame([(7, item), (8, None)], "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(900, 7)}
    assert decontaminate.lcs([1, 2, 3, 4], [2, 9, 4, 1])[0] == 2
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(d, none).count() == 0


def test_decontamination_of_a_frequent_item(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(2000)]
    item = "the quick crimson llama silently ordered seventeen purple lanterns before dawn arrived. Its answer was marigold under glass."
    other = item.replace("crimson", "tall").replace("purple", "dim")  # 16 of 18 words
    rows = [(i, " ".join(rng.choices(vocab, k=70)) + (f" {other if i % 30 == 0 else item} " if i % 3 == 0 else " ") + " ".join(rng.choices(vocab, k=70))) for i in range(600)]
    rows.append((900, " ".join(rng.choices(vocab, k=40000)) + f" {item} " + " ".join(rng.choices(vocab, k=30000))))
    got = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(i, 7) for i in [*range(0, 600, 3), 900]}


def test_decontamination_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEMS", 2)
    rng = random.Random(9)
    made = [" ".join(f"x{rng.randint(0, 5000)}" for _ in range(20)) + "." for _ in range(7)]
    ids = [None, 1, 5, 5, 5, 5, 6]
    d = spark.createDataFrame([(i, f"some words before {t} and after") for i, t in enumerate(made)], "doc_id long, text string")
    got = decontaminate.leaks(d, spark.createDataFrame(list(zip(ids, made)), "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == set(enumerate(ids))


def test_decontamination_basis_of_all_documents(spark):
    """The pass that the basis comes from takes in every passage of every document, also of more than 1,000."""
    rng = random.Random(12)
    made = [" ".join(f"u{i % 40}x{rng.randint(0, 9)}" for _ in range(rng.choice([1, 30, 48, 49, 120]))) for i in range(1500)]
    texts = spark.createDataFrame([(t,) for t in made], "text string").repartition(3)
    rng = np.random.default_rng(1)
    idf = np.where(rng.random(decontaminate.FEATURES) < 0.1, 0, rng.random(decontaminate.FEATURES))
    q = rng.normal(size=(decontaminate.FEATURES, 5))
    want = np.zeros(q.shape)
    for t in made:
        words = decontaminate._terms(decontaminate._words(*text_bytes(pa.array([t])))[0])
        for k in range(0, len(words), decontaminate.PASSAGE):
            x = np.bincount(words[k : k + decontaminate.PASSAGE], minlength=decontaminate.FEATURES) * idf
            if x.any():
                x /= np.linalg.norm(x)
                want += np.outer(x, x @ q)
    assert np.allclose(decontaminate._summed(texts, q, idf), want, rtol=1e-3, atol=1e-3)
    v = decontaminate.basis(texts, texts.limit(3), idf)
    assert v.shape == (decontaminate.FEATURES, decontaminate.RANK) and np.allclose(v.T @ v, np.eye(decontaminate.RANK), atol=1e-6)


def test_decontamination_of_paraphrases(spark):
    """Recall against brute force: the comparison of every item with every stretch of every text."""
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(3000)]
    items = [" ".join(rng.choices(vocab, k=30)) + ". " + " ".join(rng.choices(vocab, k=6)) + "." for _ in range(12)]
    rows = []
    for i in range(240):
        words = items[i % 12].split()
        for k in rng.sample(range(29), rng.randint(6, 16)):  # the last sentence stays
            words[k] = rng.choice(vocab)
        rows.append((i, " ".join([*rng.choices(vocab, k=60), *(words if i % 2 else []), *rng.choices(vocab, k=60)])))
    got = decontaminate.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    want = set()
    for d, t in rows:
        b = t.lower().split()
        for i, item in enumerate(items):
            a = item.replace(".", "").split()
            share = max(decontaminate.lcs(a, b[k : k + len(a) + 12])[0] for k in range(0, len(b), 6)) / len(a)
            if share >= decontaminate.PARAPHRASE and " ".join(a[-6:]) in t.replace(".", ""):
                want.add((d, i))
    found = {(r["doc_id"], r["item_id"]) for r in got}
    assert len(want) > 60 and len(found & want) >= 0.9 * len(want)
    assert all(i == d % 12 and d % 2 for d, i in found)


def test_html(spark):
    pages = [
        (1, "http://a.x/1", "<body><header>h</header><nav>n</nav><article><h1>T &amp; t</h1><p>one\n two<p>three<div class='comments'><p>c</div></article><footer>f</footer>"),
        (2, None, None),
        (3, "http://a.x/2", "<div id=cookie-notice>x</div><div><p>plain</p></div><script>y</script>"),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in htmltext.extract(df).collect()} == {1: "T & t\none two\nthree", 2: "", 3: "plain"}
    same = [(i, f"http://b.x/{i}", f"<div class=tag>Shared slogan</div><div class=body>{' '.join(random.Random(i).choices(WORDS, k=9))}</div>") for i in range(8)]
    got = htmltext.extract(spark.createDataFrame(same, "page_id long, url string, html string")).collect()
    assert not any("slogan" in r["text"] for r in got) and all(r["text"] for r in got)


def shop(i, menu, words=30):
    """A page without telling names: a menu, a text of its own, links that change, a line at the end."""
    rng = random.Random(i)
    own = "".join(f"<p>{' '.join(rng.choices(WORDS, k=words))} {i} {k}</p>" for k in range(rng.randint(1, 6)))
    return f"<body><div class=x1>{menu}</div><div class=x2><h2>Own {i}</h2>{own}<p>Share this with your friends today</p></div><div class=x3><p>Shared words at the end of it</p></div></body>"


def test_html_tree_without_names(spark, monkeypatch):
    monkeypatch.setattr(htmltext, "_NOISE_TAGS", frozenset())
    monkeypatch.setattr(htmltext, "_NOISE_WORDS", frozenset())
    menu = "<div>" + "".join(f"<p>Item number {k}</p>" for k in range(6)) + "</div>"
    pages = [(i, f"https://Shop.example/{i}", shop(i, menu)) for i in range(12)] + [(50, "https://alone.example/", shop(50, menu)), (51, None, shop(51, menu)), (52, "https://shop.example/52", "<i>no block</i>")]
    rows = {r["page_id"]: r["text"] for r in htmltext.extract(spark.createDataFrame([(*p, 1, "z") for p in pages], "page_id long, url string, html string, host int, cut string")).collect()}
    for i in range(12):
        assert rows[i].startswith(f"Own {i}\n") and not re.search("Item number|Shared words|Share this", rows[i]) and rows[i].count("\n") == shop(i, menu).count(f" {i} ")
    assert all("Item number 3" in rows[i] and "Shared words" in rows[i] for i in (50, 51)) and rows[52] == "no block"
    whole = {p[0]: htmltext.main_text(htmltext.Page(p[2]), set()) for p in pages}
    assert all(whole[i] != rows[i] for i in range(12))


def test_html_tree_importance(spark):
    menu = "<p>Home</p><p>News</p>"
    pages = [(i, shop(i, menu)) for i in range(6)] + [(7, shop(3, "<p>other</p>")), (7, shop(3, "<p>another</p>"))]  # copies of page 3 are that page again
    df = spark.createDataFrame([(1, h) for _, h in pages], "host long, html string")
    branches, texts = htmltext.style_tree(df)
    got = {r["node"]: r for r in branches.collect()}
    import math

    menu, own = got[htmltext._h("/body/div.x1/p")], got[htmltext._h("/body/div.x2")]
    assert (menu["m"], own["m"]) == (6, 6)
    logs = [math.log(6), math.log(6), 0.0, 0.0]  # Home, News, other, another
    logs[2:] = [0.0, 0.0]
    assert menu["content"] == pytest.approx(1 - sum(logs) / math.log(6) / 4)
    seqs = {}
    for i in range(6):
        seqs.setdefault(shop(i, "").count(f" {i} "), []).append(i)
    entropy = -sum(len(v) / 6 * math.log(len(v) / 6) for v in seqs.values()) / math.log(6)
    assert own["presentation"] == pytest.approx(entropy) and own["content"] > 0.9
    assert own["importance"] > 0.7 and got[htmltext._h("/body/div.x3")]["importance"] == pytest.approx(2 / 8 + 6 / 8 * (1 - 0.9) * 0, abs=0.01)
    assert {round(r["importance"], 3) for r in texts.collect()} == {0.25}


def test_html_rows(spark):
    page = "<article><p>same text</p></article>"
    rows = htmltext.extract(spark.createDataFrame([(1, "http://a.x/", page), (1, "http://a.x/", page), (None, "http://a.x/2", ""), (3, "http://a.x/3", "<p>" + "long word " * 200_000)], "page_id long, url string, html string")).collect()
    assert sorted((r["page_id"] or 0, r["text"][:9], r["n_chars"]) for r in rows) == [(0, "", 0), (1, "same text", 9), (1, "same text", 9), (3, "long word", 1_999_999)]
    assert htmltext.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_language(spark):
    rng = random.Random(3)
    words = {"en": "the of and to in is that it was for".split(), "de": "der die und das nicht ein ist mit sich auf".split()}
    rows = [(i, " ".join(rng.choices(words[x], k=15)), x) for i, x in enumerate(["en", "de"] * 100)] + [(500, None, "en"), (501, "12 34 !", "de"), (502, "der die das", None)]
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    held = [i for i, _, _ in rows[:200] if got[i]["held_out"]]
    assert held and np.mean([got[i]["lang_pred"] == rows[i][2] for i in held]) > 0.95
    assert got[500]["lang_pred"] == got[501]["lang_pred"] == "und" and got[502]["lang_pred"] == "de"
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert langid.identify(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def test_language_learns_all_rows(spark):
    """Weights are learnt from every learning document but the fifth that chooses penalty and temperature."""
    rows = [(i, f"{['the of and', 'der die das'][i % 2]} {chr(0x4E00 + i)}{chr(0x4E00 + i)}{chr(0x4E00 + i)}", ["en", "de"][i % 2]) for i in range(6000)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), F.lit(True))
    whole = 0
    for _, t, _ in rows:
        cp, at = langid._code_points(*text_bytes(pa.array([t])))
        whole += all(model.seen[f].all() for f, _ in langid._grams(cp, at))
    assert 0.75 * len(rows) < whole < 0.9 * len(rows)


def test_language_model(spark, docs, texts):
    got = {r["doc_id"]: r for r in langmodel.score(docs).collect()}
    split = lambda t: [w for w in re.split(rb"[\x20\x09-\x0d]+", bytes((t or "").encode().translate(bytes(b + 32 if 65 <= b < 91 else b for b in range(256))))) if w]
    count, ends = {}, 0
    for i, t in texts:
        if zlib.crc32(str(i).encode()) % 10:
            ends += 1
            for w in split(t):
                count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()) + ends, len(count) + 1
    for i, t in texts:
        cs = [count.get(w, 0) for w in split(t)] + [ends]
        assert got[i]["n_tokens"] == len(cs) and got[i]["n_known"] == sum(c > 0 for c in cs) and got[i]["train_tokens"] == n
        assert got[i]["base_score"] == pytest.approx(sum(np.log10((c + 0.1) / (n + 0.1 * (v + 1))) for c in cs))
        assert got[i]["score"] < 0


def test_language_model_learns_all_rows(spark):
    rng = random.Random(6)
    rows = [(i if i % 9 else None, " ".join(rng.choices(WORDS, k=3000))) for i in range(200)] + [(900, None), (901, ""), (902, "alpha")]
    texts = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    net = langmodel.Network(np.zeros(0, np.int64), np.ones(langmodel.VOCAB))
    before = net.weights()
    n = 200 * 3001 + 1 + 1 + 2
    assert langmodel.train(net, texts, n) == n
    assert np.isfinite(net.weights()).all() and (net.weights() != before).any()

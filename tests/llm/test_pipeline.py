"""The pipeline's stages on awkward rows, and the whole of it on a small corpus against the stages' brute force."""

import os
import random
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
corpus_pipeline = pytest.importorskip("corpus_pipeline")
common = pytest.importorskip("citeloom.llm.common")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, whole string, key_id int, gone string, n_removed int, leads boolean"
EN = "the of and to in is that it was for on are with as at be this have from or".split()
DE = "der die und das nicht ein ist mit sich auf den von zu im dem für eine als auch".split()


def row(i, text, lang="en"):
    return (i, text, lang, "s", None if text is None else len(text), "w", 1, "g", 2, True)


def prose(rng, words, n):
    return " ".join(rng.choices(words, k=n))


@pytest.fixture(scope="module")
def benchmark_dir(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    item = "what colour has the sky over the northern harbour in the early morning hours of march. a pale shade of green."
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").toPandas().to_parquet(at / "benchmark.parquet")
    return str(at), item


def test_stages_keep_columns_and_empty_tables(spark, benchmark_dir):
    none = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, none, benchmark_dir[0])
        assert out.columns == none.columns and out.count() == 0, name
    assert corpus_pipeline.packed(spark, none, benchmark_dir[0]).count() == 0


def test_language_id(spark, benchmark_dir):
    rng = random.Random(1)
    rows = [row(i, prose(rng, EN if i % 2 else DE, 30), "en" if i % 2 else "de") for i in range(120)] + [row(500, None), row(501, "12 -- 34"), row(502, ""), row(None, prose(rng, EN, 30), None), row(3, prose(rng, EN, 25))]
    out = corpus_pipeline.language_id(spark, spark.createDataFrame(rows, SCHEMA), benchmark_dir[0])
    assert {(r["doc_id"], r["text"], r["gone"]) for r in out.collect()} == {(r[0], r[1], "g") for r in rows if r[0] not in (500, 501, 502)}


def test_line_dedup(spark, benchmark_dir):
    shared = "\n".join(f"line number {k} of the notice" for k in range(10))
    rows = [row(1, shared), row(2, "own words first\n" + shared + "\nown words last"), row(3, shared), row(4, None), row(5, ""), row(None, "another own text")]
    out = {r["doc_id"]: r for r in corpus_pipeline.line_dedup(spark, spark.createDataFrame(rows, SCHEMA), benchmark_dir[0]).collect()}
    assert 3 not in out or out[3]["text"].count("line number") < 10  # nothing or the borders are left
    assert out[1]["text"] == shared and out[2]["text"].startswith("own words first") and len(out[2]["text"]) < len(rows[1][1]) and out[2]["n_chars"] == len(out[2]["text"])
    assert out[4]["text"] is None and out[5]["text"] == "" and out[None]["text"] == "another own text"
    assert all((r["n_removed"], r["gone"], r["whole"], r["key_id"]) == (2, "g", "w", 1) for r in out.values())


def test_near_duplicates(spark, benchmark_dir):
    rng = random.Random(2)
    a, b = prose(rng, [f"w{k}" for k in range(300)], 80), prose(rng, [f"v{k}" for k in range(300)], 80)
    rows = [row(7, a), row(3, a + " more"), row(None, a), row(9, b), row(9, b), row(9, "other words under the same id"), row(None, "alone without an id of its own"), row(None, None), row(12, "!"), row(13, "!")]
    out = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), benchmark_dir[0]).collect()
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in out)) == sorted([(False, 3, a + " more"), (False, 9, b), (False, 9, "other words under the same id"), (True, 0, "alone without an id of its own"), (True, 0, ""), (False, 12, "!"), (False, 13, "!")])


def test_decontamination(spark, benchmark_dir):
    at, item = benchmark_dir
    rng = random.Random(3)
    clean = [row(i, prose(rng, EN, 60)) for i in range(40)]
    rows = [*clean, row(50, "before it " + item + " behind it"), row(50, "clean under the same id"), row(None, item), row(None, "clean without an id"), row(51, None)]
    out = corpus_pipeline.decontamination(spark, spark.createDataFrame(rows, SCHEMA), at)
    assert out.columns == SCHEMA.replace(",", "").split()[::2]
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in out.collect()) == sorted((str(r[0]), r[1] or "") for r in rows if not (r[1] and item in r[1]))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_run(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    pieces = corpus_pipeline.run(spark, d).collect()
    by = {}
    for r in pieces:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in v) <= 2048 and sorted(v)[0][0] == 0 for v in by.values())
    items = [r["text"] for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {r["doc_id"] for r in pieces}
    assert not [i for i in kept if any(t in texts[i] for t in items)]
    assert docs.where(F.col("text").rlike(r"\p{L}")).count() - len(kept) < len(texts) / 2


def test_small_batches(spark):
    """A stage leaves no batches of 64 MB for Python; a size that the session names stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(key)
    try:
        for given, want in ((None, common.BATCH_BYTES), ("123456b", 123456)):
            spark.conf.unset(key) if given is None else spark.conf.set(key, given)
            corpus_pipeline.packed(spark, spark.createDataFrame([(1, "a")], "doc_id long, text string"), "")
            assert int(spark.conf.get(key).rstrip("b")) == want
    finally:
        spark.conf.set(key, old)


def test_packing_query_in_small_batches(spark, tmp_path):
    """The op8 query packs as the pipeline's stage does: no batches of 64 MB for Python."""
    from citeloom.llm import entry

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(key)
    try:
        spark.conf.unset(key)
        spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
        assert entry.op8_best_fit_packing(spark, str(tmp_path)).count() == 2
        assert int(spark.conf.get(key).rstrip("b")) == common.BATCH_BYTES
    finally:
        spark.conf.set(key, old)

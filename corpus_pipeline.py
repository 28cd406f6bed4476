"""From raw documents to packed training sequences: five operators of citeloom.llm, each on all that the one before kept.

Documents are rows: stages tell them apart by doc_id and text, so rows that share a doc_id, or have none, are decided on each
by itself; of rows equal in both, near_duplicates keeps one. All stages but the last return the columns they were given,
under any names; an empty table gives an empty table. Null and wordless texts are dropped by language_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm import decontaminate, langid, linededup, neardup, packing
from citeloom.llm.common import materialize, small_batches, table

#: Keys of documents (24 bytes each) that may be broadcast to drop them; more are joined by shuffle.
BROADCAST_KEYS = 400_000
_KEY = ("key_id", "key_a", "key_b")


def _keyed(docs: DataFrame) -> DataFrame:
    """whole (all columns in one), doc_id, text, and the row's key."""
    whole = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("whole")
    ident = F.col("doc_id").cast("long")
    return docs.select(whole, ident.alias("doc_id"), "text", F.coalesce(ident, F.lit(-1 << 63)).alias("key_id"), F.xxhash64("text").alias("key_a"), F.xxhash64(F.lit(1), "text").alias("key_b"))


def _columns(rows: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    return rows.select(*[new.get(c, F.col("whole").getField(c)).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def _without(keyed: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose key isn't among `keys`."""
    keys = materialize(keys.distinct(), "dropped")
    return keyed.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, list(_KEY), "left_anti")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without an identified language: null texts, texts without a letter, and all if none could be learnt."""
    small_batches(spark)
    return langid.keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated chunks of lines out of the texts and sets n_chars anew where there was a cut; a document of which
    nothing but blanks is left by a cut goes. Null texts stay."""
    small_batches(spark)
    out = linededup.dedup_lines(_keyed(docs).select("doc_id", "text", "whole"))
    kept = out.where((F.col("n_removed") == 0) | (F.trim("text") != ""))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("whole").getField("n_chars"))
    return _columns(kept, docs, **new)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near duplicates the first document by doc_id (null ids last), of rows equal in doc_id and text
    one (the least by its other columns where these can be compared)."""
    small_batches(spark)
    found = neardup.join(docs.select("doc_id", "text"))
    key = [F.coalesce("doc_id", F.lit(-1 << 63)).alias("key_id"), F.col("text_a").alias("key_a"), F.col("text_b").alias("key_b")]
    found = materialize(found.select(*key, "leads"), "leads")
    rest = _without(_keyed(docs), found.where(~F.col("leads")).select(*_KEY))
    twice = materialize(found.where("leads").groupBy(*_KEY).agg(F.count("*").alias("n")).where("n > 1").select(*_KEY), "twice")
    if twice.isEmpty():
        return _columns(rest, docs)
    few = twice.count() <= BROADCAST_KEYS
    side = F.broadcast(twice) if few else twice
    one = rest.join(side, list(_KEY), "left_semi").groupBy(*_KEY).agg(F.min_by("whole", F.to_json("whole")).alias("whole"))
    return _columns(rest.join(side, list(_KEY), "left_anti").select("whole").unionByName(one.select("whole")), docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage. Each row is searched under an id of its own, a hash of its key."""
    small_batches(spark)
    keyed = _keyed(docs).withColumn("own", F.xxhash64(*_KEY))
    own = keyed.select(F.col("own").alias("doc_id"), "text")
    leaks = materialize(decontaminate.leaks(own, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("own")).distinct(), "leaks")
    return _columns(keyed.join(F.broadcast(leaks) if leaks.count() <= BROADCAST_KEYS else leaks, "own", "left_anti"), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left in sequences of 2048 tokens; null texts are empty, repeated rows packed each."""
    small_batches(spark)
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs

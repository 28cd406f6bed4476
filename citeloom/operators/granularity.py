"""Granularity: bare articles to their paragraphs, with the order of predictions kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import citations as C


def children(corpus: DataFrame) -> DataFrame:
    """article, child of the corpus's paragraph-level citations."""
    return corpus.select(C.collapse_to_article(F.col("citation")).alias("article"), F.col("citation").alias("child")).where("article IS NOT NULL").distinct()


def expand(pred: DataFrame, kids: DataFrame) -> DataFrame:
    """query_id, citation, rk: articles replaced by their paragraphs (themselves where there are none), first occurrences in order. pred: query_id, pos, citation."""
    j = pred.join(kids, pred["citation"] == kids["article"], "left").select("query_id", "pos", F.coalesce("child", "citation").alias("citation"))
    first = j.groupBy("query_id", "citation").agg(F.min("pos").alias("pos"))
    return first.withColumn("rk", F.row_number().over(Window.partitionBy("query_id").orderBy("pos", "citation"))).drop("pos")


def verified(mentions: DataFrame, corpus: DataFrame) -> DataFrame:
    """query_id, citation, found, how: a mention as the corpus has it: the key itself (`exact`), regardless of case (`spelling`),
    its paragraphs (`paragraphs`), its article (`article`); `none` and no key for the rest. The first way that holds counts."""
    own = corpus.select("citation").distinct()
    m = mentions.select("query_id", "citation").distinct()
    names = own.groupBy(F.lower("citation").alias("key")).agg(F.min("citation").alias("found"))
    ways = [
        m.join(own, "citation", "left_semi").select("query_id", "citation", F.col("citation").alias("found"), F.lit(0).alias("w")),
        m.withColumn("key", F.lower("citation")).join(names, "key").select("query_id", "citation", "found", F.lit(1)),
        m.join(children(own), F.col("citation") == F.col("article")).select("query_id", "citation", F.col("child"), F.lit(2)),
        m.withColumn("key", C.collapse_to_article(F.col("citation"))).join(own.select(F.col("citation").alias("key")), "key").select("query_id", "citation", "key", F.lit(3)),
    ]
    every = ways[0]
    for w in ways[1:]:
        every = every.union(w)
    best = Window.partitionBy("query_id", "citation")
    first = every.withColumn("b", F.min("w").over(best)).where("w = b").select("query_id", "citation", "found", "w")
    how = F.get(F.array(*map(F.lit, ("exact", "spelling", "paragraphs", "article"))), F.col("w"))
    return m.join(first, ["query_id", "citation"], "left").select("query_id", "citation", "found", F.coalesce(how, F.lit("none")).alias("how"))

"""What models say, as tables: scores, verdicts, enrichment. Models themselves are outside; each call's result is kept by key,
so a run that stops goes on with what is missing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import parse_verdict


def missing(wanted: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """What a model has still to be asked: distinct wanted rows whose key the cache lacks."""
    return wanted.dropDuplicates(keys).join(cache.select(*keys).distinct(), keys, "left_anti")


def resumed(wanted: DataFrame, cache: DataFrame, keys: list[str], model: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The cache and the model's answers to what it lacks: the table to keep. Columns are the cache's."""
    return cache.unionByName(model(missing(wanted, cache, keys)).select(cache.columns))


def latest(cache: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One answer a key, the last by `order`."""
    rest = [c for c in cache.columns if c not in keys]
    return cache.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_l")).select(*keys, *[F.col("_l")[c].alias(c) for c in rest if c != order])


def reranked(cands: DataFrame, scores: DataFrame, top: int, share: float = 0.7) -> DataFrame:
    """query_id, doc_id, score, rk: of the first `top` a blend of the normalised score and a model's P(yes) (missing: 0), the rest behind them in their order.

    cands: query_id, doc_id, score, rk; scores: query_id, doc_id, p.
    """
    from .fusion import minmax

    head = cands.where(F.col("rk") <= top).withColumn("s", minmax(F.col("score"), ["query_id"])).join(scores, ["query_id", "doc_id"], "left")
    head = head.select("query_id", "doc_id", (share * F.col("s") + (1 - share) * F.coalesce("p", F.lit(0.0))).alias("score"), F.lit(0).alias("part"), "rk")
    tail = cands.where(F.col("rk") > top).select("query_id", "doc_id", F.lit(None).cast("double").alias("score"), F.lit(1).alias("part"), "rk")
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy("part", F.desc_nulls_last(F.round("score", 6)), F.when(F.col("part") == 0, F.col("doc_id")).otherwise(F.col("rk").cast("long")))
    return head.unionByName(tail).select("query_id", "doc_id", "score", F.row_number().over(w).alias("rk"))


def verdicts(raw: DataFrame, default: str = "YES") -> DataFrame:
    """query_id, doc_id, verdict of a judge's raw answers; unreadable ones are `default`."""
    return raw.select("query_id", "doc_id", parse_verdict(F.col("raw"), default).alias("verdict"))


def stub_record(text: Column, role: Column) -> Column:
    """struct(topic, specificity, method) for rows no model need read (costs, notifications, very short texts); null for others."""
    plain = role.isin("costs", "notification") | (F.length(text) < 80)
    return F.when(plain, F.struct(F.coalesce(role, F.lit("short")).alias("topic"), F.lit(0.0).alias("specificity"), F.lit("deterministic").alias("method")))


def enriched(rows: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Rows with their record, `stub` where none is needed, and `pending` where one is still missing. rows: key, text, role."""
    j = rows.withColumn("stub", stub_record(F.col("text"), F.col("role"))).join(records, key, "left")
    state = F.when(F.col("stub").isNotNull(), "stub").when(F.col("record").isNotNull(), "model").otherwise("pending")
    return j.select(*rows.columns, F.coalesce(F.col("stub.topic"), F.col("record.topic")).alias("topic"), state.alias("state"))

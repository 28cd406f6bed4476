"""Retrieval as one call: channels, weighted fusion with authority, a model's scores, a judge's verdicts, granularity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import fusion, granularity, models


def retrieve(channels: DataFrame, citations: DataFrame, corpus: DataFrame, weights: dict[str, float] | None = None, authority: DataFrame | None = None, alpha: float = 0.0, scores: DataFrame | None = None, verdicts: DataFrame | None = None, top: int = 100, head: int = 20) -> DataFrame:
    """query_id, citation, rk: what a query is answered with, in the order of the ranking, articles replaced by the corpus's paragraphs.

    channels: query_id, channel, doc_id, rk; citations: doc_id, citation (brought in after the cut); corpus: citation;
    authority: doc_id, authority; scores: query_id, doc_id, p, for the first `head`; verdicts: query_id, doc_id, verdict (missing: YES).
    Steps whose table is None are left out.
    """
    ranking = fusion.rrf(channels, weights=weights, authority=authority, alpha=alpha).where(F.col("rk") <= top).select("query_id", "doc_id", "score", "rk")
    if scores is not None:
        ranking = models.reranked(ranking, scores, head)
    if verdicts is not None:
        ranking = ranking.join(verdicts, ["query_id", "doc_id"], "left").where(F.coalesce("verdict", F.lit("YES")) == "YES").drop("verdict")
    named = ranking.join(citations, "doc_id").select("query_id", F.col("rk").alias("pos"), "citation")
    return granularity.expand(named, granularity.children(corpus))

"""Connected components by contraction, all in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """v, c: each vertex of the edges and the least vertex of its component.

    Each round hooks every vertex to its least neighbour and replaces both ends of all edges by what they hang on, which at
    least halves the vertices that still have edges; a star takes one round.
    """
    left = materialize(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct(), "edges")
    labels = left.select(F.col("a").alias("v")).union(left.select("b")).distinct().select("v", F.col("v").alias("c"))
    while not left.isEmpty():
        hook = left.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("p"))
        hook = materialize(hook, "hooks")
        labels = materialize(labels.join(hook, labels["c"] == hook["u"], "left").select("v", F.coalesce("p", "c").alias("c")), "labels")
        ends = left.join(hook, left["a"] == hook["u"], "left").select(F.coalesce("p", "a").alias("a"), "b")
        ends = ends.join(hook, ends["b"] == hook["u"]).select("a", F.col("p").alias("b"))
        left = materialize(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    return labels

"""Segment lattice: citations as (citation, segment, value) rows, an option registry, and filters over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def segments(rows: DataFrame, columns: list[str], key: str = "citation") -> DataFrame:
    """Long form of the segment columns, nulls left out."""
    parts = F.array(*[F.struct(F.lit(c).alias("segment"), F.col(c).cast("string").alias("value")) for c in columns])
    return rows.select(key, "family", F.explode(F.filter(parts, lambda p: p["value"].isNotNull())).alias("s")).select(key, "family", "s.segment", "s.value").distinct()


def registry(seg: DataFrame, own: DataFrame, key: str = "citation") -> DataFrame:
    """Options with the rows that bear them, those of the corpus itself among them, and up to five examples."""
    j = seg.join(own.select(key).distinct().withColumn("own", F.lit(1)), key, "left")
    return j.groupBy("family", "segment", "value").agg(F.count("own").alias("source_count"), F.count("*").alias("ref_count"), F.array_join(F.slice(F.array_sort(F.collect_set(key)), 1, 5), ";").alias("examples"))


def choices(reg: DataFrame, semantic: tuple[str, ...], most: int) -> DataFrame:
    """Options by frequency; the cut spares semantic segments."""
    w = Window.partitionBy("family", "segment").orderBy(F.desc("source_count"), "value")
    return reg.withColumn("rk", F.row_number().over(w)).where((F.col("rk") <= most) | F.col("segment").isin(*semantic))


def matching(seg: DataFrame, decisions: DataFrame, every: bool, key: str = "citation") -> DataFrame:
    """query_id, citation: rows that meet all decided segments (`every`) or any. decisions: query_id, segment, value."""
    hit = decisions.join(seg, ["segment", "value"]).groupBy("query_id", key).agg(F.count_distinct("segment").alias("n"))
    if not every:
        return hit
    need = decisions.groupBy("query_id").agg(F.count_distinct("segment").alias("need"))
    return hit.join(need, "query_id").where("n = need").drop("need")


def budgeted(hits: DataFrame, explicit: DataFrame, budget: int, key: str = "citation") -> DataFrame:
    """Score 500 a matched segment and 10000 for an explicit mention; the budget spares explicit ones."""
    j = hits.join(explicit.select("query_id", key).distinct().withColumn("e", F.lit(1)), ["query_id", key], "full")
    s = j.select("query_id", key, (500 * F.coalesce("n", F.lit(0)) + F.when(F.col("e") == 1, 10_000).otherwise(0)).alias("score"), F.col("e").isNotNull().alias("explicit"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return s.withColumn("rk", F.row_number().over(w)).where((F.col("rk") <= budget) | F.col("explicit"))

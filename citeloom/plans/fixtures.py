"""Citation tables derived from the star schema, the same in Spark and SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def case(arg: str, values: tuple[str, ...]) -> str:
    return f"CASE {arg} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


CODES, DIVISIONS = ("StPO", "OR", "ZGB", "BGG", "BV"), ("I", "II", "III", "IV", "V")
STATUTE = f"concat('Art. ', l_partkey % 400 + 1, ' Abs. ', l_linenumber, ' ', {case('l_suppkey % 5', CODES)})"
BASE = f"concat('BGE ', 100 + l_orderkey % 50, ' ', {case('l_orderkey % 5', DIVISIONS)}, ' ', l_orderkey % 900 + 1)"
COURT = f"concat({BASE}, ' E. ', l_linenumber)"
DOCKET = "concat(l_suppkey % 9 + 1, 'B_', l_orderkey % 9000 + 1, '/', 2000 + l_linenumber)"
DATED = f"concat({DOCKET}, ' 0', l_linenumber, '.03.2019 E. 2.', l_linenumber, '-2.', l_linenumber + 2)"

#: Court rows cite statutes; every order is a text, its lines its citations.
EDGES_SQL = f"SELECT DISTINCT {COURT} AS source, {STATUTE} AS target FROM lineitem"
RANKED_SQL = """
SELECT l_suppkey AS query_id, l_returnflag AS channel, l_partkey AS doc_id, CAST(round(sum(l_extendedprice), 2) AS DOUBLE) AS score FROM lineitem GROUP BY 1, 2, 3
"""
CHANNELS_SQL = f"SELECT query_id, channel, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id, channel ORDER BY score DESC, doc_id) AS INT) AS rk FROM ({RANKED_SQL}) r"
GOLD_SQL = "SELECT DISTINCT l_suppkey AS query_id, l_partkey AS doc_id FROM lineitem WHERE l_quantity >= 46"
FUSED_SQL = f"""
SELECT query_id, doc_id, s AS score, CAST(n AS BIGINT) AS channels, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, doc_id) AS INT) AS rk
FROM (SELECT query_id, doc_id, sum(1.0 / (60 + rk)) AS s, count(*) AS n FROM (SELECT query_id, channel, doc_id, min(rk) AS rk FROM ({CHANNELS_SQL}) c GROUP BY 1, 2, 3) b GROUP BY 1, 2) f
"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        f"{STATUTE} AS statute", f"{COURT} AS court", f"{BASE} AS base", f"{DOCKET} AS docket", f"{DATED} AS dated", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus"
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select(F.col("court").alias("source"), F.col("statute").alias("target")).distinct()


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.fusion import ranked

    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("query_id"), F.col("l_returnflag").alias("channel"), F.col("l_partkey").alias("doc_id")).agg(F.round(F.sum("l_extendedprice"), 2).alias("score"))
    return ranked(s, ["query_id", "channel"])


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").where("l_quantity >= 46").select(F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("doc_id")).distinct()

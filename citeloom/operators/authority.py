"""Scores and profiles of documents that no query changes: authority, model priority, coverage, corpus figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base of a case's authority by kind, and what its parts add.
TYPE_BASE = {"leading": 0.8, "federal": 0.6, "legacy": 0.5}


def case_authority(kind: Column, cited: Column, year: Column, specificity: Column, newest: int, span: int = 30) -> Column:
    """Base by kind, + .1 for 200 citations, + .03 for the newest year, + .02 for specificity; at most 1, four digits."""
    base = F.coalesce(F.create_map(*[F.lit(x) for p in TYPE_BASE.items() for x in p])[kind], F.lit(0.4))
    recent = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - (F.lit(newest) - year) / F.lit(float(span))))
    return F.round(F.least(F.lit(1.0), base + F.least(cited, F.lit(200)) / 200 * 0.1 + F.coalesce(recent, F.lit(0.0)) * 0.03 + F.coalesce(specificity, F.lit(0.0)) * 0.02), 4)


def court_authority(roles: Column, low_value: Column, cited: Column) -> Column:
    """1, + .5 published, + .25 detailed, - .6 for rows of low value, + min(ln(1 + n) / 7, .8); .05 at least."""
    has = lambda r, v: F.when(F.array_contains(roles, r), v).otherwise(0.0)
    return F.greatest(F.lit(0.05), 1 + has("published_leading_case", 0.5) + has("detailed_reasoning", 0.25) - F.when(low_value, 0.6).otherwise(0.0) + F.least(F.log1p(cited) / 7, F.lit(0.8)))


def law_authority(roles: Column, has_rule: Column, has_summary: Column, out: Column, cited: Column, specificity: Column) -> Column:
    """1, + .1 a role up to three, + .2 a rule, + .1 a summary, + ln(1 + out) / 20 + ln(1 + in) / 10 + .3 specificity."""
    flag = lambda c, v: F.when(c, v).otherwise(0.0)
    return 1 + 0.1 * F.least(F.size(roles), F.lit(3)) + flag(has_rule, 0.2) + flag(has_summary, 0.1) + F.log1p(out) / 20 + F.log1p(cited) / 10 + 0.3 * F.coalesce(specificity, F.lit(0.0))


def card_priority(chars: Column, signal: Column, statutes: Column, cited: Column, notification: Column) -> Column:
    """struct(score, reasons) of a row that a model may read: long texts, weak signals, statutes and citations speak for it."""
    rules = [(chars >= 800, 3, "long"), (signal == "weak", 2, "weak_signal"), (statutes > 0, 1, "has_statutes"), (cited >= 10, 2, "cited"), (notification, -5, "notification"), (chars < 80, -3, "short")]
    score = F.lit(0)
    for cond, v, _ in rules:
        score = score + F.when(cond, v).otherwise(0)
    return F.struct(score.alias("score"), F.array_compact(F.array(*[F.when(cond, name) for cond, _, name in rules])).alias("reasons"))


def rejection(chars: Column, priority: Column, roles: Column, least: int, priorities: tuple[str, ...], skip: tuple[str, ...]) -> Column:
    """Why a card isn't kept: too short, not of the priorities, all roles to be skipped; null if it is kept."""
    only = (F.size(roles) > 0) & (F.size(F.array_except(roles, F.array(*map(F.lit, skip)))) == 0)
    return F.when(chars < least, "below_min_chars").when(~priority.isin(*priorities), "filtered_priority").when(only, "filtered_role")


def profile(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Count, sum, and the quarter, middle, nine-tenths and extremes of a value by group; exact percentiles."""
    p = lambda q: F.percentile(value, q)
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), p(0.25).alias("p25"), p(0.5).alias("p50"), p(0.9).alias("p90"), F.max(value).alias("most"))


def corpus_figures(rows: DataFrame, dimensions: list[str]) -> DataFrame:
    """dimension, value, n of several columns in one pass; the columns ride as rows of an array."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in dimensions])).alias("x")
    return rows.select(each).select("x.*").groupBy("dimension", "value").agg(F.count("*").alias("n"))


def coverage(rows: DataFrame, by: str, flags: dict[str, Column]) -> DataFrame:
    """Rows by group and the share of them that meets each condition."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), *[F.avg(F.when(c, 1.0).otherwise(0.0)).alias(k) for k, c in flags.items()])

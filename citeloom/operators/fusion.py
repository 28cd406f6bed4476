"""Fusion, gating, selection. Channel results are (query_id, channel, doc_id, score, rk)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, by: list[str], score: str = "score", name: str = "rk", tie: str = "doc_id") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(F.round(score, 6)), tie)))


def rrf(channels: DataFrame, k: int = 60, weights: dict[str, float] | None = None, authority: DataFrame | None = None, alpha: float = 0.0) -> DataFrame:
    """query_id, doc_id, score, channels: sum of weight / (k + best rank); optionally times 1 + alpha * authority."""
    w = F.lit(1.0) if weights is None else F.coalesce(F.create_map(*[x for c, v in weights.items() for x in (F.lit(c), F.lit(v))])[F.col("channel")], F.lit(0.0))
    best = channels.groupBy("query_id", "channel", "doc_id").agg(F.min("rk").alias("rk")).withColumn("w", w).where("w <> 0")
    out = best.groupBy("query_id", "doc_id").agg(F.sum(F.col("w") / (k + F.col("rk"))).alias("score"), F.count("*").alias("channels"))
    if authority is not None:
        out = out.join(authority, "doc_id", "left").withColumn("score", F.col("score") * (1 + alpha * F.coalesce("authority", F.lit(0.0)))).drop("authority")
    return ranked(out, ["query_id"])


def minmax(c: Column, by: list[str], on_constant: float = 0.0) -> Column:
    w = Window.partitionBy(*by)
    lo, hi = F.min(c).over(w), F.max(c).over(w)
    return F.when(hi > lo, (c - lo) / (hi - lo)).otherwise(F.lit(on_constant))


def max_merge(*passes: DataFrame) -> DataFrame:
    out = passes[0]
    for p in passes[1:]:
        out = out.unionByName(p)
    return out.groupBy("query_id", "channel", "doc_id").agg(F.max("score").alias("score"))


def round_robin(channels: DataFrame, order: list[str], per_channel: int, total: int) -> DataFrame:
    """Turns over the channels, each giving its next unseen document; order-dependent, so a Python fold per query over its
    first `total` rows of each channel, which is all that a turn can reach."""
    spot = F.create_map(*[x for i, c in enumerate(order) for x in (F.lit(c), F.lit(i))])
    need = channels.where(F.col("channel").isin(order) & (F.col("rk") <= total)).select("query_id", spot[F.col("channel")].alias("c"), "doc_id", "rk")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        lists = [iter(g["doc_id"].tolist()) for _, g in pdf.sort_values(["c", "rk"]).groupby("c")]
        taken, seen, out = [0] * len(lists), set(), []
        alive = list(range(len(lists)))
        while alive and len(out) < total:
            for i in list(alive):
                d = next((x for x in lists[i] if x not in seen), None)
                if d is None or taken[i] >= per_channel:
                    alive.remove(i)
                    continue
                seen.add(d)
                taken[i] += 1
                out.append(d)
                if len(out) == total:
                    break
        return pd.DataFrame({"query_id": pdf["query_id"].iloc[0], "doc_id": out, "rk": range(1, len(out) + 1)})

    return need.groupBy("query_id").applyInPandas(fold, "query_id long, doc_id long, rk int")


def guaranteed(prefix: DataFrame, tail: DataFrame, k: int) -> DataFrame:
    """The prefix in its order, then the tail's other documents, to k rows."""
    both = prefix.select("query_id", "doc_id", F.lit(0).alias("s"), "rk").unionByName(tail.select("query_id", "doc_id", F.lit(1).alias("s"), "rk"))
    first = both.groupBy("query_id", "doc_id").agg(F.min(F.struct("s", "rk")).alias("at"))
    return first.withColumn("rk", F.row_number().over(Window.partitionBy("query_id").orderBy("at", "doc_id"))).where(F.col("rk") <= k).drop("at")


def gate(df: DataFrame, role: str = "role", keep: tuple[str, ...] = (), drop: tuple[str, ...] = ()) -> DataFrame:
    return df.where(F.col(role).isin(*keep) | ~F.coalesce(F.col(role), F.lit("")).isin(*drop))


def zones(score: Column, yes: float = 0.55, no: float = 0.25) -> Column:
    return F.when(score >= yes, "yes").when(score < no, "no").otherwise("judge")


def decide(df: DataFrame, verdicts: DataFrame, default: str = "YES") -> DataFrame:
    """Yes zone and judged rows with YES (missing: `default`); a query without any keeps its first. df: query_id, doc_id, score, zone."""
    j = df.join(verdicts, ["query_id", "doc_id"], "left")
    keep = j.where((F.col("zone") == "yes") | ((F.col("zone") == "judge") & (F.coalesce("verdict", F.lit(default)) == "YES"))).select("query_id", "doc_id", "score")
    first = ranked(df, ["query_id"]).where("rk = 1").join(keep, "query_id", "left_anti").select("query_id", "doc_id", "score")
    return keep.unionByName(first)


def elbows(df: DataFrame, k_min: int, k_max: int, alpha: float = 0.5, ratio: float = 0.9) -> DataFrame:
    """Cut sizes per query by six rules over ranked scores (query_id, rk, score)."""
    w = Window.partitionBy("query_id").orderBy("rk")
    d = df.where(F.col("rk") <= k_max + 2).select(
        "query_id", "rk", "score", F.lead("score").over(w).alias("s1"), F.lead("score", 2).over(w).alias("s2"), F.avg("score").over(w.rowsBetween(0, 2)).alias("m"), F.count("*").over(w.rowsBetween(0, 2)).alias("mc"), F.first("score").over(w).alias("top"),
    )
    d = d.withColumn("m1", F.when(F.col("mc") == 3, F.lead("m").over(w))).withColumn("m1", F.when(F.lead("mc").over(w) == 3, F.col("m1")))
    inside = F.col("rk").between(k_min, k_max)
    arg = lambda v: F.max_by("rk", F.struct(F.round(v, 6), -F.col("rk")))
    span = Window.partitionBy("query_id")
    lo, hi, last = F.min("score").over(span), F.max("score").over(span), F.max("rk").over(span)
    d = d.withColumn("chord", (1 - (F.col("rk") - 1) / F.greatest(last - 1, F.lit(1))) - F.when(hi > lo, (F.col("score") - lo) / (hi - lo)).otherwise(0.0))
    return d.groupBy("query_id").agg(
        arg(F.when(inside, F.col("score") - F.col("s1"))).alias("gap_k"), arg(F.when(inside, F.col("m") - F.col("m1"))).alias("smooth_k"), arg(F.when(inside, F.col("chord"))).alias("knee_k"), arg(F.when(inside, F.col("score") - 2 * F.col("s1") + F.col("s2"))).alias("bend_k"),
        F.greatest(F.lit(k_min), F.least(F.lit(k_max), F.count_if(F.col("score") >= alpha * F.col("top")))).cast("int").alias("share_k"), F.coalesce(F.min(F.when(inside & (F.col("s1") < ratio * F.col("score")), F.col("rk"))), F.lit(k_max)).alias("ratio_k"),
    )


def evidence(df: DataFrame, weights: dict[str, float], bonus: dict[int, float]) -> DataFrame:
    """Sum of source weights plus a bonus by the number of agreeing sources, at most 1. df: query_id, doc_id, channel."""
    w = F.coalesce(F.create_map(*[x for c, v in weights.items() for x in (F.lit(c), F.lit(v))])[F.col("channel")], F.lit(0.0))
    s = df.select("query_id", "doc_id", "channel").distinct().groupBy("query_id", "doc_id").agg(F.sum(w).alias("w"), F.count("*").alias("n"))
    b = F.lit(0.0)
    for n in sorted(bonus):
        b = F.when(F.col("n") >= n, bonus[n]).otherwise(b)
    return s.select("query_id", "doc_id", F.least(F.lit(1.0), F.col("w") + b).alias("score"), F.col("n").alias("sources"))


def pool(df: DataFrame) -> DataFrame:
    """Union of channels with provenance, best score and rank."""
    return df.groupBy("query_id", "doc_id").agg(F.array_join(F.array_sort(F.collect_set("channel")), ",").alias("sources"), F.max("score").alias("score"), F.min("rk").alias("best_rank"))


def variants(df: DataFrame, root: str, most: int, exempt: Column | None = None) -> DataFrame:
    """At most `most` of a root and query, exempt rows aside."""
    r = ranked(df, ["query_id", root], name="_v")
    return r.where((F.col("_v") <= most) | (exempt if exempt is not None else F.lit(False))).drop("_v")


def quantile_gate(df: DataFrame, q: float) -> DataFrame:
    cut = df.groupBy("query_id").agg(F.percentile("score", q).alias("_c"))
    return df.join(cut, "query_id").where(F.col("score") >= F.col("_c")).drop("_c")


def quota_select(df: DataFrame, quotas: dict[str, int], k: int) -> DataFrame:
    """Fills from several orderings in turn, each to its quota of new documents, then by `score`; a fold per query. df: query_id, doc_id, score and the orderings.

    Before an ordering's turn is over at most k documents are taken, so only its first k + quota can matter: each query's pool
    is cut to those by ranked windows before it goes to a task.
    """
    order = [*quotas.items(), ("score", k)]
    cut = df.select("query_id", "doc_id", *dict.fromkeys([*quotas, "score"]))
    for c, n in order:
        cut = cut.withColumn(f"r_{c}", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round(c, 6)), "doc_id")))
    near = F.lit(False)
    for c, n in order:
        near = near | (F.col(f"r_{c}") <= k + n)
    cut = cut.where(near).select("query_id", "doc_id", *[f"r_{c}" for c, _ in order])

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        out: dict[int, str] = {}
        for col, n in order:
            got = 0
            for d in pdf.sort_values(f"r_{col}")["doc_id"]:
                if len(out) >= k or got >= n:
                    break
                if d not in out:
                    out[d] = col
                    got += 1
        return pd.DataFrame({"query_id": pdf["query_id"].iloc[0], "doc_id": list(out), "source": list(out.values()), "rk": range(1, len(out) + 1)})

    return cut.groupBy("query_id").applyInPandas(fold, "query_id long, doc_id long, source string, rk int")


# --- scores, sizes and last touches of a selection


def rrf_of(df: DataFrame, ranks: list[str], k: int = 60) -> Column:
    """Sum of 1 / (k + rank) over rank columns; a null rank adds nothing."""
    out = F.lit(0.0)
    for r in ranks:
        out = out + F.coalesce(1 / (k + F.col(r)), F.lit(0.0))
    return out


def linear(terms: dict[str, float], by: list[str] | None = None) -> Column:
    """Weighted sum of columns; each brought to 0..1 within `by` first, if given. Nulls count 0."""
    out = F.lit(0.0)
    for c, w in terms.items():
        out = out + w * F.coalesce(minmax(F.col(c).cast("double"), by) if by else F.col(c).cast("double"), F.lit(0.0))
    return out


def substantive(df: DataFrame, keep: tuple[str, ...], noise: tuple[str, ...]) -> DataFrame:
    """Rows of substantive roles always, others unless they are notifications or of a noise role. df: role, notification."""
    return df.where(F.coalesce(F.col("role").isin(*keep), F.lit(False)) | (~F.coalesce("notification", F.lit(False)) & ~F.coalesce(F.col("role").isin(*noise), F.lit(False))))


def candidates(df: DataFrame, kb: DataFrame, k: int) -> DataFrame:
    """The k best of a query that the knowledge base has, with its columns."""
    return ranked(df, ["query_id"]).where(F.col("rk") <= k).join(kb, "doc_id")


def fused_zones(df: DataFrame, share: float = 0.7, yes: float = 0.55, no: float = 0.25) -> DataFrame:
    """share of the normalised retrieval score and the rest of the normalised rerank score, with zones. df: query_id, doc_id, score, rerank."""
    s = share * minmax(F.col("score"), ["query_id"]) + (1 - share) * F.coalesce(minmax(F.col("rerank"), ["query_id"]), F.lit(0.0))
    return df.select("query_id", "doc_id", s.alias("score")).withColumn("zone", zones(F.col("score"), yes, no))


def expected(df: DataFrame, sizes: DataFrame, least: int, most: int, band: float | None = None) -> DataFrame:
    """The expected number of each query's best (clamped), and those within `band` of the last one taken. sizes: query_id, k."""
    r = ranked(df, ["query_id"]).join(sizes, "query_id", "left").withColumn("k", F.greatest(F.lit(least), F.least(F.lit(most), F.coalesce("k", F.lit(least)))))
    last = F.max(F.when(F.col("rk") == F.col("k"), F.col("score"))).over(Window.partitionBy("query_id"))
    take = F.col("rk") <= F.col("k")
    if band is not None:
        take = take | ((F.col("score") >= last - band) & (F.col("rk") <= most))
    return r.withColumn("last", last).where(take if band is None else (F.col("rk") <= F.col("k")) | ((F.col("score") >= F.col("last") - band) & (F.col("rk") <= most))).select("query_id", "doc_id", "score", "rk")


def clamped(area: Column, n: Column, limits: dict[str, tuple[int, int]], other: tuple[int, int]) -> Column:
    """A number within the limits of its area."""
    pick = lambda i: F.coalesce(F.create_map(*[x for a, v in limits.items() for x in (F.lit(a), F.lit(v[i]))])[area], F.lit(other[i]))
    return F.greatest(pick(0), F.least(pick(1), n))


def rank_features(df: DataFrame, scores: list[str], top: int) -> DataFrame:
    """Rank by each score within the query, and among how many of the first `top` a row is."""
    out = df
    for c in scores:
        out = out.withColumn(f"rank_{c}", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round(c, 6)), "doc_id")))
    return out.withColumn("agreeing", sum((F.when(F.col(f"rank_{c}") <= top, 1).otherwise(0) for c in scores), F.lit(0)))


def family_quota(df: DataFrame, k: int, head: int = 100) -> DataFrame:
    """query_id, laws, courts: k split as the first `head` of each query are, a tenth at least for each. df: query_id, family, rk."""
    share = F.avg(F.when(F.col("family") == "law", 1.0).otherwise(0.0))
    s = df.where(F.col("rk") <= head).groupBy("query_id").agg(share.alias("s"))
    laws = F.greatest(F.lit(k // 10), F.least(F.lit(k - k // 10), F.round(F.col("s") * k).cast("int")))
    return s.select("query_id", laws.alias("laws"), (F.lit(k) - laws).alias("courts"))


def priority_pool(parts: list[tuple[str, DataFrame, int | None]], k: int) -> DataFrame:
    """query_id, doc_id, source, rk: lists in order of priority, each to its own limit, a document at its first. parts: (name, ranked rows, limit)."""
    both = None
    for i, (name, df, n) in enumerate(parts):
        p = (df.where(F.col("rk") <= n) if n else df).select("query_id", "doc_id", F.struct(F.lit(i).alias("p"), "rk", F.lit(name).alias("source")).alias("at"))
        both = p if both is None else both.unionByName(p)
    first = both.groupBy("query_id", "doc_id").agg(F.min("at").alias("at"))
    w = Window.partitionBy("query_id").orderBy("at.p", "at.rk", "doc_id")
    return first.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k).select("query_id", "doc_id", F.col("at.source").alias("source"), "rk")


def sourced_gate(df: DataFrame, q: float, needed: tuple[str, ...]) -> DataFrame:
    """Rows at or above the query's quantile that came from a needed source too. df: query_id, doc_id, score, sources (array)."""
    return quantile_gate(df, q).where(F.arrays_overlap("sources", F.array(*map(F.lit, needed))))


def with_floor(df: DataFrame, k: int, floor: DataFrame) -> DataFrame:
    """The k best and, whatever their score, a query's verified rows. floor: query_id, doc_id."""
    best = ranked(df, ["query_id"]).where(F.col("rk") <= k).select("query_id", "doc_id")
    return best.union(floor.select("query_id", "doc_id")).distinct()


def gap_size(df: DataFrame, share: float, drop: float, least: int, most: int) -> DataFrame:
    """query_id, k: the rank before the first score under `share` of the best or under `drop` of the one before, clamped. df: query_id, rk, score."""
    w = Window.partitionBy("query_id").orderBy("rk")
    stop = (F.col("score") < share * F.first("score").over(w)) | (F.col("score") < drop * F.lag("score").over(w))
    d = df.select("query_id", "rk", stop.alias("stop"))
    k = F.coalesce(F.min(F.when(F.col("stop"), F.col("rk") - 1)), F.max("rk"))
    return d.groupBy("query_id").agg(F.greatest(F.lit(least), F.least(F.lit(most), k)).alias("k"))


def tiered_size(query: Column, signals: dict[str, float], tiers: list[tuple[float, int, int]]) -> Column:
    """struct(laws, courts): pattern counts weighted and summed, then the first tier whose limit the sum doesn't pass."""
    s = F.lit(0.0)
    for p, w in signals.items():
        s = s + w * F.regexp_count(query, F.lit(p))
    out = F.struct(F.lit(tiers[-1][1]).alias("laws"), F.lit(tiers[-1][2]).alias("courts"))
    for limit, laws, courts in reversed(tiers[:-1]):
        out = F.when(s <= limit, F.struct(F.lit(laws).alias("laws"), F.lit(courts).alias("courts"))).otherwise(out)
    return out


def peers(pred: DataFrame, rows: DataFrame, most_cases: int = 3, most_articles: int = 2) -> DataFrame:
    """Predictions and, for each, a few rows of its judgment or article in corpus order. pred: query_id, citation; rows: citation, family, group, row_no."""
    known = pred.distinct().join(rows.select("citation", "family", "group"), "citation")
    near = known.select("query_id", "family", "group").distinct().join(rows.select("group", "family", F.col("citation").alias("peer"), "row_no"), ["group", "family"])
    near = near.join(pred.select("query_id", F.col("citation").alias("peer")).distinct(), ["query_id", "peer"], "left_anti")
    w = Window.partitionBy("query_id", "family", "group").orderBy("row_no", "peer")
    some = near.withColumn("r", F.row_number().over(w)).where(F.col("r") <= F.when(F.col("family") == "law", most_articles).otherwise(most_cases))
    return pred.select("query_id", "citation").union(some.select("query_id", F.col("peer").alias("citation"))).distinct()


def covered_aspects(kept: DataFrame, df: DataFrame) -> DataFrame:
    """What is kept and, for each aspect of the query without a kept row, its best candidate. kept: query_id, doc_id; df: query_id, doc_id, aspect, score."""
    have = df.join(kept.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi").select("query_id", "aspect").distinct()
    best = ranked(df.join(have, ["query_id", "aspect"], "left_anti"), ["query_id", "aspect"]).where("rk = 1")
    return kept.select("query_id", "doc_id").union(best.select("query_id", "doc_id")).distinct()


def title_ratio(query: Column, title: Column) -> Column:
    """How much of a title's words the query holds, of those of two letters or more; 1 if the title stands in it."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 2))
    share = F.size(F.array_intersect(words(query), words(title))) / F.greatest(F.size(words(title)), F.lit(1))
    return F.when(F.contains(F.lower(query), F.lower(title)), 1.0).otherwise(share)


def rule_scores(df: DataFrame, rules: list[tuple[Column, float]], recency: Column | None = None) -> DataFrame:
    """query_id, doc_id, score: what the rules that hold add up to, and a share for recency. df has what the rules name."""
    s = F.lit(0.0)
    for cond, v in rules:
        s = s + F.when(cond, v).otherwise(0.0)
    return df.select("query_id", "doc_id", (s + (recency if recency is not None else F.lit(0.0))).alias("score"))


def proper_case(pred: DataFrame, corpus: DataFrame) -> DataFrame:
    """Predictions in the corpus's spelling, found regardless of case (the first spelling in order); others stay. pred: query_id, citation."""
    names = corpus.groupBy(F.upper("citation").alias("u")).agg(F.min("citation").alias("known"))
    return pred.withColumn("u", F.upper("citation")).join(names, "u", "left").select("query_id", F.coalesce("known", "citation").alias("citation"))

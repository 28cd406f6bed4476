"""Set and rank evaluation. Only this module reads gold sets. gold: query_id, doc_id; ranked: query_id, doc_id, rk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import steps as S


def parse_gold(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ";"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")


def prf(tp: Column, pred: Column, gold: Column) -> tuple[Column, Column, Column]:
    """Precision, recall, F1; no prediction: precision 1; no gold: recall 1; both none: all 1."""
    p = F.when(pred == 0, 1.0).otherwise(tp / pred)
    r = F.when(gold == 0, 1.0).otherwise(tp / gold)
    f = F.when((pred == 0) & (gold == 0), 1.0).when(tp == 0, 0.0).otherwise(2.0 * tp / (pred + gold))
    return p, r, f


def by_query(pred: DataFrame, gold: DataFrame) -> DataFrame:
    p, g = pred.select("query_id", "doc_id").distinct().withColumn("p", F.lit(1)), gold.select("query_id", "doc_id").distinct().withColumn("g", F.lit(1))
    n = p.join(g, ["query_id", "doc_id"], "full").groupBy("query_id").agg(F.count_if(F.col("p").isNotNull() & F.col("g").isNotNull()).alias("tp"), F.count("p").alias("n_pred"), F.count("g").alias("n_gold"))
    return n.select("query_id", "tp", "n_pred", "n_gold", *[c.alias(x) for c, x in zip(prf(F.col("tp"), F.col("n_pred"), F.col("n_gold")), ("precision", "recall", "f1"), strict=True)])


def summary(per: DataFrame) -> DataFrame:
    tp, p, g = F.sum("tp"), F.sum("n_pred"), F.sum("n_gold")
    return per.agg(F.avg("precision").alias("macro_p"), F.avg("recall").alias("macro_r"), F.avg("f1").alias("macro_f1"), (tp / p).alias("micro_p"), (tp / g).alias("micro_r"), (2.0 * tp / (p + g)).alias("micro_f1"))


def hits(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """ranked with is_gold, the hits up to each rank and the gold size."""
    n = gold.groupBy("query_id").agg(F.count_distinct("doc_id").alias("n_gold"))
    g = ranked.join(gold.select("query_id", "doc_id").distinct().withColumn("is_gold", F.lit(1)), ["query_id", "doc_id"], "left").join(n, "query_id", "left")
    g = g.withColumn("is_gold", F.coalesce("is_gold", F.lit(0))).withColumn("n_gold", F.coalesce("n_gold", F.lit(0)))
    return g.withColumn("cum", F.sum("is_gold").over(Window.partitionBy("query_id").orderBy("rk").rowsBetween(Window.unboundedPreceding, 0)))


def recall_at(ranked: DataFrame, gold: DataFrame, ks: list[int]) -> DataFrame:
    n = gold.groupBy("query_id").agg(F.count_distinct("doc_id").alias("n_gold"))
    h = ranked.join(gold.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(*[F.count_if(F.col("rk") <= k).alias(f"h{k}") for k in ks])
    return n.join(h, "query_id", "left").select("query_id", "n_gold", *[(F.coalesce(f"h{k}", F.lit(0)) / F.col("n_gold")).alias(f"recall_{k}") for k in ks])


def sweep(ranked: DataFrame, gold: DataFrame, ks: list[int]) -> DataFrame:
    """Macro F1 at each K; the K values ride along as an array, so the ranking is read once."""
    h = hits(ranked, gold)
    at = h.groupBy("query_id").agg(F.max("n_gold").alias("n_gold"), *[F.count_if(F.col("rk") <= k).alias(f"p{k}") for k in ks], *[F.sum(F.when(F.col("rk") <= k, F.col("is_gold")).otherwise(0)).alias(f"t{k}") for k in ks])
    row = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"p{k}").alias("p"), F.col(f"t{k}").alias("t")) for k in ks])).alias("x")
    return at.select("n_gold", row).groupBy(F.col("x.k").alias("k")).agg(F.avg(prf(F.col("x.t"), F.col("x.p"), F.col("n_gold"))[2]).alias("macro_f1"))


def oracle_k(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    h = hits(ranked, gold).withColumn("f1", 2.0 * F.col("cum") / (F.col("rk") + F.col("n_gold")))
    return h.groupBy("query_id").agg(F.max_by("rk", F.struct(F.round("f1", 9), -F.col("rk"))).alias("best_k"), F.max("f1").alias("best_f1"))


def dropped(gold: DataFrame, ranked: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """Gold that is not among the first k, with the reason: not in the corpus, not retrieved, beyond the budget."""
    near = ranked.groupBy("query_id", "doc_id").agg(F.min("rk").alias("rk"))
    g = gold.select("query_id", "doc_id").distinct().join(near, ["query_id", "doc_id"], "left").join(corpus.select("doc_id").distinct().withColumn("known", F.lit(1)), "doc_id", "left")
    why = F.when(F.col("known").isNull(), "source_coverage").when(F.col("rk").isNull(), "not_retrieved").otherwise("topk_budget")
    return g.where(F.col("rk").isNull() | (F.col("rk") > k)).select("query_id", "doc_id", why.alias("reason"))


def smallest_k(ranked: DataFrame, gold: DataFrame, ks: list[int], floor: float) -> DataFrame:
    r = recall_at(ranked, gold, ks)
    row = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"recall_{k}").alias("r")) for k in ks])).alias("x")
    per = r.select(row).groupBy(F.col("x.k").alias("k")).agg(F.avg("x.r").alias("mean"), F.min("x.r").alias("least"))
    return per.agg(F.min(F.when(F.col("mean") >= floor, F.col("k"))).alias("k"))


def forbid_gold(path: str, words: tuple[str, ...] = ("gold", "label", "solution")) -> str:
    """A path for candidate generation; refuses those that name gold files."""
    if any(w in path.lower() for w in words):
        raise ValueError(f"gold may not be read here: {path}")
    return path


def by_channel(channels: DataFrame, gold: DataFrame) -> DataFrame:
    """query_id, channel, returned, hits, recall of each channel, and the gold that it alone found."""
    n = gold.groupBy("query_id").agg(F.count_distinct("doc_id").alias("n_gold"))
    c = channels.select("query_id", "channel", "doc_id").distinct()
    hit = c.join(gold.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_semi")
    alone = hit.groupBy("query_id", "doc_id").agg(F.min("channel").alias("channel"), F.count("*").alias("k")).where("k = 1").groupBy("query_id", "channel").agg(F.count("*").alias("alone"))
    per = c.groupBy("query_id", "channel").agg(F.count("*").alias("returned")).join(hit.groupBy("query_id", "channel").agg(F.count("*").alias("hits")), ["query_id", "channel"], "left").join(alone, ["query_id", "channel"], "left").join(n, "query_id")
    z = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    return per.select("query_id", "channel", "returned", z("hits"), z("alone"), (F.coalesce("hits", F.lit(0)) / F.col("n_gold")).alias("recall"))


def best_threshold(scored: DataFrame, gold: DataFrame, thresholds: list[float]) -> DataFrame:
    """threshold, macro_f1 of all thresholds over the queries with gold; the thresholds ride along as an array, the scores are read once."""
    g = gold.select("query_id", "doc_id").distinct().withColumn("g", F.lit(1))
    n = g.groupBy("query_id").agg(F.count("*").alias("n_gold"))
    s = scored.groupBy("query_id", "doc_id").agg(F.max("score").alias("score")).join(g, ["query_id", "doc_id"], "left")
    agg = [x for i, t in enumerate(thresholds) for x in (F.count_if(F.col("score") >= t).alias(f"p{i}"), F.count_if((F.col("score") >= t) & (F.col("g") == 1)).alias(f"t{i}"))]
    at = n.join(s.groupBy("query_id").agg(*agg), "query_id", "left").na.fill(0)
    row = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"p{i}").alias("p"), F.col(f"t{i}").alias("t")) for i, t in enumerate(thresholds)])).alias("x")
    return at.select("n_gold", row).groupBy(F.col("x.threshold").alias("threshold")).agg(F.avg(prf(F.col("x.t"), F.col("x.p"), F.col("n_gold"))[2]).alias("macro_f1"))


def expanded_gold(gold: DataFrame, corpus: DataFrame, kids: DataFrame) -> DataFrame:
    """Gold as corpus keys: the key itself regardless of case, else its paragraphs; what is in neither stays. gold: query_id, citation; kids: article, child."""
    names = corpus.groupBy(F.lower("citation").alias("l")).agg(F.min("citation").alias("known"))
    j = gold.select("query_id", "citation").distinct().withColumn("l", F.lower("citation")).join(names, "l", "left").join(kids, F.col("citation") == F.col("article"), "left")
    return j.select("query_id", F.coalesce("known", "child", "citation").alias("citation")).distinct()


def gold_coverage(gold: DataFrame, corpus: DataFrame, kids: DataFrame) -> DataFrame:
    """One row: different gold strings, those in the corpus, those there after expansion to paragraphs."""
    g = gold.select("citation").distinct()
    known = corpus.select("citation").distinct().withColumn("k", F.lit(1))
    wide = g.join(known, "citation", "left").join(kids.select(F.col("article").alias("citation")).distinct().withColumn("x", F.lit(1)), "citation", "left")
    return wide.agg(F.count("*").alias("gold"), F.count("k").alias("exact"), F.count_if(F.col("k").isNotNull() | F.col("x").isNotNull()).alias("expanded"))


def stage_recall(stages: list[tuple[str, DataFrame]], gold: DataFrame) -> DataFrame:
    """query_id, n_gold, and the gold left after each stage, and the stage that lost most. stages: (name, query_id + doc_id)."""
    g = gold.select("query_id", "doc_id").distinct()
    out = g.groupBy("query_id").agg(F.count("*").alias("n_gold"))
    for name, df in stages:
        left = g.join(df.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(F.count("*").alias(name))
        out = out.join(left, "query_id", "left")
    names = [n for n, _ in stages]
    out = out.na.fill(0)
    before = ["n_gold", *names[:-1]]
    worst = F.array_max(F.array(*[F.struct((F.col(b) - F.col(n)).alias("lost"), F.lit(-i).alias("i"), F.lit(n).alias("stage")) for i, (b, n) in enumerate(zip(before, names, strict=True))]))
    return out.withColumn("worst", F.when(worst["lost"] > 0, worst["stage"]))


def first_failure(gold: DataFrame, corpus: DataFrame, decisions: DataFrame, options: DataFrame, kept: DataFrame) -> DataFrame:
    """query_id, doc_id, reason of gold that isn't kept: not in the corpus, the first decision (by seq) it doesn't meet, or the budget.

    decisions: query_id, seq, segment, value; options: doc_id, segment, value. A decision is met by any of its values.
    """
    lost = gold.select("query_id", "doc_id").distinct().join(kept.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    d = decisions.groupBy("query_id", "segment").agg(F.min("seq").alias("seq"))
    met = lost.join(decisions, "query_id").join(options, ["doc_id", "segment", "value"], "left_semi").select("query_id", "doc_id", "segment").distinct()
    failed = lost.join(d, "query_id").join(met, ["query_id", "doc_id", "segment"], "left_anti").groupBy("query_id", "doc_id").agg(F.min_by("segment", "seq").alias("segment"))
    j = lost.join(corpus.select("doc_id").distinct().withColumn("k", F.lit(1)), "doc_id", "left").join(failed, ["query_id", "doc_id"], "left")
    return j.select("query_id", "doc_id", F.when(F.col("k").isNull(), "source_coverage").when(F.col("segment").isNotNull(), F.col("segment")).otherwise("topk_budget").alias("reason"))


def by_family(ranked: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """family, gold, hits, recall within the first k, overall too (family `all`). gold: query_id, doc_id, family."""
    g = gold.select("query_id", "doc_id", "family").distinct()
    hit = g.join(ranked.where(F.col("rk") <= k).select("query_id", "doc_id").distinct().withColumn("h", F.lit(1)), ["query_id", "doc_id"], "left")
    rows = hit.select(F.explode(F.array("family", F.lit("all"))).alias("family"), "h")
    return rows.groupBy("family").agg(F.count("*").alias("gold"), F.count("h").alias("hits"), (F.count("h") / F.count("*")).alias("recall"))


def oracle_plan(gold: DataFrame, options: DataFrame) -> DataFrame:
    """For audits alone, as it reads gold: the options that gold documents bear. query_id, segment, value, n."""
    return gold.select("query_id", "doc_id").distinct().join(options.distinct(), "doc_id").groupBy("query_id", "segment", "value").agg(F.count("*").alias("n"))


def gold_bank(gold: DataFrame, corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """For audits alone: the corpus rows that are gold of any query, as every query's candidates. A leak by construction."""
    bank = gold.select("doc_id").distinct().join(corpus.select("doc_id").distinct(), "doc_id", "left_semi")
    return queries.select("query_id").distinct().join(bank, F.lit(True))


def linked_gold(gold: DataFrame, edges: DataFrame) -> DataFrame:
    """query_id, source, target: edges between two gold citations of one query. gold: query_id, citation."""
    g, coded = S.numbered(edges)
    own, n = S.seeded(g.code(gold.select("query_id", "citation"), no="citation"))
    return g.name(S.within(own, n, S.lists(coded)), source="a", target="b").select("query_id", "source", "target")


def audit_stage(gold: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """query_id, before, after (recall), dropped (gold lost between)."""
    g = gold.select("query_id", "doc_id").distinct()
    flag = lambda df, c: df.select("query_id", "doc_id").distinct().withColumn(c, F.lit(1))
    j = g.join(flag(before, "b"), ["query_id", "doc_id"], "left").join(flag(after, "a"), ["query_id", "doc_id"], "left")
    return j.groupBy("query_id").agg((F.count("b") / F.count("*")).alias("before"), (F.count("a") / F.count("*")).alias("after"), F.count_if(F.col("b").isNotNull() & F.col("a").isNull()).alias("dropped"))


def guarded_cut(scored: DataFrame, k: int, gold: DataFrame, audit: bool) -> DataFrame:
    """The k best of a query; in an audit of labelled queries the gold beyond them too, marked, so that its loss shows."""
    from .fusion import ranked

    r = ranked(scored, ["query_id"])
    if not audit:
        return r.where(F.col("rk") <= k).withColumn("guarded", F.lit(False))
    g = gold.select("query_id", "doc_id").distinct().withColumn("g", F.lit(True))
    return r.join(g, ["query_id", "doc_id"], "left").where((F.col("rk") <= k) | F.col("g")).withColumn("guarded", F.col("rk") > k).drop("g")


def figures(rows: DataFrame, x: str, y: str, by: str | None = None) -> DataFrame:
    """n, means, medians, ratio of the sums and Pearson's correlation of two columns; null where either is constant."""
    flat = (F.stddev_pop(x) == 0) | (F.stddev_pop(y) == 0)
    aggs = [F.count("*").alias("n"), F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"), F.percentile(x, 0.5).alias("median_x"), F.percentile(y, 0.5).alias("median_y"), (F.sum(x) / F.nullif(F.sum(y), F.lit(0))).alias("ratio"), F.when(~flat, F.corr(x, y)).alias("corr")]
    return rows.groupBy(by).agg(*aggs) if by else rows.agg(*aggs)


def articles_per_code(gold: DataFrame) -> DataFrame:
    """law_code, articles, citations of gold statutes. gold: law_code, article."""
    return gold.groupBy("law_code").agg(F.count_distinct("article").alias("articles"), F.count("*").alias("citations"))

"""Retrieval channels: each takes what a query asks for and gives (query_id, doc_id, score, rk), best first, ties to the smaller id.

asked: query_id and a key (canon, code, term, area ...); index tables: key, doc_id. Keys meet in equi-joins; ranked cuts are
windows that Spark limits before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import settled
from .fusion import ranked
from .lexical import bm25
from .product import best


def top(df: DataFrame, k: int, by: str = "query_id") -> DataFrame:
    return ranked(df, [by]).where(F.col("rk") <= k)


def role_weight(role: Column, weights: dict[str, float], other: float = 1.0) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for p in weights.items() for x in p])[role], F.lit(other)) if weights else F.lit(other)


def link_search(asked: DataFrame, links: DataFrame, authority: DataFrame, k: int) -> DataFrame:
    """Documents linked to any anchor asked for, by authority. asked: query_id, key; links: key, doc_id; authority: doc_id, authority."""
    scored = links.select("key", "doc_id").distinct().join(authority, "doc_id", "left").select("key", "doc_id", F.coalesce("authority", F.lit(0.0)).cast("double").alias("score"))
    return top(per_group(asked.select("query_id", "key"), scored, "key", k), k)


def per_group(asked: DataFrame, scored: DataFrame, by: str, k: int) -> DataFrame:
    """query_id, doc_id, score: the best score of a document over the groups asked for, of at least a query's k best documents.

    What stands before a document in one group stands before it in the union, so the first k of each group are enough; the cut
    comes before queries meet rows. asked: query_id, `by`; scored: `by`, doc_id, score.
    """
    once = scored.groupBy(by, "doc_id").agg(F.max("score").alias("score"))
    return asked.distinct().join(top(once, k, by).drop("rk"), by).groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))


def either_key(links: DataFrame, *columns: str) -> DataFrame:
    """key, doc_id for links that may be asked for by several columns (a citation or its judgment)."""
    keys = F.explode(F.array_distinct(F.filter(F.array(*columns), lambda x: x.isNotNull())))
    return links.select(keys.alias("key"), "doc_id").distinct()


def matched(asked: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """By the number of keys that match."""
    return top(_best(asked.select("query_id", "key"), index, k), k)


def _best(asked: DataFrame, index: DataFrame, k: int, more: float = 0.0) -> DataFrame:
    return best(asked, index.withColumnRenamed("doc_id", "node"), k, more).withColumnRenamed("node", "doc_id")


def rare_matches(asked: DataFrame, index: DataFrame, roles: DataFrame, weights: dict[str, float], k: int) -> DataFrame:
    """Sum of 1 / ln(2 + df) over matching keys, times 1 + .3 for each beyond the first, times the role's weight."""
    df = index.groupBy("key").agg(F.count_distinct("doc_id").alias("df"))
    a = asked.select("query_id", "key").distinct().join(df, "key").select("query_id", "key", (1 / F.log(2 + F.col("df"))).alias("weight"))
    i = index.select("key", "doc_id").distinct().join(roles, "doc_id", "left").select("key", "doc_id", role_weight(F.col("role"), weights).alias("factor"))
    return top(_best(a, i, k, 0.3), k)


def summed(asked: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """Sum of the asked keys' weights. asked: query_id, key, weight."""
    w = asked.groupBy("query_id", "key").agg(F.max("weight").alias("weight"))
    return top(_best(w, index, k), k)


def terms(asked: DataFrame, index: DataFrame, stem, k: int, least: int = 4) -> DataFrame:
    """Per query term the best of: the term itself 1, its stem .7, one within the other .85 of short over long; summed over terms.

    asked: query_id, term; index: term, doc_id. Terms within others are found through their first `least` letters anywhere in the
    corpus terms, so only distinct terms meet, by a join on letter runs.
    """
    q, c = asked.select("query_id", F.lower("term").alias("q")).distinct(), index.select(F.lower("term").alias("c"), "doc_id").distinct()
    qs, cs = q.select("q").distinct(), c.select("c").distinct()
    same = qs.select("q", F.col("q").alias("c"), F.lit(1.0).alias("w"))
    lemma = qs.withColumn("s", stem("q")).join(cs.withColumn("s", stem("c")), "s").select("q", "c", F.lit(0.7).alias("w"))
    runs = lambda x: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - (least - 1), F.lit(1))), lambda i: F.substring(x, i, least)))
    heads = lambda t, x: t.where(F.length(x) >= least).withColumn("g", F.substring(x, 1, least))
    inner = heads(qs, "q").join(cs.withColumn("g", F.explode(runs(F.col("c")))), "g").where(F.contains("c", "q"))
    outer = heads(cs, "c").join(qs.withColumn("g", F.explode(runs(F.col("q")))), "g").where(F.contains("q", "c"))
    short, long_ = F.least(F.length("q"), F.length("c")), F.greatest(F.length("q"), F.length("c"))
    part = inner.select("q", "c").union(outer.select("q", "c")).where("q <> c").select("q", "c", (0.85 * short / long_).alias("w"))
    best = same.unionByName(lemma).unionByName(part).groupBy("q", "c").agg(F.max("w").alias("w"))
    per = q.join(best, "q").join(c, "c").groupBy("query_id", "q", "doc_id").agg(F.max("w").alias("w"))
    return top(per.groupBy("query_id", "doc_id").agg(F.sum("w").alias("score")), k)


def area_bedrock(areas: DataFrame, canons: DataFrame, index: DataFrame, codes: list[str], per_area: int, k: int) -> DataFrame:
    """The most frequent canons of the query's areas, of given codes, scored 1 / rank. areas: query_id, area; canons: area, canon, code, n."""
    w = Window.partitionBy("area").orderBy(F.desc("n"), "canon")
    first = canons.where(F.col("code").isin(codes)).withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_area)
    hit = first.join(index.select(F.col("key").alias("canon"), "doc_id").distinct(), "canon")
    return top(per_group(areas.select("query_id", "area"), hit.select("area", "doc_id", (1 / F.col("r")).alias("score")), "area", k), k)


def co_cited(asked: DataFrame, pairs: DataFrame, df: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """Documents of the asked canons' companions: n / ln(2 + df) of the best. pairs: a, b, n; df: key, df."""
    w = pairs.join(df.withColumnRenamed("key", "b"), "b").select("a", "b", "df", F.round(F.col("n") / F.log(2 + F.col("df")), 6).alias("r"), (F.col("n") / F.log(2 + F.col("df"))).alias("w"))
    # a companion of k documents fills an anchor's cut: those that weigh less than it can't enter
    least = F.max(F.when(F.col("df") >= k, F.col("r"))).over(Window.partitionBy("a"))
    w = w.withColumn("least", least).where("least IS NULL OR r >= least")
    docs = index.select("key", "doc_id").distinct().withColumn("i", F.row_number().over(Window.partitionBy("key").orderBy("doc_id"))).where(F.col("i") <= k)
    scored = w.join(docs.select(F.col("key").alias("b"), "doc_id"), "b").select(F.col("a").alias("key"), "doc_id", F.col("w").alias("score"))
    return top(per_group(asked.select("query_id", "key"), scored, "key", k), k)


def _first(rows: DataFrame, key: str, k: int, order: str) -> DataFrame:
    """The first k rows of each key, numbered (r): the same for every query, so they are cut before queries meet them."""
    w = Window.partitionBy(key).orderBy(F.desc(order), "doc_id")
    return rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)


def per_key(asked: DataFrame, rows: DataFrame, key: str, k: int, order: str = "authority") -> DataFrame:
    """For each asked key its k best rows, merged by the best order value. rows: `key`, doc_id, `order`."""
    hit = asked.distinct().join(_first(rows, key, k, order), key)
    return ranked(hit.groupBy("query_id", "doc_id").agg(F.max(F.col(order).cast("double")).alias("score")), ["query_id"])


def shared_budget(asked: DataFrame, rows: DataFrame, key: str, k: int, order: str = "authority") -> DataFrame:
    """k rows a query, in equal parts (one at least) for its keys."""
    n = asked.distinct().groupBy("query_id").agg(F.greatest(F.lit(1), F.floor(F.lit(k) / F.count("*"))).alias("each"))
    hit = asked.distinct().join(n, "query_id").join(_first(rows, key, k, order), key).where(F.col("r") <= F.col("each"))
    return ranked(hit.groupBy("query_id", "doc_id").agg(F.max(F.col(order).cast("double")).alias("score")), ["query_id"])


def by_priority(parts: list[DataFrame]) -> DataFrame:
    """Union of results (query_id, doc_id), each document at its first list, lists in order."""
    both = None
    for i, p in enumerate(parts):
        p = p.select("query_id", "doc_id", F.lit(i).alias("list"))
        both = p if both is None else both.unionByName(p)
    first = both.groupBy("query_id", "doc_id").agg(F.min("list").alias("list"))
    return first.withColumn("rk", F.row_number().over(Window.partitionBy("query_id").orderBy("list", "doc_id")))


def language_budgets(sizes: dict[str, int], k: int) -> dict[str, int]:
    """k in proportion to the languages' documents, a sixteenth at least; what is too much comes off the largest."""
    total = max(1, sum(sizes.values()))
    out = {x: max(k // 16, round(k * n / total)) for x, n in sizes.items() if n}
    while sum(out.values()) > k and out:
        largest = max(out, key=lambda x: (out[x], x))
        out[largest] -= 1
    return out


def bm25_by_language(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """BM25 within each language over ln(N + e), the best of a document, k a query. docs: doc_id, lang, text; queries: query_id, lang, query."""
    sizes = {r["lang"]: r["n"] for r in docs.where(F.col("lang").isNotNull()).groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    out = None
    for lang, most in sorted(language_budgets(sizes, k).items()):
        one = bm25(docs.where(F.col("lang") == lang), queries.where(F.col("lang") == lang).select("query_id", "query"), most)
        one = one.select("query_id", "doc_id", (F.col("score") / F.log(F.lit(sizes[lang]) + F.exp(F.lit(1.0)))).alias("score"))
        out = one if out is None else out.unionByName(one)
    return top(out.groupBy("query_id", "doc_id").agg(F.max("score").alias("score")), k)


def fields_blend(scores: DataFrame, weights: dict[str, float], rank_bonus: float, explicit: DataFrame, roles: DataFrame, priors: dict[str, float], k: int) -> DataFrame:
    """Per-field scores brought to 0..1 a query, weighted and summed, a bonus over the square root of the field's rank, 10 for explicit hits, a prior by role.

    scores: query_id, field, doc_id, score; explicit: query_id, doc_id.
    """
    w = Window.partitionBy("query_id", "field")
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    unit = F.when(hi > lo, (F.col("score") - lo) / (hi - lo)).otherwise(F.when(hi > 0, 1.0).otherwise(0.0))
    each = scores.withColumn("u", unit).withColumn("r", F.row_number().over(w.orderBy(F.desc(F.round("score", 6)), "doc_id")))
    part = role_weight(F.col("field"), weights, 0.0) * F.col("u") + F.lit(rank_bonus) / F.sqrt("r")
    sums = each.groupBy("query_id", "doc_id").agg(F.sum(part).alias("s"))
    hit = sums.join(explicit.distinct().withColumn("e", F.lit(10.0)), ["query_id", "doc_id"], "full").join(roles, "doc_id", "left")
    return top(hit.select("query_id", "doc_id", (F.coalesce("s", F.lit(0.0)) + F.coalesce("e", F.lit(0.0)) + role_weight(F.col("role"), priors, 0.0)).alias("score")), k)


def evidence_lookup(statutes: DataFrame, cases: DataFrame, concepts: DataFrame, about: DataFrame, priors: dict[str, float], k: int) -> DataFrame:
    """5 a matched statute, 4 a matched case, the sum of 1 / sqrt(rank) over concepts, and .6 authority + .3 specificity + a prior of the role.

    statutes, cases: query_id, doc_id (a row a match); concepts: query_id, doc_id, rank; about: doc_id, authority, specificity, role.
    """
    n = lambda df, c: df.groupBy("query_id", "doc_id").agg(F.count("*").alias(c))
    c = concepts.groupBy("query_id", "doc_id").agg(F.sum(1 / F.sqrt("rank")).alias("c"))
    hit = n(statutes, "s").join(n(cases, "k"), ["query_id", "doc_id"], "full").join(c, ["query_id", "doc_id"], "full").join(about, "doc_id", "left")
    z = lambda x: F.coalesce(F.col(x), F.lit(0.0))
    return top(hit.select("query_id", "doc_id", (5 * z("s") + 4 * z("k") + z("c") + 0.6 * z("authority") + 0.3 * z("specificity") + role_weight(F.col("role"), priors, 0.0)).alias("score")), k)


def code_boosts(query_terms: DataFrame, pairs: DataFrame, k: int, least: int = 2) -> DataFrame:
    """query_id, code, score: codes by the sum of their positive PMI with the query's terms, times 10. pairs: term, code, n."""
    total = pairs.agg(F.sum("n").alias("t"))
    by = lambda c: pairs.groupBy(c).agg(F.sum("n").alias(f"n_{c}"))
    pmi = F.log(F.col("n") * F.col("t") / (F.col("n_term") * F.col("n_code")))
    hit = query_terms.distinct().join(pairs.where(F.col("n") >= least), "term").join(by("term"), "term").join(by("code"), "code").crossJoin(total).withColumn("p", pmi).where("p > 0")  # one row
    s = hit.groupBy("query_id", "code").agg((10 * F.sum("p")).alias("score"))
    return ranked(s, ["query_id"], tie="code").where(F.col("rk") <= k)


def injected(queries: DataFrame, codes: DataFrame, times: int) -> DataFrame:
    """The queries with their codes put behind them, `times` over. codes: query_id, code, rk."""
    more = codes.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rk", "code"))), lambda x: F.array_join(F.array_repeat(x["code"], times), " ")), " ").alias("more"))
    return queries.join(more, "query_id", "left").select("query_id", F.concat_ws(" ", "query", "more").alias("query"))


def rank_of(scores: DataFrame, wanted: DataFrame) -> DataFrame:
    """query_id, doc_id, rk: 1 + the number of better scores, so ties share a rank."""
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)))
    return scores.withColumn("rk", F.rank().over(w)).join(wanted.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_semi").select("query_id", "doc_id", "rk")


def boosted(scores: DataFrame, about: DataFrame, boosts: list[tuple[Column, float]], k: int) -> DataFrame:
    """Scores plus what metadata conditions add. about: doc_id and what the conditions name."""
    add = F.lit(0.0)
    for cond, v in boosts:
        add = add + F.when(cond, v).otherwise(0.0)
    return top(scores.join(about, "doc_id", "left").withColumn("score", F.col("score") + add).select("query_id", "doc_id", "score"), k)


def hash_sample(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows that any run draws alike: those of least hash."""
    return rows.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def feedback(first: DataFrame, index: DataFrame, seeds: int, keys: int) -> DataFrame:
    """query_id, key, weight: the keys most shared by a first pass's best documents, for a second pass. first: query_id, doc_id, rk."""
    best = first.where(F.col("rk") <= seeds).select("query_id", "doc_id")
    n = best.join(index.distinct(), "doc_id").groupBy("query_id", "key").agg(F.count("*").alias("n")).where("n > 1")
    w = Window.partitionBy("query_id").orderBy(F.desc("n"), "key")
    return n.withColumn("r", F.row_number().over(w)).where(F.col("r") <= keys).select("query_id", "key", (F.col("n") / F.lit(float(seeds))).alias("weight"))


def two_passes(asked: DataFrame, index: DataFrame, edges: DataFrame, k: int, seeds: int = 10, keys: int = 20) -> DataFrame:
    """query_id, channel, doc_id, score, rk of two passes: matched keys; then, from the best of the first, shared keys and the
    documents that they cite or are cited by. edges: source, target."""
    first = settled(matched(asked, index, max(k, seeds)), "first-pass")
    more = summed(feedback(first, index, seeds, keys), index, k)
    best = first.where(F.col("rk") <= seeds).select("query_id", F.col("doc_id").alias("node"))
    both = edges.select("source", "target").union(edges.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct()
    near = best.join(both, F.col("node") == F.col("source")).groupBy("query_id", F.col("target").alias("doc_id")).agg(F.count("*").cast("double").alias("score"))
    tag = lambda df, c: df.select("query_id", F.lit(c).alias("channel"), "doc_id", "score", "rk")
    return tag(first.where(F.col("rk") <= k), "direct").unionByName(tag(more, "feedback")).unionByName(tag(top(near, k), "graph"))


# --- the keyword funnel: filters over a table of citations with their parsed parts


def repeated(rows: DataFrame) -> DataFrame:
    """doc_id of the documents of several rows, fit for joins."""
    out = settled(rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated")
    return F.broadcast(out) if out.count() <= 400_000 else out


def cells(rows: DataFrame, columns: list[str], several: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents whose rows are alike in `columns` are one cell, which a filter that reads no others keeps or drops as a whole.

    Returns the rows of the cells, as often as a document has them, with the cell's number as doc_id and other columns null; and of each
    cell (doc_id) n, its documents, and ids, the sum of their ids, which aren't null. A filter then meets cells, not rows.
    several: those that `repeated` gives; only their rows are collected.
    """
    sums = F.count("*").alias("n"), F.sum("doc_id").alias("ids")
    one = rows.join(several, "doc_id", "left_anti").groupBy(*columns).agg(*sums).select(F.array(F.struct(*columns)).alias("cell"), "n", "ids")
    many = rows.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("cell"))
    docs = settled(one.union(many.groupBy("cell").agg(*sums)).withColumn("no", F.monotonically_increasing_id()), "cells")
    rest = [F.lit(None).cast(kind).alias(c) for c, kind in rows.dtypes if c != "doc_id" and c not in columns]
    own = docs.select(F.col("no").alias("doc_id"), F.explode("cell").alias("_r")).select("doc_id", *[F.col("_r")[c].alias(c) for c in columns], *rest)
    return own, docs.select(F.col("no").alias("doc_id"), "n", "ids")


def mentioned_laws(mentions: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of an (article, code) that was mentioned; of the article alone where no code was. mentions: query_id, article, law_code."""
    coded, bare = mentions.where("law_code IS NOT NULL"), mentions.where("law_code IS NULL")
    a = coded.join(rows, ["article", "law_code"]).select("query_id", "doc_id")
    return a.union(bare.select("query_id", "article").join(rows, "article").select("query_id", "doc_id")).distinct()


def mentioned_courts(mentions: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of a judgment named by its key or docket. mentions: query_id, base."""
    return mentions.distinct().join(rows.select("doc_id", "base"), "base").select("query_id", "doc_id").distinct()


def of_codes(plan: DataFrame, rows: DataFrame, keep_no_code: bool = True) -> DataFrame:
    """Rows of the plan's codes, and those without a code. plan: query_id, law_code."""
    hit = plan.distinct().join(rows, "law_code").select("query_id", "doc_id")
    if keep_no_code:
        hit = hit.union(plan.select("query_id").distinct().join(rows.where("law_code IS NULL").select("doc_id"), F.lit(True)))
    return hit.distinct()


def meeting(base: DataFrame, plan: DataFrame, options: DataFrame) -> DataFrame:
    """Of the base rows those that bear an option of each segment of the plan. plan: query_id, segment, value; options: doc_id, segment, value."""
    need = plan.groupBy("query_id").agg(F.count_distinct("segment").alias("need"))
    n = plan.distinct().join(options.distinct(), ["segment", "value"]).groupBy("query_id", "doc_id").agg(F.count_distinct("segment").alias("n"))
    full = n.join(need, "query_id").where("n = need").select("query_id", "doc_id")
    unplanned = base.join(plan.select("query_id").distinct(), "query_id", "left_anti").select("query_id", "doc_id")
    return base.select("query_id", "doc_id").join(full, ["query_id", "doc_id"], "left_semi").union(unplanned)


def of_divisions(base: DataFrame, plan: DataFrame, rows: DataFrame) -> DataFrame:
    """Of the base rows those of a planned division or prefix, and those with neither. plan: query_id, division."""
    r = base.join(rows.select("doc_id", F.coalesce("division", "prefix").alias("division")), "doc_id")
    return r.join(plan.distinct(), ["query_id", "division"], "left_semi").select("query_id", "doc_id").union(r.where("division IS NULL").select("query_id", "doc_id"))


def same_judgments(seeds: DataFrame, rows: DataFrame) -> DataFrame:
    base = seeds.join(rows.select("doc_id", "base"), "doc_id").select("query_id", "base").distinct()
    return base.join(rows.select("doc_id", "base"), "base").select("query_id", "doc_id").distinct()


def citing_courts(laws: DataFrame, edges: DataFrame, rows: DataFrame) -> DataFrame:
    """Court rows that cite selected laws. laws: query_id, citation; edges: source, target; rows: citation, doc_id."""
    return laws.distinct().join(edges, F.col("citation") == F.col("target")).select("query_id", F.col("source").alias("citation")).distinct().join(rows.select("citation", "doc_id"), "citation").select("query_id", "doc_id").distinct()


def keyword_plan(queries: DataFrame, cards: DataFrame) -> DataFrame:
    """query_id, segment, value: options whose keywords stand in the query. cards: segment, value, keyword."""
    words = F.explode(F.array_distinct(F.filter(F.split(F.lower("query"), r"[^\p{L}\p{N}]+"), lambda w: w != ""))).alias("keyword")
    return queries.select("query_id", words).join(cards.select("segment", "value", F.lower("keyword").alias("keyword")).distinct(), "keyword").select("query_id", "segment", "value").distinct()


def valid_plan(plan: DataFrame, options: DataFrame) -> DataFrame:
    return plan.join(options.select("segment", "value").distinct(), ["segment", "value"], "left_semi").select("query_id", "segment", "value")


def merged_decisions(decisions: DataFrame) -> DataFrame:
    """One row a (query, dataset, family, segment, mode), its values united and sorted."""
    keys = ["query_id", "dataset", "family", "segment", "mode"]
    return decisions.groupBy(*keys).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("options")))).alias("options"))


def decisions(queries: DataFrame, registry: DataFrame, least: int = 1) -> DataFrame:
    """What a query's references decide: `include` for values the registry knows in the corpus, `maybe` for those only texts name.

    queries: query_id, query; registry: family, segment, value, source_count. Values come from the parsed references.
    """
    from ..functions import parsers as P

    ref = queries.select("query_id", F.explode(P.all_references("query")).alias("r"))
    part = F.explode(F.array(*[F.struct(F.lit(s).alias("segment"), F.col(f"r.{s}").alias("value")) for s in ("law_code", "article", "base", "division", "volume", "docket", "pinpoint")])).alias("p")
    named = ref.select("query_id", F.col("r.family").alias("family"), part).select("query_id", "family", "p.segment", "p.value").where("value IS NOT NULL").distinct()
    known = named.join(registry, ["family", "segment", "value"])
    return known.select("query_id", "family", "segment", F.when(F.col("source_count") >= least, "include").otherwise("maybe").alias("mode"), "value")


def procedural(areas: DataFrame, rows: DataFrame, codes: dict[str, tuple[str, ...]], pattern: str, k: int, default: tuple[str, ...] = ("BGG",)) -> DataFrame:
    """Rows of the procedural codes of a query's areas whose heading speaks of procedure, by authority. areas: query_id, area; rows: doc_id, law_code, heading, authority."""
    pick = F.coalesce(F.create_map(*[x for a, c in codes.items() for x in (F.lit(a), F.array(*map(F.lit, c)))])[F.col("area")], F.array(*map(F.lit, default)))
    wanted = areas.select("query_id", F.explode(pick).alias("law_code")).distinct()
    hit = wanted.join(rows.where(F.col("heading").rlike(pattern)), "law_code").select("query_id", "doc_id", F.col("authority").cast("double").alias("score"))
    return top(hit, k)


def features(cands: DataFrame, asked: DataFrame, index: DataFrame, about: DataFrame) -> DataFrame:
    """A row a candidate for a learnt ranker: matched keys, their share of what was asked and of the document's, their rarity, rank, authority.

    cands: query_id, doc_id, rk; asked: query_id, key; index: key, doc_id; about: doc_id, authority.
    """
    a, i = asked.select("query_id", "key").distinct(), index.select("key", "doc_id").distinct()
    n_asked, n_doc, df = a.groupBy("query_id").agg(F.count("*").alias("n_asked")), i.groupBy("doc_id").agg(F.count("*").alias("n_doc")), i.groupBy("key").agg(F.count("*").alias("df"))
    hit = cands.select("query_id", "doc_id").join(i, "doc_id").join(a, ["query_id", "key"]).join(df, "key").groupBy("query_id", "doc_id").agg(F.count("*").alias("matched"), F.sum(1 / F.log(2 + F.col("df"))).alias("rarity"))
    j = cands.join(hit, ["query_id", "doc_id"], "left").join(n_asked, "query_id", "left").join(n_doc, "doc_id", "left").join(about.select("doc_id", "authority"), "doc_id", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return j.select("query_id", "doc_id", z("matched").alias("matched"), (z("matched") / F.greatest(z("n_asked"), F.lit(1))).alias("of_asked"), (z("matched") / F.greatest(z("n_doc"), F.lit(1))).alias("of_doc"), z("rarity").alias("rarity"), (1 / F.col("rk")).alias("reciprocal"), F.coalesce("authority", F.lit(0.0)).alias("authority"))

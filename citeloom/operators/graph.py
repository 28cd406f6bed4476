"""Citation graph: nodes, edges, alias passes, expansion, co-citation statistics.

Edges are (source, target); seeds are (query_id, node). Per-query cuts are ranked windows, which Spark limits before the
shuffle; existence tests are semi-joins. A side is never broadcast by hand: Spark does so below its own size threshold.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import citations as C
from . import steps as S
from .product import best

#: Items of a basket whose pairs one task makes.
LARGE = 2000


def top(df: DataFrame, k: int, by: str | list[str] = "query_id", score: str = "score", tie: str = "node") -> DataFrame:
    w = Window.partitionBy(*([by] if isinstance(by, str) else by)).orderBy(F.desc(F.round(score, 6)), tie)
    return df.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)


def merge_nodes(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Union of origin bits per key; the other columns from the first row in `order`."""
    rest = [c for c in rows.columns if c not in (*keys, "origin_mask", order)]
    agg = rows.groupBy(*keys).agg(F.bit_or("origin_mask").alias("origin_mask"), *([F.min_by(F.struct(*rest), F.col(order)).alias("_f")] if rest else []))
    return agg.select(*keys, "origin_mask", *[F.col("_f")[c].alias(c) for c in rest])


def distinct_edges(edges: DataFrame) -> DataFrame:
    return edges.where("source <> target").dropDuplicates(["source", "target"])


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.agg(*[F.count_if(C.origin(b, F.col("origin_mask"))).alias(name) for b, name in ((1, "own"), (2, "referenced"))], F.count("*").alias("nodes"))
    return n.crossJoin(edges.agg(F.count("*").alias("edges")))  # one row by one row


def examples(nodes: DataFrame, by: str, column: str, k: int) -> DataFrame:
    return nodes.withColumn("rk", F.row_number().over(Window.partitionBy(by).orderBy(column))).where(F.col("rk") <= k)


def alias_edges(edges: DataFrame, nodes: DataFrame, alias: Column) -> DataFrame:
    """Edges to an alias of the target (a string, or an array of them) where it is a node."""
    many = edges.select("source", F.explode(alias).alias("target")) if "array" in edges.select(alias.alias("a")).dtypes[0][1] else edges.select("source", alias.alias("target"))
    known = nodes.select(F.col("citation").alias("target")).distinct()
    return distinct_edges(edges.select("source", "target").unionByName(many.where("target IS NOT NULL").join(known, "target", "left_semi").select("source", "target")))


def date_alias_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return alias_edges(edges, nodes, C.strip_date(F.col("target")))


def range_alias_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return alias_edges(edges, nodes, C.expand_range(F.col("target")))


def case_alias_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Fan-out to the rows of the target's judgment. Judgments join by key, so a large one is split by AQE."""
    base = lambda c: C.undated_base(C.split_court(c)["base"])
    sib = nodes.where(C.origin(1, F.col("origin_mask"))).select(base(F.col("citation")).alias("base"), F.col("citation").alias("sib")).where("base IS NOT NULL")
    fan = edges.withColumn("base", base(F.col("target"))).join(sib, "base").where("sib <> target AND sib <> source")
    return distinct_edges(edges.select("source", "target").unionByName(fan.select("source", F.col("sib").alias("target"))))


def case_alias_counts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """source, n: how many edges `case_alias_edges` would give a source, without making them.

    A source reaches all rows of the judgments that it cites, and what else it cites; itself is left out. So each judgment
    is counted once a source, and targets that are rows of a cited judgment aren't counted again.
    """
    base = lambda c: C.undated_base(C.split_court(c)["base"])
    rows = nodes.where(C.origin(1, F.col("origin_mask"))).select(F.col("citation").alias("row"), base(F.col("citation")).alias("base")).where("base IS NOT NULL")
    sizes = rows.groupBy("base").agg(F.count("*").alias("size"))
    e = edges.select("source", "target").distinct().withColumn("base", base(F.col("target")))
    reached = e.where("base IS NOT NULL").select("source", "base").distinct().join(sizes, "base")
    total = reached.groupBy("source").agg(F.sum("size").alias("n"))
    own = reached.withColumn("row", F.col("source")).join(rows, ["row", "base"], "left_semi").groupBy("source").agg(F.count("*").alias("own"))
    apart = e.where("source <> target").join(rows.select(F.col("row").alias("target"), "base"), ["target", "base"], "left_anti").groupBy("source").agg(F.count("*").alias("apart"))
    z = lambda c: F.coalesce(c, F.lit(0))
    out = total.join(own, "source", "left").join(apart, "source", "full")
    return out.select("source", (z("n") - z("own") + z("apart")).alias("n")).where("n > 0")


def own_reference_edges(rows: DataFrame) -> DataFrame:
    """Edges of references back into the own judgment. rows: citation, text."""
    from ..functions.parsers import own_references

    out = rows.select(F.col("citation").alias("source"), F.explode(own_references("text", C.court_base(F.col("citation")))).alias("target"))
    return distinct_edges(out)


def adjacency(edges: DataFrame) -> DataFrame:
    return edges.groupBy("source").agg(F.sort_array(F.collect_list("target")).alias("references"))


def in_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("target").alias("node")).agg(F.count("*").alias("in_degree"))


def neighbours(rows: DataFrame, group: str, key: str, name: str) -> DataFrame:
    """Previous and next row of a group in natural order, and the group's size."""
    w = Window.partitionBy(group).orderBy(C.natural_key(F.col(key).cast("string")), name)
    return rows.withColumns({"prev": F.lag(name).over(w), "next": F.lead(name).over(w), "group_rows": F.count("*").over(Window.partitionBy(group))})


def importance_factor(imp: Column) -> Column:
    return F.sqrt(1 + F.log1p(F.coalesce(imp, F.lit(0))))


def forward(seeds: DataFrame, edges: DataFrame, importance: DataFrame, k: int) -> DataFrame:
    """Out-neighbours of the seeds: edge count times the target's factor; seeds excluded."""
    index = edges.join(importance.withColumnRenamed("node", "target"), "target", "left").select(F.col("source").alias("key"), F.col("target").alias("node"), importance_factor(F.col("importance")).alias("factor"))
    return top(best(seeds.select("query_id", F.col("node").alias("key")), index, k, without=True), k)


def reverse(seeds: DataFrame, edges: DataFrame, importance: DataFrame, k: int, least: int = 5) -> DataFrame:
    """In-neighbours of landmark seeds, the seeds' factors summed."""
    marks = seeds.join(importance.where(F.col("importance") >= least), "node")
    hit = marks.join(edges, marks["node"] == edges["target"]).groupBy("query_id", F.col("source").alias("node")).agg(F.sum(importance_factor(F.col("importance"))).alias("score"))
    return top(hit.join(seeds, ["query_id", "node"], "left_anti"), k)


def _back(coded: DataFrame) -> DataFrame:
    return coded.select(F.col("b").alias("a"), F.col("a").alias("b"))


def two_hops(seeds: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """Nodes two steps out, by paths; seeds and first neighbours excluded. First neighbours are made distinct before the second
    step; an edge given twice counts once."""
    g, coded = S.numbered(edges)
    index, (own, n) = S.lists(coded), S.seeded(g.code(seeds, no="node"))
    out = S.second(S.reach(own, n, index), own, n, index, k, without_sets=True)
    return g.name(top(out, k, tie="no"), node="no").select("query_id", "node", "score", "rk")


def siblings(seeds: DataFrame, members: DataFrame, importance: DataFrame, k: int) -> DataFrame:
    """Rows of the seeds' judgments: seeds there times the judgment's factor. members: base, node."""
    per = seeds.join(members, "node").groupBy("query_id", "base").agg(F.count("*").alias("n"))
    out = per.join(members, "base").join(importance.withColumnRenamed("node", "base"), "base", "left")
    scored = out.select("query_id", "node", (F.col("n") * importance_factor(F.col("importance"))).alias("score"))
    return top(scored.join(seeds, ["query_id", "node"], "left_anti"), k)


def expand(seeds: DataFrame, edges: DataFrame, depth: int, beam: int) -> DataFrame:
    """Breadth-first expansion in both directions, `beam` new nodes a query and step: query_id, node, hop."""
    both = edges.select("source", "target").union(edges.select(F.col("target").alias("source"), F.col("source").alias("target")))
    seen = seeds.select("query_id", "node", F.lit(0).alias("hop"))
    last = seen
    for hop in range(1, depth + 1):
        new = last.join(both, last["node"] == both["source"]).groupBy("query_id", F.col("target").alias("node")).agg(F.count("*").cast("double").alias("score"))
        new = top(new.join(seen.select("query_id", "node"), ["query_id", "node"], "left_anti"), beam)
        last = new.select("query_id", "node", F.lit(hop).alias("hop"))
        seen = seen.unionByName(last)
    return seen


def pair_prior(baskets: DataFrame, least: int = 2) -> DataFrame:
    """Pairs of items of a basket (basket, item): support, confidences, Jaccard, PMI, NPMI.

    Only pairs of one basket meet. What one row cites bounds a basket in such corpora, but its pairs grow with its square: a
    basket above LARGE items is dealt into tiles of its items by hash, so no task holds all its pairs, and every pair still
    meets once.
    """
    b = baskets.select("basket", "item").distinct()
    tiles = F.greatest(F.lit(1), F.ceil(F.count("*").over(Window.partitionBy("basket")) / LARGE)).cast("int")
    dealt = b.withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("item"), F.col("tiles")).cast("int"))
    every = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    n = b.groupBy("item").agg(F.count("*").alias("n"))
    total = b.agg(F.count_distinct("basket").alias("total"))
    x, y = every.select("basket", "item", F.col("tile").alias("i"), F.col("other").alias("j")), every.select("basket", "item", F.col("other").alias("i"), F.col("tile").alias("j"))
    pair = x.alias("x").join(y.alias("y"), (F.col("x.basket") == F.col("y.basket")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j")) & (F.col("x.item") < F.col("y.item")))
    pair = pair.groupBy(F.col("x.item").alias("a"), F.col("y.item").alias("b")).agg(F.count("*").alias("support")).where(F.col("support") >= least)
    out = pair.join(n.select(F.col("item").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("item").alias("b"), F.col("n").alias("nb")), "b").crossJoin(total)  # one row
    pmi = F.log(F.col("support") * F.col("total") / (F.col("na") * F.col("nb")))
    return out.select(
        "a", "b", "support", (F.col("support") / F.col("na")).alias("conf_ab"), (F.col("support") / F.col("nb")).alias("conf_ba"), (F.col("support") / (F.col("na") + F.col("nb") - F.col("support"))).alias("jaccard"), pmi.alias("pmi"),
        F.when(F.col("support") < F.col("total"), pmi / -F.log(F.col("support") / F.col("total"))).alias("npmi"),
    )


def companions(prior: DataFrame, k: int, least_npmi: float = 0.0) -> DataFrame:
    both = prior.select("a", "b", "support", "npmi").unionByName(prior.select(F.col("b").alias("a"), F.col("a").alias("b"), "support", "npmi")).where(F.col("npmi") >= least_npmi)
    w = Window.partitionBy("a").orderBy(F.desc("support"), F.desc(F.round("npmi", 6)), "b")
    return both.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)


def backprop(seeds: DataFrame, edges: DataFrame, df: DataFrame, k: int) -> DataFrame:
    """Statutes that the seeds cite: distinct seeds over ln(2 + citing documents)."""
    index = edges.join(df.withColumnRenamed("node", "target"), "target").select(F.col("source").alias("key"), F.col("target").alias("node"), (1 / F.log(2 + F.col("in_degree"))).alias("factor"))
    return top(best(seeds.select("query_id", F.col("node").alias("key")), index, k), k)


# --- lookups over the graph of articles and judgments


def reverse_adjacency(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("target").alias("node")).agg(F.sort_array(F.collect_list("source")).alias("cited_by"))


def role_factor(role: Column, substantive: tuple[str, ...], boost: float = 1.5) -> Column:
    return F.when(role.isin(*substantive), boost).otherwise(1.0)


def with_roles(scored: DataFrame, roles: DataFrame, substantive: tuple[str, ...], k: int) -> DataFrame:
    """Scores times the factor of the node's role, cut anew. roles: node, role."""
    s = scored.join(roles, "node", "left").select("query_id", "node", (F.col("score") * role_factor(F.col("role"), substantive)).alias("score"))
    return top(s, k)


def through_judgments(seeds: DataFrame, members: DataFrame, most_bases: int, per_base: int) -> DataFrame:
    """Rows of the seeds' judgments: the most seeded `most_bases` of a query, `per_base` rows of each by authority.

    seeds: query_id, node; members: base, node, authority.
    """
    per = seeds.join(members.select("node", "base"), "node").groupBy("query_id", "base").agg(F.count("*").alias("n"))
    w = Window.partitionBy("query_id").orderBy(F.desc("n"), "base")
    bases = per.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most_bases).drop("r")
    rows = bases.join(members, "base").join(seeds, ["query_id", "node"], "left_anti")
    w = Window.partitionBy("query_id", "base").orderBy(F.desc("authority"), "node")
    return rows.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= per_base).select("query_id", "base", "node", "rk")


def adjacent(seeds: DataFrame, links: DataFrame, per_seed: int, most: int) -> DataFrame:
    """Neighbour rows of seeds (links: node, other, place), so many of a seed and of a query."""
    hit = seeds.join(links, "node").where(F.col("place") <= per_seed).groupBy("query_id", F.col("other").alias("node")).agg(F.min("place").alias("place"))
    hit = hit.join(seeds, ["query_id", "node"], "left_anti")
    w = Window.partitionBy("query_id").orderBy("place", "node")
    return hit.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= most).select("query_id", "node", "rk")


def co_occurring(asked: DataFrame, edges: DataFrame, authority: DataFrame, most_docs: int | None, k: int) -> DataFrame:
    """Statutes cited by the documents that cite what is asked for, by authority + ln(1 + n) / 10. All these documents count, unless
    most_docs says how many a query (the smallest names)."""
    g, coded = S.numbered(edges)
    value = g.code(authority.select("node", "authority"), b="node").select("b", F.col("authority").cast("double").alias("value"))
    own, n = S.seeded(g.code(asked.select("query_id", "node"), no="node"))
    docs = S.reach(own, n, S.lists(_back(coded)), most_docs)
    out = S.second(docs, own, n, S.lists(coded, value), k, most_docs, lambda n, authority: authority + np.log1p(n) / 10)
    return g.name(top(out, k, tie="no"), node="no").select("query_id", "node", "score", "rk")


def most_citing(articles: DataFrame, edges: DataFrame, authority: DataFrame, k: int) -> DataFrame:
    """The k judgments of most authority that cite an article; where none does, those that cite its parent. articles: node, parent."""
    cites = lambda c: articles.join(edges, F.col(c) == F.col("target")).select("node", F.col("source").alias("case"))
    own = cites("node").distinct()
    rest = cites("parent").distinct().join(own, "node", "left_anti")
    w = Window.partitionBy("node").orderBy(F.desc("authority"), "case")
    hit = own.unionByName(rest).join(authority.select(F.col("node").alias("case"), "authority"), "case", "left").withColumn("authority", F.coalesce("authority", F.lit(0.0)))
    return hit.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k).select("node", "case", "rk")


def cited_by_cases(cases: DataFrame, edges: DataFrame) -> DataFrame:
    """Articles that a case cites; where it cites none, those that its judgment's rows cite. cases: case, base."""
    own = cases.join(edges, F.col("case") == F.col("source")).select("case", F.col("target").alias("node")).distinct()
    base = edges.withColumn("base", C.court_base(F.col("source")))
    rest = cases.join(own, "case", "left_anti").join(base, "base").select("case", F.col("target").alias("node")).distinct()
    return own.unionByName(rest)


def related_cases(cases: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """Cases that share most cited articles with a case; an edge given twice counts once."""
    g, coded = S.numbered(edges)
    own, n = S.seeded(g.code(cases.select(F.col("case").alias("node")), no="node").select(F.col("no").alias("query_id"), "no"))
    out = top(S.second(S.reach(own, n, S.lists(coded)), own, n, S.lists(_back(coded)), k), k, tie="no")
    return g.name(out, other="no", case="query_id").select("case", "other", "n", "rk")


def pmi_companions(prior: DataFrame, totals: DataFrame, rows: int, k: int, least: int = 2) -> DataFrame:
    """The k companions of an item by PMI = ln(max(n_ab * rows / (n_a * n_b), 1e-10)). prior: a, b, support; totals: item, n."""
    both = prior.select("a", "b", "support").union(prior.select(F.col("b").alias("a"), F.col("a").alias("b"), "support")).where(F.col("support") >= least)
    j = both.join(totals.select(F.col("item").alias("a"), F.col("n").alias("na")), "a").join(totals.select(F.col("item").alias("b"), F.col("n").alias("nb")), "b")
    s = j.withColumn("pmi", F.log(F.greatest(F.col("support") * F.lit(float(rows)) / (F.col("na") * F.col("nb")), F.lit(1e-10))))
    w = Window.partitionBy("a").orderBy(F.desc(F.round("pmi", 6)), "b")
    return s.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k).select("a", "b", "support", "pmi", "rk")


def pool_companions(pool: DataFrame, companions_: DataFrame, k: int) -> DataFrame:
    """A pool and the first k companions of each of its nodes. pool: query_id, node; companions: a, b, rk."""
    more = pool.join(companions_.where(F.col("rk") <= k), F.col("node") == F.col("a")).select("query_id", F.col("b").alias("node"))
    return pool.select("query_id", "node").union(more).distinct()


def articles_to_cases(articles: DataFrame, edges: DataFrame, authority: DataFrame, per_article: int) -> DataFrame:
    """Cases by the sum of 1 / (60 + rank) over the articles they rank for. articles: query_id, node."""
    w = Window.partitionBy("query_id", "node").orderBy(F.desc(F.coalesce("authority", F.lit(0.0))), "case")
    hit = articles.distinct().join(edges, F.col("node") == F.col("target")).select("query_id", "node", F.col("source").alias("case")).distinct()
    hit = hit.join(authority.select(F.col("node").alias("case"), "authority"), "case", "left").withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_article)
    return hit.groupBy("query_id", F.col("case").alias("node")).agg(F.sum(1 / (60 + F.col("r"))).alias("score"))


def citing_of(targets: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges into a set of targets (target)."""
    return edges.join(targets.select("target").distinct(), "target", "left_semi").select("source", "target")


def origins_of(citations: DataFrame, nodes: DataFrame) -> DataFrame:
    """citation, law_mask, court_mask of the citations asked for. nodes: dataset, citation, origin_mask."""
    hit = nodes.join(citations.select("citation").distinct(), "citation", "left_semi")
    mask = lambda d: F.coalesce(F.bit_or(F.when(F.col("dataset") == d, F.col("origin_mask"))), F.lit(0))
    found = hit.groupBy("citation").agg(mask("law").alias("law_mask"), mask("court").alias("court_mask"))
    return citations.select("citation").distinct().join(found, "citation", "left").select("citation", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("law_mask", "court_mask")])


def reference_expansion(seeds: DataFrame, edges: DataFrame, kids: DataFrame) -> DataFrame:
    """Statutes that seed rows mention, and their paragraphs. seeds: query_id, node; kids: article, child."""
    g, coded = S.numbered(edges, kids.select("article"), kids.select("child"))
    k = g.code(kids.select("article", "child").distinct(), x="article", y="child").select("x", "y")
    more = coded.join(k, F.col("b") == F.col("x")).select("a", F.col("y").alias("b"))
    own, n = S.seeded(g.code(seeds, no="node"))
    return g.name(S.unpacked(S.reach(own, n, S.lists(coded.union(more)))), node="no").select("query_id", "node")


def same_article(rows: DataFrame, most: int = 30) -> DataFrame:
    """citation, siblings: other rows of the same article of a law, in natural order, `most` at most. rows: citation, law_code, article.

    Rows pair by (law_code, article, place), so no article's rows are collected into one value unless they are few.
    """
    w = Window.partitionBy("law_code", "article").orderBy(C.natural_key(F.regexp_extract("citation", r"Abs\. (\S+)", 1)), "citation")
    numbered = rows.withColumn("r", F.row_number().over(w))
    first = numbered.where(F.col("r") <= most + 1)
    pair = numbered.select("law_code", "article", "citation").join(first.select("law_code", "article", F.col("citation").alias("other"), "r"), ["law_code", "article"]).where("citation <> other")
    w = Window.partitionBy("citation").orderBy("r")
    cut = pair.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most)
    return cut.groupBy("citation").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "other"))), lambda x: x["other"]).alias("siblings"))


def edges_in_corpus(edges: DataFrame, corpus: DataFrame) -> DataFrame:
    """Edges with an end in the corpus, with both ends' judgments and the kind of the target. corpus: citation."""
    known = corpus.select("citation").distinct()
    side = lambda c: known.select(F.col("citation").alias(c), F.lit(True).alias(f"{c}_known"))
    j = edges.select("source", "target").distinct().join(side("source"), "source", "left").join(side("target"), "target", "left").where("source_known OR target_known")
    return j.select("source", "target", C.court_base(F.col("source")).alias("source_base"), C.court_base(F.col("target")).alias("target_base"), C.reference_family(F.col("target")).alias("target_kind"))

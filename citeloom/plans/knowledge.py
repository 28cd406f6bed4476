"""Queries over the citation graph as a store of knowledge, authority scores, builders of documents, tables of model answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import citations as C
from ..operators import authority as A
from ..operators import builders as B
from ..operators import graph as G
from ..operators import models as M
from . import fixtures as fx
from .registry import query

col = F.col
_E = f"e AS ({fx.EDGES_SQL})"
_DIV = fx.case("l_orderkey % 5", fx.DIVISIONS)
_CODE = fx.case("l_suppkey % 5", fx.CODES)
_SEEDS = f"seeds AS (SELECT DISTINCT l_suppkey AS query_id, {fx.COURT} AS node FROM lineitem WHERE l_quantity >= 49)"
_AUTH = "au AS (SELECT source AS node, CAST(count(*) AS DOUBLE) / 10 AS authority FROM e GROUP BY 1)"


def _seeds(spark, d):
    return fx.lines(spark, d).where("l_quantity >= 49").select(col("l_suppkey").alias("query_id"), col("court").alias("node")).distinct()


def _authority(spark, d):
    return fx.edges(spark, d).groupBy(col("source").alias("node")).agg((F.count("*").cast("double") / 10).alias("authority"))


def _statutes(spark, d):
    return fx.lines(spark, d).where("l_quantity >= 50").select(col("l_suppkey").alias("query_id"), col("statute").alias("node")).distinct()


_STATUTES = f"st AS (SELECT DISTINCT l_suppkey AS query_id, {fx.STATUTE} AS node FROM lineitem WHERE l_quantity >= 50)"


@query(f"SELECT target AS node, array_to_string(list_sort(list(source)), ';') AS cited_by FROM ({fx.EDGES_SQL}) e GROUP BY target")
def graph_reverse_adjacency(spark, d):
    """Who cites a node."""
    return G.reverse_adjacency(fx.edges(spark, d)).select("node", F.array_join("cited_by", ";").alias("cited_by"))


@query(
    f"""WITH {_E}, {_SEEDS}, {_AUTH}, m AS (SELECT DISTINCT {fx.BASE} AS base, {fx.COURT} AS node FROM lineitem), p AS (SELECT query_id, base, count(*) AS n FROM seeds JOIN m USING (node) GROUP BY 1, 2),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, base) AS r FROM p) x WHERE r <= 10)
SELECT query_id, base, node, CAST(rk AS INT) AS rk FROM (SELECT b.query_id, b.base, m.node, row_number() OVER (PARTITION BY b.query_id, b.base ORDER BY authority DESC, m.node) AS rk FROM b JOIN m USING (base) JOIN au ON au.node = m.node WHERE (b.query_id, m.node) NOT IN (SELECT query_id, node FROM seeds)) x WHERE rk <= 3"""
)
def graph_through_judgments(spark, d):
    """Rows of the seeds' judgments, so many judgments a query and rows a judgment."""
    m = fx.lines(spark, d).select("base", col("court").alias("node")).distinct().join(_authority(spark, d), "node")
    return G.through_judgments(_seeds(spark, d), m, 10, 3)


@query(
    f"""WITH {_E}, {_STATUTES}, ci AS (SELECT DISTINCT query_id, source AS doc FROM st JOIN e ON node = target), i AS (SELECT target AS node, CAST(count(*) AS DOUBLE) / 100 AS authority FROM e GROUP BY 1),
n AS (SELECT query_id, target AS node, count(*) AS n FROM ci JOIN e ON doc = source GROUP BY 1, 2), s AS (SELECT n.query_id, n.node, authority + ln(1 + n) / 10 AS score FROM n JOIN i USING (node) WHERE (n.query_id, n.node) NOT IN (SELECT query_id, node FROM st))
SELECT query_id, node, round(score, 4) AS score, CAST(rk AS INT) AS rk FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, node) AS rk FROM s) x WHERE rk <= 30"""
)
def statute_co_occurrence(spark, d):
    """Statutes cited along with those asked for."""
    e = fx.edges(spark, d)
    au = e.groupBy(col("target").alias("node")).agg((F.count("*").cast("double") / 100).alias("authority"))
    return G.co_occurring(_statutes(spark, d), e, au, None, 30).select("query_id", "node", F.round("score", 4).alias("score"), "rk")


_ART = f"concat('Art. ', l_partkey % 400 + 1, ' ', {_CODE})"


@query(
    f"""WITH {_E}, {_AUTH}, a AS (SELECT DISTINCT {fx.STATUTE} AS node, {_ART} AS parent FROM lineitem UNION SELECT DISTINCT concat('Art. ', l_partkey % 400 + 1, ' Abs. 99 ', {_CODE}), {fx.STATUTE} FROM lineitem WHERE l_linenumber = 1),
o AS (SELECT DISTINCT node, source AS c FROM a JOIN e ON node = target), r AS (SELECT DISTINCT node, source AS c FROM a JOIN e ON parent = target WHERE node NOT IN (SELECT node FROM o)), u AS (SELECT * FROM o UNION ALL SELECT * FROM r)
SELECT node, c AS case, CAST(rk AS INT) AS rk FROM (SELECT u.node, c, row_number() OVER (PARTITION BY u.node ORDER BY authority DESC, c) AS rk FROM u JOIN au ON au.node = c) x WHERE rk <= 5""".replace("c AS case", 'c AS "case"')
)
def citing_cases(spark, d):
    """The judgments of most authority that cite an article, else its parent."""
    x = fx.table(spark, d, "lineitem")
    a = x.selectExpr(f"{fx.STATUTE} AS node", f"{_ART} AS parent").union(x.where("l_linenumber = 1").selectExpr(f"concat('Art. ', l_partkey % 400 + 1, ' Abs. 99 ', {_CODE})", fx.STATUTE)).distinct()
    return G.most_citing(a, fx.edges(spark, d), _authority(spark, d), 5)


@query(
    f"""WITH {_E}, k AS (SELECT DISTINCT {fx.COURT} AS c, {fx.BASE} AS base FROM lineitem WHERE l_quantity >= 45 UNION SELECT DISTINCT {fx.BASE} || ' E. 99', {fx.BASE} FROM lineitem WHERE l_quantity >= 49), o AS (SELECT DISTINCT c, target AS node FROM k JOIN e ON c = source),
b AS (SELECT DISTINCT c, target AS node FROM k JOIN (SELECT regexp_extract(source, '^(.+) E\\.', 1) AS base, target FROM e) y USING (base) WHERE c NOT IN (SELECT c FROM o)) SELECT c AS "case", count(*) AS articles, min(node) AS first FROM (SELECT * FROM o UNION ALL SELECT * FROM b) z GROUP BY 1"""
)
def cited_articles(spark, d):
    """Articles that a case cites, else those of its judgment."""
    x = fx.lines(spark, d)
    k = x.where("l_quantity >= 45").select(col("court").alias("case"), "base").union(x.where("l_quantity >= 49").select(F.concat("base", F.lit(" E. 99")), "base")).distinct()
    return G.cited_by_cases(k, fx.edges(spark, d)).groupBy("case").agg(F.count("*").alias("articles"), F.min("node").alias("first"))


@query(
    f"""WITH {_E}, k AS (SELECT DISTINCT {fx.COURT} AS c FROM lineitem WHERE l_quantity >= 50), o AS (SELECT c, target FROM k JOIN e ON c = source), n AS (SELECT c, source AS other, count(*) AS n FROM o JOIN e USING (target) WHERE source <> c GROUP BY 1, 2)
SELECT c AS "case", other, n, CAST(rk AS INT) AS rk FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY n DESC, other) AS rk FROM n) x WHERE rk <= 5"""
)
def related_cases(spark, d):
    """Cases that share most cited articles."""
    k = fx.lines(spark, d).where("l_quantity >= 50").select(col("court").alias("case"))
    return G.related_cases(k, fx.edges(spark, d), 5)


_BASKET = "b AS (SELECT DISTINCT l_orderkey AS basket, l_partkey AS item FROM lineitem), p AS (SELECT x.item AS a, y.item AS b, count(*) AS support FROM b x JOIN b y ON x.basket = y.basket AND x.item < y.item GROUP BY 1, 2 HAVING count(*) >= 2), t AS (SELECT item, count(*) AS n FROM b GROUP BY 1)"


@query(
    f"""WITH {_BASKET}, w AS (SELECT a, b, support FROM p UNION ALL SELECT b, a, support FROM p), s AS (SELECT w.a, w.b, support, ln(greatest(support * (SELECT CAST(count(DISTINCT basket) AS DOUBLE) FROM b) / (x.n * y.n), 1e-10)) AS pmi FROM w JOIN t x ON x.item = w.a JOIN t y ON y.item = w.b),
c AS (SELECT a, b, support, pmi, row_number() OVER (PARTITION BY a ORDER BY round(pmi, 6) DESC, b) AS rk FROM s), q AS (SELECT DISTINCT l_suppkey AS query_id, l_partkey AS node FROM lineitem WHERE l_quantity >= 48)
SELECT query_id, node FROM q UNION SELECT query_id, b FROM q JOIN c ON a = node WHERE rk <= 3"""
)
def pool_companions(spark, d):
    """A pool with the strongest companions of its items by PMI."""
    x = fx.table(spark, d, "lineitem")
    b = x.select(col("l_orderkey").alias("basket"), col("l_partkey").alias("item")).distinct()
    c = G.pmi_companions(G.pair_prior(b), b.groupBy("item").agg(F.count("*").alias("n")), b.select("basket").distinct().count(), 3)
    return G.pool_companions(x.where("l_quantity >= 48").select(col("l_suppkey").alias("query_id"), col("l_partkey").alias("node")).distinct(), c, 3)


@query(
    f"""WITH {_E}, {_STATUTES}, {_AUTH}, h AS (SELECT DISTINCT query_id, st.node, source AS c FROM st JOIN e ON st.node = target), r AS (SELECT h.query_id, c, row_number() OVER (PARTITION BY h.query_id, h.node ORDER BY authority DESC, c) AS r FROM h JOIN au ON au.node = c)
SELECT query_id, c AS node, round(sum(1.0 / (60 + r)), 6) AS score FROM r WHERE r <= 20 GROUP BY 1, 2"""
)
def cases_of_articles(spark, d):
    """Cases by the ranks that they have for the articles asked for."""
    return G.articles_to_cases(_statutes(spark, d), fx.edges(spark, d), _authority(spark, d), 20).withColumn("score", F.round("score", 6))


@query(
    f"""WITH r AS (SELECT DISTINCT {fx.STATUTE} AS citation, {_CODE} AS code, l_partkey % 400 + 1 AS art, l_linenumber AS par FROM lineitem), p AS (SELECT a.citation, b.citation AS other, row_number() OVER (PARTITION BY a.citation ORDER BY b.par, b.citation) AS k FROM r a JOIN r b ON a.code = b.code AND a.art = b.art AND a.citation <> b.citation)
SELECT citation, string_agg(other, ';' ORDER BY k) AS siblings FROM p WHERE k <= 4 GROUP BY 1"""
)
def same_article_rows(spark, d):
    """Other paragraphs of a paragraph's article, in natural order."""
    r = fx.lines(spark, d).select(col("statute").alias("citation")).distinct().select("citation", C.pick(col("citation"), r"(\S+)$").alias("law_code"), C.pick(col("citation"), r"Art\. (\d+)").alias("article"))
    return G.same_article(r, 4).select("citation", F.array_join("siblings", ";").alias("siblings"))


@query(
    f"""WITH {_E}, k AS (SELECT DISTINCT {fx.STATUTE} AS c FROM lineitem WHERE l_quantity >= 49 UNION SELECT DISTINCT {fx.COURT} FROM lineitem WHERE l_quantity >= 49) SELECT source, target, regexp_extract(source, '^(.+) E\\.', 1) AS source_base, target AS target_base, 'statute' AS target_kind FROM e WHERE source IN (SELECT c FROM k) OR target IN (SELECT c FROM k)"""
)
def corpus_edges(spark, d):
    """Edges with an end in a part of the corpus, with judgments and kinds."""
    x = fx.lines(spark, d).where("l_quantity >= 49")
    return G.edges_in_corpus(fx.edges(spark, d), x.select(col("statute").alias("citation")).union(x.select("court")))


@query(f"WITH {_E}, n AS (SELECT source AS c, 1 AS court, 0 AS law FROM e UNION SELECT target, 0, 2 FROM e), k AS (SELECT DISTINCT {fx.STATUTE} AS c FROM lineitem WHERE l_quantity >= 49 UNION SELECT 'Art. 0 XX') SELECT k.c AS citation, CAST(coalesce(max(law), 0) AS INT) AS law_mask, CAST(coalesce(max(court), 0) AS INT) AS court_mask FROM k LEFT JOIN n USING (c) GROUP BY 1")
def origin_masks(spark, d):
    """In which corpora a citation stands."""
    e = fx.edges(spark, d)
    nodes = e.select(F.lit("court").alias("dataset"), col("source").alias("citation"), F.lit(1).alias("origin_mask")).union(e.select(F.lit("law"), "target", F.lit(2))).distinct()
    asked = fx.lines(spark, d).where("l_quantity >= 49").select(col("statute").alias("citation")).union(spark.createDataFrame([("Art. 0 XX",)], "citation string"))
    return G.origins_of(asked, nodes)


@query(
    f"""WITH {_E}, {_SEEDS}, k AS (SELECT DISTINCT {_ART} AS article, {fx.STATUTE} AS child FROM lineitem), s AS (SELECT DISTINCT query_id, target AS node FROM seeds JOIN e ON node = source) SELECT query_id, node FROM s UNION SELECT query_id, child FROM s JOIN k ON node = article"""
)
def reference_expansion(spark, d):
    """Statutes that the seeds mention, with their paragraphs."""
    kids = fx.table(spark, d, "lineitem").selectExpr(f"{_ART} AS article", f"{fx.STATUTE} AS child").distinct()
    return G.reference_expansion(_seeds(spark, d), fx.edges(spark, d), kids)


@query(
    f"""WITH {_E}, {_SEEDS}, i AS (SELECT target AS node, count(*) AS n FROM e GROUP BY 1), h AS (SELECT query_id, target AS node, count(*) AS n FROM seeds JOIN e ON node = source GROUP BY 1, 2), f AS (SELECT h.query_id, h.node, h.n * sqrt(1 + ln(1 + i.n)) AS score FROM h JOIN i USING (node)),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, node) AS r FROM f) x WHERE r <= 200), s AS (SELECT query_id, node, score * CASE WHEN node LIKE '%StPO' THEN 1.5 ELSE 1 END AS score FROM c)
SELECT query_id, node, round(score, 4) AS score, CAST(rk AS INT) AS rk FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, node) AS rk FROM s) x WHERE rk <= 20"""
)
def graph_forward_roles(spark, d):
    """Cited statutes with a factor for substantive roles."""
    e = fx.edges(spark, d)
    f = G.forward(_seeds(spark, d), e, G.in_degree(e).select("node", col("in_degree").alias("importance")), 200)
    roles = e.select(col("target").alias("node")).distinct().withColumn("role", F.when(col("node").endswith("StPO"), "procedure").otherwise("other"))
    return G.with_roles(f, roles, ("procedure",), 20).select("query_id", "node", F.round("score", 4).alias("score"), "rk")


# --- authority, profiles


@query(
    """SELECT o_orderkey, round(least(1.0, CASE o_orderstatus WHEN 'O' THEN 0.8 WHEN 'F' THEN 0.6 ELSE 0.4 END + least(o_custkey, 200) / 200 * 0.1 + greatest(0.0, least(1.0, 1 - (2024 - year(o_orderdate)) / 30)) * 0.03 + 0.5 * 0.02), 4) AS case_score,
 round(greatest(0.05, 1 + CASE WHEN o_orderstatus = 'O' THEN 0.5 ELSE 0 END + CASE WHEN o_custkey % 3 = 0 THEN 0.25 ELSE 0 END - CASE WHEN o_orderpriority = '5-LOW' THEN 0.6 ELSE 0 END + least(ln(1 + o_custkey) / 7, 0.8)), 4) AS court_score,
 round(1 + 0.1 * (CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END + CASE WHEN o_custkey % 3 = 0 THEN 1 ELSE 0 END) + CASE WHEN o_custkey % 2 = 0 THEN 0.2 ELSE 0 END + CASE WHEN o_custkey % 5 = 0 THEN 0.1 ELSE 0 END + ln(1 + o_custkey % 9) / 20 + ln(1 + o_custkey) / 10 + 0.3 * 0.5, 4) AS law_score,
 CASE WHEN o_custkey % 100 < 10 THEN 'below_min_chars' WHEN o_orderpriority NOT IN ('1-URGENT', '5-LOW') THEN 'filtered_priority' WHEN o_orderstatus = 'O' AND o_custkey % 3 <> 0 THEN 'filtered_role' END AS rejected,
 CASE WHEN o_custkey >= 800 THEN 3 ELSE 0 END + CASE WHEN o_orderstatus = 'O' THEN 2 ELSE 0 END + CASE WHEN o_custkey % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN o_custkey % 50 >= 10 THEN 2 ELSE 0 END - CASE WHEN o_orderpriority = '5-LOW' THEN 5 ELSE 0 END - CASE WHEN o_custkey < 80 THEN 3 ELSE 0 END AS priority FROM orders"""
)
def authority_scores(spark, d):
    """Authority of cases, court rows and laws, what cards are rejected for, and which a model reads first."""
    o = fx.table(spark, d, "orders")
    kind = F.when(col("o_orderstatus") == "O", "leading").when(col("o_orderstatus") == "F", "federal").otherwise("x")
    roles = F.array_compact(F.array(F.when(col("o_orderstatus") == "O", "published_leading_case"), F.when(col("o_custkey") % 3 == 0, "detailed_reasoning")))
    half = F.lit(0.5)
    return o.select(
        "o_orderkey", A.case_authority(kind, col("o_custkey"), F.year("o_orderdate"), half, 2024).alias("case_score"), F.round(A.court_authority(roles, col("o_orderpriority") == "5-LOW", col("o_custkey")), 4).alias("court_score"),
        F.round(A.law_authority(roles, col("o_custkey") % 2 == 0, col("o_custkey") % 5 == 0, col("o_custkey") % 9, col("o_custkey"), half), 4).alias("law_score"),
        A.rejection(col("o_custkey") % 100, col("o_orderpriority"), roles, 10, ("1-URGENT", "5-LOW"), ("published_leading_case",)).alias("rejected"),
        A.card_priority(col("o_custkey"), F.when(col("o_orderstatus") == "O", "weak").otherwise("strong"), F.when(col("o_custkey") % 2 == 0, 1).otherwise(0), col("o_custkey") % 50, col("o_orderpriority") == "5-LOW")["score"].alias("priority"),
    )


@query("SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS total, min(n_chars) AS least, quantile_cont(n_chars, 0.25) AS p25, quantile_cont(n_chars, 0.5) AS p50, quantile_cont(n_chars, 0.9) AS p90, max(n_chars) AS most FROM documents GROUP BY lang")
def corpus_profile(spark, d):
    """Sizes of documents by language with exact percentiles."""
    return A.profile(fx.table(spark, d, "documents"), "lang", "n_chars")


@query("SELECT 'lang' AS dimension, lang AS value, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY 2")
def corpus_figures(spark, d):
    """Documents by language and by source, in one pass."""
    return A.corpus_figures(fx.table(spark, d, "documents"), ["lang", "source"])


@query("SELECT l_returnflag, count(*) AS n, round(avg(CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0 END), 6) AS cheap, round(avg(CASE WHEN l_quantity >= 25 THEN 1.0 ELSE 0 END), 6) AS large FROM lineitem GROUP BY 1")
def coverage_by_group(spark, d):
    """Shares of rows that meet conditions, by group."""
    c = A.coverage(fx.table(spark, d, "lineitem"), "l_returnflag", {"cheap": col("l_discount") > 0.05, "large": col("l_quantity") >= 25})
    return c.select("l_returnflag", "n", F.round("cheap", 6).alias("cheap"), F.round("large", 6).alias("large"))


# --- builders


@query(
    f"""WITH l AS (SELECT {_CODE} AS law_code, concat('Title ', l_partkey % 4, ' - part ', l_linenumber) AS title, l_orderkey * 10 + l_linenumber AS row_no FROM lineitem), n AS (SELECT law_code, 'Title ' || regexp_extract(title, 'Title (\\d+)', 1) AS title, count(*) AS n, min(row_no) AS f FROM l GROUP BY 1, 2)
SELECT law_code, title FROM (SELECT *, row_number() OVER (PARTITION BY law_code ORDER BY n DESC, f) AS r FROM n) x WHERE r = 1"""
)
def code_titles(spark, d):
    """The most frequent title of a law code."""
    laws = fx.table(spark, d, "lineitem").selectExpr(f"{_CODE} AS law_code", "concat('Title ', l_partkey % 4, ' - part ', l_linenumber) AS title", "l_orderkey * 10 + l_linenumber AS row_no")
    return B.titles_of_codes(laws)


@query(f"WITH r AS (SELECT DISTINCT {fx.COURT} AS citation, {fx.BASE} AS base, {_DIV} AS division FROM lineitem) SELECT base, min(division) AS division, count(*) AS rows FROM r GROUP BY 1")
def court_decisions(spark, d):
    """Judgments with their parts and row counts."""
    r = fx.table(spark, d, "lineitem").selectExpr(f"{fx.COURT} AS citation", f"{_DIV} AS division", "CAST(NULL AS STRING) AS docket", "CAST(NULL AS INT) AS year").distinct()
    return B.decisions(r).select("base", "division", "rows")


_CARDS = f"r AS (SELECT DISTINCT {fx.COURT} AS citation, {_CODE} AS law_code, {_DIV} AS division, CAST(2000 + l_linenumber AS VARCHAR) AS year FROM lineitem), o AS (SELECT citation, 'law_code' AS kind, law_code AS value FROM r UNION ALL SELECT citation, 'division', division FROM r UNION ALL SELECT citation, 'year', year FROM r)"


@query(
    f"""WITH {_CARDS}, n AS (SELECT kind, value, count(*) AS n FROM o GROUP BY 1, 2), x AS (SELECT kind, value, citation, row_number() OVER (PARTITION BY kind, value ORDER BY citation) AS r FROM (SELECT DISTINCT kind, value, citation FROM o) z)
SELECT n.kind, n.value, n, CASE WHEN n.kind = 'law_code' AND n.value = 'BV' THEN 'Verfassung' END AS title, string_agg(citation, ';' ORDER BY r) AS examples FROM n JOIN x USING (kind, value) WHERE r <= 3 GROUP BY 1, 2, 3"""
)
def choice_cards(spark, d):
    """Options to choose from, with counts, titles and examples."""
    r = fx.table(spark, d, "lineitem").selectExpr(f"{fx.COURT} AS citation", f"{_CODE} AS law_code", f"{_DIV} AS division", "2000 + l_linenumber AS year").distinct()
    return B.choice_cards(r, spark.createDataFrame([("BV", "Verfassung")], "law_code string, title string"), 3)


@query(
    f"""WITH r AS (SELECT DISTINCT {fx.COURT} AS citation, {_CODE} AS law_code, CAST(l_linenumber AS VARCHAR) AS pinpoint, {fx.BASE} AS base FROM lineitem) SELECT citation, 'law_code' AS segment, law_code AS value, 'semantic' AS selector FROM r UNION SELECT citation, 'pinpoint', pinpoint, 'structural' FROM r UNION SELECT citation, 'base', base, 'explicit_only' FROM r"""
)
def segment_options(spark, d):
    """Parts of citations and how they may be chosen by."""
    r = fx.table(spark, d, "lineitem").selectExpr(f"{fx.COURT} AS citation", f"{_CODE} AS law_code", "l_linenumber AS pinpoint", f"{fx.BASE} AS base").distinct()
    return B.segment_options(r, ["law_code", "pinpoint", "base"]).distinct()


@query(
    rf"""WITH o AS (SELECT DISTINCT doc_id, 'lang' AS segment, lang AS value FROM documents WHERE lang IS NOT NULL), w AS (SELECT DISTINCT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}]+'), lambda w: length(w) >= 4)) AS signal FROM documents), c AS (SELECT DISTINCT doc_id, source AS signal FROM documents),
t AS (SELECT segment, value, count(*) AS docs FROM o GROUP BY 1, 2), n AS (SELECT segment, value, 'keyword' AS kind, signal, count(*) AS n FROM o JOIN w USING (doc_id) GROUP BY 1, 2, 4 UNION ALL SELECT segment, value, 'law_code', signal, count(*) FROM o JOIN c USING (doc_id) GROUP BY 1, 2, 4),
s AS (SELECT *, row_number() OVER (PARTITION BY segment, value, kind ORDER BY n DESC, signal) AS rk FROM n JOIN t USING (segment, value) WHERE n >= 5 AND (kind = 'law_code' OR n >= docs / 200)) SELECT segment, value, kind, signal, n, round(n / docs, 4) AS share, CAST(rk AS INT) AS rk FROM s WHERE rk <= 8"""
)
def co_signals(spark, d):
    """What goes with an option: the most frequent codes and words of its documents."""
    t = fx.table(spark, d, "documents")
    words = t.select("doc_id", F.explode(F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: F.length(w) >= 4)).alias("signal"))
    return B.co_signals(t.where("lang IS NOT NULL").select("doc_id", F.lit("lang").alias("segment"), col("lang").alias("value")), t.select("doc_id", col("source").alias("signal")), words)


_COURTS = f"r AS (SELECT l_orderkey * 10 + l_linenumber AS line, {fx.COURT} AS citation, concat('  Text of  ', {fx.COURT}) AS text, {fx.STATUTE} AS statute, l_linenumber AS p, {_DIV} AS division FROM lineitem)"


@query(
    f"""WITH {_COURTS} SELECT 'court:' || substr(sha1(concat_ws('|', 'court', line, citation, 'Text of ' || citation)), 1, 24) AS doc_id, citation, citation || ' ' || citation AS view, 'Statutes: ' || statute AS statutes, citation || ' | topic | a, b | Text of ' || citation AS vector, regexp_extract(citation, '^(.+) E\\.', 1) AS base, 1 AS links,
round(1 + 0.25 + ln(1 + p) / 7, 6) AS authority FROM r"""
)
def court_documents(spark, d):
    """Nested documents of court rows: views, filters, links, ranking."""
    r = fx.table(spark, d, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber AS line", f"{fx.COURT} AS citation", f"concat('  Text of  ', {fx.COURT}) AS text", "array('detailed_reasoning') AS roles", "false AS low_value", "'topic' AS topic", "array('a', 'b') AS concepts", f"array({fx.STATUTE}) AS statutes", "CAST(array() AS array<string>) AS cases", "l_linenumber AS cited", f"{_DIV} AS division", "2000 AS year")
    b = B.court_documents(r)
    return b.select("doc_id", "citation", col("retrieval.citation").alias("view"), col("retrieval.statutes").alias("statutes"), col("retrieval.vector_text").alias("vector"), col("filters.court_base").alias("base"), F.size("expansion.statute_links").alias("links"), col("ranking.authority").alias("authority"))


@query(
    f"""WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS line, {fx.STATUTE} AS citation, {_ART} AS parent, {_CODE} AS code, l_partkey % 400 + 1 AS art, l_linenumber AS p FROM lineitem)
SELECT 'law:' || substr(sha1(concat_ws('|', 'law', line, citation, 'Wortlaut')), 1, 24) AS doc_id, citation, 'Title: Gesetz' AS title, citation || ' | Gesetz | Wortlaut' AS vector, code AS law_code, CAST(art AS VARCHAR) AS article, FALSE AS article_level, parent, CASE WHEN p = 1 THEN 1 ELSE 2 END AS adjacent, round(1 + 0.1 + 0.2 + ln(1 + p) / 20 + ln(2) / 10 + 0.3 * 0.5, 6) AS authority FROM r"""
)
def law_documents(spark, d):
    """Nested documents of statute rows."""
    r = fx.table(spark, d, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber AS line", f"{fx.STATUTE} AS citation", "'Gesetz' AS title", "'Wortlaut' AS text", "array('x') AS roles", "'rule' AS rule", "'' AS summary", "l_linenumber AS out_degree", "1 AS cited", "CAST(0.5 AS DOUBLE) AS specificity", "CASE WHEN l_linenumber > 1 THEN 'p' END AS prev", "'n' AS next")
    b = B.law_documents(r)
    return b.select("doc_id", "citation", col("retrieval.title").alias("title"), col("retrieval.vector_text").alias("vector"), "filters.law_code", "filters.article", "filters.article_level", col("expansion.parent").alias("parent"), F.size("expansion.adjacent_law_links").alias("adjacent"), col("ranking.authority").alias("authority"))


@query(
    f"""WITH {_E}, r AS (SELECT DISTINCT {fx.COURT} AS citation, {fx.BASE} AS base FROM lineitem), b AS (SELECT target AS source, source AS target FROM e UNION ALL SELECT source, target FROM e), n AS (SELECT target AS citation, count(*) AS cited FROM b GROUP BY 1), pb AS (SELECT regexp_extract(target, '^(.+) E\\.', 1) AS base, count(*) AS base_cited FROM b WHERE target LIKE 'BGE%' GROUP BY 1), o AS (SELECT source AS citation, count(*) AS refs FROM b GROUP BY 1)
SELECT citation, base, 'leading' AS kind, coalesce(cited, 0) AS cited, coalesce(base_cited, 0) AS base_cited, coalesce(refs, 0) AS refs, 7 AS considerations FROM r LEFT JOIN n USING (citation) LEFT JOIN pb USING (base) LEFT JOIN o USING (citation)"""
)
def authority_cards(spark, d):
    """How often a court row and its judgment are cited, and what it cites."""
    e = fx.edges(spark, d)
    rows = fx.lines(spark, d).select(col("court").alias("citation")).distinct().withColumn("considerations", F.lit(7))
    return B.authority_cards(rows, e.union(e.select("target", "source")))


@query(
    """WITH s AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'own' ELSE '' END AS topic, CASE WHEN c_custkey % 7 = 0 THEN 'costs' ELSE 'holding' END AS role FROM customer), l AS (SELECT o_custkey AS k, arg_max('said ' || o_orderkey, o_orderkey) AS topic, arg_max('rule ' || o_orderkey, o_orderkey) AS rule FROM orders GROUP BY 1)
SELECT s.k, role, coalesce(nullif(s.topic, ''), l.topic) AS topic, CASE WHEN role = 'costs' THEN '' ELSE l.rule END AS rule FROM s LEFT JOIN l USING (k)"""
)
def merged_records(spark, d):
    """Static rows with a model's last record; rules of quiet rows stay empty."""
    s = fx.table(spark, d, "customer").selectExpr("c_custkey AS k", "CASE WHEN c_custkey % 3 = 0 THEN 'own' ELSE '' END AS topic", "CASE WHEN c_custkey % 7 = 0 THEN 'costs' ELSE 'holding' END AS role")
    said = fx.table(spark, d, "orders").selectExpr("o_custkey AS k", "o_orderkey AS seq", "concat('said ', o_orderkey) AS topic", "concat('rule ', o_orderkey) AS rule")
    return B.merged(s, said, "k", ("rule",)).select("k", "role", "topic", "rule")


# --- tables of model answers


@query(
    f"""WITH c AS (SELECT query_id, doc_id, score, rk FROM ({fx.FUSED_SQL}) f WHERE rk <= 60), p AS (SELECT DISTINCT l_suppkey AS query_id, l_partkey AS doc_id, CAST(max(l_tax) OVER (PARTITION BY l_suppkey, l_partkey) AS DOUBLE) * 10 AS p FROM lineitem WHERE l_quantity >= 10),
h AS (SELECT *, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 0 END AS s FROM c WHERE rk <= 20 WINDOW w AS (PARTITION BY query_id)), b AS (SELECT h.query_id, h.doc_id, 0.7 * s + 0.3 * coalesce(p, 0) AS score FROM h LEFT JOIN p USING (query_id, doc_id)),
r AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rk FROM b UNION ALL SELECT query_id, doc_id, NULL, rk FROM c WHERE rk > 20) SELECT query_id, doc_id, round(score, 6) AS score, CAST(rk AS INT) AS rk FROM r"""
)
def model_rerank(spark, d):
    """The head of a ranking blended with a model's scores, the tail as it was."""
    from ..operators import fusion as U

    c = U.rrf(fx.channels(spark, d)).where("rk <= 60").select("query_id", "doc_id", "score", "rk")
    p = fx.table(spark, d, "lineitem").where("l_quantity >= 10").groupBy(col("l_suppkey").alias("query_id"), col("l_partkey").alias("doc_id")).agg((F.max("l_tax").cast("double") * 10).alias("p"))
    return M.reranked(c, p, 20).withColumn("score", F.round("score", 6))


@query(
    """WITH w AS (SELECT DISTINCT l_suppkey AS q, l_partkey AS k FROM lineitem WHERE l_quantity >= 45), c AS (SELECT l_suppkey AS q, l_partkey AS k, arg_max(CASE WHEN l_linenumber % 2 = 0 THEN 'NO' ELSE 'YES' END, l_orderkey * 10 + l_linenumber) AS verdict FROM lineitem WHERE l_quantity < 20 GROUP BY 1, 2)
SELECT q, k, verdict, 'kept' AS state FROM c UNION ALL SELECT q, k, 'YES', 'asked' FROM w WHERE (q, k) NOT IN (SELECT q, k FROM c)"""
)
def resumed_verdicts(spark, d):
    """A table of a judge's answers, and those asked for that it lacks."""
    x = fx.table(spark, d, "lineitem")
    raw = F.when(col("l_linenumber") % 2 == 0, "<think>maybe YES</think> No.").otherwise("yes, it is")
    cache = x.where("l_quantity < 20").select(col("l_suppkey").alias("query_id"), col("l_partkey").alias("doc_id"), raw.alias("raw"), (col("l_orderkey") * 10 + col("l_linenumber")).alias("seq"))
    kept = M.latest(cache, ["query_id", "doc_id"], "seq").withColumn("state", F.lit("kept"))
    wanted = x.where("l_quantity >= 45").select(col("l_suppkey").alias("query_id"), col("l_partkey").alias("doc_id"))
    asked = M.resumed(wanted, kept, ["query_id", "doc_id"], lambda m: m.withColumn("raw", F.lit("unreadable")).withColumn("state", F.lit("asked")))
    v = M.verdicts(asked).join(asked.select("query_id", "doc_id", "state"), ["query_id", "doc_id"])
    return v.select(col("query_id").alias("q"), col("doc_id").alias("k"), "verdict", "state")


@query(
    """SELECT doc_id, CASE WHEN source LIKE '%1' THEN 'costs' WHEN length(text) < 80 THEN 'short' WHEN quality = 1 THEN 'known' END AS topic, CASE WHEN source LIKE '%1' OR length(text) < 80 THEN 'stub' WHEN quality = 1 THEN 'model' ELSE 'pending' END AS state FROM documents LEFT JOIN labels USING (doc_id)"""
)
def enrichment_states(spark, d):
    """Rows that need no model, rows with a record, rows still to be asked."""
    rows = fx.table(spark, d, "documents").select("doc_id", "text", F.when(col("source").endswith("1"), "costs").alias("role"))
    rec = fx.table(spark, d, "labels").where("quality = 1").select("doc_id", F.struct(F.lit("known").alias("topic")).alias("record"))
    return M.enriched(rows, rec, "doc_id").select("doc_id", "topic", "state")

"""All queries of the engine, each with its SQL counterpart where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import citations as C
from ..functions import parsers as P
from ..functions import text as T
from ..operators import evaluate as E
from ..operators import fusion as U
from ..operators import granularity as R
from ..operators import graph as G
from ..operators import lattice as L
from ..operators import lexical as X
from ..operators import vector as V
from ..sources.tables import settled
from ..streaming import events as S
from . import fixtures as fx
from . import channels, enrichment, forms, knowledge, selection  # noqa: F401
from .registry import QUERIES as _QUERIES
from .registry import SQL as _SQL
from .registry import Query, query

def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


col = F.col
_CASES = f"SELECT DISTINCT {fx.STATUTE} AS statute, {fx.COURT} AS court, {fx.DATED} AS dated, {fx.DOCKET} AS docket FROM lineitem"
_TOK = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda w: length(w) >= 2 OR regexp_matches(w, '^[0-9]+$'))"


# --- citation scalars


@query(
    rf"""SELECT statute, regexp_extract(statute, 'Art\. (\d+)', 1) || ' ' || regexp_extract(statute, '([A-Z]+[A-Za-z]*[A-Z]|[A-Z]{{2,}})$', 1) AS anchor,
  'Art. ' || regexp_extract(statute, '^Art\. (\d+)', 1) || ' ' || regexp_extract(statute, '(\S+)$', 1) AS article, 'law' AS family, regexp_extract(statute, '(\S+)$', 1) AS code,
  CASE WHEN regexp_matches(regexp_extract(statute, '(\S+)$', 1), '^[A-Z]{{2,}}$') THEN 'uppercase_abbreviation' ELSE 'mixedcase_abbreviation' END AS kind, FALSE AS article_level
FROM (SELECT DISTINCT statute FROM ({_CASES}) c) d"""
)
def citation_statutes(spark, d):
    """Canonical anchors, article forms, families, codes of statute citations."""
    s, code = fx.lines(spark, d).select("statute").distinct(), C.law_code(C.pick(col("statute"), r"(\S+)$"))
    return s.select("statute", C.statute_anchor(col("statute")).alias("anchor"), C.collapse_to_article(col("statute")).alias("article"), C.classify(col("statute")).alias("family"), code.alias("code"), C.law_code_kind(code).alias("kind"), C.is_article_level(col("statute")).alias("article_level"))


@query(
    rf"""SELECT court, regexp_extract(court, '^(.+?)\s+E\.', 1) AS base, regexp_extract(court, 'E\. (\S+)$', 1) AS pinpoint, regexp_extract(court, 'BGE \d+ ([IVX]+)', 1) AS chamber,
  replace(court, 'BGE', 'ATF') || '|' || replace(replace(court, 'BGE', 'DTF'), ' E. ', ' consid. ') AS two_aliases, lower(regexp_replace(replace(court, '.', ''), '[^A-Za-z0-9]+', '-', 'g')) AS slug
FROM (SELECT DISTINCT court FROM ({_CASES}) c) d"""
)
def citation_courts(spark, d):
    """Judgment keys, pinpoints, divisions, aliases and slugs of reporter citations."""
    c = fx.lines(spark, d).select("court").distinct()
    a = C.aliases(col("court"))
    return c.select("court", C.court_base(col("court")).alias("base"), C.split_court(col("court"))["pinpoint"].alias("pinpoint"), C.chamber(col("court")).alias("chamber"), F.concat_ws("|", a[2], a[5]).alias("two_aliases"), C.slug(F.regexp_replace("court", r"\.", "")).alias("slug"))


@query(
    f"""SELECT dated, docket || ' E. 2.' || regexp_extract(dated, '2\\.(\\d+)-', 1) || '-2.' || regexp_extract(dated, '-2\\.(\\d+)$', 1) AS undated, 'federal_tribunal_modern_docket' AS kind, 6 AS members,
  regexp_extract(dated, '^(.*)E\\.', 1) || 'E. 2.' || regexp_extract(dated, '2\\.(\\d+)-', 1) AS first_member, docket || ' E. 2.' || regexp_extract(dated, '-2\\.(\\d+)$', 1) AS last_member
FROM (SELECT DISTINCT dated, docket FROM ({_CASES}) c) d"""
)
def citation_ranges(spark, d):
    """Date-stripped forms and members of consideration ranges."""
    c = fx.lines(spark, d).select("dated").distinct()
    r = C.expand_range(col("dated"))
    return c.select("dated", C.strip_date(col("dated")).alias("undated"), C.docket_kind(col("dated")).alias("kind"), F.size(r).alias("members"), F.try_element_at(r, F.lit(1)).alias("first_member"), F.try_element_at(r, F.lit(-1)).alias("last_member"))


@query(
    f"""SELECT l_orderkey, array_to_string(list_sort(list_distinct(list({fx.STATUTE}))), ';') AS statutes, array_to_string(list_sort(list_distinct(list({fx.BASE} || ' E. ' || l_linenumber))), ';') AS courts FROM lineitem GROUP BY l_orderkey"""
)
def citation_extraction(spark, d):
    """Statutes and reporter citations parsed back out of one text an order."""
    text = fx.lines(spark, d).groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(", ", "statute", "court"))), "; gemäss ").alias("text"))
    join = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ";")
    return text.select("l_orderkey", join(P.statute_articles("text")).alias("statutes"), join(P.reporter_citations("text")).alias("courts"))


@query(
    f"""SELECT DISTINCT docket || ' 05.03.2019 E. 4' AS parsed, docket || ' E. 7' AS own FROM ({_CASES}) c"""
)
def citation_dockets(spark, d):
    """Dockets with worded dates, and references back into the own judgment."""
    c = fx.lines(spark, d).select("docket").distinct()
    t = F.concat(F.lit("Urteil "), col("docket"), F.lit(" vom 5. März 2019 E. 4"))
    own = P.own_references(F.concat(F.lit("vgl. oben E. 7; "), t), col("docket"))
    return c.select(P.case_citations(t)[0].alias("parsed"), own[0].alias("own")).distinct()


@query(
    f"""SELECT l_suppkey, list_sort(list_distinct(list('Art. ' || (l_partkey % 400 + 1) || ' ' || {fx.case('l_suppkey % 5', fx.CODES)})))[1] AS first_statute, CAST(count(DISTINCT {fx.BASE}) AS INT) AS cases FROM lineitem GROUP BY l_suppkey"""
)
def query_anchors(spark, d):
    """Anchors of one free-text query a supplier."""
    q = fx.lines(spark, d).groupBy("l_suppkey").agg(F.array_join(F.collect_set(F.concat_ws(" und ", "statute", "base")), ", ").alias("q"))
    a = q.select("l_suppkey", C.anchors(col("q")).alias("a"))
    return a.select("l_suppkey", F.try_element_at("a.statutes", F.lit(1)).alias("first_statute"), F.size("a.cases").alias("cases"))


# --- text scalars

_CUE = {x: " + ".join(f"len(list_filter(w, lambda x: x = '{c}'))" for c in T.CUES[x]) for x in ("de", "fr", "it", "en", "es")}


@query(
    rf"""SELECT doc_id, CASE WHEN greatest(de, fr, en, es) = 0 THEN 'unknown' WHEN de = greatest(de, fr, en, es) THEN 'de' WHEN fr = greatest(de, fr, en, es) THEN 'fr' WHEN en = greatest(de, fr, en, es) THEN 'en' ELSE 'es' END AS cue_lang
FROM (SELECT doc_id, {_CUE["de"]} AS de, {_CUE["fr"]} AS fr, {_CUE["en"]} AS en, {_CUE["es"]} AS es FROM (SELECT doc_id, regexp_split_to_array(lower(text), '[^\p{{L}}]+') AS w FROM documents) t) u"""
)
def cue_language(spark, d):
    """Language by cue words, ties in a fixed order."""
    return fx.table(spark, d, "documents").select("doc_id", T.language(col("text"), ("de", "fr", "en", "es")).alias("cue_lang"))


@query(
    r"""SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS clean, 'doc:' || substr(sha1(concat_ws('|', 'doc', doc_id, lang, substr(text, 1, 200))), 1, 24) AS key, greatest(-10, least(20, 3 * len(regexp_extract_all(text, 'License')) - len(regexp_extract_all(text, '[!?]')))) AS density,
 CASE WHEN text LIKE '%License%' THEN 'notice' WHEN length(text) < 200 THEN 'short' ELSE 'body' END AS role FROM documents"""
)
def text_scalars(spark, d):
    """Cleaning, content keys, weighted pattern density and ordered roles."""
    t = fx.table(spark, d, "documents")
    role = T.first_of([(col("text").contains("License"), "notice"), (F.length("text") < 200, "short")], "body")
    return t.select("doc_id", T.clean(col("text")).alias("clean"), T.document_key(F.lit("doc"), col("doc_id"), col("lang"), col("text")).alias("key"), T.density(col("text"), {"License": 3, "[!?]": -1}).alias("density"), role.alias("role"))


@query()
def text_passages(spark, d):
    """Sentences packed into passages."""
    t = fx.table(spark, d, "documents").select("doc_id", F.posexplode(T.passages(col("text"))).alias("passage", "text"))
    return t.select("doc_id", "passage", F.length("text").alias("chars"), F.md5("text").alias("digest"))


@query(f"SELECT word, count(*) AS n FROM (SELECT unnest({_TOK}) AS word FROM documents) t GROUP BY word HAVING count(*) >= 5")
def token_counts(spark, d):
    """Word counts of the corpus."""
    return fx.table(spark, d, "documents").select(F.explode(T.tokens(col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where("n >= 5")


_STEM = """WITH RECURSIVE w AS ({words}), s(word, n, stem) AS (SELECT word, n, word FROM w UNION ALL SELECT word, n, CASE WHEN regexp_matches(stem, '^.{{4,}}(en|es|em|er)$') THEN left(stem, length(stem) - 2) ELSE left(stem, length(stem) - 1) END FROM s WHERE regexp_matches(stem, '^.{{4,}}(en|es|em|er)$') OR (NOT regexp_matches(stem, '(en|es|em|er)$') AND regexp_matches(stem, '^.{{4,}}(e|n|s)$')))
SELECT stem, sum(n) AS n, count(*) AS words FROM (SELECT word, arg_min(n, length(stem)) AS n, arg_min(stem, length(stem)) AS stem FROM s GROUP BY word) x GROUP BY stem"""


@query(_STEM.format(words=f"SELECT strip_accents(word) AS word, sum(n) AS n, count(*) AS k FROM ({_SQL['token_counts']}) t GROUP BY 1").replace("count(*) AS words FROM (SELECT word, arg_min(n, length(stem)) AS n,", "sum(k) AS words FROM (SELECT word, any_value(k) AS k, arg_min(n, length(stem)) AS n,").replace("s(word, n, stem) AS (SELECT word, n, word FROM w UNION ALL SELECT word, n, CASE", "s(word, n, k, stem) AS (SELECT word, n, k, word FROM w UNION ALL SELECT word, n, k, CASE"))
def stemmed_words(spark, d):
    """Words by stem: distinct words are stemmed, not all."""
    w = token_counts(spark, d)
    return w.withColumn("stem", P.stem(P.unicode_fold("word"))).groupBy("stem").agg(F.sum("n").alias("n"), F.count("*").alias("words"))


# --- graph

_NODES = f"SELECT citation, bit_or(m) AS origin_mask FROM (SELECT source AS citation, 1 AS m FROM ({fx.EDGES_SQL}) e UNION ALL SELECT target, 2 FROM ({fx.EDGES_SQL}) e) n GROUP BY citation"


def _nodes(spark, d):
    e = fx.edges(spark, d)
    rows = e.select(col("source").alias("citation"), F.lit(1).alias("origin_mask")).unionByName(e.select(col("target").alias("citation"), F.lit(2).alias("origin_mask"))).withColumn("seq", F.lit(0))
    return G.merge_nodes(rows, ["citation"], "seq")


@query(f"SELECT count(*) FILTER (WHERE origin_mask & 1 <> 0) AS own, count(*) FILTER (WHERE origin_mask & 2 <> 0) AS referenced, count(*) AS nodes, (SELECT count(*) FROM ({fx.EDGES_SQL}) e) AS edges FROM ({_NODES}) n")
def graph_counts(spark, d):
    """Nodes by origin, and edges."""
    return G.counts(_nodes(spark, d), fx.edges(spark, d))


@query(f"SELECT source, array_to_string(list_sort(list(target)), ';') AS refs, CAST(count(*) AS INT) AS n FROM ({fx.EDGES_SQL}) e GROUP BY source")
def graph_adjacency(spark, d):
    """Adjacency lists."""
    return G.adjacency(fx.edges(spark, d)).select("source", F.array_join("references", ";").alias("refs"), F.size("references").alias("n"))


@query(
    f"""WITH e AS ({fx.EDGES_SQL}), n AS (SELECT DISTINCT source AS citation, regexp_extract(source, '^(.+) E\\.', 1) AS base FROM e),
r AS (SELECT DISTINCT target AS source, source AS target FROM e), a AS (SELECT r.source, n.citation AS target FROM r JOIN n ON n.base = regexp_extract(r.target, '^(.+) E\\.', 1) WHERE n.citation <> r.target AND n.citation <> r.source UNION SELECT source, target FROM r)
SELECT source, count(*) AS n FROM (SELECT DISTINCT source, target FROM a WHERE source <> target) x GROUP BY source"""
)
def graph_case_aliases(spark, d):
    """Edges fanned out to the rows of the target's judgment (statutes cited back), counted per source."""
    e = fx.edges(spark, d).select(col("target").alias("source"), col("source").alias("target"))
    return G.case_alias_counts(e, _nodes(spark, d))


@query(
    f"""WITH t AS (SELECT DISTINCT dated, docket, {fx.STATUTE} AS statute FROM (SELECT *, {fx.DATED} AS dated, {fx.DOCKET} AS docket FROM lineitem) l),
n AS (SELECT DISTINCT docket || ' E. 2.' || l_linenumber AS citation FROM (SELECT *, {fx.DOCKET} AS docket FROM lineitem) l),
m AS (SELECT statute AS source, docket || ' E. 2.' || unnest(generate_series(CAST(regexp_extract(dated, '2\\.(\\d+)-', 1) AS INT), CAST(regexp_extract(dated, '-2\\.(\\d+)$', 1) AS INT))) AS target FROM t)
SELECT source, count(*) AS n FROM (SELECT DISTINCT source, target FROM m WHERE target IN (SELECT citation FROM n) UNION SELECT statute, dated FROM t) x GROUP BY source"""
)
def graph_range_aliases(spark, d):
    """Edges to existing members of consideration ranges."""
    x = fx.lines(spark, d)
    e = x.select(col("statute").alias("source"), col("dated").alias("target")).distinct()
    nodes = x.select(F.concat("docket", F.lit(" E. 2."), "l_linenumber").alias("citation"))
    return G.range_alias_edges(e, nodes).groupBy("source").agg(F.count("*").alias("n"))


_SEEDS = f"SELECT DISTINCT l_suppkey AS query_id, {fx.COURT} AS node FROM lineitem WHERE l_quantity >= 49"
_SCORED = "SELECT query_id, node, round(score, 4) AS score, CAST(rk AS INT) AS rk FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, node) AS rk FROM s) t WHERE rk <= 50"


def _seeds(spark, d):
    return fx.lines(spark, d).where("l_quantity >= 49").select(col("l_suppkey").alias("query_id"), col("court").alias("node")).distinct()


def _importance(spark, d):
    return G.in_degree(fx.edges(spark, d)).select("node", col("in_degree").alias("importance"))


def _out(df):
    return df.select("query_id", "node", F.round("score", 4).alias("score"), "rk")


@query(
    f"""WITH e AS ({fx.EDGES_SQL}), seeds AS ({_SEEDS}), i AS (SELECT target AS node, count(*) AS n FROM e GROUP BY 1),
s AS (SELECT h.query_id, h.node, h.n * sqrt(1 + ln(1 + i.n)) AS score FROM (SELECT query_id, target AS node, count(*) AS n FROM seeds JOIN e ON node = source GROUP BY 1, 2) h JOIN i ON i.node = h.node) {_SCORED}"""
)
def graph_forward(spark, d):
    """Statutes that the seeds cite, by count and importance."""
    return _out(G.forward(_seeds(spark, d), fx.edges(spark, d), _importance(spark, d), 50))


@query(
    f"""WITH e AS ({fx.EDGES_SQL}), r AS (SELECT DISTINCT l_suppkey AS query_id, {fx.STATUTE} AS node FROM lineitem WHERE l_quantity >= 50), i AS (SELECT target AS node, count(*) AS n FROM e GROUP BY 1),
s AS (SELECT r.query_id, e.source AS node, sum(sqrt(1 + ln(1 + i.n))) AS score FROM r JOIN i ON r.node = i.node AND i.n >= 5 JOIN e ON e.target = r.node GROUP BY 1, 2) {_SCORED}"""
)
def graph_reverse(spark, d):
    """Court rows that cite landmark seeds."""
    s = fx.lines(spark, d).where("l_quantity >= 50").select(col("l_suppkey").alias("query_id"), col("statute").alias("node")).distinct()
    return _out(G.reverse(s, fx.edges(spark, d), _importance(spark, d), 50))


@query(
    f"""WITH e0 AS ({fx.EDGES_SQL}), e AS (SELECT source, target FROM e0 UNION SELECT target, source FROM e0), seeds AS (SELECT DISTINCT l_suppkey AS query_id, {fx.COURT} AS node FROM lineitem WHERE l_quantity >= 49),
o AS (SELECT DISTINCT query_id, target AS node FROM seeds JOIN e ON node = source), w AS (SELECT query_id, target AS node, CAST(count(*) AS DOUBLE) AS score FROM o JOIN e ON node = source GROUP BY 1, 2),
s AS (SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.query_id = w.query_id AND o.node = w.node) AND NOT EXISTS (SELECT 1 FROM seeds z WHERE z.query_id = w.query_id AND z.node = w.node)) {_SCORED}"""
)
def graph_two_hops(spark, d):
    """Court rows two steps from the seeds."""
    e = settled(fx.edges(spark, d), "edges")
    both = e.union(e.select("target", "source"))
    return _out(G.two_hops(_seeds(spark, d), both, 50))


@query(
    f"""WITH seeds AS ({_SEEDS}), m AS (SELECT DISTINCT {fx.BASE} AS base, {fx.COURT} AS node FROM lineitem), i AS (SELECT base, count(*) AS n FROM m GROUP BY 1),
s AS (SELECT p.query_id, m.node, p.n * sqrt(1 + ln(1 + i.n)) AS score FROM (SELECT query_id, base, count(*) AS n FROM seeds JOIN m USING (node) GROUP BY 1, 2) p JOIN m USING (base) JOIN i USING (base) WHERE NOT EXISTS (SELECT 1 FROM seeds z WHERE z.query_id = p.query_id AND z.node = m.node)) {_SCORED}"""
)
def graph_siblings(spark, d):
    """Rows of the seeds' judgments."""
    m = fx.lines(spark, d).select("base", col("court").alias("node")).distinct()
    return _out(G.siblings(_seeds(spark, d), m, m.groupBy("base").agg(F.count("*").alias("importance")).withColumnRenamed("base", "node"), 50))


@query(
    f"""WITH b AS (SELECT DISTINCT l_orderkey AS basket, l_partkey AS item FROM lineitem), n AS (SELECT item, count(*) AS n FROM b GROUP BY 1), t AS (SELECT count(DISTINCT basket) AS t FROM b),
p AS (SELECT x.item AS a, y.item AS b, count(*) AS support FROM b x JOIN b y ON x.basket = y.basket AND x.item < y.item GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT p.a, p.b, support, round(support / na.n, 4) AS conf_ab, round(support / nb.n, 4) AS conf_ba, round(support / (na.n + nb.n - support), 4) AS jaccard, round(ln(support * t / (CAST(na.n AS DOUBLE) * nb.n)), 4) AS pmi, round(ln(support * t / (CAST(na.n AS DOUBLE) * nb.n)) / -ln(support / t), 4) AS npmi FROM p JOIN n na ON na.item = p.a JOIN n nb ON nb.item = p.b, t"""
)
def co_citation_prior(spark, d):
    """Pair statistics of parts ordered together."""
    b = fx.table(spark, d, "lineitem").select(col("l_orderkey").alias("basket"), col("l_partkey").alias("item"))
    p = G.pair_prior(b)
    return p.select("a", "b", "support", *[F.round(c, 4).alias(c) for c in ("conf_ab", "conf_ba", "jaccard", "pmi", "npmi")])


@query(
    f"""WITH r AS (SELECT DISTINCT {fx.STATUTE} AS statute, {fx.case('l_suppkey % 5', fx.CODES)} AS code, l_partkey % 400 + 1 AS art, l_linenumber AS par FROM lineitem)
SELECT statute, lag(statute) OVER w AS prev, lead(statute) OVER w AS next, count(*) OVER (PARTITION BY code) AS group_rows FROM r WINDOW w AS (PARTITION BY code ORDER BY art * 100 + par, statute)"""
)
def graph_neighbours(spark, d):
    """Previous and next statute of a code in natural order."""
    r = fx.lines(spark, d).select("statute", C.pick(col("statute"), r"(\S+)$").alias("code"), (C.pick(col("statute"), r"Art\. (\d+)").cast("int") * 100 + col("l_linenumber")).alias("key")).distinct()
    return G.neighbours(r, "code", "key", "statute").select("statute", "prev", "next", "group_rows")


# --- retrieval


@query(
    rf"""WITH t AS (SELECT doc_id, unnest({_TOK}) AS term FROM documents), q AS (SELECT item_id AS query_id, term, least(count(*), 3) AS qtf FROM (SELECT item_id, unnest({_TOK}) AS term FROM benchmark) b GROUP BY 1, 2),
p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2), dl AS (SELECT doc_id, len({_TOK}) AS dl FROM documents), a AS (SELECT avg(dl) AS avgdl, count(*) AS n FROM dl), df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
s AS (SELECT query_id, p.doc_id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM p JOIN q USING (term) JOIN df USING (term) JOIN dl ON dl.doc_id = p.doc_id, a GROUP BY 1, 2)
SELECT query_id, doc_id, round(score, 4) AS score, CAST(rk AS INT) AS rk FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rk FROM s) r WHERE rk <= 100"""
)
def bm25_top_100(spark, d):
    """BM25 of all documents for the benchmark items."""
    q = fx.table(spark, d, "benchmark").select(col("item_id").alias("query_id"), col("text").alias("query"))
    return X.bm25(fx.table(spark, d, "documents"), q, 100).select("query_id", "doc_id", F.round("score", 4).alias("score"), "rk")


@query(
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, c.vec_id AS doc_id, list_cosine_similarity(q.e, c.e) AS score FROM v q, v c WHERE q.vec_id % 50 = 0)
SELECT query_id, doc_id, round(score, 4) AS score, CAST(rk AS INT) AS rk FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rk FROM s) r WHERE rk <= 50"""
)
def cosine_top_50(spark, d):
    """Exact cosine search with every 50th vector as a query."""
    v = fx.table(spark, d, "embeddings").select(col("vec_id").alias("doc_id"), col("embedding").alias("v"))
    q = v.where("doc_id % 50 = 0").select(col("doc_id").alias("query_id"), "v")
    return V.cosine_top_k(v, q, 50).select("query_id", "doc_id", F.round("score", 4).alias("score"), "rk")


@query(
    """WITH c AS (SELECT DISTINCT lower(p_type) AS cc FROM part), q AS (SELECT DISTINCT p_brand AS query_id, lower(p_type) AS qc FROM part),
s AS (SELECT query_id, qc, cc, CASE WHEN qc = cc THEN 1.0 ELSE greatest(CASE WHEN contains(qc, cc) OR contains(cc, qc) THEN 0.85 * least(length(qc), length(cc)) / greatest(length(qc), length(cc)) ELSE 0 END,
 len(list_intersect(list_distinct(list_filter(regexp_split_to_array(qc, '[^\\p{L}\\p{N}_]+'), lambda w: length(w) >= 3)), list_distinct(list_filter(regexp_split_to_array(cc, '[^\\p{L}\\p{N}_]+'), lambda w: length(w) >= 3)))) / greatest(len(list_distinct(list_filter(regexp_split_to_array(qc, '[^\\p{L}\\p{N}_]+'), lambda w: length(w) >= 3))), len(list_distinct(list_filter(regexp_split_to_array(cc, '[^\\p{L}\\p{N}_]+'), lambda w: length(w) >= 3))))) END AS weight FROM q, c
 WHERE len(list_intersect(list_filter(regexp_split_to_array(qc, '[^\\p{L}\\p{N}_]+'), lambda w: length(w) >= 3), list_filter(regexp_split_to_array(cc, '[^\\p{L}\\p{N}_]+'), lambda w: length(w) >= 3))) > 0)
SELECT query_id, qc, cc, round(weight, 4) AS weight, CAST(rk AS INT) AS rk FROM (SELECT *, row_number() OVER (PARTITION BY query_id, qc ORDER BY round(weight, 6) DESC, cc) AS rk FROM s) r WHERE rk <= 25"""
)
def concept_expansion(spark, d):
    """Fuzzy expansion of part types."""
    p = fx.table(spark, d, "part")
    out = X.expand_concepts(p.select(col("p_brand").alias("query_id"), col("p_type").alias("concept")).distinct(), p.select(col("p_type").alias("concept")))
    return out.withColumn("weight", F.round("weight", 4))


@query(
    f"""WITH e AS ({fx.EDGES_SQL}), seeds AS ({_SEEDS}), df AS (SELECT target AS node, count(*) AS n FROM e GROUP BY 1),
s AS (SELECT h.query_id, h.node, h.n / ln(2 + df.n) AS score FROM (SELECT query_id, target AS node, count(DISTINCT source) AS n FROM seeds JOIN e ON node = source GROUP BY 1, 2) h JOIN df USING (node)) {_SCORED}"""
)
def statute_backprop(spark, d):
    """Statutes cited by the seeds, damped by how often they are cited at all."""
    e = fx.edges(spark, d)
    return _out(G.backprop(_seeds(spark, d), e, G.in_degree(e), 50))


# --- fusion and selection


@query(f"SELECT query_id, doc_id, round(score, 8) AS score, channels, rk FROM ({fx.FUSED_SQL}) f WHERE rk <= 200")
def rrf_fusion(spark, d):
    """Reciprocal rank fusion of three channels."""
    return U.rrf(fx.channels(spark, d)).where("rk <= 200").select("query_id", "doc_id", F.round("score", 8).alias("score"), "channels", "rk")


@query(
    f"""WITH f AS ({fx.FUSED_SQL}), z AS (SELECT query_id, doc_id, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 0 END AS s FROM f WINDOW w AS (PARTITION BY query_id)),
k AS (SELECT query_id, doc_id, s FROM z WHERE s >= 0.55 OR (s >= 0.25 AND doc_id % 3 <> 0))
SELECT query_id, doc_id, round(s, 6) AS score FROM k UNION ALL SELECT query_id, doc_id, round(s, 6) FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, doc_id) AS r FROM z WHERE query_id NOT IN (SELECT query_id FROM k)) x WHERE r = 1"""
)
def zoned_decisions(spark, d):
    """Normalised scores, zones and verdicts (a missing verdict is YES)."""
    f = U.rrf(fx.channels(spark, d)).withColumn("score", U.minmax(col("score"), ["query_id"])).withColumn("zone", U.zones(col("score")))
    verdicts = f.where("doc_id % 3 = 0").select("query_id", "doc_id", T.parse_verdict(F.lit("<think>yes?</think> NO"), "YES").alias("verdict"))
    return U.decide(f.select("query_id", "doc_id", "score", "zone"), verdicts).withColumn("score", F.round("score", 6))


@query(
    f"""WITH c AS ({fx.CHANNELS_SQL}) SELECT query_id, doc_id, string_agg(DISTINCT channel, ',' ORDER BY channel) AS sources, max(score) AS score, CAST(min(rk) AS INT) AS best_rank FROM c GROUP BY 1, 2"""
)
def channel_pool(spark, d):
    """Union of the channels with provenance."""
    return U.pool(fx.channels(spark, d))


@query(
    f"""WITH c AS ({fx.CHANNELS_SQL}) SELECT query_id, doc_id, round(CAST(least(1.0, sum(CASE channel WHEN 'A' THEN 0.4 WHEN 'N' THEN 0.3 ELSE 0.2 END) + CASE WHEN count(*) >= 3 THEN 0.2 WHEN count(*) >= 2 THEN 0.1 ELSE 0 END) AS DOUBLE), 6) AS score, count(*) AS sources FROM (SELECT DISTINCT query_id, doc_id, channel FROM c) x GROUP BY 1, 2"""
)
def evidence_scores(spark, d):
    """Source weights with a bonus for agreement."""
    return U.evidence(fx.channels(spark, d), {"A": 0.4, "N": 0.3, "R": 0.2}, {2: 0.1, 3: 0.2}).withColumn("score", F.round("score", 6))


@query()
def round_robin_guarantee(spark, d):
    """A guaranteed prefix by turns over the channels, then the fused tail."""
    c = fx.channels(spark, d)
    return U.guaranteed(U.round_robin(c, ["A", "N", "R"], 20, 50), U.rrf(c), 200)


@query()
def diversified_selection(spark, d):
    """Quotas from two orderings, then by fused score."""
    f = U.rrf(fx.channels(spark, d)).withColumn("breadth", col("channels").cast("double")).withColumn("novelty", -col("doc_id").cast("double"))
    return U.quota_select(f.select("query_id", "doc_id", "score", "breadth", "novelty"), {"breadth": 40, "novelty": 20}, 100)


@query(
    f"""WITH f AS (SELECT query_id, rk, round(score, 10) AS score FROM ({fx.FUSED_SQL}) f WHERE rk <= 102), g AS (SELECT *, lead(score) OVER w AS s1, lead(score, 2) OVER w AS s2, first_value(score) OVER w AS top, (score + lead(score) OVER w + lead(score, 2) OVER w) / 3 AS m, (lead(score) OVER w + lead(score, 2) OVER w + lead(score, 3) OVER w) / 3 AS m1,
 (1 - (rk - 1) / greatest(max(rk) OVER (PARTITION BY query_id) - 1, 1)) - CASE WHEN max(score) OVER (PARTITION BY query_id) > min(score) OVER (PARTITION BY query_id) THEN (score - min(score) OVER (PARTITION BY query_id)) / (max(score) OVER (PARTITION BY query_id) - min(score) OVER (PARTITION BY query_id)) ELSE 0 END AS chord FROM f WINDOW w AS (PARTITION BY query_id ORDER BY rk))
SELECT query_id, arg_min(rk, -round(score - s1, 6) * 1000000 + rk / 1000.0) FILTER (WHERE rk BETWEEN 5 AND 100 AND s1 IS NOT NULL) AS gap_k, CAST(greatest(5, least(100, count(*) FILTER (WHERE score >= 0.5 * top))) AS INT) AS share_k, coalesce(min(rk) FILTER (WHERE rk BETWEEN 5 AND 100 AND s1 < 0.9 * score), 100) AS ratio_k FROM g GROUP BY query_id"""
)
def elbow_sizes(spark, d):
    """Cut sizes by largest gap, share of the top and ratio."""
    f = U.rrf(fx.channels(spark, d)).withColumn("score", F.round("score", 10))
    return U.elbows(f, 5, 100).select("query_id", "gap_k", "share_k", "ratio_k")


# --- granularity and lattice

_KIDS = f"SELECT DISTINCT 'Art. ' || (l_partkey % 400 + 1) || ' ' || {fx.case('l_suppkey % 5', fx.CODES)} AS article, {fx.STATUTE} AS child FROM lineitem"


@query(
    f"""WITH p AS (SELECT l_orderkey AS query_id, l_linenumber AS pos, CASE WHEN l_linenumber % 2 = 0 THEN {fx.STATUTE} ELSE 'Art. ' || (l_partkey % 400 + 1) || ' ' || {fx.case('l_suppkey % 5', fx.CODES)} END AS citation FROM lineitem), k AS ({_KIDS}),
f AS (SELECT query_id, coalesce(child, citation) AS citation, min(pos) AS pos FROM p LEFT JOIN k ON citation = article GROUP BY 1, 2) SELECT query_id, citation, CAST(row_number() OVER (PARTITION BY query_id ORDER BY pos, citation) AS INT) AS rk FROM f"""
)
def granularity_expansion(spark, d):
    """Predicted articles replaced by the corpus's paragraphs."""
    x = fx.lines(spark, d)
    p = x.select(col("l_orderkey").alias("query_id"), col("l_linenumber").alias("pos"), F.when(col("l_linenumber") % 2 == 0, col("statute")).otherwise(C.collapse_to_article(col("statute"))).alias("citation"))
    return R.expand(p, R.children(x.select(col("statute").alias("citation"))))


_SEG = f"SELECT DISTINCT {fx.COURT} AS citation, 'court' AS family, unnest(['division', 'volume', 'pinpoint']) AS segment, unnest([{fx.case('l_orderkey % 5', fx.DIVISIONS)}, CAST(100 + l_orderkey % 50 AS VARCHAR), CAST(l_linenumber AS VARCHAR)]) AS value FROM lineitem"


def _segments(spark, d):
    x = fx.lines(spark, d).select(col("court").alias("citation"), F.lit("court").alias("family"), C.chamber(col("court")).alias("division"), C.pick(col("court"), r"BGE (\d+)").alias("volume"), C.split_court(col("court"))["pinpoint"].alias("pinpoint")).distinct()
    return L.segments(x, ["division", "volume", "pinpoint"])


@query(
    f"""WITH s AS ({_SEG}), o AS (SELECT DISTINCT {fx.COURT} AS citation FROM lineitem WHERE l_linestatus = 'O'), r AS (SELECT family, segment, value, count(o.citation) AS source_count, count(*) AS ref_count, array_to_string(list_sort(list_distinct(list(s.citation)))[1:5], ';') AS examples FROM s LEFT JOIN o USING (citation) GROUP BY 1, 2, 3)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY family, segment ORDER BY source_count DESC, value) AS INT) AS rk FROM r) x WHERE rk <= 20 OR segment = 'volume'"""
)
def segment_registry(spark, d):
    """Options of citation segments, rare structural ones cut."""
    own = fx.lines(spark, d).where("l_linestatus = 'O'").select(col("court").alias("citation"))
    return L.choices(L.registry(_segments(spark, d), own), ("volume",), 20)


@query(
    f"""WITH s AS ({_SEG}), q AS (SELECT DISTINCT l_suppkey AS query_id, 'division' AS segment, {fx.case('l_suppkey % 5', fx.DIVISIONS)} AS value FROM lineitem UNION SELECT DISTINCT l_suppkey, 'volume', CAST(100 + l_suppkey % 50 AS VARCHAR) FROM lineitem),
h AS (SELECT query_id, citation, count(DISTINCT s.segment) AS n FROM q JOIN s ON q.segment = s.segment AND q.value = s.value GROUP BY 1, 2 HAVING count(DISTINCT s.segment) = 2), e AS (SELECT DISTINCT l_suppkey AS query_id, {fx.COURT} AS citation FROM lineitem WHERE l_quantity >= 50),
j AS (SELECT coalesce(h.query_id, e.query_id) AS query_id, coalesce(h.citation, e.citation) AS citation, 500 * coalesce(n, 0) + CASE WHEN e.citation IS NOT NULL THEN 10000 ELSE 0 END AS score, e.citation IS NOT NULL AS explicit FROM h FULL JOIN e ON h.query_id = e.query_id AND h.citation = e.citation)
SELECT * FROM (SELECT query_id, citation, score, explicit, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, citation) AS INT) AS rk FROM j) x WHERE rk <= 30 OR explicit"""
)
def lattice_candidates(spark, d):
    """Citations that meet all decided segments, within a budget that spares explicit mentions."""
    x = fx.table(spark, d, "lineitem").select("l_suppkey").distinct()
    q = x.selectExpr("l_suppkey AS query_id", "'division' AS segment", f"{fx.case('l_suppkey % 5', fx.DIVISIONS)} AS value").unionByName(x.selectExpr("l_suppkey AS query_id", "'volume' AS segment", "CAST(100 + l_suppkey % 50 AS STRING) AS value"))
    e = fx.lines(spark, d).where("l_quantity >= 50").select(col("l_suppkey").alias("query_id"), col("court").alias("citation"))
    return L.budgeted(L.matching(_segments(spark, d), q, True), e, 30)


# --- evaluation

_PRF = "CASE WHEN p = 0 THEN 1.0 ELSE t / p END AS precision, CASE WHEN g = 0 THEN 1.0 ELSE t / g END AS recall, CASE WHEN p = 0 AND g = 0 THEN 1.0 WHEN t = 0 THEN 0.0 ELSE 2.0 * t / (p + g) END AS f1"
_PER = f"WITH p AS (SELECT query_id, doc_id FROM ({fx.FUSED_SQL}) f WHERE rk <= 40), g AS ({fx.GOLD_SQL}), n AS (SELECT coalesce(p.query_id, g.query_id) AS query_id, count(*) FILTER (WHERE p.doc_id IS NOT NULL AND g.doc_id IS NOT NULL) AS t, count(p.doc_id) AS p, count(g.doc_id) AS g FROM p FULL JOIN g ON p.query_id = g.query_id AND p.doc_id = g.doc_id GROUP BY 1)"


def _pred(spark, d):
    return U.rrf(fx.channels(spark, d)).where("rk <= 40")


@query(f"{_PER} SELECT query_id, t AS tp, p AS n_pred, g AS n_gold, {_PRF} FROM n")
def evaluation_by_query(spark, d):
    """Precision, recall and F1 per query."""
    return E.by_query(_pred(spark, d), fx.gold(spark, d))


@query(f"{_PER}, x AS (SELECT t, p, g, {_PRF} FROM n) SELECT round(avg(precision), 6) AS macro_p, round(avg(recall), 6) AS macro_r, round(avg(f1), 6) AS macro_f1, round(sum(t) / sum(p), 6) AS micro_p, round(sum(t) / sum(g), 6) AS micro_r, round(2.0 * sum(t) / (sum(p) + sum(g)), 6) AS micro_f1 FROM x")
def evaluation_summary(spark, d):
    """Macro and micro figures."""
    s = E.summary(E.by_query(_pred(spark, d), fx.gold(spark, d)))
    return s.select(*[F.round(c, 6).alias(c) for c in s.columns])


@query(
    f"""WITH f AS ({fx.FUSED_SQL}), g AS ({fx.GOLD_SQL}) SELECT g.query_id, count(*) AS n_gold, {", ".join(f"count(*) FILTER (WHERE f.rk <= {k}) / count(*) AS recall_{k}" for k in (50, 100, 200, 500))} FROM g LEFT JOIN f ON g.query_id = f.query_id AND g.doc_id = f.doc_id GROUP BY 1"""
)
def recall_curve(spark, d):
    """Recall at several ranks."""
    return E.recall_at(U.rrf(fx.channels(spark, d)), fx.gold(spark, d), [50, 100, 200, 500])


@query(
    f"""WITH f AS ({fx.FUSED_SQL}), g AS ({fx.GOLD_SQL}), n AS (SELECT query_id, count(*) AS n FROM g GROUP BY 1), h AS (SELECT f.query_id, f.rk, coalesce(n.n, 0) AS n, sum(CASE WHEN g.doc_id IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY f.query_id ORDER BY f.rk) AS c FROM f LEFT JOIN g ON f.query_id = g.query_id AND f.doc_id = g.doc_id LEFT JOIN n ON n.query_id = f.query_id),
b AS (SELECT *, 2.0 * c / (rk + n) AS f1, row_number() OVER (PARTITION BY query_id ORDER BY round(2.0 * c / (rk + n), 9) DESC, rk) AS r FROM h) SELECT query_id, rk AS best_k, round(f1, 6) AS best_f1 FROM b WHERE r = 1"""
)
def oracle_sizes(spark, d):
    """The best cut of each ranking in hindsight."""
    return E.oracle_k(U.rrf(fx.channels(spark, d)), fx.gold(spark, d)).withColumn("best_f1", F.round("best_f1", 6))


@query(
    f"""WITH f AS ({fx.FUSED_SQL}), g AS ({fx.GOLD_SQL}) SELECT g.query_id, g.doc_id, CASE WHEN f.rk IS NULL THEN 'not_retrieved' ELSE 'topk_budget' END AS reason FROM g LEFT JOIN f ON g.query_id = f.query_id AND g.doc_id = f.doc_id WHERE f.rk IS NULL OR f.rk > 100"""
)
def dropped_gold(spark, d):
    """Gold beyond the budget, and why."""
    corpus = fx.table(spark, d, "part").select(col("p_partkey").alias("doc_id"))
    corpus = corpus.unionByName(fx.gold(spark, d).select("doc_id"))
    return E.dropped(fx.gold(spark, d), U.rrf(fx.channels(spark, d)), corpus, 100)


# --- streams and pipelines


@query("SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    """Hourly counts; the same plan serves the stream."""
    return S.windowed_counts(fx.table(spark, d, "events")).select(col("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    rf"""WITH bm AS (SELECT query_id, doc_id, rk FROM ({_SQL["bm25_top_100"]}) b), la AS (SELECT b.item_id AS query_id, d.doc_id, row_number() OVER (PARTITION BY b.item_id ORDER BY length(d.text), d.doc_id) AS rk FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
s AS (SELECT query_id, doc_id, sum(1.0 / (60 + rk)) AS score, count(*) AS channels FROM (SELECT * FROM bm UNION ALL SELECT * FROM la) u GROUP BY 1, 2)
SELECT query_id, doc_id, round(score, 6) AS score, channels, CAST(rk AS INT) AS rk FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rk FROM s) r WHERE rk <= 20"""
)
def hybrid_retrieve(spark, d):
    """Flagship: BM25 and exact-anchor channels for all queries at once, fused and cut."""
    docs, items = fx.table(spark, d, "documents"), fx.table(spark, d, "benchmark")
    q = items.select(col("item_id").alias("query_id"), col("text").alias("query"))
    lex = X.bm25(docs, q, 100).select("query_id", F.lit("bm25").alias("channel"), "doc_id", "rk")
    near = X.holders(docs, q)
    anchor = U.ranked(near.select("query_id", "doc_id", (-F.length("text")).alias("score")), ["query_id"]).select("query_id", F.lit("anchor").alias("channel"), "doc_id", "rk")
    return U.rrf(lex.unionByName(anchor)).where("rk <= 20").select("query_id", "doc_id", F.round("score", 6).alias("score"), "channels", "rk")

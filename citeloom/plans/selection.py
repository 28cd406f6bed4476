"""Queries that choose from rankings: rules, budgets, gates, peers; and that hold them against gold."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import fusion as U
from . import fixtures as fx
from .registry import query

col = F.col
_CODE = fx.case("l_suppkey % 5", fx.CODES)
_F = f"f AS ({fx.FUSED_SQL})"
_G = f"g AS ({fx.GOLD_SQL})"


def _fused(spark, d):
    return U.rrf(fx.channels(spark, d))


_UNIT = "CASE WHEN max({0}) OVER w > min({0}) OVER w THEN ({0} - min({0}) OVER w) / (max({0}) OVER w - min({0}) OVER w) ELSE 0 END"


@query(
    f"""WITH {_F}, p AS (SELECT f.query_id, f.doc_id, f.score, CAST(p_retailprice AS DOUBLE) AS rerank, p_size FROM f JOIN part ON p_partkey = doc_id), z AS (SELECT query_id, doc_id, p_size, {_UNIT.format('score')} AS s, {_UNIT.format('rerank')} AS r FROM p WINDOW w AS (PARTITION BY query_id)), x AS (SELECT query_id, doc_id, 0.7 * s + 0.3 * r AS score, 0.5 * s + 0.25 * r + 0.01 * p_size AS blend FROM z)
SELECT query_id, doc_id, round(score, 6) AS score, CASE WHEN score >= 0.55 THEN 'yes' WHEN score < 0.25 THEN 'no' ELSE 'judge' END AS zone, round(blend, 6) AS blend FROM x"""
)
def blended_zones(spark, d):
    """Retrieval and rerank scores blended, with zones, and a linear score."""
    part = fx.table(spark, d, "part").select(col("p_partkey").alias("doc_id"), col("p_retailprice").cast("double").alias("rerank"), "p_size")
    p = _fused(spark, d).join(part, "doc_id")
    z = U.fused_zones(p)
    b = p.select("query_id", "doc_id", "p_size", (0.5 * U.minmax(col("score"), ["query_id"]) + 0.25 * U.minmax(col("rerank"), ["query_id"]) + U.linear({"p_size": 0.01})).alias("blend"))
    return z.join(b, ["query_id", "doc_id"]).select("query_id", "doc_id", F.round("score", 6).alias("score"), "zone", F.round("blend", 6).alias("blend"))


@query(
    f"""WITH {_F}, k AS (SELECT s_suppkey AS query_id, CAST(greatest(5, least(40, s_nationkey * 3)) AS INT) AS k FROM supplier), r AS (SELECT query_id, doc_id, score, rk, k, max(CASE WHEN rk = k THEN score END) OVER (PARTITION BY query_id) AS last FROM f JOIN k USING (query_id)) SELECT query_id, doc_id, round(score, 8) AS score, rk FROM r WHERE rk <= k OR (score >= last - 0.0005 AND rk <= 40)"""
)
def expected_sizes(spark, d):
    """As many as a model expects of a query, and those close behind."""
    sizes = fx.table(spark, d, "supplier").select(col("s_suppkey").alias("query_id"), (col("s_nationkey") * 3).alias("k"))
    return U.expected(_fused(spark, d).select("query_id", "doc_id", "score"), sizes, 5, 40, 0.0005).withColumn("score", F.round("score", 8))


@query(
    f"""WITH {_F}, p AS (SELECT query_id, doc_id, score, CAST(p_retailprice AS DOUBLE) AS price, p_size FROM f JOIN part ON p_partkey = doc_id) SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS INT) AS rank_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(price, 6) DESC, doc_id) AS INT) AS rank_price,
CASE WHEN row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) <= 50 THEN 1 ELSE 0 END + CASE WHEN row_number() OVER (PARTITION BY query_id ORDER BY round(price, 6) DESC, doc_id) <= 50 THEN 1 ELSE 0 END AS agreeing,
round(1.0 / (60 + row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id)) + 1.0 / (60 + row_number() OVER (PARTITION BY query_id ORDER BY round(price, 6) DESC, doc_id)), 8) AS rrf FROM p"""
)
def rank_features(spark, d):
    """Ranks by several scores, how many agree, and their fusion."""
    part = fx.table(spark, d, "part").select(col("p_partkey").alias("doc_id"), col("p_retailprice").cast("double").alias("price"))
    r = U.rank_features(_fused(spark, d).select("query_id", "doc_id", "score").join(part, "doc_id"), ["score", "price"], 50)
    return r.select("query_id", "doc_id", "rank_score", "rank_price", "agreeing", F.round(U.rrf_of(r, ["rank_score", "rank_price"]), 8).alias("rrf"))


@query(f"WITH {_F}, s AS (SELECT query_id, avg(CASE WHEN p_size <= 25 THEN 1.0 ELSE 0 END) AS s FROM f JOIN part ON p_partkey = doc_id WHERE rk <= 100 GROUP BY 1), l AS (SELECT query_id, greatest(50, least(450, CAST(round(s * 500) AS INT))) AS laws FROM s) SELECT query_id, laws, 500 - laws AS courts FROM l")
def family_quotas(spark, d):
    """A budget split between families as a ranking's head is."""
    part = fx.table(spark, d, "part").select(col("p_partkey").alias("doc_id"), F.when(col("p_size") <= 25, "law").otherwise("court").alias("family"))
    return U.family_quota(_fused(spark, d).join(part, "doc_id"), 500)


@query(
    f"""WITH {_F}, a AS (SELECT query_id, doc_id, rk FROM f WHERE rk <= 20), b AS (SELECT query_id, doc_id, rk FROM ({fx.CHANNELS_SQL}) c WHERE channel = 'A' AND rk <= 30), u AS (SELECT query_id, doc_id, 0 AS p, rk, 'fused' AS source FROM a UNION ALL SELECT query_id, doc_id, 1, rk, 'A' FROM b UNION ALL SELECT query_id, doc_id, 2, rk, 'rest' FROM f),
m AS (SELECT query_id, doc_id, min(p * 1000000 + rk) AS o, arg_min(source, p * 1000000 + rk) AS source FROM u GROUP BY 1, 2) SELECT query_id, doc_id, source, CAST(rk AS INT) AS rk FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY o, doc_id) AS rk FROM m) x WHERE rk <= 60"""
)
def priority_pool(spark, d):
    """Lists in order of priority fill a pool, a document at its first."""
    f = _fused(spark, d)
    return U.priority_pool([("fused", f, 20), ("A", fx.channels(spark, d).where("channel = 'A'"), 30), ("rest", f, None)], 60)


@query(
    f"""WITH c AS ({fx.CHANNELS_SQL}), s AS (SELECT query_id, doc_id, max(score) AS score, list_distinct(list(channel)) AS sources FROM c GROUP BY 1, 2), q AS (SELECT query_id, quantile_cont(score, 0.6) AS q FROM s GROUP BY 1), k AS (SELECT s.query_id, s.doc_id FROM s JOIN q USING (query_id) WHERE score >= q AND list_contains(sources, 'R')),
t AS (SELECT query_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS r FROM s) x WHERE r <= 10), u AS (SELECT query_id, doc_id FROM t UNION SELECT query_id, doc_id FROM ({fx.GOLD_SQL}) g) SELECT 'gate' AS kind, * FROM k UNION ALL SELECT 'floor', * FROM u"""
)
def gates_and_floors(spark, d):
    """A quantile with a source that must agree; the best with a verified floor."""
    s = fx.channels(spark, d).groupBy("query_id", "doc_id").agg(F.max("score").alias("score"), F.collect_set("channel").alias("sources"))
    gate = U.sourced_gate(s, 0.6, ("R",)).select(F.lit("gate").alias("kind"), "query_id", "doc_id")
    return gate.unionByName(U.with_floor(s.select("query_id", "doc_id", "score"), 10, fx.gold(spark, d)).withColumn("kind", F.lit("floor")))


@query(
    f"""WITH f AS (SELECT query_id, rk, round(score, 10) AS score FROM ({fx.FUSED_SQL}) f), s AS (SELECT query_id, rk, score < 0.4 * first_value(score) OVER w OR score < 0.8 * lag(score) OVER w AS stop FROM f WINDOW w AS (PARTITION BY query_id ORDER BY rk)) SELECT query_id, CAST(greatest(5, least(100, coalesce(min(CASE WHEN stop THEN rk - 1 END), max(rk)))) AS INT) AS k FROM s GROUP BY 1"""
)
def gap_sizes(spark, d):
    """Cut sizes at the first fall of the scores."""
    return U.gap_size(_fused(spark, d).withColumn("score", F.round("score", 10)), 0.4, 0.8, 5, 100)


@query(r"SELECT item_id, CASE WHEN s <= 4 THEN 3 WHEN s <= 8 THEN 6 ELSE 12 END AS laws, CASE WHEN s <= 4 THEN 5 WHEN s <= 8 THEN 10 ELSE 20 END AS courts FROM (SELECT item_id, 1.0 * len(regexp_extract_all(text, '[.!?]')) + 0.5 * len(regexp_extract_all(text, ',')) AS s FROM benchmark) x")
def tiered_sizes(spark, d):
    """Cut sizes by tiers of a query's signals."""
    t = U.tiered_size(col("text"), {r"[.!?]": 1.0, ",": 0.5}, [(4, 3, 5), (8, 6, 10), (0, 12, 20)])
    return fx.table(spark, d, "benchmark").select("item_id", t["laws"].alias("laws"), t["courts"].alias("courts"))


_ROWS = f"SELECT citation, family, grp, min(row_no) AS row_no FROM (SELECT {fx.COURT} AS citation, 'court' AS family, {fx.BASE} AS grp, l_orderkey * 10 + l_linenumber AS row_no FROM lineitem UNION ALL SELECT {fx.STATUTE}, 'law', concat('Art. ', l_partkey % 400 + 1, ' ', {_CODE}), l_orderkey * 10 + l_linenumber FROM lineitem) z GROUP BY 1, 2, 3"


@query(
    f"""WITH r AS ({_ROWS}), p AS (SELECT DISTINCT l_suppkey AS query_id, {fx.COURT} AS citation FROM lineitem WHERE l_quantity >= 49 UNION SELECT DISTINCT l_suppkey, {fx.STATUTE} FROM lineitem WHERE l_quantity >= 49), k AS (SELECT DISTINCT query_id, family, grp FROM p JOIN r USING (citation)),
n AS (SELECT k.query_id, k.family, r.citation, row_number() OVER (PARTITION BY k.query_id, k.family, k.grp ORDER BY row_no, r.citation) AS x FROM k JOIN r USING (family, grp) WHERE (k.query_id, r.citation) NOT IN (SELECT query_id, citation FROM p)) SELECT query_id, citation FROM p UNION SELECT query_id, citation FROM n WHERE x <= CASE family WHEN 'law' THEN 2 ELSE 3 END"""
)
def prediction_peers(spark, d):
    """Predictions with a few peers of their judgment or article."""
    x = fx.lines(spark, d)
    no = (col("l_orderkey") * 10 + col("l_linenumber")).alias("row_no")
    art = F.concat(F.lit("Art. "), (col("l_partkey") % 400 + 1).cast("string"), F.lit(" "), F.substring_index("statute", " ", -1))
    rows = x.select(col("court").alias("citation"), F.lit("court").alias("family"), col("base").alias("group"), no).union(x.select("statute", F.lit("law"), art, no)).groupBy("citation", "family", "group").agg(F.min("row_no").alias("row_no"))
    s = x.where("l_quantity >= 49")
    pred = s.select(col("l_suppkey").alias("query_id"), col("court").alias("citation")).union(s.select("l_suppkey", "statute")).distinct()
    return U.peers(pred, rows)


@query(
    f"""WITH {_F}, p AS (SELECT query_id, doc_id, score, rk, p_brand AS aspect FROM f JOIN part ON p_partkey = doc_id), k AS (SELECT query_id, doc_id, aspect FROM p WHERE rk <= 10), b AS (SELECT *, row_number() OVER (PARTITION BY query_id, aspect ORDER BY round(score, 6) DESC, doc_id) AS r FROM p WHERE (query_id, aspect) NOT IN (SELECT query_id, aspect FROM k)) SELECT query_id, doc_id FROM k UNION SELECT query_id, doc_id FROM b WHERE r = 1"""
)
def aspect_coverage(spark, d):
    """The best row of each aspect that the kept rows leave uncovered."""
    part = fx.table(spark, d, "part").select(col("p_partkey").alias("doc_id"), col("p_brand").alias("aspect"))
    f = _fused(spark, d)
    return U.covered_aspects(f.where("rk <= 10"), f.join(part, "doc_id").select("query_id", "doc_id", "aspect", "score"))


@query(
    r"""WITH p AS (SELECT p_partkey, p_name, p_type, p_size, list_distinct(list_filter(regexp_split_to_array(lower(p_name), '[^\p{L}\p{N}]+'), lambda w: length(w) >= 2)) AS a, list_distinct(list_filter(regexp_split_to_array(lower(p_type), '[^\p{L}\p{N}]+'), lambda w: length(w) >= 2)) AS b FROM part)
SELECT p_partkey, round(CASE WHEN contains(lower(p_name), lower(p_type)) THEN 1.0 ELSE len(list_intersect(a, b)) / greatest(len(b), 1) END, 6) AS ratio, round(CASE WHEN p_size > 25 THEN 2.0 ELSE 0 END + CASE WHEN p_type LIKE '%STEEL' THEN 1.5 ELSE 0 END + p_size / 100, 6) AS score FROM p"""
)
def rule_scores(spark, d):
    """Scores by rules, and how much of a title a query holds."""
    p = fx.table(spark, d, "part").withColumns({"query_id": F.lit(1), "doc_id": col("p_partkey")})
    s = U.rule_scores(p, [(col("p_size") > 25, 2.0), (col("p_type").endswith("STEEL"), 1.5)], col("p_size") / 100)
    return s.join(p.select("doc_id", U.title_ratio(col("p_name"), col("p_type")).alias("ratio")), "doc_id").select(col("doc_id").alias("p_partkey"), F.round("ratio", 6).alias("ratio"), F.round("score", 6).alias("score"))


@query(f"WITH c AS (SELECT DISTINCT {fx.STATUTE} AS citation FROM lineitem), n AS (SELECT upper(citation) AS u, min(citation) AS known FROM c GROUP BY 1), p AS (SELECT l_suppkey AS query_id, CASE WHEN l_linenumber = 1 THEN 'unknown x' ELSE upper({fx.STATUTE}) END AS citation FROM lineitem WHERE l_quantity >= 48) SELECT query_id, coalesce(known, citation) AS citation, count(*) AS n FROM p LEFT JOIN n ON u = upper(citation) GROUP BY 1, 2")
def spelled_predictions(spark, d):
    """Predictions in the corpus's spelling."""
    x = fx.lines(spark, d)
    p = x.where("l_quantity >= 48").select(col("l_suppkey").alias("query_id"), F.when(col("l_linenumber") == 1, "unknown x").otherwise(F.upper("statute")).alias("citation"))
    return U.proper_case(p, x.select(col("statute").alias("citation")).distinct()).groupBy("query_id", "citation").agg(F.count("*").alias("n"))


# --- against gold


@query(
    f"""WITH c AS (SELECT DISTINCT query_id, channel, doc_id FROM ({fx.CHANNELS_SQL}) c), {_G}, h AS (SELECT c.* FROM c JOIN g USING (query_id, doc_id)), n AS (SELECT query_id, count(*) AS n FROM g GROUP BY 1), a AS (SELECT query_id, min(channel) AS channel FROM h GROUP BY query_id, doc_id HAVING count(*) = 1)
SELECT r.query_id, r.channel, returned, coalesce(hits, 0) AS hits, coalesce(alone, 0) AS alone, coalesce(hits, 0) / n AS recall FROM (SELECT query_id, channel, count(*) AS returned FROM c GROUP BY 1, 2) r LEFT JOIN (SELECT query_id, channel, count(*) AS hits FROM h GROUP BY 1, 2) x USING (query_id, channel) LEFT JOIN (SELECT query_id, channel, count(*) AS alone FROM a GROUP BY 1, 2) y USING (query_id, channel) JOIN n USING (query_id)"""
)
def channel_recall(spark, d):
    """Recall of each channel, and what it alone found."""
    return E.by_channel(fx.channels(spark, d), fx.gold(spark, d))


_TH = [round(0.05 * i, 2) for i in range(1, 20)]


@query(
    f"""WITH {_F}, s AS (SELECT query_id, doc_id, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 0 END AS score FROM f WINDOW w AS (PARTITION BY query_id)), {_G}, t AS (SELECT unnest([{', '.join(map(str, _TH))}]) AS t), n AS (SELECT query_id, count(*) AS g FROM g GROUP BY 1),
x AS (SELECT t, n.query_id, g, count(s.doc_id) FILTER (WHERE round(score, 9) >= t) AS p, count(g.doc_id) FILTER (WHERE round(score, 9) >= t) AS h FROM n CROSS JOIN t LEFT JOIN s ON s.query_id = n.query_id LEFT JOIN g ON g.query_id = s.query_id AND g.doc_id = s.doc_id GROUP BY 1, 2, 3)
SELECT CAST(t AS DOUBLE) AS threshold, round(avg(CASE WHEN h = 0 THEN 0 ELSE 2.0 * h / (p + g) END), 6) AS macro_f1 FROM x GROUP BY 1"""
)
def threshold_sweep(spark, d):
    """Macro F1 at each threshold."""
    s = _fused(spark, d).withColumn("score", F.round(U.minmax(col("score"), ["query_id"]), 9))
    return E.best_threshold(s, fx.gold(spark, d), _TH).withColumn("macro_f1", F.round("macro_f1", 6))


_ARTS = f"concat('Art. ', l_partkey % 400 + 1, ' ', {_CODE})"


@query(
    f"""WITH g AS (SELECT DISTINCT l_suppkey AS query_id, CASE l_linenumber % 3 WHEN 0 THEN upper({fx.STATUTE}) WHEN 1 THEN {_ARTS} ELSE 'Art. 1 Unbekannt' END AS citation FROM lineitem WHERE l_quantity >= 48), c AS (SELECT DISTINCT {fx.STATUTE} AS citation, {_ARTS} AS article FROM lineitem), n AS (SELECT lower(citation) AS l, min(citation) AS known FROM c GROUP BY 1)
SELECT DISTINCT query_id, coalesce(known, c.citation, g.citation) AS citation FROM g LEFT JOIN n ON l = lower(g.citation) LEFT JOIN c ON c.article = g.citation"""
)
def gold_keys(spark, d):
    """Gold as corpus keys: itself, its paragraphs, or as it is."""
    x = fx.table(spark, d, "lineitem")
    g = x.where("l_quantity >= 48").selectExpr("l_suppkey AS query_id", f"CASE l_linenumber % 3 WHEN 0 THEN upper({fx.STATUTE}) WHEN 1 THEN {_ARTS} ELSE 'Art. 1 Unbekannt' END AS citation")
    c = x.selectExpr(f"{fx.STATUTE} AS citation").distinct()
    return E.expanded_gold(g, c, x.selectExpr(f"{_ARTS} AS article", f"{fx.STATUTE} AS child").distinct())


@query(
    f"""WITH g AS (SELECT DISTINCT CASE l_linenumber % 3 WHEN 0 THEN {fx.STATUTE} WHEN 1 THEN {_ARTS} ELSE concat('Art. ', l_partkey, ' Unbekannt') END AS citation FROM lineitem), c AS (SELECT DISTINCT {fx.STATUTE} AS citation, {_ARTS} AS article FROM lineitem)
SELECT count(*) AS gold, count(*) FILTER (WHERE citation IN (SELECT citation FROM c)) AS exact, count(*) FILTER (WHERE citation IN (SELECT citation FROM c) OR citation IN (SELECT article FROM c)) AS expanded FROM g"""
)
def gold_coverage(spark, d):
    """How much gold the corpus has, before and after expansion."""
    x = fx.table(spark, d, "lineitem")
    g = x.selectExpr(f"CASE l_linenumber % 3 WHEN 0 THEN {fx.STATUTE} WHEN 1 THEN {_ARTS} ELSE concat('Art. ', l_partkey, ' Unbekannt') END AS citation")
    return E.gold_coverage(g, x.selectExpr(f"{fx.STATUTE} AS citation"), x.selectExpr(f"{_ARTS} AS article", f"{fx.STATUTE} AS child").distinct())


@query(
    f"""WITH {_F}, {_G}, s AS (SELECT g.query_id, count(*) AS n_gold, count(f.doc_id) AS pool, count(f.doc_id) FILTER (WHERE rk <= 200) AS ranked, count(f.doc_id) FILTER (WHERE rk <= 40) AS final FROM g LEFT JOIN f ON f.query_id = g.query_id AND f.doc_id = g.doc_id GROUP BY 1)
SELECT *, CASE WHEN greatest(n_gold - pool, pool - ranked, ranked - final) = 0 THEN NULL WHEN n_gold - pool >= greatest(pool - ranked, ranked - final) THEN 'pool' WHEN pool - ranked >= ranked - final THEN 'ranked' ELSE 'final' END AS worst FROM s"""
)
def stage_recall(spark, d):
    """Gold left after each stage, and the stage that lost most."""
    f = _fused(spark, d)
    return E.stage_recall([("pool", f), ("ranked", f.where("rk <= 200")), ("final", f.where("rk <= 40"))], fx.gold(spark, d))


@query(
    f"""WITH {_F}, {_G}, k AS (SELECT query_id, doc_id FROM f WHERE rk <= 40), l AS (SELECT query_id, doc_id FROM g WHERE (query_id, doc_id) NOT IN (SELECT query_id, doc_id FROM k)) SELECT query_id, doc_id, CASE WHEN p_size > 45 THEN 'source_coverage' WHEN p_size < 20 THEN 'size' WHEN p_brand < 'Brand#3' THEN 'brand' ELSE 'topk_budget' END AS reason FROM l JOIN part ON p_partkey = doc_id"""
)
def first_failures(spark, d):
    """Why gold was lost: corpus, the first decision it doesn't meet, budget."""
    part = fx.table(spark, d, "part").withColumn("doc_id", col("p_partkey"))
    g = fx.gold(spark, d)
    plan = g.select("query_id").distinct().select("query_id", F.explode(F.array(F.struct(F.lit(1).alias("seq"), F.lit("size").alias("segment"), F.lit("big").alias("value")), F.struct(F.lit(2).alias("seq"), F.lit("brand").alias("segment"), F.lit("late").alias("value")))).alias("x")).select("query_id", "x.*")
    opts = part.where("p_size >= 20").select("doc_id", F.lit("size").alias("segment"), F.lit("big").alias("value")).union(part.where("p_brand >= 'Brand#3'").select("doc_id", F.lit("brand"), F.lit("late")))
    return E.first_failure(g, part.where("p_size <= 45"), plan, opts, _fused(spark, d).where("rk <= 40"))


@query(
    f"""WITH {_F}, g AS (SELECT DISTINCT g.query_id, g.doc_id, p_mfgr AS family FROM ({fx.GOLD_SQL}) g JOIN (SELECT p_partkey, substr(p_brand, 1, 7) AS p_mfgr FROM part) p ON p_partkey = doc_id), h AS (SELECT g.*, f.doc_id AS h FROM g LEFT JOIN f ON f.query_id = g.query_id AND f.doc_id = g.doc_id AND rk <= 100)
SELECT family, count(*) AS gold, count(h) AS hits, count(h) / count(*) AS recall FROM h GROUP BY 1 UNION ALL SELECT 'all', count(*), count(h), count(h) / count(*) FROM h"""
)
def recall_by_family(spark, d):
    """Recall within the first hundred by family and overall."""
    part = fx.table(spark, d, "part").select(col("p_partkey").alias("doc_id"), F.substring("p_brand", 1, 7).alias("family"))
    return E.by_family(_fused(spark, d), fx.gold(spark, d).join(part, "doc_id"), 100)


@query(
    f"""WITH {_F}, {_G}, b AS (SELECT g.query_id, count(f.doc_id) FILTER (WHERE rk <= 200) / count(*) AS before, count(f.doc_id) FILTER (WHERE rk <= 50) / count(*) AS after, count(f.doc_id) FILTER (WHERE rk <= 200 AND rk > 50) AS dropped FROM g LEFT JOIN f ON f.query_id = g.query_id AND f.doc_id = g.doc_id GROUP BY 1), c AS (SELECT f.query_id, count(*) AS kept, count(*) FILTER (WHERE rk > 50) AS guarded FROM f LEFT JOIN g ON f.query_id = g.query_id AND f.doc_id = g.doc_id WHERE rk <= 50 OR g.doc_id IS NOT NULL GROUP BY 1)
SELECT query_id, before, after, dropped, kept, guarded FROM b JOIN c USING (query_id)"""
)
def stage_audit(spark, d):
    """Recall before and after a cut, and what a guarded cut would keep."""
    f, g = _fused(spark, d), fx.gold(spark, d)
    a = E.audit_stage(g, f.where("rk <= 200"), f.where("rk <= 50"))
    c = E.guarded_cut(f.select("query_id", "doc_id", "score"), 50, g, True).groupBy("query_id").agg(F.count("*").alias("kept"), F.count_if("guarded").alias("guarded"))
    return a.join(c, "query_id")


@query(f"WITH {_G}, b AS (SELECT DISTINCT doc_id FROM g WHERE doc_id IN (SELECT p_partkey FROM part WHERE p_size <= 30)), q AS (SELECT DISTINCT l_suppkey AS query_id FROM lineitem WHERE l_quantity >= 50), o AS (SELECT g.query_id, 'brand' AS segment, p_brand AS value, count(*) AS n FROM g JOIN part ON p_partkey = doc_id GROUP BY 1, 3) SELECT query_id, 'bank' AS kind, NULL AS value, (SELECT count(*) FROM b) AS n FROM q UNION ALL SELECT query_id, segment, value, n FROM o")
def audit_candidates(spark, d):
    """For audits: the bank of gold as every query's candidates, and the plan that gold would make."""
    g, part = fx.gold(spark, d), fx.table(spark, d, "part").withColumn("doc_id", col("p_partkey"))
    q = fx.table(spark, d, "lineitem").where("l_quantity >= 50").select(col("l_suppkey").alias("query_id"))
    bank = E.gold_bank(g, part.where("p_size <= 30"), q).groupBy("query_id").agg(F.count("*").alias("n"))
    plan = E.oracle_plan(g, part.select("doc_id", F.lit("brand").alias("segment"), col("p_brand").alias("value")))
    return bank.select("query_id", F.lit("bank").alias("kind"), F.lit(None).cast("string").alias("value"), "n").union(plan.select("query_id", "segment", "value", "n"))


@query(f"WITH e AS ({fx.EDGES_SQL}), g AS (SELECT DISTINCT l_suppkey AS query_id, {fx.COURT} AS c FROM lineitem WHERE l_quantity >= 45 UNION SELECT DISTINCT l_suppkey, {fx.STATUTE} FROM lineitem WHERE l_quantity >= 45) SELECT a.query_id, source, target FROM g a JOIN e ON a.c = source JOIN g b ON b.query_id = a.query_id AND b.c = target")
def linked_gold(spark, d):
    """Edges between gold citations of one query."""
    x = fx.lines(spark, d).where("l_quantity >= 45")
    g = x.select(col("l_suppkey").alias("query_id"), col("court").alias("citation")).union(x.select("l_suppkey", "statute"))
    return E.linked_gold(g, fx.edges(spark, d))


@query("SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS mean_x, round(avg(l_extendedprice), 4) AS mean_y, quantile_cont(l_quantity, 0.5) AS median_x, round(quantile_cont(l_extendedprice, 0.5), 4) AS median_y, round(sum(l_quantity) / sum(l_extendedprice), 9) AS ratio, round(corr(l_quantity, l_extendedprice), 6) AS corr FROM lineitem GROUP BY 1")
def paired_figures(spark, d):
    """Means, medians, ratio and correlation of two columns by group."""
    f = E.figures(fx.table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag")
    return f.select("l_returnflag", "n", F.round("mean_x", 6).alias("mean_x"), F.round("mean_y", 4).alias("mean_y"), "median_x", F.round("median_y", 4).alias("median_y"), F.round("ratio", 9).alias("ratio"), F.round("corr", 6).alias("corr"))


@query(f"SELECT {_CODE} AS law_code, count(DISTINCT l_partkey % 400 + 1) AS articles, count(*) AS citations FROM lineitem WHERE l_quantity >= 46 GROUP BY 1")
def articles_per_code(spark, d):
    """Different articles of each code in gold."""
    g = fx.table(spark, d, "lineitem").where("l_quantity >= 46").selectExpr(f"{_CODE} AS law_code", "l_partkey % 400 + 1 AS article")
    return E.articles_per_code(g)


@query(f"WITH {_F}, {_G}, k AS (SELECT unnest([50, 100, 200, 500, 1000, 2000]) AS k), n AS (SELECT query_id, count(*) AS n FROM g GROUP BY 1), r AS (SELECT k, n.query_id, count(g.doc_id) FILTER (WHERE rk <= k) / n AS r FROM n CROSS JOIN k LEFT JOIN f ON f.query_id = n.query_id LEFT JOIN g ON g.query_id = f.query_id AND g.doc_id = f.doc_id GROUP BY 1, 2, n) SELECT min(k) FILTER (WHERE m >= 0.5) AS k FROM (SELECT k, avg(r) AS m FROM r GROUP BY 1) x")
def smallest_size(spark, d):
    """The smallest cut with a mean recall of a half."""
    return E.smallest_k(_fused(spark, d), fx.gold(spark, d), [50, 100, 200, 500, 1000, 2000], 0.5)


_DOC_CODE = fx.case("p_partkey % 5", fx.CODES)


@query(
    f"""WITH c AS ({fx.CHANNELS_SQL}), b AS (SELECT query_id, channel, doc_id, min(rk) AS rk FROM c WHERE channel <> 'R' GROUP BY 1, 2, 3), s AS (SELECT query_id, doc_id, sum(CASE channel WHEN 'A' THEN 1.0 ELSE 0.5 END / (60 + rk)) * (1 + 0.2 * any_value(p_size) / 50.0) AS score FROM b JOIN part ON p_partkey = doc_id GROUP BY 1, 2),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rk FROM s) x WHERE rk <= 60), h AS (SELECT *, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 0 END AS u FROM f WHERE rk <= 20 WINDOW w AS (PARTITION BY query_id)),
m AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(0.7 * u + 0.3 * CASE WHEN p_size > 25 THEN p_size / 50.0 ELSE 0 END, 6) DESC, doc_id) AS rk FROM h JOIN part ON p_partkey = doc_id UNION ALL SELECT query_id, doc_id, rk FROM f WHERE rk > 20),
j AS (SELECT query_id, rk, concat('Art. ', p_partkey % 400 + 1, ' ', {_DOC_CODE}) AS citation FROM m JOIN part ON p_partkey = doc_id WHERE p_brand >= 'Brand#2'), k AS (SELECT DISTINCT concat('Art. ', l_partkey % 400 + 1, ' ', {_CODE}) AS article, {fx.STATUTE} AS child FROM lineitem),
e AS (SELECT query_id, coalesce(child, citation) AS citation, min(rk) AS pos FROM j LEFT JOIN k ON article = citation GROUP BY 1, 2) SELECT query_id, citation, CAST(row_number() OVER (PARTITION BY query_id ORDER BY pos, citation) AS INT) AS rk FROM e"""
)
def full_retrieval(spark, d):
    """Channels, weighted fusion with authority, model scores, verdicts and granularity in one call."""
    from ..operators.pipeline import retrieve

    part = fx.table(spark, d, "part").withColumn("doc_id", col("p_partkey"))
    queries = fx.table(spark, d, "supplier").select(col("s_suppkey").alias("query_id"))
    named = part.selectExpr("doc_id", f"concat('Art. ', p_partkey % 400 + 1, ' ', {_DOC_CODE}) AS citation")
    pairs = fx.channels(spark, d).select("query_id", "doc_id").distinct().join(part, "doc_id").join(queries, "query_id", "left_semi")
    scores = pairs.where("p_size > 25").select("query_id", "doc_id", (col("p_size") / 50).alias("p"))
    verdicts = pairs.select("query_id", "doc_id", F.when(col("p_brand") >= "Brand#2", "YES").otherwise("NO").alias("verdict"))
    about = part.select("doc_id", (col("p_size") / 50).alias("authority"))
    return retrieve(fx.channels(spark, d), named, fx.lines(spark, d).select(col("statute").alias("citation")), {"A": 1.0, "N": 0.5, "R": 0.0}, about, 0.2, scores, verdicts, 60, 20)

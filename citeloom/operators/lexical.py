"""Inverted index and BM25. The index is three tables: postings (field, term, doc_id, tf), lengths and term statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens

#: Rows of query terms (some 100 bytes each) that may be broadcast; more are joined by shuffle.
QUERY_TERMS = 500_000


def postings(docs: DataFrame, id_col: str = "doc_id", fields: dict[str, str] | None = None) -> DataFrame:
    """field, term, doc_id, tf. Counts are made per document inside the scan's partition before the shuffle."""
    fields = fields or {"text": "text"}
    words = lambda f, c: F.transform(tokens(F.coalesce(F.col(c), F.lit(""))), lambda t: F.struct(F.lit(f).alias("field"), t.alias("term")))
    parts = F.explode(F.flatten(F.array(*[words(f, c) for f, c in fields.items()])))
    return docs.select(F.col(id_col).alias("doc_id"), parts.alias("p")).groupBy(F.col("p.field").alias("field"), F.col("p.term").alias("term"), "doc_id").agg(F.count("*").alias("tf"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    """The table, to be broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def bm25(docs: DataFrame, queries: DataFrame, k: int, k1: float = 1.2, b: float = 0.75, qtf_cap: int | None = 3, weights: dict[str, float] | None = None, fields: dict[str, str] | None = None) -> DataFrame:
    """query_id, doc_id, score, rk. queries: query_id, query. Only postings of query terms are counted and joined.

    A posting's weight is settled before the queries come in, so the one join that multiplies rows (postings by the
    queries that ask for the term) runs on rows dealt by doc_id and is summed where it stands.
    """
    fields = fields or {"text": "text"}
    q = queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    q = q.withColumn("qtf", F.least("qtf", F.lit(qtf_cap))) if qtf_cap else q
    few = _small(q, QUERY_TERMS)
    part = lambda f, c: F.struct(F.lit(f).alias("field"), tokens(F.coalesce(F.col(c), F.lit(""))).alias("ws"))
    words = docs.select("doc_id", F.explode(F.array(*[part(f, c) for f, c in fields.items()])).alias("p")).select("doc_id", "p.field", "p.ws", F.size("p.ws").alias("dl"))
    avg = words.groupBy("field").agg(F.avg("dl").alias("avgdl"), F.count("*").alias("n"))
    asked = _small(q.select("term").distinct(), QUERY_TERMS)
    post = words.select("doc_id", "field", "dl", F.explode("ws").alias("term")).join(asked, "term", "left_semi").groupBy("doc_id", "field", "dl", "term").agg(F.count("*").alias("tf"))
    df = post.groupBy("field", "term").agg(F.count("*").alias("df"))
    df = F.broadcast(df) if few is not q else df  # a row for each field and term asked for
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.lit(1.0) if not weights else F.coalesce(F.create_map(*[x for f, w in weights.items() for x in (F.lit(f), F.lit(w))])[F.col("field")], F.lit(0.0))
    s = weight * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    weighed = post.join(df, ["field", "term"]).join(F.broadcast(avg), "field").select("doc_id", "term", s.alias("s"))  # avg: a row a field
    scored = weighed.repartition("doc_id").join(few, "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("s") * F.col("qtf")).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), "doc_id")
    return scored.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)


def holders(docs: DataFrame, queries: DataFrame, run: int = 4) -> DataFrame:
    """query_id, query, doc_id, text of all documents that contain a query, byte for byte.

    A query's words but its first and last are whole words of any text that contains it, so a document is looked up by its
    runs of `run` words and then compared. Queries of fewer words are compared with all documents.
    """
    words = lambda c: F.split(c, r"[^\p{L}\p{N}_]+")
    at = lambda ws, i: F.xxhash64(*[F.get(ws, i + k) for k in range(run)])
    q = queries.where(F.col("query").isNotNull()).withColumn("ws", words(F.col("query")))
    long_, short = q.where(F.size("ws") >= run + 2), q.where(F.size("ws") < run + 2).drop("ws")
    keys = _small(long_.select("query_id", at(F.col("ws"), F.lit(1)).alias("h")).distinct(), QUERY_TERMS)
    runs = docs.select("doc_id", words(F.col("text")).alias("ws")).where(F.size("ws") >= run)
    runs = runs.select("doc_id", F.explode(F.transform(F.sequence(F.lit(0), F.size("ws") - run), lambda i: at(F.col("ws"), i))).alias("h"))
    pairs = runs.join(keys, "h").select(F.col("doc_id").alias("d"), F.col("query_id").alias("q")).distinct()
    texts = docs.select("doc_id", "text")
    near = pairs.join(long_.drop("ws"), F.col("q").eqNullSafe(F.col("query_id"))).join(texts, F.col("d").eqNullSafe(F.col("doc_id"))).drop("d", "q")
    rest = texts.crossJoin(_small(short, QUERY_TERMS))
    cols = ["query_id", "query", "doc_id", "text"]
    return near.select(cols).unionByName(rest.select(cols)).where(F.contains("text", "query"))


def term_codes(pairs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Codes that go with the words of a query: count times idf, the k best. pairs: term, code, n."""
    n = pairs.agg(F.count_distinct("code").alias("total"))
    df = pairs.groupBy("term").agg(F.count_distinct("code").alias("df"))
    q = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term"))
    s = q.join(pairs, "term").join(df, "term").crossJoin(n).groupBy("query_id", "code").agg(F.sum(F.col("n") * F.log(1 + F.col("total") / F.col("df"))).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), "code")
    return s.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)


def expand_concepts(query: DataFrame, corpus: DataFrame, k: int = 25) -> DataFrame:
    """Fuzzy concept matches: exact 1; contained .85 of short over long; shared words over the larger set.

    Each kind but the first needs a shared word, so a join on words finds all candidates. query: query_id, concept.
    """
    words = lambda c: F.array_distinct(tokens(c, 3))
    q = query.select("query_id", F.lower("concept").alias("qc"), words(F.col("concept")).alias("qw"))
    c = corpus.select(F.lower("concept").alias("cc"), words(F.col("concept")).alias("cw")).distinct()
    pair = q.withColumn("w", F.explode("qw")).join(c.withColumn("w", F.explode("cw")), "w").drop("w").dropDuplicates(["query_id", "qc", "cc"])
    short, long_ = F.least(F.length("qc"), F.length("cc")), F.greatest(F.length("qc"), F.length("cc"))
    inside = F.contains("qc", "cc") | F.contains("cc", "qc")
    share = F.size(F.array_intersect("qw", "cw")) / F.greatest(F.size("qw"), F.size("cw"))
    s = pair.withColumn("weight", F.when(F.col("qc") == F.col("cc"), 1.0).otherwise(F.greatest(F.when(inside, 0.85 * short / long_).otherwise(0.0), share)))
    w = Window.partitionBy("query_id", "qc").orderBy(F.desc(F.round("weight", 6)), "cc")
    return s.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k).select("query_id", "qc", "cc", "weight", "rk")

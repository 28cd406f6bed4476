"""Line dedup by content-defined chunks of lines, in DataFrame functions alone.

A line's hash is the number of the first eight hex digits of its MD5. A rolling hash over the hashes of a line and of the
line before chooses the lines that end a chunk, so a chunk's borders depend on its own lines and survive shifts. A chunk
of several lines whose bytes appear earlier (in a smaller doc_id, or before it in its own document) is removed with its
line breaks. Hashes find candidates; bytes decide: texts are compared with the earliest bearer's, and one that differs
from it under an equal hash stays.

Null text stays null, with no lines. An empty text has one empty line. Rows are told apart by doc_id and text: rows that
share a doc_id but not the text are documents of their own, in the order of (doc_id, hashes of the text); rows equal in
both count as one document and get the same result. Null ids come last. One-line chunks are never removed. Other columns
pass through whatever their names, but for `n_lines` and `n_removed`, which are the operator's. An empty table gives no rows.

Only the documents that lose something have a list of chunks; it is broadcast while such lists are few, else both sides are
shuffled by document. A chunk that very many documents bear is one row of the small side; the other side is dealt anew by
the planner's skew join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: One line in SPARSE ends a chunk; chunks of fewer lines than LEAST stay; repeated chunks and documents that may be broadcast (some 60 bytes each).
SPARSE, LEAST, BROADCAST_ROWS = 3, 2, 400_000
_KEY = ("d", "a", "b")
_LAST = (1 << 63) - 1


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once, however the planner merges projections."""
    return F.transform(F.array(value), body)[0]


def chunks(lines: Column) -> Column:
    """array<struct<s, n>>: where each chunk begins (from 1) and its lines."""

    def pairs(hashes: Column) -> Column:
        zero = F.array(F.lit(0).cast("long"))
        return F.slice(F.zip_with(F.concat(zero, hashes), F.concat(hashes, zero), lambda a, b: (a * 31 + b) % SPARSE), 1, F.size(lines))

    hashes = F.transform(lines, lambda x: F.conv(F.substring(F.md5(F.encode(x, "UTF-8")), 1, 8), 16, 10).cast("long"))
    marked = F.transform(_let(hashes, pairs), lambda r, i: F.when(r == 0, i + 2))
    starts = F.array_distinct(F.concat(F.array(F.lit(1)), F.filter(marked, lambda p: p.isNotNull() & (p <= F.size(lines)))))
    return _let(starts, lambda s: F.zip_with(s, F.concat(F.slice(s, 2, F.size(s)), F.array(F.size(lines) + 1)), lambda a, b: F.struct(a.alias("s"), (b - a).alias("n"))))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _repeated(docs: DataFrame) -> DataFrame:
    """The key of each document that loses chunks, and these, by first line. docs: key, text."""
    cut = docs.select(F.struct(*_KEY).alias("k"), _lines(F.col("text")).alias("l")).withColumn("c", F.explode(F.filter(chunks(F.col("l")), lambda c: c["n"] >= LEAST)))
    piece = cut.select(F.struct("k.*", F.col("c.s").alias("s")).alias("at"), F.array_join(F.slice("l", F.col("c.s"), F.col("c.n")), "\n").alias("t"))
    piece = piece.select("at", "t", F.xxhash64("t", F.length("t")).alias("h"))
    again = piece.groupBy("h").agg(F.count("*").alias("m"), F.min("at").alias("first")).where("m > 1").select("h", "first")
    again = materialize(again, "repeated")
    few = again.count() <= BROADCAST_ROWS
    found = materialize(piece.join(F.broadcast(again) if few else again, "h"), "chunks")
    kept = found.where(F.col("at") == F.col("first")).groupBy("h").agg(F.min("t").alias("kept"))
    gone = found.join(kept, "h").where((F.col("t") == F.col("kept")) & (F.col("at") != F.col("first")))
    return gone.groupBy(*[F.col(f"at.{c}").alias(c) for c in _KEY]).agg(F.collect_set("at.s").alias("gone"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The input's columns with `text` rewritten, and n_lines, n_removed (lines)."""
    whole = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("whole")
    keyed = docs.select(whole, "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("d"), F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"))
    hit = materialize(_repeated(keyed.where(F.col("text").isNotNull()).drop("whole")), "cut")
    joined = keyed.join(F.broadcast(hit) if hit.count() <= BROADCAST_ROWS else hit, [*_KEY], "left")
    left = lambda l: F.flatten(F.transform(F.filter(chunks(l), lambda c: ~F.array_contains("gone", c["s"])), lambda c: F.slice(l, c["s"], c["n"])))
    cut = lambda l: _let(left(l), lambda k: F.struct(F.array_join(k, "\n").alias("text"), F.size(l).alias("n"), (F.size(l) - F.size(k)).alias("gone")))
    as_is = F.struct("text", F.when(F.col("text").isNull(), 0).otherwise(F.size(_lines(F.col("text")))).alias("n"), F.lit(0).alias("gone"))
    out = joined.select("whole", F.when(F.col("gone").isNotNull() & F.col("text").isNotNull(), _let(_lines(F.col("text")), cut)).otherwise(as_is).alias("out"))
    rest = [F.col("out.text").alias(c) if c == "text" else F.col("whole").getField(c).alias(c) for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    return out.select(*rest, F.col("out.n").alias("n_lines"), F.col("out.gone").alias("n_removed"))


SQL = f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
h AS (SELECT *, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) AS h FROM l),
b AS (SELECT *, (coalesce(lag(h) OVER w, 0) * 31 + h) % {SPARSE} = 0 AS ends FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT doc_id, line, i, coalesce(sum(CAST(ends AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM b),
g AS (SELECT doc_id, c, string_agg(line, chr(10) ORDER BY i) AS t, count(*) AS n FROM c GROUP BY doc_id, c),
r AS (SELECT doc_id, c, row_number() OVER (PARTITION BY t ORDER BY doc_id, c) > 1 AS gone FROM g WHERE n >= {LEAST}),
k AS (SELECT c.doc_id, c.i, c.line, coalesce(r.gone, FALSE) AS gone FROM c LEFT JOIN r ON c.doc_id = r.doc_id AND c.c = r.c)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS text, CAST(count(*) AS INTEGER) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS INTEGER) AS n_removed
FROM k GROUP BY doc_id
"""

"""Whole enriched rows: formal anchors from the source text, the model's hints sorted, views for retrieval, quality marks.

rows: citation, text, and structs `said` (what a model described: legal_area, topic, subtopic, micro_topic, concepts_en,
terms_original, paragraph_role, outcome_signal, doctrinal_rule, legal_test, legal_rule, statute_anchors, case_anchors) and
`known` (deterministic: court_base, statutes, cases, law_codes, notification). One select after the parse; no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import citations as C
from ..functions import enrich as E
from ..functions import parsers as P
from ..functions import text as T

_RULES = ("doctrinal_rule", "legal_test", "legal_rule")


def case_anchors(found: Column, citation: Column, base: Column) -> Column:
    """struct(cases, own, pages, cantonal): page references apart, references to the own judgment out, bounded as 80/40/40/40."""
    page = lambda x: x.rlike(r"\sS\.\s*\d")
    mine = lambda x: (C.court_base(x) == base) | (x == citation)
    other = lambda x: x.rlike(r"^(?:VGE|EGV|ACJC|ATA|TAF|BVGer|BVGE|TPF|SK|BB|RR|VG|KG|OGer|VB)\b")
    cut = lambda a, n: F.slice(F.array_distinct(a), 1, n)
    return F.struct(
        cut(F.filter(found, lambda x: ~page(x) & ~mine(x) & ~other(x)), 80).alias("cases"), cut(F.filter(found, mine), 40).alias("own"), cut(F.filter(found, page), 40).alias("pages"), cut(F.filter(found, lambda x: ~page(x) & ~mine(x) & other(x)), 40).alias("cantonal"),
    )


def normalised(rows: DataFrame) -> DataFrame:
    """citation, role, outcome, anchors, rules, views and quality of each row."""
    none = F.array().cast("array<string>")
    said, known = (lambda c: F.col(f"said.{c}")), (lambda c: F.col(f"known.{c}"))
    lists = lambda c: F.coalesce(c, none)
    refs = lambda family: F.transform(F.filter("refs", lambda x: x["family"] == family), lambda x: x["citation"])
    hints = F.concat(lists(said("statute_anchors")), lists(said("case_anchors")))
    r = rows.withColumn("text", T.clean(F.col("text"))).withColumn("refs", P.all_references("text"))
    r = r.withColumn("base", F.coalesce(F.nullif(T.clean(known("court_base")), F.lit("")), C.court_base(F.col("citation"))))
    r = r.withColumn("statutes", F.slice(F.array_distinct(F.concat(refs("law"), lists(known("statutes")))), 1, 80))
    r = r.withColumn("c", case_anchors(F.concat(refs("court"), lists(known("cases"))), F.col("citation"), F.col("base")))
    r = r.withColumn("role", E.paragraph_role(said("paragraph_role"), F.col("text"), known("notification")))
    r = r.withColumn("outcome", E.outcome_signal(said("outcome_signal"), F.col("text"), F.col("role.role")))
    of = lambda kind: F.filter(hints, lambda h: E.nonformal(h) == kind)
    signals = {k: F.slice(F.array_distinct(F.concat(E.signal_terms(F.col("text"), w), of(k))), 1, 60) for k, w in E.SIGNALS.items()}
    quiet = F.col("role.role").isin(*E.WITHOUT_RULES)
    rule = lambda c: F.when(quiet, "").otherwise(T.clean(said(c)))
    topic = T.field_join(said("legal_area"), said("topic"), said("subtopic"), said("micro_topic"))
    joined = lambda *parts: F.array_join(F.array_distinct(F.filter(F.concat(*parts), lambda x: x != "")), " | ")
    views = F.struct(
        topic.alias("topic_path"), joined(F.array(topic), lists(said("concepts_en"))).alias("semantic"), joined(lists(said("terms_original"))).alias("original_terms"), joined(F.col("statutes"), signals["legal_source_anchors"], lists(known("law_codes"))).alias("statutes"),
        joined(F.array(F.coalesce("base", F.lit(""))), F.col("c.cases")).alias("cases"), joined(F.array(*[rule(c) for c in _RULES])).alias("rules"), joined(F.array(F.col("role.role"), F.col("outcome.outcome"))).alias("procedure"), F.substring("text", 1, 1200).alias("context"),
    )
    quality = F.struct(
        (F.size("statutes") > 0).alias("has_statute"), (F.size("c.cases") > 0).alias("has_case"), (topic != "").alias("has_topic"), F.col("role.role").isin("notification", "costs").alias("low_value"), F.size(F.filter(hints, lambda h: E.nonformal(h).isNotNull())).alias("moved"),
        (quiet & (joined(F.array(*[T.clean(said(c)) for c in _RULES])) != "")).alias("rules_suppressed"),
    )
    return r.select("citation", "base", F.col("role.role").alias("role"), F.col("role.corrected").alias("role_corrected"), F.col("outcome.outcome").alias("outcome"), F.col("outcome.corrected").alias("outcome_corrected"), "statutes", "c.cases", "c.own", "c.pages", "c.cantonal", *[v.alias(k) for k, v in signals.items()], views.alias("views"), quality.alias("quality"))


def repaired(words: DataFrame, vocabulary: DataFrame, known: DataFrame) -> DataFrame:
    """word, repaired: a known repair, else the round trip through Windows-1252 if it is a word of the vocabulary, else the
    first spelling with umlauts that is one; null if none is. vocabulary: word; known: word, fixed."""
    w = words.select("word").distinct()
    vocab = vocabulary.select(F.col("word").alias("option")).distinct()
    options = w.select("word", F.posexplode(F.concat(F.array(P.repair_mojibake("word")), E.umlaut_candidates(F.col("word")))).alias("at", "option")).where("option <> word")
    found = options.join(vocab, "option", "left_semi").groupBy("word").agg(F.min_by("option", "at").alias("best"))
    return w.join(known.select("word", "fixed"), "word", "left").join(found, "word", "left").select("word", F.coalesce("fixed", "best").alias("repaired"))


def repaired_in_source(words: DataFrame) -> DataFrame:
    """id, word, repaired: the first spelling with umlauts that stands in the row's own source text. words: id, word, source."""
    options = F.concat(F.array("word"), E.umlaut_candidates(F.col("word")))
    return words.select("id", "word", F.get(F.filter(options, lambda o: F.contains("source", o)), F.lit(0)).alias("repaired"))


def concepts(docs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """doc_id, labels, areas, terms: dictionary terms (term, label, area) that stand in the text word by word.

    A term's first word finds its candidates by a join; the term is then looked for in the text, so a dictionary of any size works.
    """
    d = dictionary.select(F.lower("term").alias("term"), "label", "area").distinct()
    split = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    heads = d.select("*", F.get(split(F.col("term")), F.lit(0)).alias("w")).where("w IS NOT NULL")
    text = F.concat(F.lit(" "), F.array_join(split(F.col("text")), " "), F.lit(" "))
    t = docs.where(F.col("text").isNotNull()).select("doc_id", text.alias("t"))
    near = t.select("doc_id", F.explode(F.array_distinct(F.split(F.trim("t"), " "))).alias("w")).join(heads, "w").join(t, "doc_id")
    hit = near.where(F.contains("t", F.concat(F.lit(" "), F.array_join(split(F.col("term")), " "), F.lit(" "))))
    each = lambda c: F.array_sort(F.collect_set(c)).alias(f"{c}s")
    return hit.groupBy("doc_id").agg(each("label"), each("area"), each("term"))

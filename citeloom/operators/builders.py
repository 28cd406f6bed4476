"""Nested documents and cards from flat rows; one select each, joins only where another table brings a part."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import citations as C
from ..functions import text as T
from . import authority as A


def titles_of_codes(laws: DataFrame) -> DataFrame:
    """law_code, title: the most frequent first part of a law's titles (before ` - `), ties to the first row. laws: law_code, title, row_no."""
    head = F.trim(F.element_at(F.split("title", " - "), 1))
    n = laws.where("law_code IS NOT NULL").groupBy("law_code", head.alias("title")).agg(F.count("*").alias("n"), F.min("row_no").alias("first")).where("title <> ''")
    return n.groupBy("law_code").agg(F.min_by("title", F.struct(-F.col("n"), "first")).alias("title"))


def decisions(rows: DataFrame) -> DataFrame:
    """One row a judgment: its parts from its first row, and how many rows it has. rows: citation, division, docket, year."""
    r = rows.withColumn("base", C.court_base(F.col("citation")))
    return r.groupBy("base").agg(F.min_by(F.struct("division", "docket", "year"), "citation").alias("f"), F.count("*").alias("rows")).select("base", "f.*", "rows")


def choice_cards(rows: DataFrame, titles: DataFrame, k: int = 5) -> DataFrame:
    """kind, value, n, title, examples of the options to choose from: law codes, divisions, years. rows: citation, law_code, division, year."""
    kinds = F.explode(F.filter(F.array(*[F.struct(F.lit(c).alias("kind"), F.nullif(F.col(c).cast("string"), F.lit("")).alias("value")) for c in ("law_code", "division", "year")]), lambda x: x["value"].isNotNull())).alias("o")
    o = rows.select("citation", kinds).select("citation", "o.kind", "o.value")
    w = Window.partitionBy("kind", "value").orderBy("citation")
    n = o.groupBy("kind", "value").agg(F.count("*").alias("n"))
    few = o.dropDuplicates(["kind", "value", "citation"]).withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).groupBy("kind", "value").agg(F.array_join(F.array_sort(F.collect_list("citation")), ";").alias("examples"))
    t = titles.select(F.lit("law_code").alias("kind"), F.col("law_code").alias("value"), "title")
    return n.join(few, ["kind", "value"]).join(t, ["kind", "value"], "left").select("kind", "value", "n", "title", "examples")


def segment_options(rows: DataFrame, segments: list[str]) -> DataFrame:
    """citation, segment, value, selector: every known part of a row, and how it may be chosen by."""
    parts = F.array(*[F.struct(F.lit(c).alias("segment"), F.col(c).cast("string").alias("value")) for c in segments])
    s = rows.select("citation", F.explode(F.array_distinct(F.filter(parts, lambda p: p["value"].isNotNull() & (p["value"] != "")))).alias("p")).select("citation", "p.segment", "p.value")
    kind = F.when(F.col("segment").isin("law_code", "division", "area"), "semantic").when(F.col("segment").isin("base", "docket", "article"), "explicit_only").otherwise("structural")
    return s.withColumn("selector", kind)


def co_signals(options: DataFrame, codes: DataFrame, words: DataFrame, most: int = 8, least: int = 5) -> DataFrame:
    """segment, value, kind, signal, n, share: codes and words that go with an option in `least` documents or more, the most frequent.

    options: doc_id, segment, value; codes, words: doc_id, signal (distinct); words need a 200th of the option's documents besides.
    """
    docs = options.distinct().groupBy("segment", "value").agg(F.count("*").alias("docs"))
    hit = lambda t, kind: options.distinct().join(t.distinct(), "doc_id").groupBy("segment", "value", "signal").agg(F.count("*").alias("n")).withColumn("kind", F.lit(kind))
    n = hit(codes, "law_code").unionByName(hit(words, "keyword")).join(docs, ["segment", "value"])
    n = n.where((F.col("n") >= least) & ((F.col("kind") == "law_code") | (F.col("n") >= F.col("docs") / 200)))
    w = Window.partitionBy("segment", "value", "kind").orderBy(F.desc("n"), "signal")
    return n.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= most).select("segment", "value", "kind", "signal", "n", F.round(F.col("n") / F.col("docs"), 4).alias("share"), "rk")


def merged(static: DataFrame, said: DataFrame, key: str, quiet: tuple[str, ...], roles: tuple[str, ...] = ("costs", "notification")) -> DataFrame:
    """Static rows with a model's record of the same key: static values win, the last record of a key counts (column seq), and
    the columns `quiet` stay empty for rows of the given roles."""
    cols = [c for c in said.columns if c not in (key, "seq")]
    last = said.groupBy(key).agg(F.max_by(F.struct(*cols), "seq").alias("_s"))
    j = static.join(last, key, "left")
    own = lambda c: F.nullif(F.col(c), F.lit("")) if c in static.columns else F.lit(None).cast("string")
    role = F.coalesce(own("role"), F.col("_s.role")) if "role" in cols else own("role")
    value = lambda c: F.when(role.isin(*roles), "").otherwise(F.coalesce(own(c), F.col(f"_s.{c}"))) if c in quiet else F.coalesce(own(c), F.col(f"_s.{c}"))
    rest = [c for c in static.columns if c not in cols]
    return j.select(*rest, *[value(c).alias(c) for c in cols])


def court_documents(cards: DataFrame, most_source: int = 4000, most_vector: int = 2000) -> DataFrame:
    """Nested documents of court rows: retrieval views, filters, links for expansion, ranking.

    cards: line, citation, text, roles (array), low_value, topic, concepts (array), statutes (array), cases (array), cited, division, year.
    """
    base = C.court_base(F.col("citation"))
    source = T.clean(F.col("text"))
    vector = T.field_join(F.col("citation"), F.col("topic"), F.array_join("concepts", ", "), source)
    views = F.struct(T.weighted_join(F.col("citation"), 2).alias("citation"), T.labelled("Statutes", F.array_join("statutes", "; ")).alias("statutes"), F.substring(vector, 1, most_vector).alias("vector_text"), F.substring(source, 1, most_source).alias("source_text"))
    filters = F.struct(base.alias("court_base"), "division", "year", C.docket_kind(F.col("citation")).alias("docket_kind"))
    links = F.struct(F.slice("statutes", 1, 80).alias("statute_links"), F.slice("cases", 1, 80).alias("case_links"))
    ranking = F.struct(F.round(A.court_authority(F.col("roles"), F.col("low_value"), F.col("cited")), 6).alias("authority"), "low_value")
    return cards.select(T.document_key(F.lit("court"), F.col("line"), F.col("citation"), source).alias("doc_id"), F.lit("court").alias("family"), "citation", views.alias("retrieval"), filters.alias("filters"), links.alias("expansion"), ranking.alias("ranking"))


def law_documents(cards: DataFrame, most_source: int = 4000, most_vector: int = 2000) -> DataFrame:
    """Nested documents of statute rows. cards: line, citation, title, text, roles (array), rule, summary, out_degree, cited, specificity, prev, next."""
    source = T.clean(F.col("text"))
    code = C.law_code(C.pick(F.col("citation"), r"(\S+)$"))
    vector = T.field_join(F.col("citation"), F.col("title"), F.col("summary"), source)
    views = F.struct(T.labelled("Title", F.col("title")).alias("title"), F.substring(vector, 1, most_vector).alias("vector_text"), F.substring(source, 1, most_source).alias("source_text"))
    filters = F.struct(code.alias("law_code"), C.pick(F.col("citation"), r"Art\.\s+(\d+[a-z]*)").alias("article"), C.is_article_level(F.col("citation")).alias("article_level"))
    links = F.struct(F.filter(F.array("prev", "next"), lambda x: x.isNotNull()).alias("adjacent_law_links"), C.collapse_to_article(F.col("citation")).alias("parent"))
    score = A.law_authority(F.col("roles"), T.clean(F.col("rule")) != "", T.clean(F.col("summary")) != "", F.col("out_degree"), F.col("cited"), F.col("specificity"))
    return cards.select(T.document_key(F.lit("law"), F.col("line"), F.col("citation"), source).alias("doc_id"), F.lit("law").alias("family"), "citation", views.alias("retrieval"), filters.alias("filters"), links.alias("expansion"), F.struct(F.round(score, 6).alias("authority")).alias("ranking"))


def fan_out(docs: DataFrame) -> dict[str, DataFrame]:
    """The flat tables of nested documents: documents, and one table a kind of link that they have."""
    flat = docs.select("doc_id", "family", "citation", "retrieval.*", "filters.*", "ranking.*")
    names = [f.name for f in docs.schema["expansion"].dataType.fields if f.dataType.typeName() == "array"]
    return {"documents": flat} | {n: docs.select("doc_id", F.posexplode(f"expansion.{n}").alias("place", "target")) for n in names}


def authority_cards(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """What is known of a court row's standing: kind, how often it and its judgment are cited, references out. rows: citation, considerations."""
    base = C.court_base(F.col("citation"))
    n = edges.groupBy(F.col("target").alias("citation")).agg(F.count("*").alias("cited"))
    per = edges.groupBy(C.court_base(F.col("target")).alias("base")).agg(F.count("*").alias("base_cited"))
    out = edges.groupBy(F.col("source").alias("citation")).agg(F.count("*").alias("refs"))
    z = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    kind = F.when(F.col("citation").startswith("BGE"), "leading").when(F.col("citation").rlike(C.MODERN), "federal").otherwise("legacy")
    return rows.withColumn("base", base).join(n, "citation", "left").join(per, "base", "left").join(out, "citation", "left").select("citation", "base", kind.alias("kind"), z("cited"), z("base_cited"), z("refs"), "considerations")


def processed(rows: DataFrame, build, key: str) -> tuple[DataFrame, DataFrame]:
    """(documents, errors) of a builder with a required key: rows that give none go to the errors with the reason, none stop the rest."""
    out = build(rows)
    bad = F.col(key).isNull() | (F.col(key).cast("string") == "")
    return out.where(~bad), out.where(bad).groupBy(F.lit(f"no {key}").alias("reason")).agg(F.count("*").alias("n"))

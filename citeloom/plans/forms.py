"""Citations in many written forms, from templates and the numbers of order lines, with what must be read out of each."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import citations as C
from ..functions import parsers as P
from . import fixtures as fx
from .registry import query

col = F.col
#: (text, references expected, family); n, p, q and c stand for numbers and a law code of the line.
FORMS = [
    ("concat('nach Art. ', n, ' Abs. ', p, ' ', c, ' gilt')", "concat('Art. ', n, ' Abs. ', p, ' ', c)", "'law'"),
    ("concat('(Art. ', n, ' Abs.', p, ' lit. a und b ', c, ')')", "concat('Art. ', n, ' Abs. ', p, ' Bst. a und b ', c)", "'law'"),
    ("concat('Artikel ', n, ' bis ', n + p, ' ', c, '.')", "concat('Art. ', n, '-', n + p, ' ', c)", "'law'"),
    ("concat('Art. ', n, ', ', n + 1, ' und ', n + 2, ' ', c)", "concat('Art. ', n, ' ', c, ';Art. ', n + 1, ' ', c, ';Art. ', n + 2, ' ', c)", "'law'"),
    ("concat('Art. ', n, ' ff. des Gesetzes (', c, '; SR 1', p, '.0)')", "concat('Art. ', n, ' ff. ', c, ';SR 1', p, '.0')", "'law'"),
    ("concat('Art. ', n, ' Nummer ', p, ' SR 31', p, '.0')", "concat('Art. ', n, ' Ziff. ', p, ' 31', p, '.0;SR 31', p, '.0')", "'law'"),
    ("concat('nach § ', n, 'a Abs. ', p, ' ', c, '/ZH')", "concat('§ ', n, 'a Abs. ', p, ' ', c, '/ZH')", "'law'"),
    ("concat('cf. ATF 1', 10 + p, ' II ', n, ' consid. ', p, '.1 et les références')", "concat('BGE 1', 10 + p, ' II ', n, ' E. ', p, '.1')", "'court'"),
    ("concat('DTF 1', 10 + p, ' IV ', n, ' cons. ', p, 'a; BGE 1', 10 + p, ' IV ', n, ' E. ', p, 'a')", "concat('BGE 1', 10 + p, ' IV ', n, ' E. ', p, 'a')", "'court'"),
    ("concat('BGE 1', 10 + p, ' I ', n, ' S. ', n + p, ' ff. und Art. ', n, ' ', c)", "concat('Art. ', n, ' ', c, ';BGE 1', 10 + p, ' I ', n, ' S. ', n + p, ' ff')", "'law'"),
    ("concat('arrêt 5A ', n, '/201', p, ' du 1', p, ' février 2014 c. ', p, '.2')", "concat('5A_', n, '/201', p, ' 1', p, '.02.2014 E. ', p, '.2')", "'court'"),
    ("concat('Urteil 2P.', n, '/200', p, ' vom 0', p, '.05.2007, E. ', p)", "concat('2P.', n, '/200', p, ' 0', p, '.05.2007 E. ', p)", "'court'"),
    ("concat('I ', n, '/0', p, ' vom ', p, '. März 2003')", "concat('I ', n, '/0', p, ' 0', p, '.03.2003')", "'court'"),
    ("concat('BBl 200', p, ' ', n, ' und AS 201', p, ' ', n)", "concat('BBl 200', p, ' ', n, ';AS 201', p, ' ', n)", "'official_reference'"),
    ("concat('Artikel ohne Nummer, Seite ', n)", "''", "''"),
]
#: (text, considerations of the own judgment expected).
BACK = [
    ("concat('wie dargelegt (vgl. E. ', p, '.2 hiervor), primär')", "concat('X E. ', p, '.2')"),
    ("concat('siehe oben E. ', p, '.1 und ', p, '.3.2. Im Übrigen')", "concat('X E. ', p, '.1;X E. ', p, '.3.2')"),
    ("concat('voir considérant ', p, ' ci-dessus')", "concat('X E. ', p)"),
    ("concat('come esposto sopra consid. ', p, 'b')", "concat('X E. ', p, 'b')"),
    ("concat('vgl. ferner E. ', p, '.4; BGE 130 III ', n, ' E. 5')", "concat('X E. ', p, '.4')"),
    ("concat('BGE 130 III ', n, ' E. ', p, ' mit Hinweis')", "''"),
    ("concat('voir l''arrêt 1B_', n, '/2010 du 23 décembre 2010 consid. ', p, '.5 pour la suite')", "''"),
    ("concat('die vorstehend dargestellte Problematik (E. ', p, ')')", "concat('X E. ', p)"),
    ("concat('nach E. ', p, ' der Vorinstanz')", "''"),
]
_LINES = f"SELECT DISTINCT CAST(l_partkey % 400 + 10 AS INT) AS n, CAST(l_linenumber AS INT) AS p, {fx.case('l_suppkey % 5', fx.CODES)} AS c FROM lineitem"


def _table(forms: list[tuple], k: int) -> str:
    return "CASE f " + " ".join(f"WHEN {i} THEN {x[k]}" for i, x in enumerate(forms)) + " END"


def _texts(spark, d, forms: list[tuple]):
    lines = fx.table(spark, d, "lineitem").selectExpr("CAST(l_partkey % 400 + 10 AS INT) AS n", "CAST(l_linenumber AS INT) AS p", f"{fx.case('l_suppkey % 5', fx.CODES)} AS c").distinct()
    numbered = lines.withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(len(forms) - 1))))
    return numbered.selectExpr("f", "n", "p", "c", f"{_table(forms, 0)} AS text")


_NUMBERED = f"SELECT f, n, p, c FROM ({_LINES}) l, (SELECT unnest(range({{}})) AS f) r"


@query(f"SELECT CAST(f AS INT) AS f, n, p, c, {_table(FORMS, 1)} AS refs, {_table(FORMS, 2)} AS family FROM ({_NUMBERED.format(len(FORMS))}) x")
def citation_forms(spark, d):
    """All references of texts in many forms: statutes, sections, reporters, dockets, publications."""
    refs = _texts(spark, d, FORMS).withColumn("r", P.all_references("text"))
    return refs.select("f", "n", "p", "c", F.array_join(F.transform("r", lambda x: x["citation"]), ";").alias("refs"), F.coalesce(F.get("r.family", F.lit(0)), F.lit("")).alias("family"))


@query(f"SELECT CAST(f AS INT) AS f, n, p, {_table(BACK, 1)} AS refs FROM (SELECT DISTINCT f, n, p FROM ({_NUMBERED.format(len(BACK))}) y) x")
def own_reference_forms(spark, d):
    """References back into the own judgment, worded in several languages, and texts that have none."""
    t = _texts(spark, d, BACK).select("f", "n", "p", "text").distinct()
    return t.select("f", "n", "p", F.array_join(P.own_references("text", F.lit("X")), ";").alias("refs"))


#: Corpus keys: (key, family, subfamily, base, pinpoint).
KEYS = [
    ("concat('Art. ', n, ' Abs. ', p, ' ', c)", "'law'", "'statute_article'", "NULL", "NULL"),
    ("concat('BGE 1', 10 + p, ' II ', n, ' E. ', p, '.1')", "'court'", "'bge'", "concat('BGE 1', 10 + p, ' II ', n)", "concat(p, '.1')"),
    ("concat('5A_', n, '/201', p, ' E. ', p)", "'court'", "'federal_tribunal_modern_docket'", "concat('5A_', n, '/201', p)", "concat(p, '')"),
    ("concat('2P.', n, '/200', p, ' 09.05.2007 E. 2')", "'court'", "'federal_tribunal_dot_docket'", "concat('2P.', n, '/200', p)", "'2'"),
    ("concat('I ', n, '/0', p, ' 13.11.2002 E. 4')", "'court'", "'federal_tribunal_legacy_single_letter_docket'", "concat('I ', n, '/0', p)", "'4'"),
    ("concat('12T_', n, '/200', p, ' 29.05.2007 E.')", "'unknown'", "'unknown'", "concat('12T_', n, '/200', p)", "NULL"),
    ("concat('1C/', n, ' E. ', p)", "'unknown'", "'unknown'", "NULL", "concat(p, '')"),
    ("concat('Anhang ', n)", "'unknown'", "'unknown'", "NULL", "NULL"),
]


@query(f"SELECT CAST(f AS INT) AS f, n, p, c, {_table(KEYS, 0)} AS citation, {_table(KEYS, 1)} AS family, {_table(KEYS, 2)} AS subfamily, {_table(KEYS, 3)} AS base, {_table(KEYS, 4)} AS pinpoint FROM ({_NUMBERED.format(len(KEYS))}) x")
def citation_keys(spark, d):
    """What corpus keys are, with what can be made out of malformed ones."""
    k = _texts(spark, d, KEYS).withColumn("x", P.classified(col("text")))
    return k.select("f", "n", "p", "c", col("text").alias("citation"), "x.family", "x.subfamily", "x.base", "x.pinpoint")


_CODES = ("101", "311.0", "PBG/SZ", "EG-ZGB", "ArGV 1", "BV", "BETMG", "StPO", "BetmG-VO 2", "SVGABCDE")
_KIND = "CASE WHEN regexp_full_match(code, '\\d+(\\.\\d+)*') THEN 'systematic_collection_number' WHEN contains(code, '/') THEN 'cantonal_or_slash_abbreviation' WHEN contains(code, '-') THEN 'compound_abbreviation' WHEN regexp_full_match(code, '.*\\s\\d+') THEN 'numbered_abbreviation' WHEN regexp_full_match(code, '[A-Z]{2,6}') THEN 'uppercase_abbreviation' ELSE 'mixedcase_abbreviation' END"


@query(f"SELECT code, {_KIND} AS kind, n FROM (SELECT [{', '.join(repr(c) for c in _CODES)}][l_partkey % {len(_CODES)} + 1] AS code, count(*) AS n FROM lineitem GROUP BY 1) x")
def law_code_kinds(spark, d):
    """Law codes by what they look like."""
    codes = F.array(*map(F.lit, _CODES))
    x = fx.table(spark, d, "lineitem").select(F.get(codes, (col("l_partkey") % len(_CODES)).cast("int")).alias("code")).groupBy("code").agg(F.count("*").alias("n"))
    return x.select("code", C.law_code_kind(col("code")).alias("kind"), "n")


#: Titles of laws: (title, heading, date, aliases with the code first).
TITLES = [
    ("concat('Gesetz über Sache ', n, ' (SachG, XyZ; alt) vom ', p, '. März 19', n + 10 - n % 10)", "concat('Gesetz über Sache ', n, ' (SachG, XyZ; alt) vom ', p, '. März 19', n + 10 - n % 10)", "NULL", "concat(c, ';SachG;XyZ')"),
    ("concat('Verordnung ', n, ' - Abschnitt vom ', p, '. Dezember 2001 (AbC)')", "concat('Verordnung ', n)", "concat('2001-12-0', p)", "concat(c, ';AbC')"),
    ("concat('Erlass vom 1', p, '.Januar 1999 - (klein) - Schluss')", "concat('Erlass vom 1', p, '.Januar 1999')", "concat('1999-01-1', p)", "c"),
    ("'Ohne Datum'", "'Ohne Datum'", "NULL", "c"),
]


@query(f"SELECT CAST(f AS INT) AS f, n, p, c, {_table(TITLES, 1)} AS heading, CASE WHEN f = 0 AND n < 90 THEN concat('19', n + 10 - n % 10, '-03-0', p) ELSE {_table(TITLES, 2)} END AS enacted, {_table(TITLES, 3)} AS aliases FROM ({_NUMBERED.format(len(TITLES))}) x WHERE n < 90 OR f <> 0")
def law_titles(spark, d):
    """Headings, dates and abbreviations out of titles of laws."""
    t = _texts(spark, d, TITLES).where("n < 90 OR f <> 0")
    return t.select("f", "n", "p", "c", C.heading(col("text")).alias("heading"), C.enactment_date(col("text")).alias("enacted"), F.array_join(C.title_aliases(col("text"), col("c")), ";").alias("aliases"))


#: Texts that name law: (text, class, terms to match, clean consideration, raw one).
NAMED = [
    ("concat('nach Art. ', n, ' Abs. ', p, ' StPO or so')", "'HARD'", "concat('\"nach\" OR \"Art\" OR \"', n, '\" OR \"Abs\" OR \"StPO\" OR \"so\"')", "NULL", "NULL"),
    ("concat('Art. ', n, ' XyZ, E. ', p, '.1.')", "'HARD_UNKNOWN_CODE'", "concat('\"Art\" OR \"', n, '\" OR \"XyZ\"')", "concat(p, '.1')", "concat(p, '.1.')"),
    ("concat('§ ', n, ' und consid. ', p)", "'SECTION'", "concat('\"', n, '\" OR \"und\" OR \"consid\"')", "concat(p, '')", "concat(p, '')"),
    ("concat('BGE 1', n, ' cons.')", "'NONE'", "concat('\"BGE\" OR \"1', n, '\" OR \"cons\"')", "NULL", "''"),
    ("concat('gemäss Art. ', n, ' gilt')", "'SOFT'", "concat('\"gemäss\" OR \"Art\" OR \"', n, '\" OR \"gilt\"')", "NULL", "NULL"),
]


@query(
    f"SELECT CAST(f AS INT) AS f, n, p, CASE WHEN f = 3 AND n < 100 THEN 'SOFT' ELSE {_table(NAMED, 1)} END AS class, {_table(NAMED, 2)} AS terms, {_table(NAMED, 3)} AS clean, {_table(NAMED, 4)} AS raw FROM (SELECT DISTINCT f, n, p FROM ({_NUMBERED.format(len(NAMED))}) y) x"
)
def named_law(spark, d):
    """How firmly texts name law, their terms for a match, and considerations read loosely."""
    t = _texts(spark, d, NAMED).select("f", "n", "p", "text").distinct()
    loose = C.loose_consideration(col("text"))
    return t.select("f", "n", "p", C.mention_class(col("text")).alias("class"), C.match_terms(col("text")).alias("terms"), loose["clean"].alias("clean"), loose["raw"].alias("raw"))


@query(
    f"""SELECT l_orderkey, count(DISTINCT {fx.STATUTE}) AS laws, count(DISTINCT {fx.COURT}) AS cases, count(DISTINCT {fx.STATUTE}) AS statute, count(DISTINCT {fx.COURT}) AS court, 1 AS official, 1 AS other, array_to_string(list_sort(list_distinct(list(concat(l_partkey % 400 + 1, ' ', {fx.case('l_suppkey % 5', fx.CODES)})))), ';') AS anchors FROM lineitem GROUP BY 1"""
)
def reference_lists(spark, d):
    """Lists of references split into laws and cases and by family, and a row's anchors in canonical form."""
    x = fx.lines(spark, d).groupBy("l_orderkey").agg(F.collect_set("statute").alias("s"), F.collect_set("court").alias("k"))
    x = x.withColumn("refs", F.concat("s", "k")).withColumn("all", F.concat("refs", F.array(F.lit("SR 101"), F.lit("Anhang 1"))))
    fam, two = C.references_by_family(col("all")), C.split_references(col("refs"))
    n = [F.size(fam[f]).cast("long").alias(f) for f in ("statute", "court")] + [F.size(fam[f]).alias(f) for f in ("official", "other")]
    return x.select("l_orderkey", F.size(two["laws"]).cast("long").alias("laws"), F.size(two["cases"]).cast("long").alias("cases"), *n, F.array_join(F.array_sort(C.row_anchors(col("s"))), ";").alias("anchors"))


@query(
    f"""WITH c AS (SELECT DISTINCT {fx.STATUTE} AS citation, concat('Art. ', l_partkey % 400 + 1, ' ', {fx.case('l_suppkey % 5', fx.CODES)}) AS article FROM lineitem), m AS (SELECT DISTINCT l_suppkey AS query_id, CASE l_linenumber WHEN 1 THEN {fx.STATUTE} WHEN 2 THEN upper({fx.STATUTE}) WHEN 3 THEN concat('Art. ', l_partkey % 400 + 1, ' ', {fx.case('l_suppkey % 5', fx.CODES)}) ELSE concat('Art. ', l_partkey, ' Abs. 9 Xy') END AS citation, l_linenumber AS k FROM lineitem WHERE l_quantity >= 45)
SELECT DISTINCT query_id, m.citation, CASE k WHEN 1 THEN m.citation WHEN 2 THEN n.known WHEN 3 THEN a.citation END AS found, CASE WHEN k = 1 THEN 'exact' WHEN k = 2 THEN 'spelling' WHEN k = 3 THEN 'paragraphs' ELSE 'none' END AS how FROM m LEFT JOIN (SELECT lower(citation) AS l, min(citation) AS known FROM c GROUP BY 1) n ON k = 2 AND l = lower(m.citation) LEFT JOIN c a ON k = 3 AND a.article = m.citation"""
)
def verified_citations(spark, d):
    """Mentions as the corpus has them: exactly, in its spelling, by paragraphs, not at all."""
    from ..operators import granularity as R

    x = fx.table(spark, d, "lineitem")
    art = f"concat('Art. ', l_partkey % 400 + 1, ' ', {fx.case('l_suppkey % 5', fx.CODES)})"
    m = x.where("l_quantity >= 45").selectExpr("l_suppkey AS query_id", f"CASE l_linenumber WHEN 1 THEN {fx.STATUTE} WHEN 2 THEN upper({fx.STATUTE}) WHEN 3 THEN {art} ELSE concat('Art. ', l_partkey, ' Abs. 9 Xy') END AS citation")
    return R.verified(m, x.selectExpr(f"{fx.STATUTE} AS citation"))

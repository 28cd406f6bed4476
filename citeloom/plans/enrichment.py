"""Queries over enriched paragraphs, made from templates with the results they must have."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import enrich as E
from ..operators import normalise as N
from . import fixtures as fx
from .registry import query

col = F.col
#: (text, role said, notification, outcome said, role expected, outcome expected)
ROWS = [
    ("Die Gerichtskosten von Fr. 1000 werden auferlegt", "holding", False, "dismissed", "costs", "none"),
    ("Demnach erkennt das Gericht: Die Beschwerde wird abgewiesen", "reasoning", False, "granted", "disposition", "dismissed"),
    ("Le recours est partiellement fondé; le recours est admis", "neutral", False, "none", "disposition", "partial"),
    ("Die Sache wird zu weiterer Abklärung an das Amt zurückgewiesen", "holding", False, "granted", "holding", "remitted"),
    ("Auf die Sache ist nicht einzutreten", "obiter", False, "dismissed", "reasoning", "inadmissible"),
    ("Im vorliegenden Fall fehlt es daran", "Background", False, "neutral", "application", "neutral"),
    ("Gemäss Art. 5 BV gilt dies", "reasoning", False, "granted", "legal_standard", "none"),
    ("Il ricorso è respinto", "x", True, "dismissed", "notification", "none"),
    ("En fait et en droit", "legal rule", False, "bogus", "legal_standard", "none"),
    ("Der Sachverhalt ist unstrittig", "holding", False, "partial", "facts", "none"),
    ("Er rügt dies zu Unrecht", "holding", False, "Remitted", "holding", "none"),
]


def _value(k: int) -> str:
    return "CASE f " + " ".join(f"WHEN {i} THEN {str(r[k]).lower() if isinstance(r[k], bool) else repr(r[k])}" for i, r in enumerate(ROWS)) + " END"


_BASE = f"SELECT DISTINCT CAST(l_partkey % 40 + 10 AS INT) AS n, CAST(f AS INT) AS f FROM lineitem, (SELECT unnest(range({len(ROWS)})) AS f) r"


def _rows(spark, d):
    x = fx.table(spark, d, "lineitem").select((col("l_partkey") % 40 + 10).cast("int").alias("n")).distinct().withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(len(ROWS) - 1))))
    return x.selectExpr("n", "f", f"{_value(0)} AS text", f"{_value(1)} AS role", f"{_value(2)} AS notification", f"{_value(3)} AS outcome")


@query(f"SELECT n, f, {_value(4)} AS role, {_value(4)} <> {_value(1)} AS changed, {_value(5)} AS outcome FROM ({_BASE}) x")
def paragraph_roles(spark, d):
    """Roles by cues, outcomes only where a role may have one."""
    r = _rows(spark, d).withColumn("r", E.paragraph_role(col("role"), col("text"), col("notification")))
    return r.select("n", "f", col("r.role").alias("role"), (col("r.role") != col("role")).alias("changed"), E.outcome_signal(col("outcome"), col("text"), col("r.role"))["outcome"].alias("outcome"))


@query(
    f"""SELECT n, f, {_value(4)} AS role, {_value(5)} AS outcome, concat('Art. ', n, ' Abs. 2 BV') || CASE WHEN f = 6 THEN ';Art. 5 BV' ELSE '' END || ';SR 1' AS statutes, concat('1B_', n, '/2021') AS cases, concat('BGE 139 I ', n, ' S. 8') AS pages, 'Zonenplan' AS documents, 'Basler Kommentar' AS secondary,
  CASE WHEN {_value(4)} IN ('facts', 'procedural_history', 'costs', 'notification') THEN '' ELSE 'A rule. | A test.' END AS rules, {_value(4)} IN ('costs', 'notification') AS low_value, 2 AS moved FROM ({_BASE}) x"""
)
def normalised_rows(spark, d):
    """Whole rows: anchors from the text, hints sorted, rules of quiet rows dropped."""
    more = F.concat(F.lit("; vgl. Art. "), "n", F.lit(" Abs. 2 BV, BGE 139 I "), "n", F.lit(" S. 8, BGE 139 I "), "n", F.lit(" E. 3, Urteil 1B_"), "n", F.lit("/2021"))
    order = F.when(col("f") == 6, F.concat(F.lit("Art. "), "n", F.lit(" Abs. 2 BV; "), "text", more)).otherwise(F.concat("text", more))
    rows = _rows(spark, d).select(
        "n", "f", F.concat(F.lit("BGE 139 I "), "n", F.lit(" E. 7")).alias("citation"), order.alias("text"),
        F.struct(F.lit("area").alias("legal_area"), F.lit("topic").alias("topic"), F.lit(None).cast("string").alias("subtopic"), F.lit("").alias("micro_topic"), F.array(F.lit("x")).alias("concepts_en"), F.array(F.lit("y")).alias("terms_original"), col("role").alias("paragraph_role"), col("outcome").alias("outcome_signal"), F.lit("A rule.").alias("doctrinal_rule"), F.lit(" A  test. ").alias("legal_test"), F.lit("").alias("legal_rule"), F.array(F.lit("Zonenplan"), F.lit("Art. 1 BV")).alias("statute_anchors"), F.array(F.lit("Basler Kommentar")).alias("case_anchors")).alias("said"),
        F.struct(F.concat(F.lit("BGE 139 I "), "n").alias("court_base"), F.array(F.lit("SR 1")).alias("statutes"), F.lit(None).cast("array<string>").alias("cases"), F.array(F.lit("BV")).alias("law_codes"), "notification").alias("known"),
    )
    joined = lambda c: F.array_join(c, ";")
    out = N.normalised(rows.select(F.concat_ws("#", "citation", "n", "f").alias("citation"), "text", "said", "known"))
    part = lambda k: F.split("citation", "#")[k]
    return out.select(part(1).cast("int").alias("n"), part(2).cast("int").alias("f"), "role", "outcome", joined("statutes").alias("statutes"), joined("cases").alias("cases"), joined("pages").alias("pages"), joined("document_or_plan_anchors").alias("documents"), joined("secondary_sources").alias("secondary"), col("views.rules").alias("rules"), col("quality.low_value").alias("low_value"), col("quality.moved").alias("moved"))


_WORDS = ("Verfugung", "Ubergang", "Gericht", "Prufung", "Auslander", "Grosse", "Hohe", "Munze", "unfug")
_VOCAB = ("Verfügung", "Prüfung", "Ausländer", "Höhe", "Münze", "Gericht")
_WANT = ("Verfügung", None, None, "Prüfung", "Ausländer", "Grösse", "Höhe", "Münze", None)


@query(f"SELECT word, repaired, n FROM (SELECT [{', '.join(map(repr, _WORDS))}][l_partkey % {len(_WORDS)} + 1] AS word, [{', '.join('NULL' if w is None else repr(w) for w in _WANT)}][l_partkey % {len(_WORDS)} + 1] AS repaired, count(*) AS n FROM lineitem GROUP BY 1, 2) x")
def umlaut_repairs(spark, d):
    """Words that lost their umlauts, mended against a vocabulary and a list of known repairs."""
    words = fx.table(spark, d, "lineitem").select(F.get(F.array(*map(F.lit, _WORDS)), (col("l_partkey") % len(_WORDS)).cast("int")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    vocab = spark.createDataFrame([(w,) for w in _VOCAB], "word string")
    known = spark.createDataFrame([("Grosse", "Grösse")], "word string, fixed string")
    return words.join(N.repaired(words, vocab, known), "word").select("word", "repaired", "n")


_TERMS = (("License", "license", "contract"), ("the of", "frequent pair", "grammar"), ("copyright", "notice", "contract"), ("und die", "frequent pair", "grammar"), ("el de", "frequent pair", "grammar"))
_NORM = r"concat(' ', array_to_string(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> ''), ' '), ' ')"


@query(
    f"""WITH d AS (SELECT unnest([{", ".join("{'term': '" + t.lower() + "', 'label': '" + lb + "', 'area': '" + a + "'}" for t, lb, a in _TERMS)}], recursive := true)), t AS (SELECT doc_id, {_NORM} AS t FROM documents)
SELECT doc_id, array_to_string(list_sort(list_distinct(list(label))), ';') AS labels, array_to_string(list_sort(list_distinct(list(area))), ';') AS areas, array_to_string(list_sort(list_distinct(list(term))), ';') AS terms FROM t JOIN d ON contains(t.t, concat(' ', d.term, ' ')) GROUP BY doc_id"""
)
def legal_concepts(spark, d):
    """Dictionary concepts of documents, found by a join on the terms' first words."""
    out = N.concepts(fx.table(spark, d, "documents"), spark.createDataFrame(list(_TERMS), "term string, label string, area string"))
    return out.select("doc_id", *[F.array_join(c, ";").alias(c) for c in ("labels", "areas", "terms")])


@query(
    r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '\?')) AS INT) AS questions, CAST(len(regexp_extract_all(text, '[.!?]+(?:\s|$)')) AS INT) AS sentences, length(replace(replace(replace(replace(replace(replace(replace(text, 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'Ä', 'Ae'), 'Ö', 'Oe'), 'Ü', 'Ue'), 'ß', 'ss')) AS spelled, CAST(len(regexp_extract_all(lower(text), '[\p{L}\p{N}_./]+')) AS INT) AS words,
 CASE WHEN length(text) < 80 THEN 'skip' WHEN length(text) < 400 THEN 'normal' ELSE 'high' END AS priority FROM documents"""
)
def text_signals(spark, d):
    """Counts of question signals, umlauts spelled out, words, and which rows a model should read first."""
    t = fx.table(spark, d, "documents")
    q = E.question_signals(col("text"))
    none = F.array().cast("array<string>")
    return t.select("doc_id", q["questions"].alias("questions"), q["sentences"].alias("sentences"), F.length(E.spelled_out(col("text"))).alias("spelled"), F.size(E.words(col("text"))).alias("words"), E.model_priority(E.signal_level(none, none, none, none), none, F.length("text")).alias("priority"))


@query(
    f"""WITH x AS (SELECT DISTINCT {fx.case('l_orderkey % 5', fx.DIVISIONS)} AS division, CAST(l_suppkey % 9 + 1 AS VARCHAR) || 'B' AS prefix FROM lineitem)
SELECT division, prefix, CASE division {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in E.AREAS.items() if not k.isdigit())} END AS by_division, coalesce(CASE prefix {" ".join(f"WHEN '{k}B' THEN '{v}'" for k, v in E.AREAS.items() if k.isdigit())} END, 'unknown') AS by_prefix,
 CASE division {" ".join("WHEN '" + k + "' THEN '" + ",".join(x for x in E.AREAS if not x.isdigit() and E.AREAS[x] == v) + "'" for k, v in E.AREAS.items() if not k.isdigit())} END AS divisions FROM x"""
)
def areas_of_law(spark, d):
    """Areas by division and docket prefix, and back to divisions."""
    x = fx.lines(spark, d).selectExpr(f"{fx.case('l_orderkey % 5', fx.DIVISIONS)} AS division", "concat(l_suppkey % 9 + 1, 'B') AS prefix").distinct()
    none = F.lit(None).cast("string")
    by = E.area_from_structure(col("division"), col("prefix"))
    return x.select("division", "prefix", by.alias("by_division"), E.area_from_structure(none, col("prefix")).alias("by_prefix"), F.array_join(E.allowed_divisions(F.array(by)), ",").alias("divisions"))

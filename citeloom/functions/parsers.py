"""Sequential citation parsers in Arrow batches: statutes, judgments and references back, read by `grammar`; suffix-stripped
stems, Unicode folding, repair of mojibake. Texts without a cue stay in the JVM."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from . import grammar
from .grammar import fold as fold_text

_UNIT = StructType([StructField(c, StringType()) for c in ("marker", "value", "category")])
_TEXTS = ("citation", "family", "subfamily", "article", "law_code", "law_code_family", "resolution", "base", "pinpoint", "docket", "date", "chamber", "area", "serial", "year", "separator", "volume", "division", "page", "fallback")
REFERENCE = StructType([*[StructField(c, StringType()) for c in _TEXTS], StructField("units", ArrayType(_UNIT))])


def _row(ref: grammar.Reference) -> dict:
    return {c: ref.parts.get(c) for c in _TEXTS} | {"citation": ref.citation, "family": ref.family, "subfamily": ref.subfamily, "units": ref.parts.get("units") or []}


def articles_of(text: str, own_code: str | None = None) -> list[str]:
    return list(dict.fromkeys(x.citation for x in grammar.articles(grammar.Reader(text), own_code)))


def dockets_of(text: str) -> list[str]:
    return list(dict.fromkeys(x.citation for x in grammar.dockets(grammar.Reader(text))))


back_references = grammar.back_references


def stem_of(word: str) -> str:
    """Strips German endings again and again while four letters are left."""
    while True:
        m = re.search(r"(?:en|es|em|er|e|n|s)$", word)
        if not m or m.start() < 4:
            return word
        word = word[: m.start()]


@pandas_udf(ArrayType(StringType()))
def _statutes(text: pd.Series) -> pd.Series:
    return text.map(lambda t: articles_of(t or ""))


@pandas_udf(ArrayType(StringType()))
def _judgments(text: pd.Series) -> pd.Series:
    return text.map(lambda t: dockets_of(t or ""))


@pandas_udf(ArrayType(StringType()))
def _reporters(text: pd.Series) -> pd.Series:
    return text.map(lambda t: list(dict.fromkeys(x.citation for x in grammar.reporters(grammar.Reader(t)))) if t else [])


@pandas_udf(ArrayType(StringType()))
def _own(text: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([grammar.back_references(t, b) for t, b in zip(text, base, strict=True)])


@pandas_udf(ArrayType(REFERENCE))
def _references(text: pd.Series, code: pd.Series) -> pd.Series:
    return pd.Series([[_row(x) for x in grammar.references(t, c)] if t else [] for t, c in zip(text, code, strict=True)])


@pandas_udf(REFERENCE)
def classified(citation: pd.Series) -> pd.DataFrame:
    """What a corpus key is, with its parts; null for null."""
    rows = [_row(grammar.classify(c)) if c is not None else dict.fromkeys(REFERENCE.names) for c in citation]
    return pd.DataFrame(rows, columns=REFERENCE.names)


def _texts(c: Column | str, cue: str) -> Column:
    """The text where it holds a cue, else null: texts without one aren't sent to Python."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.rlike(cue), c)


def statute_articles(c: Column | str) -> Column:
    return _statutes(_texts(c, r"(?i)\bart(\.|ikel)"))


def case_citations(c: Column | str) -> Column:
    return _judgments(_texts(c, r"\d/\d\d"))


def reporter_citations(c: Column | str) -> Column:
    """Reporter citations of a text in canonical form, in order, each once."""
    return _reporters(_texts(c, r"\b(BGE|ATF|DTF)\b"))


def own_references(c: Column | str, base: Column | str) -> Column:
    return _own(_texts(c, r"(?i)\b(e\.|c\.|erw|cons)"), base)


def all_references(c: Column | str, own_code: Column | None = None) -> Column:
    """array<REFERENCE>: all families, each canonical form once. Null texts have none."""
    return _references(_texts(c, r"(?i)\bart(\.|ikel)|§|BGE|ATF|DTF|\d/\d\d|\b(SR|BBl|AS)\s"), F.lit(None).cast("string") if own_code is None else own_code)


@pandas_udf(StringType())
def stem(word: pd.Series) -> pd.Series:
    return word.map(lambda w: stem_of(w) if w else w)


@pandas_udf(StringType())
def unicode_fold(text: pd.Series) -> pd.Series:
    return text.map(lambda t: fold_text(t) if t else t)


@pandas_udf(StringType())
def repair_mojibake(text: pd.Series) -> pd.Series:
    def fix(t):
        try:
            return t.encode("cp1252").decode("utf-8") if t else t
        except (UnicodeEncodeError, UnicodeDecodeError):
            return t

    return text.map(fix)

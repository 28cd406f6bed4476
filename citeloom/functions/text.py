"""Text scalars: cleaning, joining, clipping, ids, language and role cues, tokens, greedy passages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cue words per language, in the order that decides ties.
CUES = {"de": ("der", "die", "das", "und", "nicht"), "fr": ("le", "les", "des", "une", "est"), "it": ("il", "che", "della", "non", "per"), "en": ("the", "and", "of", "to", "that"), "es": ("el", "los", "que", "por", "una")}


def clean(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), "\0", " "), r"(?U)\s+", " "))


def unique_in_order(arr: Column, most: int) -> Column:
    return F.slice(F.array_distinct(F.filter(arr, lambda x: x.isNotNull() & (x != ""))), 1, most)


def field_join(*parts: Column) -> Column:
    return F.array_join(F.filter(F.transform(F.array(*parts), clean), lambda x: x != ""), " | ")


def weighted_join(part: Column, times: int) -> Column:
    return F.array_join(F.array_repeat(part, times), " ")


def labelled(label: str, c: Column) -> Column:
    return F.when(clean(c) != "", F.concat(F.lit(label + ": "), clean(c))).otherwise("")


def document_key(family: Column, line: Column, citation: Column, text: Column) -> Column:
    """Content key: family and 24 hex digits of a SHA-1."""
    return F.concat(family, F.lit(":"), F.substring(F.sha1(F.concat_ws("|", family, line.cast("string"), citation, F.substring(text, 1, 200))), 1, 24))


def tokens(c: Column, least: int = 2) -> Column:
    """Lower-cased words of letters, digits and `_`, of `least` characters or a number."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}_]+"), lambda w: (F.length(w) >= least) | w.rlike("^[0-9]+$"))


def cue_count(c: Column, lang: str) -> Column:
    return F.size(F.filter(F.split(F.lower(c), r"[^\p{L}]+"), lambda w: w.isin(*CUES[lang])))


def language(c: Column, langs: tuple[str, ...] = ("de", "fr", "it")) -> Column:
    """The language with most cue words, ties in the order given, `unknown` without any."""
    counts = [cue_count(c, x) for x in langs]
    most = F.greatest(*counts) if len(counts) > 1 else counts[0]
    out = F.when(most == 0, "unknown")
    for x, n in zip(langs, counts, strict=True):
        out = out.when(n == most, x)
    return out


def density(c: Column, weights: dict[str, int], low: int = -10, high: int = 20) -> Column:
    """Sum of weighted pattern counts, clamped."""
    total = sum((F.regexp_count(c, F.lit(p)) * w for p, w in weights.items()), F.lit(0))
    return F.greatest(F.lit(low), F.least(F.lit(high), total))


def is_corrupt(c: Column) -> Column:
    return c.rlike("�|Ã[\u0080-¿]|\\p{L}\\?\\p{L}")


def passages(c: Column, target: int = 520) -> Column:
    """Sentences packed greedily into passages of at least `target` characters, in order."""
    sentence = F.split(c, r"(?<=[.!?])\s+")
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(acc, s):
        joined = F.concat_ws(" ", F.nullif(acc["open"], F.lit("")), s)
        full = F.length(joined) >= target
        return F.struct(F.when(full, F.concat(acc["done"], F.array(joined))).otherwise(acc["done"]).alias("done"), F.when(full, "").otherwise(joined).alias("open"))

    return F.aggregate(sentence, zero, add, lambda acc: F.when(acc["open"] != "", F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]))


def parse_verdict(raw: Column, default: str = "YES") -> Column:
    """A judge's YES or NO behind its thoughts; `default` where there is none."""
    rest = F.upper(F.regexp_replace(raw, r"(?is)<think>.*?</think>", ""))
    return F.coalesce(F.nullif(F.regexp_extract(rest, r"\b(YES|NO)\b", 1), F.lit("")), F.lit(default))


def first_of(rules: list[tuple[Column, str]], default: str) -> Column:
    """Ordered rules: the label of the first that holds."""
    out = F.when(rules[0][0], rules[0][1])
    for cond, label in rules[1:]:
        out = out.when(cond, label)
    return out.otherwise(default)

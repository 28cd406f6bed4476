"""Citation scalars: parsing, canonical forms and classification as column expressions.

Sequential parses (chains of units, windows behind a match, masked text) are Arrow UDFs in `parsers`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that never are a law code.
NOT_CODES = ("Abs", "Absatz", "lit", "Bst", "Ziff", "Ziffer", "Satz", "Art", "Artikel", "und", "oder", "des", "der", "vom", "von", "im", "in", "vgl", "sowie", "mit", "nach", "ff", "f")
# Roots of statute collections and known federal law codes.
KNOWN_CODES = ("BGG", "BV", "StGB", "StPO", "OR", "ZGB", "ZPO", "SchKG", "SVG", "VwVG", "IVG", "AHVG", "UVG", "KVG", "ATSG", "AsylG", "AIG", "BVG", "DBG", "MWSTG", "IPRG", "EMRK")
DATE = r"\d{1,2}\.\d{1,2}\.\d{4}"
MODERN, LEGACY = r"\d{1,2}[A-Z]{1,2}[_. ]\d{1,5}/\d{4}", r"[A-Z]\s+\d{1,5}/\d{2}"
PINPOINT = r"[A-Za-z0-9]+(?:[./-][A-Za-z0-9]+)*"


def pick(c: Column, pattern: str, group: int = 1) -> Column:
    """A regex group, null where the pattern doesn't match or the group is empty."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def squash(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def strip_edges(c: Column) -> Column:
    return F.regexp_replace(c, r"^[ \t\r\n,;:.)\]}]+|[ \t\r\n,;:.)\]}]+$", "")


def law_code(c: Column) -> Column:
    """Canonical law code: edges stripped, `SR n` as n, words that aren't codes as null."""
    s = strip_edges(squash(c))
    s = F.coalesce(pick(s, r"^SR\s+(\d+(?:\.\d+)*)$"), s)
    return F.when((s != "") & ~F.lower(s).isin([x.lower() for x in NOT_CODES]), s)


def law_code_kind(c: Column) -> Column:
    """What a law code looks like."""
    kind = F.when(c.isNull() | (c == ""), "unresolved_law_code").when(c.rlike(r"^\d+(\.\d+)*$"), "systematic_collection_number").when(c.contains("/"), "cantonal_or_slash_abbreviation")
    return kind.when(c.contains("-"), "compound_abbreviation").when(c.rlike(r"\s\d+$"), "numbered_abbreviation").when(c.rlike(r"^[A-Z]{2,6}$"), "uppercase_abbreviation").otherwise("mixedcase_abbreviation")


def article_series(c: Column) -> Column:
    """struct(parts, kind) of a series such as `5, 6 und 7` or `30-39`."""
    ranged = c.rlike(r"(?i)^\s*\d+[a-z]*\s*(-|bis|to)\s*\d+[a-z]*\s*$")
    parts = F.filter(F.split(squash(c), r"(?i)\s*(?:,|/|\bund\b|\boder\b|\band\b)\s*"), lambda x: x != "")
    one = F.array(F.regexp_replace(squash(c), r"(?i)\s*(-|bis|to)\s*", "-"))
    return F.struct(F.when(ranged, one).otherwise(parts).alias("parts"), F.when(ranged, "range").when(F.size(parts) > 1, "list").otherwise("single").alias("kind"))


def split_court(c: Column) -> Column:
    """struct(base, pinpoint) of `BASE E. X`, null members otherwise."""
    p = rf"^(.+?)\s+E\.\s+([A-Za-z0-9./-]+)$"
    return F.struct(F.trim(pick(c, p, 1)).alias("base"), pick(c, p, 2).alias("pinpoint"))


def undated_base(c: Column) -> Column:
    return F.coalesce(F.trim(pick(c, rf"^(.+?)\s+{DATE}$")), c)


def strip_date(c: Column) -> Column:
    """The form without date of a dated docket, null for others."""
    p = rf"^((?:{MODERN})|(?:{LEGACY}))\s+{DATE}(?:\s+(E\.\s+\S+))?$"
    return F.when(c.rlike(p), F.concat_ws(" ", pick(c, p, 1), pick(c, p, 2)))


def expand_range(c: Column, most: int = 50) -> Column:
    """`... E. 2.1-2.4` -> its members, with date and, after them, without; empty if the ends have other parents or are too far apart."""
    p = r"^(.+?\s+)E\.\s+((?:\d+\.)*)(\d+)\s*-\s*((?:\d+\.)*)(\d+)$"
    lo, hi = pick(c, p, 3).cast("int"), pick(c, p, 5).cast("int")
    head, parent = F.regexp_extract(c, p, 1), F.regexp_extract(c, p, 2)
    ok = c.rlike(p) & (parent == F.regexp_extract(c, p, 4)) & (lo <= hi) & (hi - lo <= most)
    bare = pick(head, rf"^(.+?)\s+{DATE}\s+$")
    refs = lambda h: F.transform(F.sequence(lo, hi), lambda i: F.concat(h, F.lit("E. "), parent, i.cast("string")))
    empty = F.array().cast("array<string>")
    return F.when(ok, F.concat(refs(head), F.when(bare.isNotNull(), refs(F.concat(bare, F.lit(" ")))).otherwise(empty))).otherwise(empty)


def official_refs(c: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"\bSR\s+\d+(?:\.\d+)*|\b(?:BBl|AS)\s+\d{4}\s+\d+"), F.lit(0)), squash))


def docket_kind(c: Column) -> Column:
    """The kind of the docket that a string begins with."""
    kind = F.when(c.rlike(r"^\d{1,2}[A-Z]{1,2}[_ ]\d"), "federal_tribunal_modern_docket").when(c.rlike(r"^\d{1,2}[A-Z]{1,2}\.\d"), "federal_tribunal_dot_docket")
    return kind.when(c.rlike(rf"^{LEGACY}"), "federal_tribunal_legacy_single_letter_docket").otherwise("unknown_docket")


def docket_parts(c: Column) -> Column:
    """struct(prefix, serial, year) of a docket."""
    p = r"^(\d{1,2}[A-Z]{1,2}|[A-Z])[_.\s]+(\d{1,5})/(\d{2,4})"
    return F.struct(*[pick(c, p, k).alias(n) for k, n in ((1, "prefix"), (2, "serial"), (3, "year"))])


def court_base(c: Column) -> Column:
    """Judgment key: the reporter triple, the docket with `_`, or what stands before ` E.`."""
    return F.coalesce(pick(c, r"(BGE\s+\d{3}\s+[IVX]{1,4}\s+\d+[a-z]?)"), F.translate(pick(c, rf"({MODERN})"), ".", "_"), F.trim(pick(c, r"^(.+?)\s+E\.")), c)


def consideration(label: Column) -> Column:
    """struct(root, depth): `4.2.1` -> 4, 3; a letter -> itself, 0."""
    return F.struct(F.substring_index(label, ".", 1).alias("root"), F.when(label.rlike("^[A-Za-z]"), 0).otherwise(F.size(F.split(label, r"\."))).alias("depth"))


def aliases(c: Column) -> Column:
    """Reporter and consideration spellings of a reporter citation, each once in order."""
    forms = [F.regexp_replace(F.regexp_replace(c, "^BGE", r), r" E\. ", f" {u} ") for r in ("BGE", "ATF", "DTF") for u in ("E.", "consid.")]
    return F.array_distinct(F.array(*forms))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(fold(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def fold(c: Column) -> Column:
    """Lower-case-preserving removal of the accents of Latin-1 letters."""
    return F.translate(c, "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy")


def is_article_level(c: Column) -> Column:
    return ~c.rlike(r"(?i)\b(?:Abs|Absatz|al|lit|Bst|Ziff|Ziffer|Nr|Satz)\b")


def statute_anchor(c: Column) -> Column:
    """`Art. N ... CODE` -> `N CODE`, the last capitalised word being the code; the input where it isn't one."""
    n = pick(c, r"(?i)\bart(?:\.|ikel)?\s+(\d+[a-z]*)")
    codes = F.regexp_extract_all(c, F.lit(r"\b([A-Z][A-Za-z]{1,}[A-Z]|[A-Z]{2,})\b"), F.lit(1))
    code = F.try_element_at(codes, F.lit(-1))
    return F.coalesce(F.concat(n, F.lit(" "), code), c)


def collapse_to_article(c: Column) -> Column:
    """`Art. N Abs. M ... CODE` -> `Art. N CODE`; null for article-level or other strings."""
    p = r"^Art\.\s+(\d+[a-z]*)\s+(?:(?:Abs|lit|Ziff|Bst|Satz)\.?\s+\S+\s+)+(\S.*)$"
    return F.when(c.rlike(p), F.concat(F.lit("Art. "), pick(c, p, 1), F.lit(" "), pick(c, p, 2)))


def strip_units(c: Column) -> Column:
    """Without Abs./lit./... units, for comparisons of predicted and gold statutes."""
    return squash(F.regexp_replace(c, r"\s+(?:Abs|lit|Ziff|Bst|Satz|al)\.?\s+[0-9a-zA-Z]+\b", ""))


def chamber(c: Column) -> Column:
    return F.coalesce(pick(c, r"BGE\s+\d{3}\s+([IVX]{1,4})\b"), pick(c, r"^(\d{1,2}[A-Z]{1,2})[_. ]"), F.lit("?"))


def reference_family(c: Column) -> Column:
    return F.when(c.rlike(r"^Art\.|^§"), "statute").when(c.rlike(r"^(?:SR|BBl|AS)\s"), "official").when(c.rlike(rf"^BGE\s|^{MODERN}|^{LEGACY}"), "court").otherwise("other")


def natural_key(c: Column) -> Column:
    """struct(number, rest): sorts 2 before 10 and 10 before 10a; without a number last."""
    return F.struct(F.coalesce(pick(c, r"^(\d+)").cast("int"), F.lit(1_000_000_000)).alias("n"), F.regexp_replace(c, r"^\d+", "").alias("rest"))


def classify(c: Column) -> Column:
    """Family of a corpus key."""
    return F.when(c.rlike(r"(?i)^Art\.\s+\d"), "law").when(c.rlike(r"^(?:BGE|ATF|DTF)\s+\d{3}"), "court_bge").when(c.rlike(rf"^(?:{MODERN}|{LEGACY})"), "court_case").otherwise("unknown")


def anchors(c: Column) -> Column:
    """struct(cases, dockets, statutes, law_codes) of a free-text query, each sorted and once."""
    get = lambda p: F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(p), F.lit(0))))
    statutes = F.transform(F.regexp_extract_all(c, F.lit(r"Art\.?\s+\d+[a-z]*(?:\s+(?:Abs|lit|Ziff)\.?\s+\w+)*\s+[A-Z][A-Za-z]+"), F.lit(0)), lambda x: F.concat(F.lit("Art. "), statute_anchor(x)))
    words = F.regexp_extract_all(c, F.lit(r"\b([A-Z][A-Za-z]{1,8})\b"), F.lit(1))
    return F.struct(get(r"BGE\s+\d{3}\s+[IVX]{1,4}\s+\d+").alias("cases"), get(MODERN).alias("dockets"), F.array_sort(F.array_distinct(statutes)).alias("statutes"), F.array_sort(F.array_intersect(words, F.array(*map(F.lit, KNOWN_CODES)))).alias("law_codes"))


def origin(bit: int, mask: Column) -> Column:
    return mask.bitwiseAND(F.lit(bit)) != 0


# --- titles, lists of references, anchors of a row


def _once(value: Column, body) -> Column:
    """body(value), the value computed once."""
    return F.transform(F.array(value), body)[0]


def title_parts(c: Column) -> Column:
    """The parts of a law's title between ` - `; the first is its heading."""
    return F.transform(F.split(c, r"\s+-\s+"), lambda x: F.trim(x))


def heading(c: Column) -> Column:
    return F.try_element_at(title_parts(c), F.lit(1))


def enactment_date(c: Column) -> Column:
    """The first German worded date of a title as yyyy-mm-dd, null without one."""
    from .grammar import MONTHS

    p = r"(\d{1,2})\.\s*([A-Za-zä]+)\s+(\d{4})"
    months = F.create_map(*[F.lit(x) for k, names in MONTHS.items() for x in (names[0], f"{k:02d}")])
    month = months[F.lower(fold(pick(c, p, 2)))]
    return F.when(month.isNotNull(), F.concat_ws("-", pick(c, p, 3), month, F.lpad(pick(c, p, 1), 2, "0")))


def title_aliases(title: Column, code: Column, most: int = 12) -> Column:
    """Abbreviations in the parentheses of a title, and its code first, each once."""
    inner = F.flatten(F.transform(F.regexp_extract_all(title, F.lit(r"\(([^()]*)\)"), F.lit(1)), lambda x: F.split(x, r"\s*[,;]\s*")))
    short = F.filter(inner, lambda x: x.rlike(r"^[A-Z][A-Za-z0-9./-]{1,15}$") & x.rlike(r"[A-Z].*[A-Z]"))
    return F.slice(F.array_distinct(F.array_compact(F.concat(F.array(code), short))), 1, most)


def is_case(c: Column) -> Column:
    return c.rlike(rf"^(?:BGE|ATF|DTF)\s+\d|^(?:{MODERN}|{LEGACY})")


def split_references(refs: Column) -> Column:
    """struct(laws, cases): what is no case counts as a law."""
    return F.struct(F.filter(refs, lambda x: ~is_case(x)).alias("laws"), F.filter(refs, is_case).alias("cases"))


def references_by_family(refs: Column, most: int = 80) -> Column:
    """struct(statute, court, official, other): each at most so many, in order."""
    of = lambda f: F.slice(F.array_distinct(F.filter(refs, lambda x: reference_family(x) == f)), 1, most).alias(f)
    return F.struct(of("statute"), of("court"), of("official"), of("other"))


def row_order(citation: Column, row_no: Column) -> Column:
    """struct to sort corpus rows by: law code, article in natural order, its units, the row."""
    return F.struct(pick(citation, r"(\S+)$").alias("code"), natural_key(pick(citation, r"(?:Art\.|§)\s+(\S+)")).alias("article"), F.regexp_replace(citation, r"^\S+\s+\S+\s*", "").alias("rest"), row_no.alias("row"))


def norm_token(c: Column, lower: bool = True) -> Column:
    out = squash(F.coalesce(c, F.lit("")))
    return F.lower(out) if lower else out


def row_anchors(anchors: Column, default_code: Column | None = None) -> Column:
    """The statute anchors of a row as `N CODE`: those without a code take the first code of the row, else the default; what has none is left out."""

    def canonical(x: Column, code: Column) -> Column:
        n = pick(x, r"(?i)^(?:art\.?|artikel)?\s*(\d+[a-z]*)")
        own = pick(x, r"\s([A-Z][A-Za-z]*[A-Z][A-Za-z]*)\s*$")
        return F.concat_ws(" ", n, F.coalesce(own, code))

    codes = F.filter(F.transform(anchors, lambda x: pick(x, r"\s([A-Z][A-Za-z]*[A-Z][A-Za-z]*)\s*$")), lambda x: x.isNotNull())
    first = F.coalesce(F.get(codes, F.lit(0)), default_code if default_code is not None else F.lit(None).cast("string"))
    full = _once(F.struct(anchors.alias("a"), first.alias("f")), lambda s: F.transform(s["a"], lambda x: canonical(x, s["f"])))
    return F.array_distinct(F.filter(full, lambda x: x.rlike(r"^\d+[a-z]* \S")))


def match_terms(c: Column) -> Column:
    """The words of a query for a full-text match: two letters or more, no operators, quoted and joined by OR."""
    words = F.filter(F.split(c, r"[^\p{L}\p{N}_]+"), lambda w: (F.length(w) >= 2) & ~F.upper(w).isin("AND", "OR", "NOT", "NEAR"))
    return F.array_join(F.transform(words, lambda w: F.concat(F.lit('"'), w, F.lit('"'))), " OR ")


def loose_consideration(c: Column, most: int = 90) -> Column:
    """struct(clean, raw) of what follows the first consideration word; raw is empty if nothing does, null without the word."""
    head = F.substring(c, 1, most)
    p = r"\b(?:consid\.|cons\.|E\.|c\.)\s*([^\s,;)]*)"
    raw = F.when(head.rlike(p), F.regexp_extract(head, p, 1))
    return F.struct(F.nullif(F.regexp_replace(strip_edges(raw), r"[^A-Za-z0-9]+$", ""), F.lit("")).alias("clean"), raw.alias("raw"))


def mention_class(c: Column, known: tuple[str, ...] = KNOWN_CODES) -> Column:
    """How firmly a text names law: HARD with a known code, HARD_UNKNOWN_CODE, SECTION, SOFT (an article or case without one), NONE."""
    codes = F.regexp_extract_all(c, F.lit(r"\bArt\.\s*\d+[a-z]*(?:\s+(?:Abs|lit|Bst|Ziff|Satz)\.?\s*\w+)*\s+([A-Z][A-Za-z]*[A-Z][A-Za-z]*)"), F.lit(1))
    out = F.when(F.size(F.array_intersect(codes, F.array(*map(F.lit, known)))) > 0, "HARD").when(F.size(codes) > 0, "HARD_UNKNOWN_CODE")
    return out.when(c.rlike(r"§\s*\d"), "SECTION").when(c.rlike(rf"\bArt\.\s*\d|\b(?:BGE|ATF|DTF)\s+\d{{3}}\b|{MODERN}"), "SOFT").otherwise("NONE")

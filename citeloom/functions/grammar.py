"""A reader of legal citations: words, numbers and marks of a text, and a small grammar over them.

Statutes: `Art.` or `Artikel` (also the section sign), a series of numbers, a chain of units, a law code. Judgments:
reporter citations and dockets with date and consideration. References back: a consideration of the same judgment that is
introduced, placed or put in parentheses. Values are read as written and rendered in one canonical form.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

# Unit words (lower case, without the dot), their canonical marker and what they number.
UNIT_WORDS = {
    "abs": ("Abs.", "paragraph"),
    "absatz": ("Abs.", "paragraph"),
    "absätze": ("Abs.", "paragraph"),
    "absatze": ("Abs.", "paragraph"),
    "al": ("Abs.", "paragraph"),
    "unterabs": ("Unterabs.", "subparagraph"),
    "unterabsatz": ("Unterabs.", "subparagraph"),
    "bst": ("Bst.", "letter"),
    "buchstabe": ("Bst.", "letter"),
    "buchstaben": ("Bst.", "letter"),
    "lit": ("Bst.", "letter"),
    "ziff": ("Ziff.", "number"),
    "ziffer": ("Ziff.", "number"),
    "nummer": ("Ziff.", "number"),
    "nummern": ("Ziff.", "number"),
    "nr": ("Ziff.", "number"),
    "satz": ("Satz", "sentence"),
}
# Months by number, in German, French and Italian, without accents.
MONTHS = {
    1: ("januar", "janvier", "gennaio"),
    2: ("februar", "fevrier", "febbraio"),
    3: ("marz", "mars", "marzo"),
    4: ("april", "avril", "aprile"),
    5: ("mai", "maggio"),
    6: ("juni", "juin", "giugno"),
    7: ("juli", "juillet", "luglio"),
    8: ("august", "aout", "agosto"),
    9: ("september", "septembre", "settembre"),
    10: ("oktober", "octobre", "ottobre"),
    11: ("november", "novembre"),
    12: ("dezember", "decembre", "dicembre"),
}
# Words that stand where a law code may, and are none.
NO_CODE = {*(w for u in UNIT_WORDS for w in (u, u + "n")), "art", "artikel", "und", "oder", "and", "or", "des", "der", "dem", "den", "die", "das", "du", "de", "della", "delle", "dell", "vom", "von", "in", "im", "i", "i.v.m", "vgl", "sowie", "mit", "nach", "zu", "zur", "zum", "ff", "f"}
# Reporters of one collection in three languages, and words before the number of a consideration.
REPORTERS, PINPOINT_WORDS = ("BGE", "ATF", "DTF"), ("e.", "consid.", "cons.", "c.")
# How a judgment names its own considerations.
OWN_WORDS = {"e.", "erw.", "erwägung", "erwägungen", "consid.", "considérant", "considérants", "cons.", "considerando", "c."}
INTRODUCED = {"vgl", "siehe", "cf", "cfr", "voir", "vedi", "vedasi", "vedere"}
BETWEEN = {"auch", "aussi", "also", "anche", "bereits", "ferner", "noch", "i.e", "d.h"}
PLACED = {
    *("hiervor", "hierin", "oben", "vorstehend", "vorstehende", "vorstehenden", "vorstehender", "vorstehendes", "vorhergehend", "vorhin"),
    *("ci-dessus", "ci-après", "ci-apres", "ci-avant", "précédent", "précédente", "sopra", "supra", "infra", "precedente", "prossimo"),
    *("above", "earlier", "hereunder", "hereinafter", "hereinabove"),
}
_LISTED = {",", "/", "und", "oder", "and"}
_REFS_LISTED = {",", "/", ";", "und", "et", "e", "oder", "ou", "o"}
# Shapes of docket numbers, of dates in digits, of numbers behind a consideration word.
DOCKET = r"\d{1,2}[A-Z]{1,2}[_. ]\d{1,5}/\d{4}|[A-Z]\s+\d{1,5}/\d{2}"
_DATE = re.compile(r"\d{2}\.\d{2}\.\d{4}")
_PINPOINT = re.compile(r"\s*([A-Za-z0-9]+(?:[./-][A-Za-z0-9]+)*)(\s*ff?\.)?")
_TOKEN = re.compile(rf"(?P<docket>\b(?:{DOCKET})\b)|(?P<num>\d+(?:\.\d+)*[a-z]*)|(?P<word>[^\W\d_]\w*(?:[.\-/]\w+)*\.?)|(?P<mark>§§?|\S)")
_SHORT = {*UNIT_WORDS, "art", "e", "erw", "consid", "cons", "c", "s", "vgl", "cf"}
_VALUE = {"letter": re.compile(r"[a-z]\.?", re.I)}
_NUMBER = re.compile(r"\d+(?:bis|ter|quater|quinquies|sexies|septies|octies|novies|decies|[a-z])?", re.I)
# How many characters behind its head the parts of a reference may lie.
WINDOW, SECTION_WINDOW, DOCKET_WINDOW = 260, 120, 90


@dataclass
class Token:
    kind: str
    text: str
    start: int
    end: int

    @property
    def low(self) -> str:
        return self.text.lower()


@dataclass
class Reference:
    citation: str
    family: str
    subfamily: str
    parts: dict = field(default_factory=dict)


_END = Token("end", "", 1 << 60, 1 << 60)


def tokens(text: str) -> list[Token]:
    """Words keep inner dots, hyphens and slashes, but for abbreviations that run into their number (`Abs.1`)."""
    out, at = [], 0
    while m := _TOKEN.search(text, at):
        kind, end = m.lastgroup, m.end()
        if kind == "word" and "." in m[0]:
            head = m[0].split(".")[0]
            if head.lower() in _SHORT and m[0] != head + ".":
                end = m.start() + len(head) + 1
        out.append(Token(kind, text[m.start() : end], m.start(), end))
        at = end
    return out


class Reader:
    """A text's tokens, and what is read from a place on: each method gives the value and the next place."""

    def __init__(self, text: str):
        self.text, self.toks = text, tokens(text)

    def at(self, i: int) -> Token:
        return self.toks[i] if 0 <= i < len(self.toks) else _END

    def raw(self, i: int, j: int) -> str:
        return " ".join(self.text[self.at(i).start : self.at(j - 1).end].split())

    def series(self, i: int) -> tuple[list[str], str | None, int]:
        """Numbers of articles: `5, 6 und 7`, `30-39`, `3 bis 5`."""
        first, sign, other = self.at(i), self.at(i + 1), self.at(i + 2)
        if (sign.text in ("-", "–", "—") or sign.low in ("bis", "to")) and other.kind == "num":
            return [f"{first.text}-{other.text}"], "range", i + 3
        found, j = [first.text], i + 1
        while self.at(j).low in _LISTED and self.at(j + 1).kind == "num":
            found.append(self.at(j + 1).text)
            j += 2
        return found, "list" if len(found) > 1 else None, j

    def units(self, i: int) -> tuple[list[dict], int]:
        """The chain of units: marker, value as written (`1 und 2`), what it numbers."""
        found = []
        while unit := UNIT_WORDS.get(self.at(i).low.rstrip(".")):
            value = _VALUE.get(unit[1], _NUMBER)
            fits = lambda t: t.kind in ("num", "word") and value.fullmatch(t.text)  # noqa: B023, E731
            if not fits(self.at(i + 1)):
                break
            j = i + 2
            while self.at(j).low in _LISTED and fits(self.at(j + 1)):
                j += 2
            found.append({"marker": unit[0], "value": self.raw(i + 1, j).rstrip("."), "category": unit[1]})
            i = j
        return found, i

    def code(self, i: int) -> tuple[str | None, int]:
        """A law code: `StPO`, `PBG/SZ`, `ArGV 1`, `SR 101`, a systematic number."""
        i += self.at(i).text in ("(", "[")
        t, nxt = self.at(i), self.at(i + 1)
        if t.text == "SR" and nxt.kind == "num":
            return nxt.text, i + 2
        if t.kind == "num":
            return (t.text, i + 1) if re.fullmatch(r"\d{2,}(\.\d+)*", t.text) else (None, i)
        word = t.text.rstrip(".")
        if t.kind != "word" or not re.fullmatch(r"[A-Z][A-Za-z0-9.\-/]+", word) or (word in NO_CODE or (word.istitle() and word.lower() in NO_CODE)):
            return None, i
        if t.text == word and re.fullmatch(r"[IVX]{1,4}|\d+", nxt.text) and nxt.start > t.end:
            return f"{word} {nxt.text}", i + 2
        return word, i + 1

    def code_nearby(self, i: int, until: int) -> str | None:
        """`(ABBR; SR n)`, else `SR n`, in what follows."""
        number = None
        while (t := self.at(i)).start < until:
            if t.text in ("(", "["):
                code, j = self.code(i)
                if code and self.at(j).text in (";", ",") and self.at(j + 1).text == "SR" and self.at(j + 2).kind == "num":
                    return code
            if t.text == "SR" and self.at(i + 1).kind == "num":
                number = number or self.at(i + 1).text
            i += 1
        return number

    def date(self, i: int) -> tuple[str | None, int]:
        """`12.05.2023`, `vom 12. Mai 2023`, `du 12 mai 2023`."""
        j = i + (self.at(i).low in ("vom", "du", "del", "of"))
        t = self.at(j)
        if _DATE.fullmatch(t.text):
            return t.text, j + 1
        day = re.match(r"\d{1,2}(?!\d)", t.text) if t.kind == "num" else None
        j += 2 if self.at(j + 1).text == "." else 1
        month = next((k for k, names in MONTHS.items() if fold(self.at(j).text).rstrip(".") in names), None)
        if day and month and re.fullmatch(r"\d{4}", self.at(j + 1).text):
            return f"{int(day[0]):02d}.{month:02d}.{self.at(j + 1).text}", j + 2
        return None, i

    def pinpoint(self, i: int) -> str | None:
        m = _PINPOINT.match(self.text, self.at(i).end)
        return (m[1] + (m[2] or "")).rstrip(" .") if m else None

    def past(self, end: int, i: int) -> int:
        while self.at(i).start < end:
            i += 1
        return i


def fold(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).lower()


def code_kind(code: str | None) -> str:
    """What a law code looks like."""
    if not code:
        return "unresolved_law_code"
    rules = ((r"\d+(\.\d+)*", "systematic_collection_number"), (r".*/.*", "cantonal_or_slash_abbreviation"), (r".*-.*", "compound_abbreviation"), (r".*\s\d+", "numbered_abbreviation"), (r"[A-Z]{2,6}", "uppercase_abbreviation"))
    return next((kind for p, kind in rules if re.fullmatch(p, code)), "mixedcase_abbreviation")


def _chain(units: list[dict], code: str | None) -> str:
    return "".join(f" {u['marker']} {u['value']}" for u in units) + (f" {code}" if code else "")


def articles(r: Reader, own_code: str | None = None) -> list[Reference]:
    out = []
    for i, t in enumerate(r.toks):
        if t.low not in ("art.", "artikel") or r.at(i + 1).kind != "num":
            continue
        numbers, kind, j = r.series(i + 1)
        more = r.at(j).low if r.at(j).low in ("f.", "ff.") else None
        units, j = r.units(j + bool(more))
        code, _ = r.code(j)
        how = "inline"
        if not code and (code := r.code_nearby(i + 1, t.end + WINDOW)):
            how = "nearby_parenthetical_or_sr"
        elif not code:
            code, how = own_code, "source_law_context" if own_code else None
        for n in numbers:
            parts = {"article": n, "series": kind, "continuation": more, "units": units, "law_code": code, "law_code_family": code_kind(code), "resolution": how}
            out.append(Reference(f"Art. {n}{f' {more}' if more else ''}{_chain(units, code)}", "law", "statute_article", parts))
    return out


def sections(r: Reader) -> list[Reference]:
    out = []
    for i, t in enumerate(r.toks):
        if t.text not in ("§", "§§") or r.at(i + 1).kind != "num" or (t.start and not r.text[t.start - 1].isspace()):
            continue
        sign, other = r.at(i + 2), r.at(i + 3)
        ranged = (sign.text in ("-", "–", "—") or sign.low in ("bis", "to")) and other.kind == "num"
        number, j = r.raw(i + 1, i + 4 if ranged else i + 2).translate({0x2013: "-", 0x2014: "-"}), i + (4 if ranged else 2)
        more = f" {r.at(j).text}" if r.at(j).low in ("f.", "ff.") else ""
        units, j = r.units(j + bool(more))
        code = r.code(j)[0] or r.code_nearby(i + 1, t.end + SECTION_WINDOW)
        out.append(Reference(f"{t.text} {number}{more}{_chain(units, code)}", "law", "statute_section", {"article": number, "units": units, "law_code": code, "law_code_family": code_kind(code)}))
    return out


def _reporter(r: Reader, i: int) -> tuple[Reference | None, int, int]:
    """A reporter citation at i: it, the next place, and where it ends in the text."""
    word, volume, division, page = (r.at(i + k) for k in range(4))
    if word.text not in REPORTERS or not re.fullmatch(r"\d{3}", volume.text) or not re.fullmatch(r"[IVX]{1,4}", division.text) or not re.fullmatch(r"\d+[a-z]?", page.text):
        return None, i + 1, 0
    base, unit, j, end = f"BGE {volume.text} {division.text} {page.text}", r.at(i + 4).low, i + 4, page.end
    parts = {"base": base, "volume": volume.text, "division": division.text, "page": page.text, "pinpoint": None, "pinpoint_unit": None}
    if unit in (*PINPOINT_WORDS, "s.") and (m := _PINPOINT.match(r.text, r.at(j).end)):
        parts |= {"pinpoint": r.pinpoint(j), "pinpoint_unit": "S" if unit == "s." else "E"}
        end = m.end()
        j = r.past(end, j)
    tail = f" {parts['pinpoint_unit']}. {parts['pinpoint']}" if parts["pinpoint"] else ""
    return Reference(base + tail, "court", "bge", parts), j, end


def reporters(r: Reader) -> list[Reference]:
    return [ref for i in range(len(r.toks)) if (ref := _reporter(r, i)[0])]


def docket_kind(docket: str) -> tuple[str, dict]:
    m = re.fullmatch(r"(\d{1,2})([A-Z]{1,2})([_. ])(\d{1,5})/(\d{4})", docket)
    if m:
        style = {"_": "underscore", ".": "dot", " ": "space"}[m[3]]
        return "federal_tribunal_dot_docket" if style == "dot" else "federal_tribunal_modern_docket", {"chamber": m[1], "area": m[2], "separator": style, "serial": m[4], "year": m[5]}
    m = re.fullmatch(r"([A-Z])\s+(\d{1,5})/(\d{2})", docket)
    if m:
        return "federal_tribunal_legacy_single_letter_docket", {"chamber": None, "area": m[1], "separator": "space", "serial": m[2], "year": m[3]}
    return "unknown_docket", {}


def dockets(r: Reader) -> list[Reference]:
    """Those with a four-digit year first."""
    out = []
    for i, t in enumerate(r.toks):
        if t.kind != "docket":
            continue
        kind, parts = docket_kind(" ".join(t.text.split()))
        docket = t.text.replace(" ", "_") if kind == "federal_tribunal_modern_docket" else " ".join(t.text.split())
        date, j = r.date(i + 1)
        after = r.at(j - 1).end + DOCKET_WINDOW if date else t.end + DOCKET_WINDOW
        while r.at(j).start < after and r.at(j).low not in PINPOINT_WORDS:
            j += 1
        point = r.pinpoint(j) if r.at(j).start < after else None
        point = re.sub(r" ff?$", "", point) if point else None
        out.append(Reference(" ".join(x for x in (docket, date, f"E. {point}" if point else "") if x), "court", kind, parts | {"docket": docket, "base": docket, "date": date, "pinpoint": point}))
    return sorted(out, key=lambda x: "legacy" in x.subfamily)


def official(r: Reader) -> list[Reference]:
    out = []
    for word, kind, n in (("SR", "systematic_collection", 1), ("BBl", "federal_gazette", 2), ("AS", "official_collection", 2)):
        for i, t in enumerate(r.toks):
            rest = [r.at(i + k) for k in range(1, n + 1)]
            if t.text == word and all(x.kind == "num" for x in rest) and (n == 1 or re.fullmatch(r"\d{4}", rest[0].text)):
                out.append(Reference(" ".join([word, *(re.match(r"[\d.]+", x.text)[0].rstrip(".") for x in rest)]), "official_reference", kind))
    return out


def references(text: str, own_code: str | None = None) -> list[Reference]:
    """All references of a text, by family, each canonical form once."""
    r = Reader(text)
    out: dict[str, Reference] = {}
    for ref in (*articles(r, own_code), *sections(r), *reporters(r), *dockets(r), *official(r)):
        out.setdefault(ref.citation, ref)
    return list(out.values())


def classify(value: str) -> Reference:
    """What a corpus key is: a statute, a reporter citation, a docket, or unknown with what can be made out."""
    value = " ".join(value.split())
    r = Reader(value)
    if value.startswith("Art. ") and (found := articles(r)):
        same = next((x for x in found if x.citation == value), found[0])
        return Reference(value, same.family, same.subfamily, same.parts)
    if value.startswith("BGE ") and (found := reporters(r)):
        return found[0]
    found = dockets(r)
    for ref in found:
        if ref.citation == value:
            return ref
    parts: dict = {}
    compact = re.match(r"(\d{1,2})([A-Z]{1,2})/(\d{1,6})", value)
    if found:
        parts = found[0].parts | {"fallback": found[0].subfamily}
    elif compact:
        parts = {"chamber": compact[1], "area": compact[2], "serial": compact[3], "separator": "slash_compact", "fallback": "compact_slash_docket"}
    loose = re.search(r"\b(?:consid\.|cons\.|E\.|c\.)\s*([^\s,;)]*)", value)
    if parts and loose:
        parts["pinpoint"] = re.sub(r"[^A-Za-z0-9]+$", "", loose[1]) or None
    return Reference(value, "unknown", "unknown", parts)


def base_of(citation: str | None) -> str | None:
    """The judgment that a court citation belongs to."""
    ref = classify(citation) if citation else None
    return ref.parts.get("base") if ref and ref.family == "court" else None


def _cited(r: Reader) -> list[tuple[int, int]]:
    """Spans of full citations: what they name is not of this judgment."""
    spans, i = [], 0
    while i < len(r.toks):
        ref, j, end = _reporter(r, i)
        t = r.at(i)
        if ref:
            spans.append((t.start, end))
        elif t.kind == "docket":
            _, j = r.date(i + 1)
            end = r.at(j - 1).end
            if r.at(j).low in PINPOINT_WORDS and (m := _PINPOINT.match(r.text, r.at(j).end)):
                end = m.end()
                j = r.past(end, j)
            spans.append((t.start, end))
        i = max(j, i + 1)
    return spans


def back_references(text: str | None, base: str | None) -> list[str]:
    """Considerations of the own judgment that a text refers to, as `base E. n`, sorted."""
    if not text or not base:
        return []
    r = Reader(text)
    cited, found = _cited(r), set()
    for i, t in enumerate(r.toks):
        if t.low not in OWN_WORDS or r.at(i + 1).kind != "num" or any(a <= t.start < b for a, b in cited):
            continue
        refs, j = [r.at(i + 1).text], i + 2
        while r.at(j).low in _REFS_LISTED and r.at(j + 1).kind == "num":
            refs.append(r.at(j + 1).text)
            j += 2
        b = i - 1 - (r.at(i - 1).low == "in")
        placed = r.at(b).low in PLACED
        b = i - 1
        if r.at(b).low.rstrip(".") in BETWEEN:
            b -= 1
        elif (r.at(b - 1).low, r.at(b).low) in (("i.", "e."), ("d.", "h.")):
            b -= 2
        introduced = r.at(b).low.rstrip(".") in INTRODUCED or (r.at(b).text == "." and r.at(b - 1).low in INTRODUCED)
        alone = r.at(i - 1).text == "(" and r.at(j).text == ")"
        if placed or introduced or alone or r.at(j).low.rstrip(".") in PLACED:
            found.update(x for x in refs if re.fullmatch(r"\d+(\.\d+)*[a-z]?", x))
    return sorted(f"{base} E. {x}" for x in found)

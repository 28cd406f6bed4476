"""Rules over paragraphs and their model-made descriptions: roles, outcomes, signal words, areas, repair of letters.

What a model says is a hint; cues in the source text decide. Word lists are parameters with defaults.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .citations import fold
from .text import clean

# Roles of a paragraph, other names for them, and the cues that settle a role, first hit in this order.
ROLES = ("holding", "reasoning", "facts", "procedural_history", "legal_standard", "application", "citation", "costs", "notification", "disposition", "neutral")
ROLE_NAMES = {"background": "facts", "fact": "facts", "factual": "facts", "procedure": "procedural_history", "procedural": "procedural_history", "standard_of_review": "legal_standard", "cost": "costs", "fees": "costs", "notice": "notification", "notify": "notification", "obiter": "reasoning"}
ROLE_CUES = {
    "notification": ("dieses urteil wird", "le présent arrêt est communiqué", "la presente sentenza", "schriftlich mitgeteilt", "greffier", "gerichtsschreiber"),
    "costs": ("gerichtskosten", "prozesskosten", "verfahrenskosten", "parteientschädigung", "frais judiciaires", "frais de la cause", "dépens", "spese giudiziarie", "ripetibili", "unentgeltliche rechtspflege", "assistance judiciaire"),
    "disposition": ("demnach erkennt", "erkennt das bundesgericht", "par ces motifs", "per questi motivi", "die beschwerde wird", "le recours est", "il ricorso è"),
    "facts": ("sachverhalt", "faits", "fatti"),
    "procedural_history": ("vorinstanz", "verwaltungsgericht", "kantonsgericht", "tribunal cantonal", "cour de justice", "replik", "duplik", "vernehmlassung"),
    "legal_standard": ("nach art.", "gemäss art.", "selon l'art.", "aux termes de l'art.", "giusta l'art.", "ai sensi dell'art.", "rechtsprechung", "jurisprudence"),
    "application": ("im vorliegenden fall", "en l'espèce", "nel caso concreto", "vorliegend"),
}
# Outcomes, and the phrases that show one (each a run of words that may have others between them where `…` stands).
OUTCOMES = ("neutral", "dismissed", "granted", "partial", "inadmissible", "remitted", "none")
OUTCOME_PHRASES = {
    "remitted": ("sache wird … zurückgewiesen", "sache wird … zurueckgewiesen", "zur neuen entscheidung … zurückgewiesen", "zur neuen beurteilung … zurückgewiesen", "zur erneuten beurteilung … zurückgewiesen", "an die vorinstanz … zurückgewiesen", "renvoie la cause", "la cause est renvoyée", "la causa è rinviata", "rinvia la causa"),
    "inadmissible": ("auf die beschwerde wird nicht eingetreten", "nicht einzutreten", "nichteintreten", "irrecevable", "inammissibile"),
    "granted": ("beschwerde wird gutgeheissen", "beschwerde gutzuheissen", "le recours est admis", "recours doit être admis", "il ricorso è accolto", "ricorso dev'essere accolto"),
    "dismissed": ("beschwerde wird abgewiesen", "beschwerde abzuweisen", "le recours est rejeté", "recours doit être rejeté", "il ricorso è respinto", "ricorso dev'essere respinto"),
    "in part": ("teilweise", "partiellement", "parzialmente"),
}
WITH_OUTCOME, WITHOUT_RULES = ("disposition", "holding", "application", "reasoning"), ("facts", "procedural_history", "costs", "notification")
# Words of sources that are no formal anchors, by what they point to.
SIGNALS = {
    "secondary_sources": ("Basler Kommentar", "Zürcher Kommentar", "Berner Kommentar", "Commentaire romand", "Kommentar", "Commentaire", "Handbuch", "Traité", "Lehrbuch", "RDAF", "AJP", "ZBl", "SZS", "ZBJV", "ZSR"),
    "document_or_plan_anchors": ("Zonenplan", "Nutzungsplan", "Richtplan", "Gestaltungsplan", "Baubewilligung", "Baugesuch", "Vertrag", "Gutachten", "Bericht", "Protokoll", "Zahlungsbefehl", "plan de zones", "permis de construire", "contrat", "rapport", "expertise", "piano regolatore", "licenza edilizia", "contratto", "perizia"),
    "event_anchors": ("Volksabstimmung", "Abstimmung", "Referendum", "Initiative", "Wahl", "votation", "élection", "votazione", "iniziativa", "elezione"),
    "legal_source_anchors": ("Bundesgesetz", "Gesetz", "Verordnung", "Reglement", "Richtlinie", "Kreisschreiben", "Weisung", "Botschaft", "loi fédérale", "ordonnance", "règlement", "circulaire", "legge federale", "ordinanza", "regolamento"),
}
# Divisions and docket prefixes of the court with the area of law they deal with.
AREAS = {"I": "constitutional", "II": "public", "III": "civil", "IV": "criminal", "V": "social insurance", "1": "constitutional", "2": "public", "4": "civil", "5": "civil", "6": "criminal", "8": "social insurance", "9": "social insurance"}
UMLAUTS = {"a": "ä", "o": "ö", "u": "ü"}
NO_CODES = ("Abs", "Art", "lit", "Bst", "Ziff", "Satz", "Nr", "BGE", "ATF", "DTF")


def norm(c: Column) -> Column:
    """Blanks squashed, accents folded, lower case."""
    return F.lower(fold(clean(c)))


def holds(text: Column, phrases: tuple[str, ...]) -> Column:
    """Whether a normalised text holds a phrase; `…` stands for up to 140 characters."""
    plain = [p for p in phrases if "…" not in p]
    gaps = [p for p in phrases if "…" in p]
    out = F.lit(False)
    for p in plain:
        out = out | text.contains(_folded(p))
    for p in gaps:
        out = out | text.rlike(".{0,140}".join(_folded(x) for x in p.split("…")))
    return out


def _once(value: Column, body) -> Column:
    """body(value), the value computed once."""
    return F.transform(F.array(value), body)[0]


def _folded(s: str) -> str:
    from .grammar import fold as fold_text

    return fold_text(s)


def named_role(c: Column) -> Column:
    """A role by any of its names; `reasoning` for others."""
    key = F.replace(norm(c), F.lit(" "), F.lit("_"))
    names = F.create_map(*[F.lit(x) for pair in ROLE_NAMES.items() for x in pair])
    key = F.when(key == "legal_rule", "legal_standard").otherwise(F.coalesce(names[key], key))
    return F.when(key.isin(*ROLES), key).otherwise("reasoning")


def paragraph_role(said: Column, text: Column, notification: Column | None = None) -> Column:
    """struct(role, said, corrected): a notification mark, else the first cue of the text, else what the model said."""

    def settle(t: Column) -> Column:
        found = F.when(F.coalesce(notification, F.lit(False)), "notification") if notification is not None else F.when(F.lit(False), "")
        for role, cues in ROLE_CUES.items():
            found = found.when(holds(t, cues), role)
        return found

    def both(x: Column) -> Column:
        role = F.coalesce(x["found"], x["was"])
        return F.struct(role.alias("role"), x["was"].alias("said"), (role != x["was"]).alias("corrected"))

    return _once(F.struct(_once(norm(text), settle).alias("found"), named_role(F.coalesce(said, F.lit(""))).alias("was")), both)


def shown_outcome(text: Column, head: int = 1400) -> Column:
    """The outcome that a text's head states, null without any."""

    def settle(t: Column) -> Column:
        part = holds(t, OUTCOME_PHRASES["in part"])
        out = F.when(holds(t, OUTCOME_PHRASES["remitted"]), "remitted").when(holds(t, OUTCOME_PHRASES["inadmissible"]), "inadmissible")
        for kind in ("granted", "dismissed"):
            out = out.when(holds(t, OUTCOME_PHRASES[kind]), F.when(part, "partial").otherwise(kind))
        return out

    return _once(norm(F.substring(text, 1, head)), settle)


def outcome_signal(said: Column, text: Column, role: Column) -> Column:
    """struct(outcome, said, corrected): a stated outcome where the role may have one; else nothing but what is neutral stays."""
    was = F.replace(norm(F.coalesce(said, F.lit(""))), F.lit(" "), F.lit("_"))
    was = F.when(was.isin(*OUTCOMES), was).otherwise("none")
    shown = F.when(role.isin(*WITH_OUTCOME), shown_outcome(text))
    outcome = F.coalesce(shown, F.when(was.isin("neutral", "none"), was).otherwise("none"))
    return F.struct(outcome.alias("outcome"), was.alias("said"), (outcome != was).alias("corrected"))


def signal_terms(text: Column, words: tuple[str, ...]) -> Column:
    """Those of the words that stand in the text as words, in the list's order."""
    found = [F.when(text.rlike(rf"(?iu)(?<![\p{{L}}\p{{N}}])\Q{w}\E(?![\p{{L}}\p{{N}}])"), F.lit(w)) for w in words]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def nonformal(c: Column) -> Column:
    """Where an anchor that is none belongs: secondary source, document, event, legal source; null if nowhere."""
    out = F.when(F.lit(False), "")
    for kind, words in SIGNALS.items():
        out = out.when(F.size(signal_terms(c, words)) > 0, kind)
    return out


def area_from_structure(division: Column, prefix: Column, codes_area: Column | None = None) -> Column:
    """The area by division of the reporter, else by docket prefix, else of the first code, else unknown."""
    areas = F.create_map(*[F.lit(x) for pair in AREAS.items() for x in pair])
    return F.coalesce(areas[division], areas[F.regexp_extract(prefix, r"^(\d+)", 1)], codes_area if codes_area is not None else F.lit(None), F.lit("unknown"))


def authority_roles(reporter: Column, refs: Column, considerations: Column, notification: Column) -> Column:
    """What a judgment row is good for: published, leading (25 references or more), detailed (5 considerations or more), procedural."""
    return F.array_compact(F.array(F.when(reporter, "published_leading_case"), F.when(refs >= 25, "frequently_cited"), F.when(considerations >= 5, "detailed_reasoning"), F.when(notification, "procedural")))


def signal_level(labels: Column, domains: Column, roles: Column, terms: Column) -> Column:
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    return F.when((n(labels) > 0) & (n(terms) >= 3), "strong").when((n(labels) > 0) | (n(domains) > 0) | (n(roles) >= 2), "medium").otherwise("weak")


def model_priority(level: Column, roles: Column, chars: Column) -> Column:
    """Which rows a model should read first."""
    return F.when((chars < 80) | F.array_contains(roles, "procedural"), "skip").when(level == "strong", "low").when((level == "medium") | (chars < 400), "normal").otherwise("high")


def consideration_role(label: Column, text: Column, said: Column) -> Column:
    """The model's role, else facts for lettered considerations, else by phrases of holding and admissibility, else reasoning."""
    t = norm(text)
    return F.coalesce(F.nullif(clean(said), F.lit("")), F.when(label.rlike("^[A-Z]"), "facts"), F.when(holds(t, ("demnach", "par ces motifs", "per questi motivi")), "holding"), F.when(holds(t, ("einzutreten", "eintreten", "recevable", "ammissibile")), "admissibility"), F.lit("reasoning"))


def is_noise(text: Column, role: Column, roles: tuple[str, ...] = ("costs", "notification")) -> Column:
    """Rows that shouldn't be retrieved: by role, or cost, disposition and signature phrases."""
    return F.coalesce(role.isin(*roles), F.lit(False)) | holds(norm(text), (*ROLE_CUES["costs"][:4], *ROLE_CUES["notification"][:2], "im namen des"))


def is_notification(text: Column, head: int = 600) -> Column:
    return holds(norm(F.substring(text, 1, head)), ROLE_CUES["notification"])


def query_areas(query: Column, words: dict[str, tuple[str, ...]]) -> Column:
    """Areas whose words stand in the query; `any` without."""
    t = norm(query)
    found = F.array_compact(F.array(*[F.when(holds(t, w), a) for a, w in words.items()]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("any")))


def allowed_divisions(areas: Column) -> Column:
    """Divisions that deal with any of the areas; all for `any`."""
    divisions = [d for d in AREAS if not d.isdigit()]
    return F.when(F.array_contains(areas, "any"), F.array(*map(F.lit, divisions))).otherwise(F.array_compact(F.array(*[F.when(F.array_contains(areas, AREAS[d]), d) for d in divisions])))


def law_codes(values: Column, known: tuple[str, ...]) -> Column:
    """Codes among the values: edges stripped, known or all upper-case, in order, each once."""
    bare = F.transform(values, lambda v: F.regexp_replace(v, r"^[\s(\[,;:.]+|[\s)\],;:.]+$", ""))
    return F.array_distinct(F.filter(bare, lambda v: ~v.isin(*NO_CODES) & (v.isin(*known) | v.rlike(r"^[A-Z][A-Z0-9]{1,10}$"))))


def invalid_codes(values: Column, known: tuple[str, ...]) -> Column:
    return F.array_except(values, law_codes(values, known))


def term_map(m: Column) -> Column:
    """struct(labels, terms) of a map of concepts to their terms."""
    return F.struct(F.map_keys(m).alias("labels"), F.array_distinct(F.flatten(F.map_values(m))).alias("terms"))


def text_of(parts: Column, most: int = 2000) -> Column:
    """Nested parts in one text, cut at `most` characters."""
    return F.substring(F.array_join(F.filter(F.transform(F.flatten(parts), clean), lambda x: x != ""), " "), 1, most)


def spelled_out(c: Column) -> Column:
    out = c
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("Ä", "Ae"), ("Ö", "Oe"), ("Ü", "Ue"), ("ß", "ss")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def words(c: Column) -> Column:
    """Lower-case words, digits, dockets (`_` as `.`)."""
    return F.transform(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_./]+"), F.lit(0)), lambda w: F.translate(w, "_", "."))


def question_signals(c: Column) -> Column:
    """struct(questions, numbers, statutes, cases, sentences) counted in a query."""
    n = lambda p: F.regexp_count(c, F.lit(p))
    return F.struct(n(r"\?").alias("questions"), n(r"\b\d+\b").alias("numbers"), n(r"(?i)\bart\.\s*\d").alias("statutes"), n(r"\b(?:BGE|ATF|DTF)\s+\d").alias("cases"), n(r"[.!?]+(?:\s|$)").alias("sentences"))


def english_rather(c: Column) -> Column:
    from .text import cue_count

    return cue_count(c, "en") > cue_count(c, "de")


def umlaut_candidates(word: Column, most: int = 3) -> Column:
    """The spellings of a word with umlauts in up to `most` of its first vowels that may have lost them, in a fixed order."""
    out = F.array(F.struct(F.lit("").alias("done"), F.lit(0).alias("n")))
    step = lambda acc, ch: F.flatten(F.transform(acc, lambda a: _options(a, ch, most)))
    spelled = F.aggregate(F.split(word, ""), out.cast("array<struct<done:string,n:int>>"), lambda acc, ch: F.when(ch == "", acc).otherwise(step(acc, ch)))
    return F.filter(F.transform(spelled, lambda a: a["done"]), lambda w: w != word)


def _options(a: Column, ch: Column, most: int) -> Column:
    kind = "array<struct<done:string,n:int>>"
    same = F.struct(F.concat(a["done"], ch).alias("done"), a["n"].alias("n"))
    marks = F.create_map(*[F.lit(x) for pair in UMLAUTS.items() for x in pair])
    other = F.struct(F.concat(a["done"], marks[ch]).alias("done"), (a["n"] + 1).alias("n"))
    return F.when(marks[ch].isNotNull() & (a["n"] < most), F.array(same, other).cast(kind)).otherwise(F.array(same).cast(kind))

"""Citation scalars and parsers on golden examples."""

from pyspark.sql import functions as F

from citeloom.functions import citations as C
from citeloom.functions import grammar
from citeloom.functions import parsers as P
from citeloom.functions import text as T


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "c string").select(f(F.col("c")).alias("x")).first()["x"]


def test_split_and_dates(spark):
    assert tuple(one(spark, "BGE 112 IV 35 E. 4.2", C.split_court)) == ("BGE 112 IV 35", "4.2")
    assert one(spark, "BGE 112 IV 35 S. 128", C.split_court)["base"] is None
    assert one(spark, "1B_31/2014 02.06.2014 E. 3", C.strip_date) == "1B_31/2014 E. 3"
    assert one(spark, "I 51/04 02.06.2005", C.strip_date) == "I 51/04"
    assert one(spark, "1B_31/2014 E. 3", C.strip_date) is None
    assert one(spark, "1B_77/2015 11.08.2015", C.undated_base) == "1B_77/2015"


def test_ranges(spark):
    assert one(spark, "BGE 112 IV 35 E. 4-6", C.expand_range) == [f"BGE 112 IV 35 E. {i}" for i in (4, 5, 6)]
    assert one(spark, "BGE 112 IV 35 E. 2.1-3.4", C.expand_range) == []
    assert one(spark, "1B_8/2012 09.04.2012 E. 2.1-2.2", C.expand_range) == ["1B_8/2012 09.04.2012 E. 2.1", "1B_8/2012 09.04.2012 E. 2.2", "1B_8/2012 E. 2.1", "1B_8/2012 E. 2.2"]
    assert one(spark, "BGE 112 IV 35 E. 1-99", C.expand_range) == []


def test_reporters_and_codes(spark):
    assert one(spark, "vgl. ATF 120 II 7 consid. 2; DTF 120 II 7 c. 2, BGE 121 V 8", P.reporter_citations) == ["BGE 120 II 7 E. 2", "BGE 121 V 8"]
    assert one(spark, "SR 101.1", C.law_code) == "101.1"
    assert one(spark, "Abs", C.law_code) is None
    assert one(spark, "5A.12/2010 E. 3", C.court_base) == "5A_12/2010"
    assert tuple(one(spark, "4.2.1", C.consideration)) == ("4", 3)


def test_articles():
    want = {
        "nach Art. 14 Abs. 3 lit. c StPO gilt": ["Art. 14 Abs. 3 Bst. c StPO"],
        "Art. 7, 8 und 9 BV": ["Art. 7 BV", "Art. 8 BV", "Art. 9 BV"],
        "Art. 21abis Abs. 2 AsylG": ["Art. 21abis Abs. 2 AsylG"],
        "Art. 11-13 EpG": ["Art. 11-13 EpG"],
        "Art. 3 to 5 BV": ["Art. 3-5 BV"],
        "Art. 5 Abs. 1 und 2 BV": ["Art. 5 Abs. 1 und 2 BV"],
        "Art. 3 Abs.1 StPO": ["Art. 3 Abs. 1 StPO"],
        "Art. 29a Abs. 1 lit. a und b BV": ["Art. 29a Abs. 1 Bst. a und b BV"],
        "Art. 4 Nummer 3 OR": ["Art. 4 Ziff. 3 OR"],
        "Artikel 2 des Gesetzes (XyG; SR 999.1)": ["Art. 2 XyG"],
        "Art. 2 des Gesetzes, SR 999.1": ["Art. 2 999.1"],
        "Art. 6 und Art. 7 Satz 2 des Vertrags": ["Art. 6", "Art. 7 Satz 2"],
        "Art. 1 XyV 2": ["Art. 1 XyV 2"],
        "Artig. 5 BV": [],
        "Art. \n 5": ["Art. 5"],
    }
    assert {t: P.articles_of(t) for t in want} == want
    assert P.articles_of("Art. 12 gilt", "OR") == ["Art. 12 OR"]


def test_sections_and_publications():
    cites = lambda t: [x.citation for x in grammar.references(t)]
    assert cites("§ 4a Abs. 1 SHG, §§ 5 ff. PBG/SZ; § 1.22 und §7") == ["§ 4a Abs. 1 SHG", "§§ 5 ff. PBG/SZ", "§ 1.22", "§ 7"]
    assert cites("SR 1, BBl 2001 2 und AS 2003 4.") == ["SR 1", "BBl 2001 2", "AS 2003 4"]
    assert cites("Art. 1 BV; BGE 111 II 3; Art. 1 BV; ATF 111 II 3") == ["Art. 1 BV", "BGE 111 II 3"]
    assert cites("") == [] and cites("Art. BGE E. § x 5A_ ") == []


def test_dockets_and_keys():
    assert P.dockets_of("Urteil 1C_21/2013 vom 2. Mai 2014 E. 3.1") == ["1C_21/2013 02.05.2014 E. 3.1"]
    assert P.dockets_of("arrêt 1C 21/2013 du 2 août 2014 consid. 3") == ["1C_21/2013 02.08.2014 E. 3"]
    assert P.dockets_of("I 12/03; 2A.3/2001") == ["2A.3/2001", "I 12/03"]
    assert P.dockets_of("1C_21/2013" + " x" * 60 + " E. 4") == ["1C_21/2013"]
    key = grammar.classify("12T_1/2007 29.05.2007 E.")
    assert (key.family, key.parts["fallback"], key.parts["chamber"], key.parts["pinpoint"]) == ("unknown", "federal_tribunal_modern_docket", "12", None)
    key = grammar.classify("1C/8235 E. 3")
    assert (key.parts["separator"], key.parts["serial"], key.parts["pinpoint"]) == ("slash_compact", "8235", "3")
    assert grammar.base_of("BGE 111 II 3 E. 4") == "BGE 111 II 3" and grammar.base_of("Art. 1 BV") is None and grammar.base_of(None) is None
    assert [grammar.code_kind(c) for c in (None, "101", "A/B", "A-B", "AbC 1", "ABC", "AbC")] == ["unresolved_law_code", "systematic_collection_number", "cantonal_or_slash_abbreviation", "compound_abbreviation", "numbered_abbreviation", "uppercase_abbreviation", "mixedcase_abbreviation"]


def test_back_references():
    want = {
        "wie dargelegt (vgl. E. 1.2 hiervor), dass": ["1.2"],
        "(vgl. E. 6.2.1 hiervor und E. 7 hiervor)": ["6.2.1", "7"],
        "voir considérant 4 ci-dessus": ["4"],
        "siehe sopra consid. 4": ["4"],
        "vgl. ferner E. 3.2": ["3.2"],
        "consid. 5 ci-après": ["5"],
        "vgl. oben E. 3.2 und 3.3; BGE 111 II 3 E. 4": ["3.2", "3.3"],
        "vgl. bereits hiervor E. 3.3a)": ["3.3a"],
        "siehe auch Erwägungen 2, 3 oder 4": ["2", "3", "4"],
        "(cf. supra consid. 6.6) nach 6B_15/2020": ["6.6"],
        "vgl. i. e. E. 9": ["9"],
        "nach BGE 111 II 3 E. 4.2": [],
        "vgl. 1B_4/2010 vom 2. Mai 2010 E. 3.5 oben": [],
        "vorstehend dargestellt; E. 4 der Vorinstanz": [],
        "dazu (E. 4)": ["4"],
    }
    assert {t: P.back_references(t, "X") for t in want} == {t: [f"X E. {r}" for r in v] for t, v in want.items()}
    assert P.back_references(None, "X") == P.back_references("vgl. E. 2", None) == []
    assert P.stem_of("gerichten") == "gericht"


def test_text(spark):
    assert one(spark, " a\x00b \n c ", T.clean) == "a b c"
    assert one(spark, "Der Hund und die Katze", T.language) == "de"
    assert one(spark, "xyz", T.language) == "unknown"
    assert one(spark, "One a. Two b. Three c.", lambda c: T.passages(c, 10)) == ["One a. Two b.", "Three c."]
    assert one(spark, "<think>NO</think> yes", T.parse_verdict) == "YES"

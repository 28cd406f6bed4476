"""Every query with a SQL counterpart against DuckDB, on the smallest tables; the fold-based operators against plain Python."""

import math
import os
import random
from collections import Counter
from decimal import Decimal

import duckdb
import pytest

from citeloom.operators import evaluate, fusion, granularity, lexical
from citeloom.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def key(v):
    return round(float(v), 5) if isinstance(v, (int, float, Decimal)) and not isinstance(v, bool) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, duck, name):
    df = catalog.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    mine = sorted(tuple(key(v) for v in r) for r in df.select(cols).collect())
    res = duck.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in res.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    assert mine == sorted(tuple(key(r[i]) for i in order) for r in res.fetchall())


def test_anchors_of_widely_held_items(spark, tmp_path):
    rng = random.Random(8)
    vocab = [f"v{i}" for i in range(300)]
    item, short = "Alpha beta, gamma delta: epsilon zeta eta theta", "ta xy"
    docs = []
    for i in range(160):
        a, b = (" ".join(rng.choices(vocab, k=rng.randint(1, 200))) for _ in range(2))
        docs.append((i, f"{a} {item if i % 8 else item.lower()}{b} {'beta xyz' if i % 3 == 0 else ''}"))
    spark.createDataFrame([*docs, (900, None), (901, ""), (902, "gamma delta epsilon zeta eta")], "doc_id long, text string").toPandas().to_parquet(tmp_path / "documents.parquet")
    spark.createDataFrame([(1, item), (2, short), (3, None)], "item_id long, text string").toPandas().to_parquet(tmp_path / "benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    df = catalog.queries()["hybrid_retrieve"](spark, str(tmp_path))
    res = con.execute(catalog.oracle_sql()["hybrid_retrieve"])
    names = [c[0] for c in res.description]
    want = sorted(tuple(key(r[names.index(c)]) for c in df.columns) for r in res.fetchall())
    assert sorted(tuple(key(v) for v in r) for r in df.collect()) == want
    held = lexical.holders(spark.read.parquet(str(tmp_path / "documents.parquet")), spark.createDataFrame([(1, item), (2, short)], "query_id long, query string"))
    assert {(r["query_id"], r["doc_id"]) for r in held.collect()} == {(k, i) for k, q in ((1, item), (2, short)) for i, t in docs if q in t}


def test_round_robin(spark):
    rows = [(1, "a", 10, 1), (1, "a", 11, 2), (1, "b", 10, 1), (1, "b", 12, 2), (1, "b", 13, 3)]
    df = spark.createDataFrame(rows, "query_id long, channel string, doc_id long, rk int")
    got = [r["doc_id"] for r in fusion.round_robin(df, ["a", "b"], 2, 10).orderBy("rk").collect()]
    assert got == [10, 12, 11, 13]
    tail = spark.createDataFrame([(1, 13, 1), (1, 99, 2)], "query_id long, doc_id long, rk int")
    both = fusion.guaranteed(fusion.round_robin(df, ["a", "b"], 1, 2), tail, 10)
    assert [r["doc_id"] for r in both.orderBy("rk").collect()] == [10, 12, 13, 99]


def test_empty_sets(spark):
    s = "query_id long, doc_id long"
    pred, gold = spark.createDataFrame([(1, 5)], s), spark.createDataFrame([(2, 7)], s)
    got = {r["query_id"]: (r["precision"], r["recall"], r["f1"]) for r in evaluate.by_query(pred, gold).collect()}
    assert got == {1: (0.0, 1.0, 0.0), 2: (1.0, 0.0, 0.0)}


def test_granularity(spark):
    corpus = spark.createDataFrame([("Art. 78 Abs. 1 BV",), ("Art. 78 Abs. 2 BV",), ("Art. 9 BV",)], "citation string")
    pred = spark.createDataFrame([(1, 0, "Art. 78 BV"), (1, 1, "Art. 78 Abs. 2 BV"), (1, 2, "BGE 141 IV 87")], "query_id long, pos int, citation string")
    got = [r["citation"] for r in granularity.expand(pred, granularity.children(corpus)).orderBy("rk").collect()]
    assert got == ["Art. 78 Abs. 1 BV", "Art. 78 Abs. 2 BV", "BGE 141 IV 87"]


def test_forbid_gold():
    with pytest.raises(ValueError):
        evaluate.forbid_gold("/data/gold_bank.csv")


def test_sources(spark, tmp_path):
    from citeloom.sources import files

    (tmp_path / "a.jsonl").write_text('{"citation": "x", "n": 1}\n\nnot json\n[1]\n{"citation": "y", "n": 2}\n')
    got = files.read_jsonl(spark, str(tmp_path / "a.jsonl"), "citation string, n int")
    assert sorted(r["citation"] for r in got.collect()) == ["x", "y"]
    (tmp_path / "a.csv").write_text('citation,text\nA,"two\nlines"\nB,one\n')
    rows = files.numbered(files.read_csv(spark, str(tmp_path / "a.csv"), ["citation", "text"]))
    assert [(r["row_no"], r["text"]) for r in rows.orderBy("row_no").collect()] == [(0, "two\nlines"), (1, "one")]
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    upd = spark.createDataFrame([(2, "c", 1), (2, "d", 2)], "k long, v string, seq int")
    assert {r["k"]: r["v"] for r in files.overlay(base, upd, "k", ["v"]).collect()} == {1: "a", 2: "d"}


def test_stream(spark, tmp_path):
    from citeloom.streaming import events

    e = spark.read.parquet(f"{DIR}/events.parquet")
    e.write.parquet(str(tmp_path / "in"))
    q = events.windowed_counts(events.read_stream(spark, str(tmp_path / "in"), e.schema)).writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("w").agg({"n": "sum"}).first()[0] == e.count()


def test_lines_and_targets(spark, tmp_path):
    from citeloom.sources import files

    (tmp_path / "a.jsonl").write_text('{"citation": "x", "n": 1}\n\nnot json\n[1]\n{"citation": "y", "n": 2}\n')
    got = files.read_lines(spark, str(tmp_path / "a.jsonl"), "citation string, n int").collect()
    assert sorted((r["line_no"], r["citation"], r["n"]) for r in got) == [(1, "x", 1), (5, "y", 2)]
    (tmp_path / "t.json").write_text('[{"id": 1}, {"id": 2}, {"id": 3}]')
    assert [r["id"] for r in files.targets(spark, str(tmp_path / "t.json"), "id int", 2).collect()] == [1, 2]
    rows = spark.createDataFrame([(1, "a", "p"), (2, "b", "q")], "id int, v string, w string")
    other = spark.createDataFrame([(2, "z"), (2, "z")], "id int, more string")
    assert [tuple(r) for r in files.picked(rows, spark.createDataFrame([(2,), (2,), (9,)], "id int"), "id", ["v"], other).collect()] == [(2, "b", "z")]


def test_corpus_to_graph(spark, tmp_path):
    from citeloom.sources import files

    (tmp_path / "c.csv").write_text('citation,text\nBGE 111 II 3 E. 4,"nach Art. 5 BV und\nBGE 111 II 3 E. 4; 1B_2/2020 E. 1"\nArt. 5 BV,Wortlaut\n')
    rows = files.numbered(files.read_csv(spark, str(tmp_path / "c.csv"), ["citation", "text"]))
    nodes, edges = files.graph_of(rows, "all")
    assert {tuple(r) for r in edges.collect()} == {("BGE 111 II 3 E. 4", "Art. 5 BV"), ("BGE 111 II 3 E. 4", "1B_2/2020 E. 1")}
    masks = {r["citation"]: (r["origin_mask"], r["row_no"], r["dataset"]) for r in nodes.collect()}
    assert masks == {"BGE 111 II 3 E. 4": (1, 0, "all"), "Art. 5 BV": (3, 1, "all"), "1B_2/2020 E. 1": (2, None, "all")}
    files.write_classified(nodes, str(tmp_path / "classified"))
    again = spark.read.json(str(tmp_path / "classified"))
    assert {(r["citation"], r["family"]) for r in again.collect()} == {("BGE 111 II 3 E. 4", "court"), ("Art. 5 BV", "law"), ("1B_2/2020 E. 1", "court")}
    flat = {r["citation"]: r for r in files.segment_table(files.classified(nodes)).collect()}
    assert set(flat) == {"BGE 111 II 3 E. 4", "Art. 5 BV"} and (flat["BGE 111 II 3 E. 4"]["base"], flat["Art. 5 BV"]["law_code"]) == ("BGE 111 II 3", "BV")
    files.write_links(edges, str(tmp_path / "links"))
    assert files.read_adjacency(spark, str(tmp_path / "links")).count() == 2
    files.export_citations(nodes, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/counts")).first()["citations"] == 3


def test_index_files_and_lists(spark, tmp_path):
    from citeloom.sources import files

    docs = spark.createDataFrame([(1, "aa bb aa"), (2, "bb cc"), (3, None)], "doc_id long, text string")
    files.write_postings(lexical.postings(docs), docs.selectExpr("doc_id", "length(text) AS n"), str(tmp_path / "index"), 2)
    post, lengths = files.read_postings(spark, str(tmp_path / "index"), ["bb", "aa"])
    assert {(r["term"], r["doc_id"], r["tf"]) for r in post.collect()} == {("aa", 1, 2), ("bb", 1, 1), ("bb", 2, 1)} and lengths.count() == 3
    files.write_split_csv(spark.range(10), str(tmp_path / "split"), 4)
    assert spark.read.csv(str(tmp_path / "split"), header=True).count() == 10
    gold = spark.createDataFrame([(1, "Art. 1 X;B;B"), (2, "C")], "k long, g string")
    kids = spark.createDataFrame([("Art. 1 X", "Art. 1 Abs. 1 X"), ("Art. 1 X", "Art. 1 Abs. 2 X")], "article string, child string")
    out, stats = files.expanded_lists(gold, "k", "g", kids)
    assert {r["k"]: r["g"] for r in out.collect()} == {1: "Art. 1 Abs. 1 X;Art. 1 Abs. 2 X;B", 2: "C"}
    assert tuple(stats.first()) == (4, 1, 5)


def test_nested_documents(spark, tmp_path):
    from citeloom.operators import builders
    from citeloom.sources import files

    cards = spark.createDataFrame([(1, "Art. 5 Abs. 1 BV", "T", "text", ["x"], "", "", 1, 1, 0.5, None, "Art. 6 BV")], "line long, citation string, title string, text string, roles array<string>, rule string, summary string, out_degree int, cited int, specificity double, prev string, next string")
    parts = builders.fan_out(builders.law_documents(cards))
    assert set(parts) == {"documents", "adjacent_law_links"} and [r["target"] for r in parts["adjacent_law_links"].collect()] == ["Art. 6 BV"]
    good, bad = builders.processed(cards.unionByName(cards.withColumn("citation", lit_null())), builders.law_documents, "citation")
    assert good.count() == 1 and bad.first()["n"] == 1
    files.write_corpus(builders.law_documents(cards).select("doc_id", "family", "expansion.*"), str(tmp_path / "corpus"))
    assert spark.read.parquet(str(tmp_path / "corpus/adjacent_law_links")).count() == 1


def lit_null():
    from pyspark.sql import functions as F

    return F.lit(None).cast("string")


def test_vectors(spark, monkeypatch):
    import numpy as np

    from citeloom.operators import vector

    monkeypatch.setattr(vector, "BLOCK", 2)
    rng = np.random.default_rng(1)
    docs = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(40)] + [(50, None), (51, [1.0]), (52, [0.0] * 4)] + [(60 + i, [1.0, 0.0, 0.0, 0.0]) for i in range(5)]
    queries = [(7, docs[7][1]), (7, docs[8][1]), (9, [1.0, 0.0, 0.0, 0.0]), (10, None), (11, docs[3][1]), (12, docs[5][1])]
    got = {}
    frame = lambda rows, c: spark.createDataFrame(rows, f"{c} long, v array<double>").repartition(3)
    for r in vector.cosine_top_k(frame(docs, "doc_id"), frame(queries, "query_id"), 4).collect():
        got.setdefault(r["query_id"], []).append((r["rk"], r["doc_id"]))
    assert sorted(got[9])[:4] == [(1, 60), (2, 61), (3, 62), (4, 63)] and (1, 3) in got[11] and 10 not in got
    unit = {i: np.array(v) / max(1e-12, np.linalg.norm(v)) for i, v in docs if v and len(v) == 4}
    best = sorted((-round(float(unit[i] @ unit[5]), 6), i) for i in unit)[:4]
    assert [d for _, d in sorted(got[12])] == [i for _, i in best]


def test_language_budgets():
    from citeloom.operators import channels

    assert channels.language_budgets({"de": 900, "fr": 80, "it": 20}, 160) == {"de": 137, "fr": 13, "it": 10}
    assert sum(channels.language_budgets({"a": 5, "b": 5, "c": 0}, 11).values()) == 11
    assert channels.language_budgets({}, 10) == {}


def test_umlauts(spark):
    from pyspark.sql import functions as F

    from citeloom.functions import enrich

    one = lambda w: spark.range(1).select(enrich.umlaut_candidates(F.lit(w)).alias("x")).first()["x"]
    assert one("Hut") == ["Hüt"] and one("xyz") == [] and set(one("Ubung")) == {"Ubüng"} and len(one("aouaou")) == sum(1 for k in range(1, 64) if bin(k).count("1") <= 3)


@pytest.mark.parametrize("large", [2000, 2])
def test_pairs_of_large_baskets(spark, monkeypatch, large):
    from itertools import combinations

    from citeloom.operators import graph

    monkeypatch.setattr(graph, "LARGE", large)
    rng = random.Random(4)
    baskets = {b: rng.sample(range(12), rng.randint(0, 9)) for b in range(14)}
    got = graph.pair_prior(spark.createDataFrame([(b, i) for b, v in baskets.items() for i in [*v, *v[:1]]], "basket long, item long")).collect()
    want = {}
    for v in baskets.values():
        for p in combinations(sorted(v), 2):
            want[p] = want.get(p, 0) + 1
    assert {(r["a"], r["b"]): r["support"] for r in got} == {p: n for p, n in want.items() if n >= 2}


def test_case_alias_counts(spark):
    from citeloom.operators import graph

    rows = [f"BGE 111 II {b} E. {e}" for b in (1, 2) for e in range(1, 5)]
    edges = [("x", rows[0]), ("x", rows[1]), ("x", rows[5]), ("x", "Art. 1 BV"), (rows[0], rows[1]), (rows[2], "BGE 111 II 9 E. 1"), (rows[3], rows[3]), ("y", "x"), ("x", "BGE 111 II 1 E. 77")]
    nodes = spark.createDataFrame([(r, 1) for r in rows] + [("Art. 1 BV", 3), ("BGE 111 II 9 E. 1", 2)], "citation string, origin_mask int")
    e = spark.createDataFrame([*edges, edges[0]], "source string, target string")
    slow = {r["source"]: r["count"] for r in graph.case_alias_edges(e, nodes).groupBy("source").count().collect()}
    assert {r["source"]: r["n"] for r in graph.case_alias_counts(e, nodes).collect()} == slow


def test_folds_against_plain_python(spark):
    """The two order-dependent selections on a whole table against a plain reading of their definition."""
    from citeloom.plans import fixtures as fx
    from citeloom.plans import selection  # noqa: F401

    lists, fused = {}, {}
    for r in fx.channels(spark, DIR).collect():
        lists.setdefault(r["query_id"], {}).setdefault(r["channel"], []).append((r["rk"], r["doc_id"]))
    f = fusion.rrf(fx.channels(spark, DIR)).collect()
    for r in f:
        fused.setdefault(r["query_id"], []).append((r["rk"], r["doc_id"], round(r["score"], 6), r["channels"]))
    first, chosen = {}, {}
    for q, by in lists.items():
        queues = {c: [d for _, d in sorted(v)] for c, v in by.items()}
        taken, out = dict.fromkeys("ANR", 0), []
        alive = [c for c in "ANR" if c in queues]
        while alive and len(out) < 50:
            for c in list(alive):
                while queues[c] and queues[c][0] in out:
                    queues[c].pop(0)
                if not queues[c] or taken[c] >= 20:
                    alive.remove(c)
                elif len(out) < 50:
                    out.append(queues[c].pop(0))
                    taken[c] += 1
        rest = [d for _, d, _, _ in sorted(fused[q]) if d not in out]
        first[q] = (out + rest)[:200]
        pool, pick = fused[q], []
        for key_, n in ((lambda x: (-x[3], x[1]), 40), (lambda x: (x[1], x[1]), 20), (lambda x: (-x[2], x[1]), 100)):
            new = [x[1] for x in sorted(pool, key=key_) if x[1] not in pick][: min(n, 100 - len(pick))]
            pick += new
        chosen[q] = pick
    for name, want in (("round_robin_guarantee", first), ("diversified_selection", chosen)):
        got = {}
        for r in catalog.queries()[name](spark, DIR).collect():
            got.setdefault(r["query_id"], []).append((r["rk"], r["doc_id"]))
        assert {q: [d for _, d in sorted(v)] for q, v in got.items()} == want, name


def against_sql(spark, folder, name, **tables):
    """A query and its SQL over tables of their own (rows, schema)."""
    con = duckdb.connect()
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).toPandas().to_parquet(folder / f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = catalog.queries()[name](spark, str(folder))
    res = con.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in res.description]
    want = sorted(tuple(key(r[names.index(c)]) for c in df.columns) for r in res.fetchall())
    assert want and sorted(tuple(key(v) for v in r) for r in df.collect()) == want


LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_returnflag string"
ORDERS = "o_orderkey long, o_custkey long, o_totalprice double, o_orderpriority string"


def some_lines(seed, orders, suppliers, parts):
    """Lines and orders in which queries share many keys and documents tie."""
    rng = random.Random(seed)
    lines = [(o, rng.randrange(parts), rng.randrange(suppliers), n + 1, float(rng.choice([1, 2, 25, 48, 49, 50])), rng.randrange(11) / 100, rng.choice("ANR")) for o in range(orders) for n in range(rng.randint(1, 7))]
    about = [(o, rng.randrange(50), float(rng.choice([1000, 14500, 100500, 250000.25])), rng.choice(["1-URGENT", "3-MEDIUM", "5-LOW"])) for o in range(orders) if o % 9]
    return {"lineitem": (lines, LINES), "orders": (about, ORDERS)}


def test_authority_rounds_as_in_sql(spark, tmp_path):
    prices = [14500.0, 28500.0, 56500.0, 100500.0, 213500.0, 401500.0, 150500.0]
    against_sql(spark, tmp_path, "evidence_lookup", lineitem=([(i, i, 7, 1, 50.0, 0.0, "A") for i in range(7)], LINES), orders=([(i, i, p, "3-MEDIUM") for i, p in enumerate(prices)], ORDERS))


@pytest.mark.parametrize("name", ["law_direct", "court_statutes", "concept_channel", "anchor_links", "anchor_budgets", "area_bedrock", "companion_channel", "two_pass_channels", "ranker_features"])
@pytest.mark.parametrize("rows", [1 << 20, 300])
def test_channels_of_frequent_keys(spark, tmp_path, name, rows, monkeypatch):
    """Frequent keys, ties at the cut, weights of 0; in one tile and in many."""
    monkeypatch.setattr("citeloom.operators.product.INDEX_ROWS", rows)
    monkeypatch.setattr("citeloom.operators.product.ASKED_ROWS", rows)
    monkeypatch.setattr("citeloom.operators.product.DENSE", 4 if rows > 300 else 0)
    against_sql(spark, tmp_path, name, **some_lines(5, 700, 4, 30))


def test_co_occurrence_of_all_citing_documents(spark, tmp_path):
    """A statute that 130 documents cite: what only the last of them cites along with it is found too."""
    lines = [(o, 0, 5, 1, 50.0 if o == 0 else 1.0, 0.0, "A") for o in range(130)] + [(o, 7 + o % 2, 5, 1, 1.0, 0.0, "A") for o in range(90, 130)]
    names = {o: f"BGE {100 + o % 50} {('I', 'II', 'III', 'IV', 'V')[o % 5]} {o + 1} E. 1" for o in range(130)}
    last = sorted(names, key=names.get)[-1]
    lines.append((last, 20, 5, 1, 1.0, 0.0, "A"))
    table = spark.createDataFrame(lines, LINES).selectExpr("*", "1.0D AS l_extendedprice", "'O' AS l_linestatus")
    table.toPandas().to_parquet(tmp_path / "lineitem.parquet")
    edges = {(names[o], f"Art. {p % 400 + 1} Abs. 1 StPO") for o, p, *_ in lines}
    cites, own = Counter(t for _, t in edges), "Art. 1 Abs. 1 StPO"
    docs = {s for s, t in edges if t == own}
    n = Counter(t for s, t in edges if s in docs and t != own)
    want = sorted((-round(cites[t] / 100 + math.log1p(c) / 10, 4), t) for t, c in n.items())
    got = catalog.queries()["statute_co_occurrence"](spark, str(tmp_path)).orderBy("rk").collect()
    assert len(docs) == 130 and [(-r["score"], r["node"]) for r in got] == want and "Art. 21 Abs. 1 StPO" in n


@pytest.mark.parametrize("rows", [1 << 19, 40])
def test_funnel_of_documents_of_several_rows(spark, tmp_path, rows, monkeypatch):
    """Documents of up to eight rows; queries that ask for an article with and without its code. Laws meet queries in tiles, not in a join."""
    from citeloom.operators import cells

    for name in ("GATHER_ROWS", "TILE_ROWS", "ASKED_ROWS"):
        monkeypatch.setattr(cells, name, rows)
    rng = random.Random(12)
    lines = [(o % 60, rng.randrange(40) + 400 * rng.randrange(3), rng.randrange(9), rng.randint(1, 3), float(rng.choice([1, 50])), 0.0, "A") for o in range(700)]
    against_sql(spark, tmp_path, "funnel_filters", lineitem=(lines, LINES))
    assert "FlatMapCoGroupsInArrow" in catalog.queries()["funnel_filters"](spark, str(tmp_path))._jdf.queryExecution().toString()

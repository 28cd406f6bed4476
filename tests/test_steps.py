"""Steps over numbered edges against brute force, in several tiles and blocks; funnel cells."""

import random
from collections import Counter

import pytest

from citeloom.operators import channels, evaluate, graph, steps


@pytest.fixture
def small(monkeypatch):
    for name, value in (("EDGE_ROWS", 40), ("SEED_ROWS", 5), ("BLOCKS", 2)):
        monkeypatch.setattr(steps, name, value)


@pytest.fixture(scope="module")
def net():
    rng = random.Random(3)
    edges = {(f"c{rng.randrange(30)}", f"s{min(rng.randrange(25), rng.randrange(25))}") for _ in range(200)}
    seeds = {(rng.randrange(12), f"c{rng.randrange(33)}") for _ in range(40)}  # some are no nodes
    return sorted(edges), sorted(seeds)


def best(scores, k):
    """The first k of {node: score}."""
    return sorted(scores.items(), key=lambda x: (-round(x[1], 6), x[0]))[:k]


def cogroups(df):
    """The pairs of a query and what it reaches meet in tiles, not in a join."""
    return "FlatMapCoGroupsInArrow" in df._jdf.queryExecution().toString()


def near(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    return out


def test_two_hops(spark, small, net):
    edges, seeds = net
    both = edges + [(b, a) for a, b in edges]
    df = graph.two_hops(spark.createDataFrame([*seeds, seeds[0]], "query_id long, node string"), spark.createDataFrame([*both, both[0], (None, "x")], "source string, target string"), 4)
    assert cogroups(df)
    got, want, to = {(r["query_id"], r["rk"]): (r["node"], r["score"]) for r in df.collect()}, {}, near(both)
    for q in {q for q, _ in seeds}:
        own = {n for x, n in seeds if x == q}
        one = set().union(*[to.get(n, set()) for n in own])
        paths = Counter(t for n in one for t in to.get(n, ()) if t not in one | own)
        want |= {(q, i + 1): (n, float(s)) for i, (n, s) in enumerate(best(paths, 4))}
    assert got == want


def test_related_cases(spark, small, net):
    edges, seeds = net
    df = graph.related_cases(spark.createDataFrame([(c,) for _, c in seeds], "case string"), spark.createDataFrame(edges, "source string, target string"), 3)
    assert cogroups(df)
    to, want = near(edges), {}
    for c in {c for _, c in seeds if c in to}:
        shared = {o: len(to[c] & to[o]) for o in to if o != c and to[c] & to[o]}
        want |= {(c, i + 1): (o, n) for i, (o, n) in enumerate(best(shared, 3))}
    assert {(r["case"], r["rk"]): (r["other"], r["n"]) for r in df.collect()} == want


def test_co_occurring(spark, small, net):
    from math import log1p

    edges, _ = net
    rng = random.Random(5)
    asked, au = sorted({(q, f"s{rng.randrange(25)}") for q in range(9) for _ in range(3)}), {f"s{i}": i / 7 for i in range(0, 25, 2)}
    df = graph.co_occurring(spark.createDataFrame(asked, "query_id long, node string"), spark.createDataFrame(edges, "source string, target string"), spark.createDataFrame(list(au.items()), "node string, authority double"), 4, 5)
    assert cogroups(df)
    want = {}
    for q in range(9):
        own = {n for x, n in asked if x == q}
        docs = sorted({a for a, b in edges if b in own})[:4]
        n = Counter(b for a, b in edges if a in docs and b not in own)
        want |= {(q, i + 1): (x, round(s, 6)) for i, (x, s) in enumerate(best({b: au.get(b, 0) + log1p(c) / 10 for b, c in n.items()}, 5))}
    assert {(r["query_id"], r["rk"]): (r["node"], round(r["score"], 6)) for r in df.collect()} == want


def test_reference_expansion(spark, small, net):
    edges, seeds = net
    kids = [("s0", "s0 a"), ("s0", "s1"), ("s3", "s3 a"), ("s99", "s99 a")]
    df = graph.reference_expansion(spark.createDataFrame(seeds, "query_id long, node string"), spark.createDataFrame(edges, "source string, target string"), spark.createDataFrame(kids, "article string, child string"))
    assert cogroups(df)
    to = near(edges)
    said = {(q, t) for q, n in seeds for t in to.get(n, ())}
    assert sorted(tuple(r) for r in df.collect()) == sorted(said | {(q, c) for q, n in said for a, c in kids if a == n})


def test_linked_gold(spark, small, net):
    edges, seeds = net
    gold = seeds + [(q, b) for (q, _), (_, b) in zip(seeds, edges, strict=False)]
    df = evaluate.linked_gold(spark.createDataFrame(gold, "query_id long, citation string"), spark.createDataFrame(edges, "source string, target string"))
    assert cogroups(df)
    want = {(q, a, b) for a, b in edges for q in range(12) if (q, a) in gold and (q, b) in gold}
    assert want and sorted(tuple(r) for r in df.collect()) == sorted(want)


def test_counts_by_bits(spark, small, net, monkeypatch):
    """Both ways of counting agree."""
    edges, seeds = net
    both = edges + [(b, a) for a, b in edges]
    run = lambda: sorted(tuple(r) for r in graph.two_hops(spark.createDataFrame(seeds, "query_id long, node string"), spark.createDataFrame(both, "source string, target string"), 9).collect())
    one = run()
    monkeypatch.setattr(steps, "BITS", 0)
    assert run() == one


def test_no_edges(spark):
    none = spark.createDataFrame([], "source string, target string")
    assert graph.two_hops(spark.createDataFrame([(1, "a")], "query_id long, node string"), none, 3).count() == 0


def test_funnel_cells(spark):
    """10,000 like documents are one cell, and a document of several rows one of its own."""
    rows = spark.range(10_000).selectExpr("id AS doc_id", "'StPO' AS law_code", "'I' AS division", "CAST(NULL AS STRING) AS prefix")
    rows = rows.union(spark.createDataFrame([(3, "OR", "II", None), (20_000, None, None, None), (20_001, "OR", None, None)], "doc_id long, law_code string, division string, prefix string"))
    own, sizes = channels.cells(rows, ["law_code", "division"], channels.repeated(rows))
    assert own.count() == 5 and sizes.count() == 4
    plan = spark.createDataFrame([(1, "OR"), (2, "StPO"), (2, "OR")], "query_id long, law_code string")
    in_cells = channels.of_codes(plan, own).join(sizes, "doc_id").groupBy("query_id").sum("n", "ids")
    assert sorted(map(tuple, in_cells.collect())) == sorted(map(tuple, channels.of_codes(plan, rows).groupBy("query_id").agg({"doc_id": "count", "*": "count"}).select("query_id", "count(1)").join(channels.of_codes(plan, rows).groupBy("query_id").sum("doc_id"), "query_id").collect()))

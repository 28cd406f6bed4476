"""One and two steps over edges for many queries, without a row for each path.

Where nodes are few and edges many, what a query reaches in one step is nearly every node, and joins make queries times nodes rows
and a multiple of them for a second step. Here nodes are numbered in the order of their names, the edges become lists of numbers,
dealt into tiles by their targets, and queries are dealt into blocks; each tile and block is worked in one task with arrays. What
a step reaches travels as one packed set a query and tile. Only the best rows of a query leave a second step.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import settled

#: Edges of a tile, seeds of a block, least blocks, names that may be broadcast, bytes of a table of bits, rows sent at once.
EDGE_ROWS, SEED_ROWS, BLOCKS, NAMES, BITS, ROWS = 1 << 23, 1 << 20, 12, 400_000, 64 << 20, 1 << 16


class Graph:
    """Nodes with their numbers (node, no); `side` is fit for joins on either."""

    def __init__(self, *names: DataFrame):
        out = names[0].toDF("node")
        for n in names[1:]:
            out = out.union(n.toDF("node"))
        placed = settled(out.where("node IS NOT NULL").distinct().orderBy("node").withColumn("place", F.monotonically_increasing_id()), "places")
        part = F.shiftright("place", 33)
        sizes = sorted((r["p"], r["n"]) for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())  # a row a partition
        starts, self.n = [], 0
        for p, n in sizes:
            starts.append((p, self.n))
            self.n += n
        start = placed.sparkSession.createDataFrame(starts, "p long, start long")
        kind = "int" if self.n < 1 << 31 else "long"
        no = (F.col("start") + F.col("place") - F.shiftleft(F.col("p"), 33)).cast(kind)
        self.nodes = settled(placed.withColumn("p", part).join(F.broadcast(start), "p").select("node", no.alias("no")), "nodes")
        self.side = F.broadcast(self.nodes) if self.n <= NAMES else self.nodes

    def code(self, df: DataFrame, **columns: str) -> DataFrame:
        """df with the numbers of the named columns' nodes under new names; rows with an unknown node go."""
        for new, old in columns.items():
            df = df.join(self.side.select(F.col("node").alias(old), F.col("no").alias(new)), old)
        return df

    def name(self, df: DataFrame, **columns: str) -> DataFrame:
        for new, old in columns.items():
            df = df.join(self.side.select(F.col("no").alias(old), F.col("node").alias(new)), old)
        return df


def numbered(edges: DataFrame, *more: DataFrame) -> tuple[Graph, DataFrame]:
    """The nodes of edges (source, target) and of more, and the edges (a, b) by numbers."""
    e = settled(edges.select("source", "target"), "edges")
    g = Graph(e.select("source"), e.select("target"), *more)
    return g, settled(g.code(e, a="source", b="target").select("a", "b"), "coded")


def lists(edges: DataFrame, values: DataFrame | None = None) -> tuple[DataFrame, int]:
    """t, a, to: the different targets of each source in a tile, and the number of tiles. edges: a, b, numbers. Of values (b, value)
    each tile gets those of its targets, 0 where there is none, as the list of source -1."""
    e = settled(edges.select("a", "b").distinct(), "numbers")
    tiles = max(1, -(-e.count() // EDGE_ROWS))
    t = F.pmod(F.xxhash64("b"), F.lit(tiles)).cast("int").alias("t")
    dealt = e.groupBy(t, "a").agg(F.sort_array(F.collect_list("b")).alias("to"))
    if values is not None:
        each = e.select("b").distinct().join(values, "b", "left").select(t, F.struct("b", F.coalesce("value", F.lit(0.0)).alias("value")).alias("v"))
        each = each.groupBy("t").agg(F.sort_array(F.collect_list("v")).alias("v"))
        kind = dict(e.dtypes)["a"]
        dealt = dealt.withColumn("value", F.lit(None).cast("array<double>")).union(each.select("t", F.lit(-1).cast(kind), F.col("v.b"), F.col("v.value")))
    return settled(dealt, "lists"), tiles


def _blocks(n: int) -> int:
    return max(BLOCKS, -(-n // SEED_ROWS))


def _dealt(queries: DataFrame, index: DataFrame, tiles: int, blocks: int):
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.withColumn("u", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("t", every(tiles))
    return index.withColumn("u", every(blocks)).groupBy("t", "u").cogroup(q.groupBy("t", "u"))


def _column(t: pa.Table, name: str):
    c = t[name].combine_chunks()
    return c if isinstance(c, pa.Array) else c.chunk(0)


class _Lists:
    """The lists of a tile: sources, and their targets as codes of `names`."""

    def __init__(self, t: pa.Table, most: int | None = None):
        self.keys = _column(t, "a").to_numpy().astype(np.int64)
        to = _column(t, "to")
        at, flat = to.offsets.to_numpy().astype(np.int64), to.values.to_numpy()
        self.names, code = np.unique(flat, return_inverse=True)
        self.code, by = code.astype(np.int32), np.argsort(self.keys)
        self.keys, self.lo, self.hi = self.keys[by], at[:-1][by], at[1:][by]
        if len(self.keys) and self.keys[0] == -1:  # it lists all targets
            self.value = _column(t, "value")[int(by[0])].values.to_numpy()
            self.keys, self.lo, self.hi = self.keys[1:], self.lo[1:], self.hi[1:]
        if most is not None:  # lists ascend
            self.hi = np.minimum(self.hi, self.lo + most)
        self._bits = None

    def of(self, nodes: np.ndarray) -> np.ndarray:
        """Which lists are those of the nodes."""
        at = np.minimum(np.searchsorted(self.keys, nodes), len(self.keys) - 1)
        return at[self.keys[at] == nodes]

    def reached(self, nodes: np.ndarray) -> np.ndarray:
        """The codes that the nodes' lists hold, each once, ascending."""
        at = self.of(nodes)
        if not len(at):
            return np.zeros(0, np.int64)
        got = np.concatenate([self.code[self.lo[x] : self.hi[x]] for x in at])
        if 8 * len(got) < len(self.names):
            return np.unique(got)
        mark = np.zeros(len(self.names), bool)
        mark[got] = True
        return np.flatnonzero(mark)

    def counts(self, nodes: np.ndarray) -> np.ndarray:
        """For each code the number of the nodes' lists that hold it."""
        at = self.of(nodes)
        width = -(-len(self.keys) // 64)
        if 8 * width * len(self.names) <= BITS and (self.hi - self.lo)[at].sum() > width * len(self.names):
            if self._bits is None:
                self._bits = np.zeros((len(self.names), width), np.uint64)
                for x in range(len(self.keys)):
                    self._bits[self.code[self.lo[x] : self.hi[x]], x >> 6] |= np.uint64(1 << (x & 63))
            mine = np.zeros(width, np.uint64)
            np.bitwise_or.at(mine, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
            return np.bitwise_count(self._bits & mine).sum(axis=1, dtype=np.int64)
        got = np.concatenate([np.zeros(0, np.int32), *[self.code[self.lo[x] : self.hi[x]] for x in at]])
        return np.bincount(got, minlength=len(self.names))


def _pack(ascending: np.ndarray) -> bytes:
    return zlib.compress(np.diff(ascending, prepend=0).astype(np.int64).tobytes(), 1)


def _unpack(packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(packed), np.int64))


def _schema(df: DataFrame, rest: str) -> tuple[str, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema

    text = f"query_id {dict(df.dtypes)['query_id']}, {rest}"
    return text, to_arrow_schema(df.sparkSession.createDataFrame([], text).schema)


def _made(schema: pa.Schema, *columns) -> pa.Table:
    return pa.Table.from_arrays([(c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type)).cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def seeded(seeds: DataFrame) -> tuple[DataFrame, int]:
    """query_id, own: the numbers that a query starts from, and how many there are in all. seeds: query_id, no."""
    s = settled(seeds.where("query_id IS NOT NULL").groupBy("query_id").agg(F.sort_array(F.collect_set("no")).alias("own")), "seeds")
    return s, s.agg(F.coalesce(F.sum(F.size("own")), F.lit(0))).first()[0]


def reach(own: DataFrame, size: int, index: tuple[DataFrame, int], most: int | None = None) -> DataFrame:
    """query_id, got: the numbers one step from a query's seeds, packed, in one row a tile of targets; of each list only the `most` least."""
    text, schema = _schema(own, "got binary")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        tile, ids, sets = _Lists(left, most), [], []
        for i, nodes in enumerate(_column(right, "own")):
            got = tile.reached(nodes.values.to_numpy())
            if len(got):
                ids.append(i)
                sets.append(_pack(tile.names[got][:most]))
        return _made(schema, right["query_id"].take(pa.array(ids, pa.int64())), sets)

    return _dealt(own, *index, _blocks(size)).applyInArrow(run, text)


def unpacked(sets: DataFrame) -> DataFrame:
    """query_id, no of the packed sets."""
    text, schema = _schema(sets, "no long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, packed in enumerate(batch.column("got")):
                got = _unpack(packed.as_py())
                for lo in range(0, len(got), ROWS):
                    part = got[lo : lo + ROWS]
                    yield from _made(schema, batch.column("query_id").take(pa.array(np.full(len(part), i))), part).to_batches()

    return sets.select("query_id", "got").mapInArrow(run, text)


def second(
    sets: DataFrame, own: DataFrame, size: int, index: tuple[DataFrame, int], k: int, least: int | None = None, score: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, without_sets: bool = False
) -> DataFrame:
    """query_id, no, n, score: of each tile of targets a query's best k by the number n of lists of its set that hold them, ties to
    the lesser number; not the query's seeds, nor its set if `without_sets`. Of a set the `least` least. score: of n and the
    targets' values, if not n."""
    sets = settled(sets.groupBy("query_id").agg(F.collect_list("got").alias("got")).join(own, "query_id"), "sets")
    text, schema = _schema(own, "no long, n long, score double")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        tile, ids, cols = _Lists(left), [], ([], [], [])
        for i, (packed, seeds) in enumerate(zip(_column(right, "got"), _column(right, "own"), strict=True)):
            nodes = np.sort(np.concatenate([_unpack(x) for x in packed.as_py()]))[:least]
            n = tile.counts(nodes)
            out = np.concatenate([seeds.values.to_numpy(), nodes]) if without_sets else seeds.values.to_numpy()
            at = np.minimum(np.searchsorted(tile.names, out), len(tile.names) - 1)
            n[at[tile.names[at] == out]] = 0
            d = np.flatnonzero(n)
            s = score(n[d], tile.value[d]) if score else n[d].astype(float)
            if len(d) > k:
                r = np.round(s, 6)
                edge = np.partition(r, len(r) - k)[len(r) - k]
                over, level = np.flatnonzero(r > edge), np.flatnonzero(r == edge)
                pick = np.concatenate([over, level[: k - len(over)]])
                d, s = d[pick], s[pick]
            ids.append(np.full(len(d), i))
            for c, v in zip(cols, (tile.names[d], n[d], s), strict=True):
                c.append(v)
        return _made(schema, right["query_id"].take(pa.array(np.concatenate(ids))), *map(np.concatenate, cols))

    return _dealt(sets, *index, _blocks(size)).applyInArrow(run, text)


def within(own: DataFrame, size: int, index: tuple[DataFrame, int]) -> DataFrame:
    """query_id, a, b: edges both of whose ends a query starts from."""
    text, schema = _schema(own, "a long, b long")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        tile, ids, a, b = _Lists(left), [], [], []
        mark = np.zeros(len(tile.names), bool)
        for i, nodes in enumerate(_column(right, "own")):
            nodes = nodes.values.to_numpy()
            at = np.minimum(np.searchsorted(tile.names, nodes), len(tile.names) - 1)
            mine = at[tile.names[at] == nodes]
            mark[mine] = True
            for x in tile.of(nodes):
                to = tile.code[tile.lo[x] : tile.hi[x]]
                to = to[mark[to]]
                ids.append(np.full(len(to), i))
                a.append(np.full(len(to), tile.keys[x]))
                b.append(tile.names[to])
            mark[mine] = False
        if not ids:
            return schema.empty_table()
        return _made(schema, right["query_id"].take(pa.array(np.concatenate(ids))), np.concatenate(a), np.concatenate(b))

    return _dealt(own, *index, _blocks(size)).applyInArrow(run, text)

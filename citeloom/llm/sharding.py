"""Sharding: minimax contiguous partition of ordered atomic groups.

Equal texts form one atomic group; groups are ordered by the 64-bit hash of their text. The smallest capacity with which
greedy filling needs at most `shards` shards is found by binary search, and the order is cut there. Group sizes never
meet in one place: a histogram over leading hash bits is refined only where a cut can fall, until the answer is exact.
Among the partitions within that capacity the cuts lie nearest to equal shares of what is left.

Null texts count as empty ones. An empty table gives no rows. Two texts of equal hash would share a shard, which keeps
every law stated here.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gapless_rank, materialize

_SIGN = -(1 << 63)
#: Leading bits per refinement step; a step returns at most 2**BITS counts for each segment that a cut may touch.
BITS = 14


class Segments:
    """Ordered runs of hash space: [lo, hi] as unsigned ints, bytes, and whether it holds one group."""

    def __init__(self, items: list[tuple[int, int, int, bool]]):
        self.items = items
        self.ends = list(_running(x[2] for x in items))
        self.total = self.ends[-1] if items else 0

    def _reach(self, pos: int, cap: int, split: bool) -> int:
        """The farthest position that a shard from `pos` with capacity `cap` reaches."""
        want = pos + cap
        if want >= self.total:
            return self.total
        i = bisect_right(self.ends, want)
        below = self.ends[i - 1] if i else 0
        return want if split and not self.items[i][3] else below

    def fill(self, cap: int, split: bool, most: int, pos: int = 0) -> list[int] | None:
        """Greedy ends with capacity `cap`; None if more than `most` shards are needed."""
        out = []
        while pos < self.total:
            end = self._reach(pos, cap, split)
            if end <= pos or len(out) == most:
                return None
            out.append(end)
            pos = end
        return out

    def least(self, most: int, split: bool) -> int:
        lo, hi = max(1, -(-self.total // most)), max(1, self.total)
        while lo < hi:
            mid = (lo + hi) // 2
            if self.fill(mid, split, most) is None:
                lo = mid + 1
            else:
                hi = mid
        return lo


def _running(xs):
    total = 0
    for x in xs:
        total += x
        yield total


def _segments(slim: DataFrame, prefix: list[tuple[int, int]] | None, bits: int) -> list[tuple[int, int, int, bool]]:
    """Sums by the next `bits` leading bits; `prefix`: (depth, value) of the segments to refine, or all."""
    u = F.col("_h").bitwiseXOR(F.lit(_SIGN))
    if prefix is None:
        cells = slim.withColumn("_d", F.lit(0)).withColumn("_c", F.shiftrightunsigned("_h", 64 - bits))
    else:
        by_depth: dict[int, list[int]] = {}
        for d, v in prefix:
            by_depth.setdefault(d, []).append(v)
        parts = []
        for d, vs in by_depth.items():
            nxt = min(64, d + bits)
            inside = F.shiftrightunsigned("_h", 64 - d).isin(vs)
            cell = F.shiftrightunsigned("_h", 64 - nxt) if nxt < 64 else F.col("_h")
            parts.append(slim.where(inside).withColumn("_d", F.lit(d)).withColumn("_c", cell))
        cells = reduce(DataFrame.unionByName, parts)
    rows = cells.groupBy("_d", "_c").agg(F.min(u).alias("a"), F.max(u).alias("b"), F.sum("size").alias("s")).collect()
    return sorted((r["a"] - _SIGN, r["b"] - _SIGN, r["s"], r["a"] == r["b"]) for r in rows)


def cut_points(slim: DataFrame, shards: int, bits: int = BITS) -> list[int]:
    """The last hash (unsigned) of each shard. slim: _h, size."""
    items, depth = _segments(slim, None, bits), {}
    if not items:
        return []
    for x in items:
        depth[x[:2]] = bits
    while True:
        segs = Segments(items)
        low, high = segs.least(shards, True), segs.least(shards, False)
        if low == high:
            break
        starts = [0, *segs.ends[:-1]]
        touched = set()
        near, far = 0, 0
        for _ in range(shards):  # where the j-th cut can fall with any capacity between the bounds
            near = segs._reach(near, low, False) if near < segs.total else near
            far = segs._reach(far, high, True) if far < segs.total else far
            i = bisect_right(segs.ends, near)
            while i < len(items) and starts[i] <= far:
                if not items[i][3]:
                    touched.add(i)
                i += 1
        if not touched:
            break
        step = max(1, min(bits, ((1 << 20) // len(touched)).bit_length() - 1))
        finer = []
        for d in {depth[items[i][:2]] for i in touched}:
            keys = [(d, _signed(items[i][0] >> (64 - d))) for i in touched if depth[items[i][:2]] == d]
            got = _segments(slim, keys, step)
            for x in got:
                depth[x[:2]] = min(64, d + step)
            finer += got
        items = sorted([x for i, x in enumerate(items) if i not in touched] + finer)
    ends, cuts, pos = segs.ends, [], 0
    for j in range(shards - 1):
        left = shards - j
        if pos >= segs.total:
            break
        want = pos + (segs.total - pos) / left
        first, last = bisect_right(ends, pos), bisect_right(ends, pos + high) - 1
        lo, hi = first, last
        while lo < hi:  # the first end from which the other shards suffice
            mid = (lo + hi) // 2
            if segs.fill(high, False, left - 1, ends[mid]) is None:
                lo = mid + 1
            else:
                hi = mid
        near = min(max(bisect_right(ends, want) - 1, lo), last)
        if near < last and abs(ends[near + 1] - want) < abs(ends[near] - want):
            near += 1
        pos = ends[near]
        cuts.append(items[near][1])
    return cuts


def _signed(v: int) -> int:
    return v - (1 << 64) if v >= 1 << 63 else v


def shard_by_bytes(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: shards of nearly equal bytes; equal texts stay together."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = materialize(
        docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("_h")),
        "shard",
    )
    cuts = cut_points(slim, shards)
    rows = slim.count()
    ordered = F.col("_h").bitwiseXOR(F.lit(_SIGN))
    shard = reduce(lambda a, c: a + (ordered > F.lit(_signed((c ^ (1 << 63)) & ((1 << 64) - 1)))).cast("int"), cuts, F.lit(0))
    placed = slim.withColumn("shard", shard)
    out = gapless_rank(placed, ["shard"], [F.col("_h"), F.col("doc_id")], [F.col("_h"), F.col("doc_id")], rows, "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

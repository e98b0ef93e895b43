"""Connected components, and exact verification of candidate clusters in bounded blocks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, table


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for the nodes of edges (a, b: long); comp is the smallest node reachable.

    Alternates large-star and small-star steps until the edges no longer change. Each step is two
    aggregations and a join on node ids; stars of any size are pre-aggregated before the shuffle, and
    every round is written to the shared folder. Self-loops keep single nodes; no edges give no rows.
    """
    now = table(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    mark = None
    while True:
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("m").alias("a"), "b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.col("m").alias("x"), "a", "b")
        small = small.select(F.explode(F.array(F.struct(F.col("x").alias("a"), F.col("b")), F.struct(F.col("x").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b")
        loops = now.filter("a = b")
        after = table(small.unionByName(loops).distinct())
        got = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        drop_table(now)
        now = after
        if got == mark:
            break
        mark = got
    return now.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("comp"))


def candidate_clusters(bands: DataFrame, block: int) -> DataFrame:
    """(node, cluster, k) of every node that shares a band with another; bands: (band: long, node: long).

    k: number of blocks into which its cluster is split, so that a block holds about `block` nodes.
    """
    shared = bands.groupBy("band").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi")
    edges = bands.join(shared.select("band", "lo"), "band").filter("node <> lo").select(F.col("lo").alias("a"), F.col("node").alias("b"))
    found = table(components(edges))
    sizes = found.groupBy("comp").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("k"))
    return found.join(sizes, "comp").select("node", F.col("comp").alias("cluster"), "k")


def block_pairs(members: DataFrame) -> DataFrame:
    """Deal the members of clusters (cluster, k, node, ...) to pairs of blocks (bi <= bj); side tells its block."""
    own = F.pmod(F.xxhash64("node"), F.col("k")).cast("int")
    dealt = members.withColumn("side", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    return dealt.withColumn("bi", F.least("side", "other")).withColumn("bj", F.greatest("side", "other")).drop("other", "k")


class Forest:
    """Union-find over 0..n-1; the smallest index is the root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def set_overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, tile: int = 4096) -> np.ndarray:
    """Sizes of the intersections of sets of distinct hashes, rows left against rows right, by tiles of a 0/1 matrix."""
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, ids, count = np.unique(flat, return_inverse=True, return_counts=True)
    many = count[ids] > 1
    _, ids = np.unique(ids[many], return_inverse=True)
    owner = owner[many]
    out = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(ids, kind="stable")
    ids, owner = ids[order], owner[order]
    width = int(ids[-1]) + 1 if len(ids) else 0
    for lo in range(0, width, tile):
        a, b = np.searchsorted(ids, [lo, lo + tile])
        m = np.zeros((len(sets), min(tile, width - lo)), np.float32)
        m[owner[a:b], ids[a:b] - lo] = 1
        out += m[left] @ m[right].T
    return out

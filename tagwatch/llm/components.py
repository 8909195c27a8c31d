"""Connected components of a link table, distributed.

Links are first contracted to stars within each task by union-find.  If fewer
than CHUNK are left, one task contracts them all.  Else alternating large-star
and small-star steps (Kiveris et al. 2014) run until nothing changes: every step
is a minimum by node and a join, and is written to the shared folder, so lineage
stays short and no task ever holds more than CHUNK links.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagwatch.llm.scratch import cut, drop, map_arrow

#: Links contracted together in a task, at most.
CHUNK = 200_000


class Forest:
    """Union-find whose roots are the least members."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != top:
            parent[x], x = top, up
        return top

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        a, b = min(a, b), max(a, b)
        self.parent[b] = a
        self.parent.setdefault(a, a)
        return True

    def links(self) -> tuple[list[int], list[int]]:
        members = [x for x in self.parent if self.root(x) != x]
        return members, [self.root(x) for x in members]


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest, n = Forest(), 0

    def out(forest: Forest) -> pa.RecordBatch:
        high, low = forest.links()
        return pa.RecordBatch.from_arrays([pa.array(high, pa.int64()), pa.array(low, pa.int64())], names=["a", "b"])

    for batch in batches:
        for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            forest.join(a, b)
        n += batch.num_rows
        if n >= CHUNK:
            yield out(forest)
            forest, n = Forest(), 0
    yield out(forest)


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b"), F.col("a")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """links: (a, b) longs, in either order.  Returns (node, component) for every linked node, component the least of its nodes."""
    plain = links.where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long"))
    links = cut(map_arrow(plain, _stars, "a long, b long"), "links")
    mark = None
    while True:
        now = links.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if now == mark or now["n"] == 0:
            break
        mark = now
        if now["n"] < CHUNK:  # bounded: one task holds what remains
            new = cut(map_arrow(links.coalesce(1), _stars, "a long, b long"), "links")
            drop(links)
            links = new
            break
        star = cut(_large_star(links), "links")
        new = cut(_small_star(star), "links")
        drop(star)
        drop(links)
        links = new
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select("b", "b")).distinct()

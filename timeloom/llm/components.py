"""Connected components of a graph of links: union-find inside tasks, star contraction between them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeloom.llm.common import stage

#: Links that one union-find holds before it gives out its forest and begins anew.
FOREST_LINKS = 500_000


class UnionFind:
    """Sets of numbers; a set's root is its least member."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != top:
            parent[x] = top
            x = up
        return top

    def unite(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.parent[max(x, y)] = min(x, y)
        return True

    def forest(self) -> tuple[list[int], list[int]]:
        """Each member that is no root, and its root."""
        members = [x for x in self.parent if self.root(x) != x]
        return members, [self.root(x) for x in members]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sets, links = UnionFind(), 0

    def out() -> pa.RecordBatch:
        members, roots = sets.forest()
        return pa.RecordBatch.from_arrays([pa.array(members, pa.int64()), pa.array(roots, pa.int64())], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            sets.unite(a, b)
        links += batch.num_rows
        if links >= FOREST_LINKS:
            yield out()
            sets, links = UnionFind(), 0
    yield out()


def components(links: DataFrame) -> DataFrame:
    """node and component (the least node reachable) for every node that is not its own component.

    ``links`` has two non-null numbers per row, ``a`` and ``b``; direction, repeats and loops
    do not matter. Tasks first reduce their links to forests. Then each round hangs a node's
    larger neighbours, and itself, on its least neighbour, until every tree is a star. No
    node's neighbours are ever gathered: a round is a minimum per node and a join.
    """
    edges = stage(links.select("a", "b").mapInArrow(_forests, "a long, b long").distinct(), "forests")
    before = None
    while True:
        seen = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        if seen == before or not seen[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = seen
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = (
            both.join(least, "a")
            .filter("b > a")
            .select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
            .distinct()
        )
        large = stage(large, "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stage(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "small-star")
